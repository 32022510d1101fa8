"""Product-research analytics over stored marketplace pages, on Spark."""
