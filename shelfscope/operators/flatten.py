"""Nested columns to flat export columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions import text as X

BULLETS_SHOWN = 5
SUB_RANKS_SHOWN = 3


def _sub_ranks(value: Column) -> list[Column]:
    out = [F.size(value).alias("sub_category_count")]
    for n in range(1, SUB_RANKS_SHOWN + 1):
        entry = F.get(value, F.lit(n - 1))
        out += [entry.rank.alias(f"sub_rank_{n}"), entry.category.alias(f"sub_category_{n}")]
    return out


def _stars(value: Column) -> list[Column]:
    return [F.try_element_at(value, F.lit(f"{n}_star")).alias(f"rating_{n}_star") for n in (5, 4, 3, 2, 1)]


def flatten(df: DataFrame) -> DataFrame:
    out: list[Column] = []
    for field in df.schema.fields:
        value, nested = F.col(field.name), isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        if not nested:
            out.append(value)
        elif field.name == "bullet_points":
            out.append(F.array_join(F.slice(value, 1, BULLETS_SHOWN), " | ").alias(field.name))
        elif field.name == "images":
            out.append(F.size(value).alias("image_count"))
            out.append(F.coalesce(F.get(value, F.lit(0)), F.lit("")).alias("main_image"))
        elif field.name == "variants":
            out.append(F.size(value).alias("variant_count"))
        elif field.name == "sub_category_ranks":
            out += _sub_ranks(value)
        elif field.name == "rating_distribution":
            out += _stars(value)
        else:
            out.append(X.encode_json(value).alias(field.name))
    return df.select(*out)


def with_json_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, all others unchanged."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            X.encode_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
