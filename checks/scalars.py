"""Column functions over whole tables. Inputs take several written forms by key; oracles state the expected value
of each form, or use DuckDB's own functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import base
from shelfscope.functions import numbers as N
from shelfscope.functions import text as X
from shelfscope.operators.extract_search import valid_brand
from shelfscope.operators.flatten import flatten
from shelfscope.sources.tables import migrate

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _forms(spark, sf, table: str, key: str, forms: list[str], keep: list[str] = ()):
    """``table`` with a ``form`` text: the one of ``forms`` (SQL expressions) that the key picks."""
    cases = " ".join(f"WHEN {n} THEN {form}" for n, form in enumerate(forms))
    return base(spark, sf, table).select(
        key, *keep, F.expr(f"CASE {key} % {len(forms)} {cases} END").alias("form")
    )


def _cases(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"


@query("brand_cleaning", """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 THEN replace(p_brand, 'Brand', '') ELSE p_brand END AS brand FROM part""")
def brand_cleaning(spark, sf):
    """A name that itself begins with "Brand" loses it, unless another lead or a blank stands before it."""
    forms = [
        "concat('Visit the ', p_brand, ' Store')", "concat('Brand: ', p_brand)", "concat('brand ', p_brand)",
        "concat(p_brand, '  store')", "concat('\t', p_brand, ' ')", "concat('VISIT THE', p_brand, 'STORE')",
    ]
    return _forms(spark, sf, "part", "p_partkey", forms).select("p_partkey", X.clean_brand(F.col("form")).alias("brand"))


_VALID = [
    "p_name", "concat(p_name, ' deal')", "concat('$', p_name)", "concat(p_name, ' 9.99')", "repeat('x', 61)", "''",
    "concat(p_name, ' €5')", "upper(p_name)", "concat('Amazon''s Choice ', p_name)", "repeat('y', 60)",
]


@query("brand_text_validity", f"""
SELECT p_partkey, {_cases("p_partkey", ["1 - CAST(contains(p_name, 'ad') AS INT)", "0", "0", "0", "0", "0", "0", "1 - CAST(contains(p_name, 'ad') AS INT)", "0", "1"])} AS is_valid FROM part""")
def brand_text_validity(spark, sf):
    got = _forms(spark, sf, "part", "p_partkey", _VALID)
    return got.select("p_partkey", valid_brand(F.col("form")).cast("int").alias("is_valid"))


@query("price_text_value", f"""
SELECT o_orderkey, CAST({_cases("o_orderkey", ["o_orderkey + 0.99", "o_orderkey + 0.5", "0", "0", "0", "0.5", "100", "o_orderkey", "o_orderkey + 0.25", "1000 + o_orderkey % 1000", "-o_orderkey"])} AS DOUBLE) AS price_value
FROM orders""")
def price_text_value(spark, sf):
    forms = [
        "concat('$', cast(o_orderkey AS string), '.99')", "concat(cast(o_orderkey AS string), '.5 - 99.99')",
        "concat('€', cast(o_orderkey AS string))", "''", "'abc'", "'.5'", "'1e2x'", "concat('  ', cast(o_orderkey AS string))",
        "concat(cast(o_orderkey AS string), '.25USD')", "concat('$1,', lpad(cast(o_orderkey % 1000 AS string), 3, '0'))",
        "concat('-', cast(o_orderkey AS string), 'e')",
    ]
    got = _forms(spark, sf, "orders", "o_orderkey", forms)
    return got.select("o_orderkey", N.price_value(F.col("form")).alias("price_value"))


@query("comma_integer", f"""
SELECT o_orderkey, CAST({_cases("o_orderkey", ["1000000 + o_orderkey % 1000", "o_orderkey", "NULL", "NULL"])} AS BIGINT) AS ratings FROM orders""")
def comma_integer(spark, sf):
    forms = [
        "concat('1,000,', lpad(cast(o_orderkey % 1000 AS string), 3, '0'), ' ratings')",
        "concat('about ', cast(o_orderkey AS string), ' ratings, 5 stars')", "'no ratings'", "', none'",
    ]
    return _forms(spark, sf, "orders", "o_orderkey", forms).select(
        "o_orderkey", N.first_comma_integer(F.col("form")).alias("ratings")
    )


_BOUGHT = [
    "concat(cast(o_orderkey % 90 AS string), 'K+ bought in past month')", "concat(cast(o_orderkey % 9 AS string), '.5M+ bought')",
    "concat('1,', lpad(cast(o_orderkey % 1000 AS string), 3, '0'), '+ bought')", "concat(cast(o_orderkey % 50 AS string), ' more bought')",
    "'bought'", "concat(cast(o_orderkey AS string), ' k bought')",
]


@query("bought_number", f"""
SELECT o_orderkey, CAST({_cases("o_orderkey", ["o_orderkey % 90 * 1000", "o_orderkey % 9 * 1000000 + 500000", "1", "o_orderkey % 50 * 1000000", "0", "o_orderkey * 1000"])} AS BIGINT) AS plain,
 CAST({_cases("o_orderkey", ["o_orderkey % 90 * 1000", "o_orderkey % 9 * 1000000 + 500000", "1000 + o_orderkey % 1000", "o_orderkey % 50", "0", "o_orderkey * 1000"])} AS BIGINT) AS strict
FROM orders""")
def bought_number(spark, sf):
    got, form = _forms(spark, sf, "orders", "o_orderkey", _BOUGHT), F.col("form")
    return got.select("o_orderkey", N.bought_number(form).alias("plain"), N.bought_number(form, strict=True).alias("strict"))


@query("rating_text", f"""
SELECT l_orderkey, l_linenumber, l_quantity, CAST({_cases("l_orderkey", ["l_quantity", "l_quantity / 10", "NULL", "NULL"])} AS DOUBLE) AS rating,
 CAST({_cases("l_orderkey", ["l_quantity", "floor(l_quantity / 10)", "NULL", "5"])} AS INT) AS stars FROM lineitem""")
def rating_text(spark, sf):
    forms = [
        "concat(cast(cast(l_quantity AS int) AS string), ' out of 5 stars')",
        "concat('rated ', cast(l_quantity / 10 AS decimal(4, 1)), '  out of 5')", "concat('4.5.1 out of ', cast(cast(l_quantity AS int) AS string))",
        "'5 stars'",
    ]
    got = _forms(spark, sf, "lineitem", "l_orderkey", forms, ["l_linenumber", "l_quantity"])
    form = F.col("form")
    return got.select(
        "l_orderkey", "l_linenumber", "l_quantity", N.rating_value(form).alias("rating"), N.star_rating(form).alias("stars")
    )


@query("helpful_votes", f"""
SELECT l_orderkey, l_linenumber, {_cases("l_orderkey", ["l_orderkey", "l_orderkey % 1000", "1", "0", "1"])} AS votes FROM lineitem""")
def helpful_votes(spark, sf):
    forms = [
        "concat(cast(l_orderkey AS string), ' people found this helpful')",
        "concat('1,', lpad(cast(l_orderkey % 1000 AS string), 3, '0'), ' people found this helpful')",
        "'One person found this helpful'", "concat(cast(l_orderkey AS string), ' readers')", "'One person and no more'",
    ]
    got = _forms(spark, sf, "lineitem", "l_orderkey", forms, ["l_linenumber"])
    return got.select("l_orderkey", "l_linenumber", N.helpful_votes(F.col("form")).cast("bigint").alias("votes"))


_LONG = "strftime(l_shipdate, '%B %-d, %Y')"


@query("review_dates", f"""
SELECT l_orderkey, l_linenumber, {_cases("l_orderkey", [_LONG, f"concat('on ', {_LONG})", _LONG])} AS date_text,
 strftime({_cases("l_orderkey", ["l_shipdate", "NULL", "l_shipdate"])}, '%Y-%m-%d') AS typed FROM lineitem""")
def review_dates(spark, sf):
    day = "date_format(l_shipdate, 'MMMM d, yyyy')"
    forms = [f"concat('Reviewed in Canada on ', {day})", f"concat('Reviewed in London on ', {day})", day]
    got = _forms(spark, sf, "lineitem", "l_orderkey", forms, ["l_linenumber"])
    date = X.review_date(F.col("form"))
    typed = F.date_format(X.long_date(date), "yyyy-MM-dd")
    return got.select("l_orderkey", "l_linenumber", date.alias("date_text"), typed.alias("typed"))


@query("first_available_dates", f"""
SELECT l_orderkey, l_linenumber, {_cases("l_orderkey", [_LONG, "strftime(l_shipdate, '%b %-d %Y')", "NULL"])} AS available FROM lineitem""")
def first_available_dates(spark, sf):
    forms = [
        "concat('Date First Available\n : ', date_format(l_shipdate, 'MMMM d, yyyy'), ' ')",
        "concat('Date First Available: ', date_format(l_shipdate, 'MMM d yyyy'))", "'Date First Available: unknown'",
    ]
    got = _forms(spark, sf, "lineitem", "l_orderkey", forms, ["l_linenumber"])
    return got.select("l_orderkey", "l_linenumber", X.available_date(F.col("form")).alias("available"))


@query("keyword_addresses", """
SELECT p_partkey, concat('https://www.amazon.com/s?k=', replace(p_name, ' ', '+'), '&page=', CAST(p_size AS VARCHAR)) AS url, p_name AS keyword FROM part""")
def keyword_addresses(spark, sf):
    url = F.concat(F.lit("https://www.amazon.com/s?k="), X.keyword_to_url(F.col("p_name")), F.lit("&page="), F.col("p_size"))
    got = base(spark, sf, "part").select("p_partkey", url.alias("url"))
    return got.withColumn("keyword", X.keyword_from_url(X.extract(F.col("url"), r"[?&]k=([^&#]*)")))


@query("content_hash", "SELECT doc_id, substr(md5(substr(text, 1, 100)), 1, 12) AS short_id FROM documents")
def content_hash(spark, sf):
    return base(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("short_id"))


@query("truncated_text", "SELECT doc_id, substr(text, 1, 50) AS head, length(substr(text, 1, 2000)) AS kept FROM documents")
def truncated_text(spark, sf):
    text = F.col("text")
    return base(spark, sf, "documents").select(
        "doc_id", X.truncated(text, 50).alias("head"), F.length(X.truncated(text, 2000)).cast("bigint").alias("kept")
    )


@query("mentions_phrase", "SELECT doc_id, CAST(contains(lower(text), 'of the') AS INT) AS found FROM documents")
def mentions_phrase(spark, sf):
    return base(spark, sf, "documents").select("doc_id", X.flag(X.mentions(F.col("text"), "Of The")).alias("found"))


@query("json_round_trip", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_name || '|' || p_brand END AS joined,
 CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 2 END AS items FROM part""")
def json_round_trip(spark, sf):
    text = F.when(F.col("p_partkey") % 4 == 3, F.lit("[broken")).otherwise(X.encode_json(F.array("p_name", "p_brand")))
    got = X.decode_json_array(text, "string")
    return base(spark, sf, "part").select(
        "p_partkey", F.array_join(got, "|").alias("joined"), F.size(got).cast("bigint").alias("items")
    )


@query("json_keys", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 'https://i.example/' || CAST(p_partkey AS VARCHAR) || '.jpg|b' END AS names FROM part""")
def json_keys(spark, sf):
    form = F.expr(
        "CASE WHEN p_partkey % 5 = 4 THEN 'not json' ELSE "
        "concat('{\"https://i.example/', p_partkey, '.jpg\":[500,500],\"b\":[1,2]}') END"
    )
    return base(spark, sf, "part").select("p_partkey", F.array_join(F.json_object_keys(form), "|").alias("names"))


@query("event_props_keys", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_keys(spark, sf):
    return base(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("star_map_lookup", "SELECT p_partkey, p_size AS five, CAST(0 AS INT) AS four FROM part")
def star_map_lookup(spark, sf):
    shares = F.create_map(F.lit("5_star"), F.col("p_size"), F.lit("1_star"), F.lit(1))
    return base(spark, sf, "part").select(
        "p_partkey", X.lookup(shares, "5_star").alias("five"), X.lookup(shares, "4_star").alias("four")
    )


@query("truth_flags", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(o_orderstatus = 'F' AS INT) END AS INT) AS flag FROM orders")
def truth_flags(spark, sf):
    value = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "F")
    return base(spark, sf, "orders").select("o_orderkey", X.flag(value).alias("flag"))


@query("percent_of_total", """
SELECT o_orderpriority, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1) AS filled,
 CAST(NULL AS DOUBLE) AS of_none FROM orders GROUP BY 1""")
def percent_of_total(spark, sf):
    counts = base(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n")
    )
    return counts.select(
        "o_orderpriority",
        N.percent(F.col("f"), F.col("n")).cast("double").alias("filled"),
        N.percent(F.col("f"), F.lit(0)).cast("double").alias("of_none"),
    )


def nested_products(spark, sf):
    """Products with list, map and struct columns."""
    rank = "struct(cast(p_size AS bigint) AS rank, p_type AS category, 'u' AS url)"
    return base(spark, sf, "part").selectExpr(
        "concat('B', lpad(cast(p_partkey AS string), 9, '0')) AS asin", "p_brand AS brand", "p_name AS title",
        "transform(sequence(1, cast(p_partkey % 8 AS int) + 1), n -> concat(p_name, ' ', n)) AS bullet_points",
        "CASE WHEN p_partkey % 3 = 0 THEN cast(array() AS array<string>) ELSE array(concat('i', p_partkey), 'j') END AS images",
        "array(struct(p_name AS asin, '' AS value, true AS available)) AS variants",
        f"slice(array({rank}, {rank}, {rank}, {rank}), 1, cast(p_partkey % 5 AS int)) AS sub_category_ranks",
        "map('5_star', p_size, '1_star', 7) AS rating_distribution", "array(p_size, null) AS other",
    )


@query("flattened_products", """
SELECT concat('B', lpad(cast(p_partkey AS string), 9, '0')) AS asin, p_brand AS brand, p_name AS title,
 list_aggregate(list_transform(range(1, least(p_partkey % 8 + 1, 5) + 1), lambda n: p_name || ' ' || CAST(n AS VARCHAR)), 'string_agg', ' | ') AS bullet_points,
 CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS image_count, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'i' || CAST(p_partkey AS VARCHAR) END AS main_image,
 1 AS variant_count, p_partkey % 5 AS sub_category_count,
 CASE WHEN p_partkey % 5 >= 1 THEN p_size END AS sub_rank_1, CASE WHEN p_partkey % 5 >= 1 THEN p_type END AS sub_category_1,
 CASE WHEN p_partkey % 5 >= 2 THEN p_size END AS sub_rank_2, CASE WHEN p_partkey % 5 >= 2 THEN p_type END AS sub_category_2,
 CASE WHEN p_partkey % 5 >= 3 THEN p_size END AS sub_rank_3, CASE WHEN p_partkey % 5 >= 3 THEN p_type END AS sub_category_3,
 p_size AS rating_5_star, CAST(NULL AS INT) AS rating_4_star, CAST(NULL AS INT) AS rating_3_star, CAST(NULL AS INT) AS rating_2_star, 7 AS rating_1_star,
 '[' || CAST(p_size AS VARCHAR) || ',null]' AS other
FROM part""")
def flattened_products(spark, sf):
    return flatten(nested_products(spark, sf))


@query("migrated_products", """
SELECT concat('B', lpad(cast(p_partkey AS string), 9, '0')) AS asin, p_name AS title, '' AS bought_count, CAST(0 AS BIGINT) AS bought_count_number,
 CAST(NULL AS BIGINT) AS bsr_rank, CAST(0 AS INT) AS is_fba FROM part""")
def migrated_products(spark, sf):
    old = base(spark, sf, "part").selectExpr("concat('B', lpad(cast(p_partkey AS string), 9, '0')) AS asin", "p_name AS title")
    return migrate(migrate(old, "products"), "products").select(
        "asin", "title", "bought_count", "bought_count_number", "bsr_rank", "is_fba"
    )
