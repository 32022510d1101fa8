"""Edge texts and the values they must give."""

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import numbers as N
from shelfscope.functions import text as X
from shelfscope.operators.extract_search import valid_brand
from shelfscope.operators.filters import is_target_brand

TABLE = [
    (N.price_value, ["12.99 - 15.99", "1299.00", "€10", "", "abc", ".5", "1e2x", " 12", "12.99USD", "$1,299.00", "-3"],
     [12.99, 1299.0, 0.0, 0.0, 0.0, 0.5, 100.0, 12.0, 12.99, 1299.0, -3.0]),
    (N.bought_number, ["2K+ bought in past month", "1.5M+ bought", "1,000+ bought", "5 more bought", "bought", None],
     [2000, 1500000, 1, 5000000, 0, 0]),
    (lambda c: N.bought_number(c, strict=True), ["2K+ bought", "1,000+ bought", "5 more bought"], [2000, 1000, 5]),
    (X.clean_brand, ["Visit the Acme Store", "Brand: Acme", "brand Acme", "Acme Store", "Acme", "visit the  Acme  STORE"],
     ["Acme"] * 6),
    (X.review_date, ["Reviewed in Canada on March 5, 2024", "Reviewed in London on March 5, 2024", "5 May", None],
     ["March 5, 2024", "on March 5, 2024", "5 May", None]),
    (N.helpful_votes, ["12 people found", "1,234 people found", "One person found", "", None], [12, 234, 1, 0, 0]),
    (valid_brand, ["Acme", "Adidas", "Prime Cut", "$5", "9.99", "x" * 61, "", None],
     [True, False, False, False, False, False, False, False]),
    (N.rating_value, ["4.5 out of 5", "4.5.1 out of 5", "five", None], [4.5, None, None, None]),
    (N.star_rating, ["4.0 out of 5", "3.9", "...", "none"], [4, 3, None, None]),
    (N.first_comma_integer, ["1,234 ratings", "none", ",", "(56)"], [1234, None, None, 56]),
    (X.available_date, ["Date First Available : March 5, 2024", "May 6 2023", "2024-01-01"], ["March 5, 2024", "May 6 2023", None]),
    (lambda c: X.long_date(c).cast("string"), ["March 5, 2024", "5 May", ""], ["2024-03-05", None, None]),
    (X.strip, ["  a\tb  ", "\x1c x", ""], ["a\tb", "x", ""]),
    (lambda c: X.mentions_any(c, ["a.c", "(x"]), ["abc", "A.C", "f(X)", ""], [False, True, True, False]),
    (lambda c: is_target_brand(c, ["acme"]), ["ACME Pro", "Other", "", None], [True, False, False, False]),
    (lambda c: is_target_brand(c, [" Acme "], "exact"), ["ACME ", "Acme Pro", ""], [True, False, False]),
    (lambda c: is_target_brand(c, [], enabled=False), ["x", "", None], [True, True, True]),
    (lambda c: is_target_brand(c, []), ["x", ""], [False, False]),
]


@pytest.mark.parametrize("case", range(len(TABLE)))
def test_values(spark, case):
    function, inputs, expected = TABLE[case]
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, t string")
    got = [r.v for r in df.select("n", function(F.col("t")).alias("v")).orderBy("n").collect()]
    assert got == expected


def test_json_helpers_keep_nulls_and_survive_bad_text(spark):
    df = spark.sql("select named_struct('a', cast(null as int), 'b', 'é') as s, '[1,2' as bad, '[\"x\"]' as good")
    row = df.select(
        X.encode_json(F.col("s")).alias("s"), X.decode_json_array(F.col("bad"), "int").alias("bad"),
        X.decode_json_array(F.col("good"), "string").alias("good"),
    ).first()
    assert (row.s, row.bad, row.good) == ('{"a":null,"b":"é"}', [], ["x"])
