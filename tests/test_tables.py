"""Keyed tables: conflict rules, snapshots, folding, resets."""

import random

import pytest
from pyspark.sql import functions as F

from shelfscope.sources import files, tables
from shelfscope.sources.tables import KeyedTable, Store

DDL = "asin string, brand string, title string, seq int"


def rows(df):
    return sorted((r.asin, r.brand or "", r.brand is None, r.title) for r in df.collect())


def test_last_row_wins_and_null_keys_never_collide(spark, folder):
    batch = [("x", "p", "1", 1), ("x", None, "2", 2), ("x", None, "3", 3), ("x", "p", "4", 4), ("x", "", "5", 5), ("x", "", "6", 6)]
    table = KeyedTable(spark, folder, "products").create().upsert(spark.createDataFrame(batch, DDL))
    assert rows(table.read()) == sorted([("x", "", True, "2"), ("x", "", True, "3"), ("x", "p", False, "4"), ("x", "", False, "6")])


def test_upserts_equal_a_dictionary(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "MAX_PARTS", 3)
    rng, model, table = random.Random(5), {}, KeyedTable(spark, folder, "products").create()
    for step in range(6):
        batch = [(f"a{rng.randint(0, 9)}", f"b{rng.randint(0, 2)}", f"{step}.{n}", n) for n in range(12)]
        table.upsert(spark.createDataFrame(batch, DDL))
        model.update({(a, b): t for a, b, t, _ in batch})
    assert rows(table.read()) == sorted((a, b, False, t) for (a, b), t in model.items())
    assert len(table._latest()[1]) <= 3


def test_small_additions_do_not_rewrite_a_large_table(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "MAX_PARTS", 3)
    table = KeyedTable(spark, folder, "products").create()
    large = spark.range(20000).selectExpr("concat('a', id) as asin", "'b' as brand", "sha2(cast(id as string), 256) as title", "1 as seq")
    table.upsert(large)
    (base,) = table._latest()[1]
    for step in range(7):
        table.upsert(spark.createDataFrame([("a1", "b", f"new{step}", 1), (f"n{step}", "b", "x", 1)], DDL))
    parts = table._latest()[1]
    assert parts[0] == base and len(parts) <= 3 and parts == sorted(parts)
    assert table.read().count() == 20007
    assert [r.title for r in table.read().where("asin = 'a1'").collect()] == ["new6"]
    assert len(table.fold()._latest()[1]) == 1 and table.read().count() == 20007


def test_repeating_an_upsert_changes_nothing(spark, folder):
    batch = spark.createDataFrame([("a", "b", "t", 1), ("a", None, "u", 2)], DDL)
    table = KeyedTable(spark, folder, "products").create().upsert(batch.where("brand is not null"))
    once = rows(table.read())
    assert rows(table.upsert(batch.where("brand is not null")).read()) == once


def test_readers_keep_the_table_they_opened(spark, folder):
    table = KeyedTable(spark, folder, "products").create()
    table.upsert(spark.createDataFrame([("a", "b", "old", 1)], DDL))
    before = table.read()
    table.upsert(spark.createDataFrame([("a", "b", "new", 1)], DDL))
    assert [r.title for r in before.collect()] == ["old"] and [r.title for r in table.read().collect()] == ["new"]


def test_an_unpublished_part_is_not_seen(spark, folder):
    table = KeyedTable(spark, folder, "products").create()
    table.upsert(spark.createDataFrame([("a", "b", "t", 1)], DDL))
    table.conform(spark.createDataFrame([("z", "z", "z", 1)], DDL)).drop("seq").write.parquet(table._part("000000099-crashed"))
    assert rows(table.read()) == [("a", "b", False, "t")]
    table.purge()
    assert not any("crashed" in n for n in files.names(spark, table.path))


def test_two_writers_cannot_publish_the_same_version(spark, folder):
    table = KeyedTable(spark, folder, "products").create()
    table._publish(2, [], {})
    with pytest.raises(Exception):
        table._publish(2, [], {})


def test_a_folded_table_is_a_plain_scan_with_pushdown(spark, folder):
    table = KeyedTable(spark, folder, "products").create()
    for n in range(2):
        table.upsert(spark.createDataFrame([("a", "b", str(n), 1)], DDL))
    plan = table.fold().read().where("brand = 'b'").select("asin")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(brand,b)" in plan and "ReadSchema: struct<asin:string,brand:string>" in plan


def test_defaults_flags_and_stamps(spark, folder):
    table = KeyedTable(spark, folder, "products").create()
    table.upsert(spark.createDataFrame([("a", "b", True)], "asin string, brand string, is_fba boolean"))
    row = table.read().first()
    assert (row.is_fba, row.has_aplus, row.bought_count, row.rating_5_star, row.title) == (1, 0, "", 0, None)
    assert row.created_at is not None and row.updated_at is not None


def test_reset_needs_confirmation_and_reports_counts(spark, folder):
    store = Store(spark, folder)
    store["products"].create().upsert(spark.createDataFrame([("a", "b", "t", 1)], DDL))
    with pytest.raises(ValueError):
        store.reset()
    assert [tuple(r) for r in store.reset(confirm=True).collect()] == [("products", 1, 0)]
    assert store.read("products").columns == store.read("products").columns and store.read("products").count() == 0


def test_migration_is_idempotent(spark):
    old = spark.createDataFrame([("a", "t")], "asin string, title string")
    once = tables.migrate(old, "products")
    assert once.columns == tables.migrate(once, "products").columns
    assert once.first().bought_count == "" and once.first().bought_count_number == 0
