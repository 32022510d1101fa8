"""The pipeline on a small folder of tables, each decision checked by hand."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{i:03d}word".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(500)] + ["the", "of", "and"] * 60
    text = lambda n=200: " ".join(rng.choices(words, k=n))
    docs = {i: text() for i in range(200)}
    toxic = set(range(0, 200, 10))
    for i in toxic:
        docs[i] += " awful vile horrid awful vile"
    copies = {201: docs[11], 202: docs[12].upper(), 203: docs[13].replace(docs[13].split()[7], "changed", 1)}
    item = text(30)
    leaks = {204: text(60) + " " + item + " " + text(60), 205: item.capitalize()}
    personal = {206: text() + " reach me at ab.cd@ef.gh or 10.20.30.40"}
    rows = docs | copies | leaks | personal | {207: "", 208: None, 209: "   "}
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, text(25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, toxic


def test_stages_take_effect_one_after_the_other(spark, tables):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left, gone = docs.columns, set(rows), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, folder))
        assert sorted(docs.columns) == sorted(columns)
        now = {r["doc_id"] for r in docs.collect()}
        gone.append((name, left - now))
        left = now
    assert dict(gone) == {"toxicity": toxic, "near_duplicates": {201, 202, 203, 208, 209}, "decontamination": {204, 205}, "pii": set()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[206].endswith("reach me at <email> or <ip>") and texts[11] == rows[11]


def test_run_packs_all_that_stays(spark, tables):
    folder, rows, toxic = tables
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == set(rows) - toxic - {201, 202, 203, 204, 205, 208, 209}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
