"""Token files against the tokenizer itself, byte for byte."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfscope.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got):
    """``rows`` in the order of the files."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = {t: tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in {t or "" for _, t in rows}}
    start = 0
    for (doc, text), r in zip(rows, got, strict=True):
        own = ids[text or ""]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        assert "ids" not in r or r["ids"] == own
        start += len(own)


def test_texts_come_back(spark, documents, folder):
    texts = [
        "Two words", "", None, "tab\there\r\nnew  line", "nb sp   em \x1c \x85 x", "é ́ mark", "ΣΑΣ İstanbul ﬁ", "<|endoftext|> and <|STARTOFTEXT|> a<|b",
        "it's 'S we'LL 123 45.6", "日本語 テキスト 𝒳🙂", "a  b   c", " lead and trail ", "x" * 5000,
    ]
    rows = list(enumerate(texts))
    T.write(documents(*reversed(rows)), folder, PATH)
    check(rows, T.read(spark, folder).orderBy("start").collect())


def test_a_vocabulary_that_keeps_blanks_is_never_cut():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, coder = Tokenizer.from_file(path), T.Encoder(path)
    texts = ["Two words\nand more", " lead  and trail ", "", None, "a\n\nb"]
    assert not coder.cuts and T.Encoder(PATH).cuts
    assert [np.frombuffer(c, dtype=f"<u{coder.width}").tolist() for c in coder.batch(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_documents_of_the_table(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    T.write(docs, folder, PATH)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    check(rows, T.read(spark, folder, ids=False).orderBy("doc_id").collect())
    parts = T.parts_of(spark, folder).orderBy("part").collect()
    assert all(b["base"] == a["base"] + a["tokens"] for a, b in zip(parts, parts[1:])) and parts[0]["base"] == 0


def test_odd_rows_and_empty_tables(spark, odd, nothing, folder):
    T.write(odd, folder, PATH)
    got = T.read(spark, folder, ids=False).orderBy("start").collect()
    assert len(got) == 11 and got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
    T.write(nothing, folder + "-none", PATH)
    assert T.read(spark, folder + "-none").count() == 0


def test_files_are_flat_integers(spark, documents, folder):
    T.write(documents((1, "some words"), (2, "more")), folder, PATH)
    parts = T.parts_of(spark, folder).orderBy("part").collect()
    local = folder.removeprefix("file:")
    ids = np.concatenate([np.fromfile(f"{local}/part-{p['part']:06d}.bin", dtype=f"<u{p['width']}") for p in parts])
    offsets = [np.fromfile(f"{local}/part-{p['part']:06d}.off", dtype="<u8") for p in parts]
    assert len(ids) == sum(p["tokens"] for p in parts) == offsets[-1][-1] and offsets[0][0] == 0
