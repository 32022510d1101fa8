"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Python inside ``mapInArrow``: texts stay where they were read, nothing is shuffled, and a task holds one Arrow batch. Every pattern is
matched in time linear in the text, also where a text is one long run of digits or letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban"]
#: The part of an address from @ on; what stands before it is looked up backwards.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: A match can only begin where a run of digits begins, as what follows the run is the same for all its digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", re.ASCII)
#: Characters of an account number by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: What a span's kind is worth by itself, and the words nearby that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
WORDS = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "client"},
    "card": {"card", "visa", "credit", "payment", "mastercard", "cvv"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "contact"},
    "iban": {"iban", "bank", "account", "transfer"},
}
DOUBTS = {"example", "sample", "test", "version", "isbn", "dummy"}
NEARBY = 60
#: Least score of what the pipeline masks: only confirmed spans with several doubts around them stay.
LEAST = 0.3
STEP = 0.1
WORD = re.compile(r"[a-z]+")
MASK = {kind: f"<{kind}>" for kind in KINDS}
SPANS = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and summed by digits, makes the sum a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the number with the first four characters moved to the end, letters as 10 to 35, leaves 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of the base kinds, kind by kind, by start."""
    if "@" in text:
        yield from (("email", *s) for s in _emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may run on into the words after a number, or begin before it: each of its prefixes that ends with a word is tried, that of
    its country's length first, then from the longest on; the search goes on behind a number, or behind the first letter of a failed proposal."""
    at = 0
    while m := IBAN.search(text, at):
        ends = [i for i in range(m.end(), m.start(), -1) if i == m.end() or text[i] == " "]
        ends.sort(key=lambda i: len(text[m.start() : i].replace(" ", "")) != IBAN_LENGTHS.get(m[0][:2]))
        for end in ends:
            bare = text[m.start() : end].replace(" ", "")
            if 15 <= len(bare) <= 34 and mod97(bare):
                yield m.start(), end
                at = end
                break
        else:
            at = m.start() + 1


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    yield from (("iban", *s) for s in _ibans(text))


def score(text: str, kind: str, start: int, stop: int) -> float:
    """The kind's own score, a step up for each different word nearby that speaks for it, a step down for each doubt; 0 to 1."""
    near = set(WORD.findall((text[max(0, start - NEARBY) : start] + " " + text[stop : stop + NEARBY]).lower()))
    return round(min(1.0, max(0.0, SCORES[kind] + STEP * len(near & WORDS[kind]) - STEP * len(near & DOUBTS))), 6)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans, kinds as listed, then by start. A null text has none."""
    text = text or ""
    return [(k, a, b, score(text, k, a, b)) for k, a, b in (*base_spans(text), *more_spans(text))]


def redact(text: str | None, least: float = LEAST) -> str | None:
    """The text with the spans of at least that score replaced by their kinds; overlapping spans are one, named by the first."""
    if not text:
        return text
    out, done = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b, s in find(text) if s >= least):
        if start >= done:
            out += [text[done:start], MASK[kind]]
        done = max(done, stop)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row of ``docs``, spans as (kind, start, stop, score). Null and empty texts have none; other columns are not read."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "stop", "score"), s)) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")



def report(found: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans, all spans and the best score, from the rows of ``scan``."""
    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != "iban")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", least: float = LEAST) -> DataFrame:
    """``docs`` with all columns and rows, personal data in the text replaced and the length column, if there is one, counted anew.

    Texts without such data stay as they are; a null text stays null and keeps its length.
    """
    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, least))

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(kind), F.col(length_col)))
    return out
