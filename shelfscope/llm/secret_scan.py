"""Secret scan: patterns propose spans, and how many owners hold the same value tells live secrets from copied examples.

Spans come from column functions alone. The pieces that ``split`` leaves between the matches of a pattern and the matches that
``regexp_extract_all`` gives alternate, so running sums of their lengths are the places of the matches, in code points. Values are
hashed as soon as they are found; only hashes are counted and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import look_up, span_key
from shelfscope.session import stage


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The base kinds: pattern, the group that holds the value, and its least length. Fixed values.
BASE = {
    "assign": (f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
#: Kinds whose form alone tells a secret.
FORMS = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 64),
    "prefixed": (r"\b(?:gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32),
}
#: Long mixed strings: secrets only if one owner alone has the value.
OPAQUE = ("[A-Za-z0-9+_-]+", 0, 20)
ORDER = [*BASE, *FORMS, "opaque"]
#: A value that this many owners hold is a copied example. Repositories of one owner say nothing: a copy of a document is one more of them.
EXAMPLE_OWNERS = 3
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,hash:string>>"
#: Matches of a text that are walked in one go: adding to a list copies it, so lists are kept short and put together at the end.
RUN = 256


def _with(value: Column, use) -> Column:
    """``use`` applied to a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, also=None) -> Column:
    """Leftmost non-overlapping matches whose value has the least length; a match that fails is dropped, not tried again."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        good = F.length(x["value"]) >= least
        span = F.struct(F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), F.sha2(x["value"], 256).alias("hash"))
        return F.struct(
            F.coalesce(stop, acc["at"]).cast("bigint").alias("at"),
            F.when(good if also is None else good & also(x["value"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    long = lambda x: F.coalesce(F.length(x["gap"]), F.lit(0)) + F.coalesce(F.length(x["match"]), F.lit(0))
    runs_of = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.slice(p, i * RUN + 1, RUN))
    length_of = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda n, x: n + long(x))

    def walk(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0).cast("bigint")), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + length_of(run))))
        starts = F.slice(ends, 1, F.size(runs))
        walked = F.zip_with(runs, starts, lambda run, at: F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), step)["out"])
        return F.flatten(walked)

    walked = _with(parts, lambda p: _with(runs_of(p), walk))
    probe = pattern if pattern not in (BASE["hex"][0], OPAQUE[0]) else pattern.removesuffix("+") + "{%d}" % least
    return F.when(F.regexp(text, F.lit(probe)), walked).otherwise(empty)


def _mixed(value: Column) -> Column:
    """Small and large letters and digits, ten different characters at least."""
    kinds = [F.regexp(value, F.lit(p)) for p in ("[a-z]", "[A-Z]", "[0-9]")]
    return kinds[0] & kinds[1] & kinds[2] & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def candidates(text: Column) -> tuple[Column, Column]:
    """(base spans, further spans): what patterns propose."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*(spans_of(text, kind, *BASE[kind]) for kind in BASE))
    forms = F.concat(*(spans_of(text, kind, *FORMS[kind]) for kind in FORMS))
    return base, F.concat(forms, spans_of(text, "opaque", *OPAQUE, also=_mixed))


def _apart(spans: DataFrame) -> DataFrame:
    """``spans`` without opaque ones that touch a span of another kind of the same row.

    One that begins no later reaches into it, or one that begins later begins in it: a running maximum and a running minimum.
    """
    other = lambda c: F.when(F.col("kind") != "opaque", F.col(c))
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    touched = (F.max(other("stop")).over(up) > F.col("start")) | (F.min(other("start")).over(down) < F.col("stop"))
    return spans.withColumn("touched", touched).where("kind <> 'opaque' OR NOT coalesce(touched, false)").drop("touched")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, n_held) of candidates (hash, repo, owner).

    Counts in steps (repository, owner, value), each of which Spark sums before its shuffle, so a value that a third of all
    repositories hold is one row per task and owner. A repository is told by owner and name together.
    """
    repos = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_held"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, spans).

    ``rows``: one per row of ``docs``, with a row number, the id and the base spans. ``spans``: (row, kind, start, stop, hash, n_repos,
    n_owners, live) of every accepted span. A span is live if fewer than EXAMPLE_OWNERS owners hold its value; opaque strings
    count only if a single owner does and they touch no other span. A null text is an empty one, a null owner or repository is one of
    its own, repeated rows are scanned again. Hashes and places go to the shared scratch folder, no values.
    """
    base, more = candidates(F.col("text"))
    own = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner")
    )
    rows = stage(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", base.alias("base"), more.alias("more")))
    every = rows.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", "repo", "owner", F.explode(F.concat("base", "more")).alias("s"))
    found = stage(_apart(every.select("row", "repo", "owner", "s.*")))
    met = look_up(found, stage(ownership(found)), "hash", "n_held")
    live = F.col("n_owners") < EXAMPLE_OWNERS
    spans = met.select("row", "kind", "start", "stop", "hash", "n_repos", "n_owners", live.alias("live"))
    return rows, spans.where("kind <> 'opaque' OR (live AND n_owners = 1)")


def report(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per scanned row: counts of the base kinds, a digest of the base spans, all spans, and how many are live or copied."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    listed = spans.select("row", F.struct("start", place.alias("place"), span_key(F.col("kind"), F.col("start"), F.col("stop")).alias("text"), "live").alias("s"))
    per_row = listed.groupBy("row").agg(
        F.array_sort(F.collect_list("s")).alias("all"), F.count_if(F.col("s.live")).alias("n_live"), F.count_if(~F.col("s.live")).alias("n_copied")
    )
    order = F.array(*map(F.lit, ORDER))
    keyed = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), span_key(s["kind"], s["start"], s["stop"]).alias("text"))))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("row", "doc_id", "base").join(per_row, "row", "left").select(
        "doc_id",
        *(number(kind) for kind in BASE),
        F.sha2(F.array_join(F.transform(keyed, lambda s: s["text"]), ","), 256).alias("base_sha256"),
        F.coalesce(F.array_join(F.transform("all", lambda s: s["text"]), ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
