"""Toxicity by maximum-scoring segments.

A token's score is its log-odds between toxic and other labelled documents, under Dirichlet priors drawn from all of them; a word the model
does not hold has the score of its beginning. A constant is taken off, so that scores fall on the average and only dense passages
rise. A linear scan finds every maximal scoring segment of a text. How large the best segment of a harmless text of that length gets by chance
follows an extreme-value law, whose two parameters come from harmless documents; a logistic curve makes the surplus a probability.

Counting and scoring run in Spark. The model is fitted on at most ``FIT_ROWS`` labelled rows and holds at most ``MODEL_TOKENS`` tokens; both bounds
are parameters. Scores depend on the text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import accumulate
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.session import stage

#: Labelled rows the model is fitted on, those with the smallest hashes of their ids; and the tokens it keeps, the surest first.
FIT_ROWS, MODEL_TOKENS = 20_000, 50_000
#: Letters of a word's beginning that stand for unknown words.
BEGINNING = 5
#: Weight of the prior as a share of all counted tokens, so that it weighs alike at every size; least surety of a kept token (in
#: standard deviations); and what is taken off each token's score.
PRIOR, SURETY, DRIFT = 0.05, 3.0, 0.25
#: Expected number of segments so large in a harmless text below which a segment is significant.
EVALUE = 0.05
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")
EULER = 0.5772156649015329
_KEPT_WORDS = 300_000


def fold(id_column: Column) -> Column:
    """0 for held-out rows, from 1 for those that may be learnt from."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


class Scores(dict):
    """Word to score; words not in the model are looked up by their beginning, and the last ones asked for are kept."""

    def __init__(self, tokens: dict[str, float]):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, word: str) -> float:
        found = self.tokens.get(word)
        if found is None:
            found = self.tokens.get(f"{word[:BEGINNING]}*", 0.0) if len(word) >= BEGINNING else 0.0
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = found - DRIFT
        return self[word]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, sum) in one pass: no part of one scores more, and none can be widened."""
    sums = [0.0, *accumulate(scores)]
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    at: list[int] = []  # of each segment: the last one before it with a smaller sum before, or -1
    for i, s in enumerate(scores):
        if s <= 0:
            continue
        start, end, low, high = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = at[j]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                at.append(j)
                break
            start, low = found[j][0], found[j][2]
            del found[j:], at[j:]
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass
class Model:
    """Token scores, the extreme-value law of harmless texts (rate, size) and the logistic curve (slope, shift)."""

    tokens: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    shift: float = -2.0

    def surplus(self, best: float, length: int) -> float:
        """Minus the logarithm of how many segments as good are expected in a harmless text of that length."""
        return self.rate * best - log(self.size * max(length, 1))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.slope * evidence + self.shift))))

    def judge(self, text: str | None, table: Scores) -> tuple[float, int]:
        """Evidence against a text, and its number of significant passages.

        The evidence is the best segment's surplus, and that of every further significant segment on top of it.
        """
        own = WORD.findall((text or "").lower())
        best, *rest = sorted((self.surplus(s, len(own)) for _, _, s in segments([table[w] for w in own])), reverse=True) or [self.surplus(0.0, len(own))]
        further = [s for s in rest if s >= -log(EVALUE)]
        return best + sum(further), len(further) + (best >= -log(EVALUE))

    def passages(self, text: str | None, table: Scores) -> list[tuple[int, int, float]]:
        """Significant segments as (first word, last word exclusive, expected number by chance)."""
        own = WORD.findall((text or "").lower())
        judged = ((a, b, exp(-self.surplus(s, len(own)))) for a, b, s in segments([table[w] for w in own]))
        return [x for x in judged if x[2] <= EVALUE]


def labelled(labels: DataFrame, rows: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """At most ``rows`` (id, y) that may be learnt from; which ones depends on their ids alone."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    return known.where(fold(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)


def token_scores(texts: DataFrame, most: int) -> dict[str, float]:
    """Log-odds of the surest tokens of (text, y), each counted once per different text; beginnings of words end in an asterisk."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    own = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"\p{L}+"), F.lit(0)))
    starts = F.array_distinct(F.transform(F.filter("own", lambda w: F.length(w) >= BEGINNING), lambda w: F.concat(F.substring(w, 1, BEGINNING), F.lit("*"))))
    different = texts.select(own.alias("own"), "y").dropDuplicates(["own"])
    counted = (
        different.select(F.explode(F.concat("own", starts)).alias("token"), "y")
        .groupBy("token")
        .agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    )
    counted = stage(counted.where("a + b > 1"))
    n1, n0 = counted.agg(F.sum("a"), F.sum("b")).first()
    if not n1 or not n0:
        return {}
    alpha, total = PRIOR * (F.col("a") + F.col("b")), PRIOR * (n1 + n0)
    odds = lambda y, n: F.log((F.col(y) + alpha) / (n + total - F.col(y) - alpha))
    judged = counted.select("token", (odds("a", n1) - odds("b", n0)).alias("score"), F.sqrt(1 / (F.col("a") + alpha) + 1 / (F.col("b") + alpha)).alias("error"))
    sure = judged.select("token", "score", (F.abs("score") / F.col("error")).alias("z")).where(F.col("z") >= SURETY)
    return {r["token"]: r["score"] for r in sure.orderBy(F.desc("z"), "token").limit(most).collect()}


def _rate(values: np.ndarray) -> float:
    """The positive root of mean(exp(rate * score)) = 1, for scores that fall on the average; 1 where none exists."""
    if values.max(initial=0.0) <= 0 or values.mean() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while np.exp(high * values).mean() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(mid * values).mean() < 1 else (low, mid)
    return max(high, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and shift by Newton's steps; the penalty keeps the curve finite where the classes part."""
    scale = x.std() or 1.0
    design, w = np.stack([(x - x.mean()) / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.diag([1.0, 1e-3]), design.T @ (y - p) - ridge * np.array([1.0, 1e-3]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[0] / scale
    return float(slope), float(w[1] - slope * x.mean())


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, tokens: int = MODEL_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows of ``docs`` outside the held-out fold. Without both labels among them, a model that knows no tokens."""
    chosen = F.broadcast(labelled(labels, rows))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = stage(narrow.join(chosen, narrow["doc_id"] == chosen["id"]).select("text", "y"))
    model = Model(token_scores(texts, tokens))
    if not model.tokens:
        return model
    # One value per harmless token at the most: the scores of whole texts are summed up by rounded score before they come to the driver.
    sent = docs.sparkSession.sparkContext.broadcast(model.tokens)

    @F.pandas_udf("best double, length long, scores array<int>, counts array<long>")
    def measured(column: pd.Series) -> pd.DataFrame:
        table, out = Scores(sent.value), []
        for t in column:
            scores = [table[w] for w in WORD.findall((t or "").lower())]
            values, counts = np.unique(np.round(np.array(scores) * 10).astype(int), return_counts=True)
            out.append((max((s for _, _, s in segments(scores)), default=0.0), len(scores), values.tolist(), counts.tolist()))
        return pd.DataFrame(out, columns=["best", "length", "scores", "counts"])

    seen = stage(texts.select("y", measured("text").alias("m")).select("y", "m.*"))
    spectrum = seen.where("y = 0").select(F.explode(F.arrays_zip("scores", "counts")).alias("z")).groupBy("z.scores").agg(F.sum("z.counts").alias("n")).collect()
    values = np.repeat([r["scores"] / 10 for r in spectrum], [max(1, round(1_000_000 * r["n"] / sum(s["n"] for s in spectrum))) for r in spectrum]) if spectrum else np.zeros(0)
    model.rate = _rate(values) if len(values) else 1.0
    harmless = seen.where("y = 0").select("best", "length").toPandas()  # at most as many rows as the fit has
    if len(harmless):
        model.size = float(np.exp(np.clip((model.rate * harmless["best"] - np.log(harmless["length"].clip(lower=1))).mean() - EULER, -30, 30)))
    known = texts.select("y", judge_column(docs.sparkSession, model, F.col("text"))["evidence"].alias("x")).toPandas()
    if known["y"].nunique() == 2:
        model.slope, model.shift = _logistic(known["x"].to_numpy(), known["y"].to_numpy(dtype=float))
    return model


def judge_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """(evidence, score, passages) of each text; a null text is an empty one."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("evidence double, score double, passages int")
    def judged(column: pd.Series) -> pd.DataFrame:
        table, m = Scores(sent.value.tokens), sent.value
        found = [m.judge(t, table) for t in column]
        return pd.DataFrame({"evidence": [x for x, _ in found], "score": [m.probability(x) for x, _ in found], "passages": [n for _, n in found]})

    return judged(text)


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) for each row of ``docs``; repeated rows repeat, other columns are not read."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    judged = docs.select(F.col(id_col).alias("doc_id"), judge_column(docs.sparkSession, model, F.col(text_col)).alias("j"))
    score = F.col("j.score")
    return judged.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("j.passages").alias("n_passages"))


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, last_word, evalue) of every significant toxic passage, words from 0, the last exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<first_word:int,last_word:int,evalue:double>>")
    def found(column: pd.Series) -> pd.Series:
        own = Scores(sent.value.tokens)
        return column.map(lambda t: [dict(zip(("first_word", "last_word", "evalue"), p)) for p in sent.value.passages(t, own)])

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is not judged toxic, with all columns."""
    return docs.where(judge_column(docs.sparkSession, model, F.col(text_col))["score"] < 0.5)
