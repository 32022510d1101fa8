"""A membership filter for work lists of any length: a Bloom filter as a small table, tested by a join inside the scan's own stage.

Every listed key sets a few bits of one 64-bit word; the words are the rows of the table. The table has a fixed most size, so it
can always be sent to all executors: a longer list makes the filter let more strangers through, and never stops a listed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that share a word at best, bits that a key sets, and the most words: 2^20 rows of two longs.
KEYS_PER_WORD, BITS, MOST_WORDS = 4, 4, 1 << 20


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _bits(key: Column) -> Column:
    """Six bits of a second hash choose each bit."""
    number = F.xxhash64(key, F.lit(1))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        chosen = F.shiftright(number, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), chosen))
    return out


def words_for(count: int) -> int:
    words = 1
    while words * KEYS_PER_WORD < count and words < MOST_WORDS:
        words *= 2
    return words


def bloom(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits) of the listed keys; at most ``MOST_WORDS`` rows."""
    return keys.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_bits(F.col(key))).alias("bits"))


def likely_in(rows: DataFrame, keys: DataFrame, key: str, count: int) -> DataFrame:
    """Rows whose ``key`` is listed, and a few others. ``count`` is about how many keys there are."""
    words = words_for(count)
    table = F.broadcast(bloom(keys, key, words).withColumnRenamed("word", "_word"))
    own = _bits(rows[key])
    return rows.join(table, (_word(rows[key], words) == table["_word"]) & (table["bits"].bitwiseAND(own) == own), "left_semi")
