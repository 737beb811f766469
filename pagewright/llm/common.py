"""What several operators share: held-out folds, hot-key joins, words."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Keys that may be broadcast as hot in hot_left_join: so many at most, whatever the input.
HOT_KEYS = 1000
#: What this worker remembers, of one operator.
_remembered: dict | None = None


def remember(memory: dict) -> None:
    """To be called before words are put into an operator's memory: that of the operator before is emptied. Workers serve one
    stage after another, and their memories would add up."""
    global _remembered
    if _remembered is not memory:
        if _remembered is not None:
            _remembered.clear()
        _remembered = memory


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def hot_left_join(rows: DataFrame, groups: DataFrame, key: str, count: str, spread: str, carry: list[str], least: int = 64) -> DataFrame:
    """Left join of rows with groups (one row a key, with its count) that no hot key can slow.

    The HOT_KEYS largest groups of at least `least` rows go by broadcast, whose size that number bounds; all
    others have few rows a key and are shuffled. Rows already served by the broadcast, and rows with a null key,
    take a key of their own in the shuffle (from `spread`), so that they don't meet in one task.
    """
    hot = groups.where(F.col(count) >= least).orderBy(F.desc(count), F.col(key)).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in carry]))
    met = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    # Two columns make the key: the real one, or null with a spreading hash beside it.
    met = met.withColumn("_salt", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(7), F.col(spread)).bitwiseOR(F.lit(1).cast("long"))))
    rest = groups.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_zero"), *[F.col(c).alias(f"_rest_{c}") for c in carry])
    joined = met.join(rest, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    keep = [c for c in rows.columns]
    return joined.select(*keep, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in carry])


@contextmanager
def small_batches(spark, rows: int = 1000):
    """Within it, Arrow batches have at most so many rows: rows that carry whole texts or sets are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
