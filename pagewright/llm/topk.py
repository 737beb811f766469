"""Exact top-k search by columnar branch and bound.

Vectors are quantised to whole numbers and laid out vertically, dimension by dimension, in blocks of rows. For a
block of queries against a block of candidates, inner products are accumulated one block of dimensions after the
other; after each, a candidate stays only if its score so far plus the most that the remaining dimensions can give
(product of the remaining masses, Cauchy-Schwarz) still reaches the query's bound; the survivors are compacted. A query's
bound is at first its k-th best exact score among SEEDS rows of the largest norms, which every block thus begins with; it
rises with each part of a block, and parts whose norms can't reach it are skipped. Blocks of queries meet blocks of candidates
by an equi-join on block numbers, so that no task holds more than one block of either. Only the seeds are sent to all tasks.

Edge cases: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no
part; every other row is a candidate of its own, and a query, if its id is wanted: rows that repeat are found as often as
there are, a row that repeats finds its copies, and rows that share an id but not the vector are told apart; vectors of
unequal length are padded with zeros; ties go to the smaller id; an empty table gives no rows; other columns of the input are
ignored. Sums that leave 2**53 are done in Python's whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Rows of a block of candidates, of a part of it and of a block of queries; dimensions that are added at once; rows that give the first bounds.
CANDIDATES, PART, QUERIES, DIMENSIONS, SEEDS = 8192, 2048, 2048, 16, 512
LONGEST = (1 << 63) - 1
EXACT = 2**53


def _matrix(rows, width: int) -> np.ndarray:
    """Vertical layout: a row for each dimension."""
    out = np.zeros((width, len(rows)))
    for j, x in enumerate(rows):
        out[: len(x), j] = x
    return out


def too_large(a: np.ndarray, b: np.ndarray) -> bool:
    return len(a) * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) >= EXACT


def first_bounds(q_keys: list, q: np.ndarray, seeds: list, k: int) -> np.ndarray:
    """Each query's k-th best score among the seeds (id, vector, copies) but the query itself; minus infinity, if they are fewer."""
    if not seeds:
        return np.full(len(q_keys), -np.inf)
    c = _matrix([v for _, v, _ in seeds], len(q))
    if too_large(q, c):
        return np.full(len(q_keys), -np.inf)
    place = {(i, tuple(v)): n for n, (i, v, _) in enumerate(seeds)}
    many = np.array([min(n, k + 1) for _, _, n in seeds])
    scores, out = (c.T @ q), np.full(len(q_keys), -np.inf)
    for j, key in enumerate(q_keys):
        left = many
        if (own := place.get(key)) is not None:
            left = many.copy()
            left[own] -= 1
        order = np.argsort(-scores[:, j], kind="stable")
        at = np.searchsorted(np.cumsum(left[order]), k)
        if at < len(order):
            out[j] = scores[order[at], j]
    return out


def block_top(q_keys, q: np.ndarray, bounds: np.ndarray, c_keys, c_ids: np.ndarray, c: np.ndarray, copies: np.ndarray, k: int, step: int = DIMENSIONS) -> list[tuple[int, int, int, int]]:
    """(query, candidate, score, copies), by place, of each query's best candidates other than itself, at least those among
    its k best. q, c: dimensions by rows. bounds: scores that k others are known to reach; raised here."""
    own = {key: n for n, key in enumerate(c_keys)}
    width = len(q)
    # Blocks of dimensions with most mass come first: they tell most.
    order = np.argsort(-(np.square(q).sum(1) * np.square(c).sum(1)), kind="stable")
    q, c = q[order], c[order]
    left = lambda x: np.sqrt(np.concatenate([np.cumsum(np.square(x)[::-1], 0)[::-1], np.zeros((1, x.shape[1]))]))
    q_left, c_left = left(q), left(c)
    first = min(step, width)
    best: list[list] = [[] for _ in q_keys]
    for lo in range(0, c.shape[1], PART):
        part = slice(lo, min(lo + PART, c.shape[1]))
        mass = c_left[0, part].max()
        start = q[:first].T @ c[:first, part]
        for i, key in enumerate(q_keys):
            if q_left[0, i] * mass * (1 + 1e-9) + 1e-6 < bounds[i]:
                continue
            alive = np.arange(part.start, part.stop)
            if (me := own.get(key)) is not None and part.start <= me < part.stop and copies[me] == 1:
                alive = np.delete(alive, me - part.start)
            score, done = start[i, alive - part.start], first
            while True:
                if done < width:
                    slack = q_left[done, i] * c_left[done, alive] * (1 + 1e-9) + 1e-6
                    least = bounds[i]
                    if len(alive) > k:
                        least = max(least, np.partition(score - slack, len(alive) - k)[len(alive) - k])
                    stays = score + slack >= least
                    if not stays.all():
                        alive, score = alive[stays], score[stays]
                if done >= width or not len(alive):
                    break
                upto = min(done + step, width)
                score = score + q[done:upto, i] @ c[done:upto, alive]
                done = upto
            top = np.lexsort((c_ids[alive], -score))[:k]
            best[i] = sorted(best[i] + [(-float(score[t]), int(c_ids[alive[t]]), int(alive[t])) for t in top])[:k]
            if len(best[i]) == k:
                bounds[i] = max(bounds[i], -best[i][-1][0])
    return [(i, n, int(-s), int(copies[n] - (own.get(key) == n))) for i, key in enumerate(q_keys) for s, _, n in best[i]]


def block_top_whole(q_keys, q, c_keys, c_ids, c, copies, k):
    """The same for numbers beyond the whole range of doubles; scores are held to the range of a long."""
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    out, c, own = [], whole(c), {key: n for n, key in enumerate(c_keys)}
    for i, key in enumerate(q_keys):
        left = [int(m - (own.get(key) == n)) for n, m in enumerate(copies)]
        scores = (whole(q[:, [i]]) * c).sum(0)
        best = sorted((-max(-LONGEST - 1, min(LONGEST, s)), int(c_ids[n]), n) for n, s in enumerate(scores) if left[n])[:k]
        out += [(i, n, -s, left[n]) for s, _, n in best]
    return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, whole-number vector v (as doubles) and number of copies of the rows that take part; equal rows are one."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    kept = vectors.where(F.coalesce(fine, F.lit(False)))
    # Minus zero is zero.
    floors = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double") + F.lit(0.0))
    return kept.select(F.col(id_col).cast("long").alias("id"), floors.alias("v")).groupBy("id", "v").agg(F.count("*").alias("copies"))


def top_k(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates with the largest inner product. queries: a condition on column id."""
    rows = quantised(vectors, id_col, vector_col, scale)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("m"), F.max(F.size("v")).alias("w")).first()
    n_blocks, q_blocks, width = max(1, math.ceil(size.n / CANDIDATES)), max(1, math.ceil(size.m / QUERIES)), size.w or 1
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seeds = [(r.id, list(r.v), r.copies) for r in rows.orderBy(F.desc(norm), "id", "v").limit(SEEDS).collect()]

    @F.pandas_udf("double")
    def bound(ids: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series(first_bounds([(i, tuple(v)) for i, v in zip(ids, vs, strict=True)], _matrix(vs, width), seeds, k), index=ids.index)

    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = rows.where(queries).select("id", "v", bound("id", "v").alias("bound"), block(q_blocks).alias("qb"))
    left = wanted.select("*", every(n_blocks).alias("cb"))
    right = rows.select("id", "v", "copies", norm.alias("norm"), block(n_blocks).alias("cb"), every(q_blocks).alias("qb"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            b = b.sort_values(["norm", "id"], ascending=[False, True])  # parts of large norms first
            q_keys, c_keys = ([(i, tuple(v)) for i, v in zip(x.id, x.v, strict=True)] for x in (a, b))
            q, c, c_ids, copies = _matrix(a.v, width), _matrix(b.v, width), b.id.to_numpy(), b.copies.to_numpy()
            if too_large(q, c):
                found = block_top_whole(q_keys, q, c_keys, c_ids, c, copies, k)
            else:
                found = block_top(q_keys, q, a.bound.to_numpy(copy=True), c_keys, c_ids, c, copies, k)
            found = [(int(a.id.iloc[i]), a.v.iloc[i], int(c_ids[n]), s, min(m, k)) for i, n, s, m in found]
        return pd.DataFrame(found, columns=["query_id", "v", "vec_id", "score", "copies"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.LongType()) for c in ("vec_id", "score", "copies")]])
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(search, schema)
    each = best.select("query_id", "v", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rank = F.row_number().over(W.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    told = each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "v", "rank", "vec_id", "score")
    # A query row that repeats is answered as often.
    again = rows.where(queries & (F.col("copies") > 1)).select(F.col("id").alias("query_id"), "v", "copies")
    told = told.join(again, ["query_id", "v"], "left").select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))).alias("_copy"))
    return told.drop("_copy")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
