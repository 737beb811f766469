"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a linear score of what it says and how it looks: its words, hashed into WORDS buckets by their share of
the text, and a few measures of its surface. It is learnt from preference pairs (a document labelled good against one
labelled bad) by the logistic loss of the difference of their features: every labelled document against every one of the
other class, by Newton's method. A document's pull depends on the pairs by its score alone, so that a pass over the rows that
counts scores, and one that adds up slopes and curvatures, stand for all pairs; only sums of a fixed size reach the driver.
Scores are counted on a grid, each shared out between its two neighbours there, which changes a pair's pull by at most 1e-4.

The threshold is a quantile of the scores of all labelled rows; which one, is told by rows that the scoring model didn't see
(two halves, each scored by the other's model). For it scores are rounded to 1/CELLS.

Edge cases: null and empty texts have all features 0; without labels of both classes every score is 0.5; ids that
repeat in the labels count once, good if any of their labels is; repeated rows are each returned; rows with a null id
are scored and never learnt from; an empty table gives no rows; columns of the input that are named score or predicted are
replaced in score_quality() and left alone by score_column(). In learning, scores beyond REACH either way count as REACH.
"""

from __future__ import annotations

import math
import re
import zlib
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import fold, remember, small_batches
from pagewright.llm.toxicity import sigmoid
from pagewright.session import Scratch

#: Buckets of words; words that a worker remembers; weight of the squared weights; steps of the fit at most.
WORDS, MEMORY, RIDGE, STEPS = 256, 200_000, 1e-3, 60
#: The grids of scores: from -REACH to REACH by FINE for slopes and by COARSE, a multiple, for curvatures; cells a unit for the threshold.
REACH, FINE, COARSE, CELLS = 128, 1 / 16, 1 / 2, 256
#: What the grid may add to the mean loss.
SLACK = FINE**2 / 16
CUT = 0.3
LETTERS = bytes(x for x in range(256) if x >= 128 or chr(x).isalpha())
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
USUAL = LETTERS + DIGITS + b" \n\t.,;:'\"-?()"
END = re.compile(r"[.?!](?:\s|$)")
MEASURES = ["odd", "bars", "shouts", "upper", "digits", "again", "distinct", "lines_again", "word_length", "long_words", "sentences", "size", "short", "bare"]


class Buckets(dict):
    def __missing__(self, word: str) -> int:
        found = zlib.crc32(word.strip(".,;:!?()\"'").lower().encode("utf-8", "replace")) % WORDS
        if len(self) < MEMORY:
            self[word] = found
        return found


_buckets = Buckets()


def measures(text: str | None) -> list[float]:
    """The measures of a whole text, each about 0 to 1."""
    if not text or not (ws := text.split()):
        return [0.0] * len(MEASURES)
    raw, n = text.encode("utf-8", "replace"), len(ws)
    size = len(raw)
    without = lambda drop: size - len(raw.translate(None, drop))
    distinct = len(set(ws))
    lines = [x for x in text.split("\n") if x]
    # Texts of any length are held to the number of different words to be expected of it.
    expected = 1.0 if n < 30 else min(1.0, 12 * n**-0.5)
    return [
        min(1.0, 4 * (size - without(USUAL)) / size),
        min(1.0, 4 * text.count("|") / n),
        min(1.0, 2 * text.count("!") / n),
        without(UPPER) / max(1, without(LETTERS)),
        without(DIGITS) / size,
        sum(map(eq, ws, ws[1:])) / n,
        min(1.0, distinct / n / expected),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, size / n / 20),
        min(1.0, 10 * sum(len(w) > 25 for w in ws) / n),
        min(1.0, 10 * len(END.findall(text)) / n),
        min(1.0, math.log1p(n) / 10),
        1.0 if n < 8 else 0.0,
        1.0 if without(LETTERS) < size / 2 else 0.0,
    ]


def features(text: str | None) -> np.ndarray:
    """The measures, then the root of each word bucket's share of the text."""
    out = np.zeros(len(MEASURES) + WORDS, "f4")
    if text and (ws := text.split()):
        out[: len(MEASURES)] = measures(text)
        remember(_buckets)
        found = np.fromiter(map(_buckets.__getitem__, ws), "i8", len(ws))
        out[len(MEASURES) :] = np.sqrt(np.bincount(found, minlength=WORDS) / len(ws))
    return out


def grid(step: float) -> np.ndarray:
    return np.arange(round(2 * REACH / step) + 1) * step - REACH


def places(s: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The point of the grid under each score, and the share that belongs to the next one."""
    at = (np.clip(s, -REACH, REACH) + REACH) / step
    under = np.minimum(at.astype("i8"), round(2 * REACH / step) - 1)
    return under, at - under


def tally(s: np.ndarray, y: np.ndarray, step: float = FINE, weight=1.0) -> np.ndarray:
    """How many bad and good ones have each score of the grid."""
    under, share = places(s, step)
    n, weight = round(2 * REACH / step) + 1, np.broadcast_to(weight, s.shape)
    return np.stack([np.bincount(under[k], ((1 - share) * weight)[k], n) + np.bincount(under[k] + 1, (share * weight)[k], n) for k in (y == 0, y > 0)])


def mean_loss(counts: np.ndarray, w: np.ndarray) -> float:
    points, (bad, good) = grid(FINE), (np.flatnonzero(c) for c in counts)
    losses = np.logaddexp(0, points[bad] - points[good][:, None])
    return float(counts[1, good] @ losses @ counts[0, bad] / counts[0].sum() / counts[1].sum() + RIDGE / 2 * w @ w)


def pulls(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a bad and a good one of each score adds to the slope (on the fine grid) and to the curvature (on the coarse one)."""
    points, (bad, good) = grid(FINE), (np.flatnonzero(c) for c in counts)
    wrong = sigmoid(points[bad] - points[good][:, None])
    slope = np.zeros(counts.shape)
    n_bad, n_good = counts.sum(1)
    slope[0, bad], slope[1, good] = counts[1, good] @ wrong / n_bad / n_good, -(wrong @ counts[0, bad]) / n_bad / n_good
    few = np.stack([tally(points, np.zeros(len(points)), COARSE, c)[0] for c in counts])
    return slope, few[::-1] @ bends() / n_bad / n_good


def bends() -> np.ndarray:
    """The curvature of a pair's loss, by both scores on the coarse grid."""
    points = grid(COARSE)
    p = sigmoid(points - points[:, None])
    return p * (1 - p)


class Sums:
    """The slope of the loss and the parts of its curvature, added up over rows: rows by themselves, and by class and score."""

    def __init__(self, width: int):
        self.slope, self.own, self.met = np.zeros(width), np.zeros((width, width)), {}

    def add(self, u: np.ndarray, y: np.ndarray, w: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> None:
        s, good = u @ w, (y > 0).astype("i8")
        under, share = places(s, FINE)
        self.slope += (slope[good, under] * (1 - share) + slope[good, under + 1] * share) @ u
        under, share = places(s, COARSE)
        self.own += (u * (bend[good, under] * (1 - share) + bend[good, under + 1] * share)[:, None]).T @ u
        for at, part in ((under, 1 - share), (under + 1, share)):
            keys, which = np.unique(2 * at + good, return_inverse=True)
            shares = np.zeros((len(keys), len(u)))
            shares[which, np.arange(len(u))] = part
            for key, v in zip(keys.tolist(), shares @ u, strict=True):
                self.met[key] = self.met.get(key, 0) + v

    def step(self, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """Newton's step, and twice by how much it would lower the loss if that were a parabola."""
        bad, good = (sorted(k for k in self.met if k % 2 == c) for c in (0, 1))
        between = bends()[np.ix_([k // 2 for k in good], [k // 2 for k in bad])] / counts[0].sum() / counts[1].sum()
        cross = np.stack([self.met[k] for k in good]).T @ between @ np.stack([self.met[k] for k in bad])
        slope = self.slope + RIDGE * w
        step = -np.linalg.solve(self.own - cross - cross.T + RIDGE * np.eye(len(w)), slope)
        return step, float(-slope @ step)


def climb(tallies, sums, models: list[int], width: int) -> dict[int, np.ndarray]:
    """The weights of each model. tallies: models' weights to the counts of their rows' scores; sums: models' weights and pulls
    to the sums over their rows."""
    w = {m: np.zeros(width) for m in models}
    counts = tallies(w)
    low, going = {m: mean_loss(counts[m], w[m]) for m in models}, set(models)
    for _ in range(STEPS):
        if not going:
            break
        got, steps = sums({m: (w[m], *pulls(counts[m])) for m in going}), {}
        for m in sorted(going):
            steps[m], gain = got[m].step(w[m], counts[m])
            if gain < 1e-8:
                w[m] = w[m] + steps.pop(m)
                going.remove(m)
        while steps:
            tried = {m: w[m] + d for m, d in steps.items()}
            found = tallies(tried)
            for m, v in tried.items():
                loss = mean_loss(found[m], v)
                if loss < low[m] + SLACK:
                    w[m], low[m], counts[m] = v, loss, found[m]
                    del steps[m]
                elif np.abs(steps[m]).max() < 1e-6:
                    going.remove(m)
                    del steps[m]
                else:
                    steps[m] = steps[m] / 2
    return w


def fit(u: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by the mean logistic loss of the differences of all good and all bad ones."""

    def sums(given):
        out = Sums(u.shape[1])
        out.add(u, y, *given[0])
        return {0: out}

    return climb(lambda w: {0: tally(u @ w[0], y)}, sums, [0], u.shape[1])[0]


def parting_quantile(s: np.ndarray, y: np.ndarray, n=1) -> float:
    """The quantile of the scores at which the two classes part best, both weighing the same; n rows have a score."""
    _, at = np.unique(s, return_inverse=True)
    bad, good = np.bincount(at, n * (y == 0)), np.bincount(at, n * (y > 0))
    gain = np.cumsum(bad / bad.sum() - good / good.sum())
    return float(np.cumsum(bad + good)[gain.argmax()] / (bad + good).sum())


def learn_quality(docs: DataFrame, labels: DataFrame) -> dict | None:
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    # Labels grow with the documents: never broadcast.
    rows = docs.select("doc_id", "text").where(fold("doc_id", 5) != 0).join(known.hint("merge"), "doc_id").select("text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))

    def measured(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "half": pdf.half, "x": [features(t).tobytes() for t in pdf.text]})

    with small_batches(spark), Scratch(spark) as scratch:
        return learn(scratch.stored(rows.mapInPandas(measured, "y int, half int, x binary"), "quality-features"))


def learn(rows: DataFrame) -> dict | None:
    """The model from rows of y, half and features. Models 0 and 1 don't see the half of that number, model 2 sees all."""

    def moments(batches):
        out: dict = {}
        for pdf in batches:
            x = np.stack([np.frombuffer(b, "f4") for b in pdf.x]).astype("f8") if len(pdf) else np.zeros((0, 1))
            for key in set(zip(pdf.y, pdf.half, strict=True)):
                k = ((pdf.y == key[0]) & (pdf.half == key[1])).to_numpy()
                out[key] = out.get(key, 0) + np.stack([np.full(x.shape[1], k.sum()), x[k].sum(0), (x[k] ** 2).sum(0)])
        yield pd.DataFrame([(*key, v.tobytes()) for key, v in sorted(out.items())], columns=["y", "half", "v"])

    parts: dict = {}
    for r in sorted(rows.mapInPandas(moments, "y int, half int, v binary").collect()):
        parts[r.y, r.half] = parts.get((r.y, r.half), 0) + np.frombuffer(r.v).reshape(3, -1)
    if len({y for y, _ in parts}) < 2:
        return None
    n, x, squares = sum(parts.values())
    # Measures each on their own scale, words all on one.
    mean = x / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-6
    scale[len(MEASURES) :] = math.sqrt(float((scale[len(MEASURES) :] ** 2).mean()))
    models = [0, 1, 2] if len(parts) == 4 else [2]

    def blocks(batches):
        """Rows' features on their scales, classes and halves."""
        for pdf in batches:
            if len(pdf):
                yield (np.stack([np.frombuffer(b, "f4") for b in pdf.x]) - mean) / scale, pdf.y.to_numpy(), pdf.half.to_numpy()

    def tallies(ws):
        def count(batches):
            out = {m: np.zeros((2, len(grid(FINE)))) for m in ws}
            for u, y, half in blocks(batches):
                for m, w in ws.items():
                    out[m] += tally(u[half != m] @ w, y[half != m])
            yield pd.DataFrame([(m, v.tobytes()) for m, v in out.items()], columns=["m", "v"])

        found: dict = {}
        for r in sorted(rows.mapInPandas(count, "m int, v binary").collect()):
            found[r.m] = found.get(r.m, 0) + np.frombuffer(r.v).reshape(2, -1)
        return found

    def sums(given):
        def part(batches):
            out = {m: Sums(len(mean)) for m in given}
            for u, y, half in blocks(batches):
                for m, v in given.items():
                    out[m].add(u[half != m], y[half != m], *v)
            # Slopes to the full digits; curvatures only lead the way.
            flat = [(m, k, i, v.astype("f8" if k == 0 else "f4").tobytes()) for m, o in out.items() for k, vs in enumerate(([(0, o.slope)], enumerate(o.own), o.met.items())) for i, v in vs]
            yield pd.DataFrame(flat, columns=["m", "k", "i", "v"])

        def add(batches):
            out: dict = {}
            for pdf in batches:
                for m, k, i, v in zip(pdf.m, pdf.k, pdf.i, pdf.v, strict=True):
                    out[m, k, i] = out.get((m, k, i), 0) + np.frombuffer(v, "f8" if k == 0 else "f4").astype("f8")
            yield pd.DataFrame([(*key, v.tobytes()) for key, v in out.items()], columns=["m", "k", "i", "v"])

        shape, found = "m int, k int, i int, v binary", {m: Sums(len(mean)) for m in given}
        for r in rows.mapInPandas(part, shape).repartition(8, "m", "k", "i").mapInPandas(add, shape).collect():
            v = np.frombuffer(r.v)
            if r.k == 0:
                found[r.m].slope = v
            elif r.k == 1:
                found[r.m].own[r.i] = v
            else:
                found[r.m].met[r.i] = v
        return found

    w = climb(tallies, sums, models, len(mean))

    def cells(batches):
        for u, y, half in blocks(batches):
            seen = [pd.DataFrame({"m": m, "s": np.rint((u @ v) * CELLS).astype("i8"), "y": y})[(half == m) | (m == 2)] for m, v in w.items()]
            yield pd.concat(seen).groupby(["m", "s", "y"]).size().rename("n").reset_index()

    got = rows.mapInPandas(cells, "m int, s long, y int, n long").groupBy("m", "s", "y").agg(F.sum("n").alias("n")).orderBy("m", "s", "y").toPandas()
    quantile = {m: parting_quantile(p.s.to_numpy(), p.y.to_numpy(), p.n.to_numpy()) for m, p in got.groupby("m")}
    q = float(np.mean([quantile[m] for m in models if m < 2 or len(models) == 1]))
    every = got[got.m == 2]
    upto, s = every.n.cumsum().to_numpy(), every.s.to_numpy() / CELLS
    k = min(max(1, round(q * upto[-1])), upto[-1] - 1)
    below, above = s[np.searchsorted(upto, [k - 1, k], "right")]
    return {"w": w[2] / scale, "b": float(-(mean / scale) @ w[2]), "cut": float((below + above) / 2), "quantile": q}


def scores(texts, model: dict | None) -> np.ndarray:
    """The score of each whole text, 0.3 at the model's threshold."""
    if model is None:
        return np.full(len(texts), 0.5)
    lift, out = math.log(CUT / (1 - CUT)), np.zeros(len(texts))
    for i, t in enumerate(texts):
        out[i] = features(t) @ model["w"]
    return sigmoid(out + model["b"] - model["cut"] + lift)


def score_column(model: dict | None, text_col: str = "text", arrow: bool = True) -> Column:
    """The score of each text. Without Arrow, workers hold 100 texts at a time, not a batch of 10,000."""
    if not arrow:
        return F.udf(lambda t: float(scores([t], model)[0]), "double", useArrow=False)(F.col(text_col))
    return F.pandas_udf(lambda text: pd.Series(scores(text, model), index=text.index), "double")(F.col(text_col))


def score_quality(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with columns score (0 to 1; 0.3 where the ranking score is at the threshold) and predicted (1 from 0.3 on)."""
    return docs.withColumn("score", score_column(model, text_col)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
