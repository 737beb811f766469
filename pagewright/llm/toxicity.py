"""Toxicity classifier, logistic, with counterfactual regularisation.

Each labelled text has a counterfactual pair: the text and the same text in which its identity terms are swapped for others
of their group. A text that names no group gets one of a group's terms put in (which, is told by a hash of its id), so that
every text speaks of a group in one half of the pair or the other; half of those texts are also learnt from with the term in
them. The loss adds the mean squared change of the score over the pairs, so that a neutral mention of a group doesn't count
as toxic, whatever the labelled texts hold by chance. Features are words and their beginnings. The model is fitted on the
driver from at most `sample` labelled texts, of which only the counts of at most `vocabulary` chosen features are collected;
the features are chosen by counts over that sample, taken on the executors. Every text is scored whole.

Edge cases: null and empty texts have no features and get the intercept's score; without labels of both classes every
score is 0.5; ids that repeat in the labels count once, toxic if any of their labels is; repeated rows are each
returned; rows with a null id are scored and never learnt from; an empty table gives no rows; columns of the input that are
named score or predicted are replaced in score_toxicity() and left alone by score_column().
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import WORD, fold
from pagewright.session import stored

#: Fixed word lists: terms that may stand for each other in a sentence.
IDENTITY_GROUPS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
    ["women", "men"], ["woman", "man"], ["female", "male"], ["girls", "boys"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "african", "european", "latino", "arab", "indigenous"],
    ["immigrants", "refugees", "natives", "foreigners"], ["deaf", "blind", "disabled"],
    ["chrétiens", "musulmans", "juifs", "athées"], ["femmes", "hommes"], ["christen", "muslime", "juden", "atheisten"],
    ["frauen", "männer"], ["cristianos", "musulmanes", "judíos", "ateos"], ["mujeres", "hombres"],
]
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
#: Labelled texts and features at most; weight of the counterfactual penalty and of the squared weights.
SAMPLE, VOCABULARY, PENALTY, RIDGE = 6000, 2000, 1.0, 1e-3
HEADS = (4, 5, 6, 7)
CUT = 0.7


def features(words: list[str], known=None) -> Counter:
    """Counts of words and of their beginnings (marked by a bar); only the known ones, if given."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        for f in (w, *(w[:h] + "|" for h in HEADS if len(w) > h)):
            if known is None or f in known:
                out[f] += n
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def counterfactual(ws: list[str], seed: int) -> tuple[list[str], list[str], bool]:
    """A text's words in two halves of a pair that differ in identity terms only, and whether the terms were put in."""
    if not SWAP.keys().isdisjoint(ws):
        return ws, [SWAP.get(w, w) for w in ws], False
    group = IDENTITY_GROUPS[seed % len(IDENTITY_GROUPS)]
    i = seed // len(IDENTITY_GROUPS) % len(group)
    j = (i + 1 + seed // 997 % (len(group) - 1)) % len(group)
    return [*ws, group[i]], [*ws, group[j]], True


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept; both classes weigh the same. changes: the mean of d d' over all pairs, d being what the swap
    changes in the features, so that w' changes w is the mean squared change of the score."""
    w, b = np.zeros(x.shape[1], "f4"), 0.0
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype("f4")
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g = weight * (sigmoid(x @ w + b) - y)
        gw, gb = x.T @ g + RIDGE * w + 2 * penalty * (changes @ w), g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w - rate * mw / (np.sqrt(vw) + 1e-8), b - rate * mb / (math.sqrt(vb) + 1e-8)
    return w, float(b)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in which a cut gives the best F1."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    i = int(f1.argmax())
    below = z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 1
    return float((z[order[i]] + below) / 2)


def labelled(docs: DataFrame, labels: DataFrame, target: str, learn, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and y of at most `sample` labelled documents, the same ones on every run. The broadcast is bounded by `sample`."""
    rows = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.max(target).alias("y"))
    few = rows.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(few), id_col).select(id_col, "text", "y")


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, penalty: float = PENALTY) -> dict | None:
    """Feature weights, intercept, cut and scale, or nothing if a class is missing."""
    rows = stored(labelled(docs, labels, "toxic", fold("doc_id", 3) != 1, sample), "toxic-sample")

    def counts(batches):
        seen: dict[str, list[int]] = {}
        n = [0, 0]
        for pdf in batches:
            for text, y in zip(pdf.text, pdf.y, strict=True):
                n[int(y > 0)] += 1
                for f in features(WORD.findall((text or "").lower())):
                    seen.setdefault(f, [0, 0])[int(y > 0)] += 1
        yield pd.DataFrame([("", *n), *((f, *v) for f, v in seen.items())], columns=["f", "clean", "toxic"])

    table = rows.mapInPandas(counts, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = table.where("f = ''").first()
    if n is None or not n.clean or not n.toxic:
        return None
    # How much likelier the feature is in either class, times the root of how often it is seen.
    odds = F.log((F.col("toxic") + 0.5) / (n.toxic + 1)) - F.log((F.col("clean") + 0.5) / (n.clean + 1))
    chosen = table.where("f <> '' AND toxic + clean >= 3").select("f", (F.abs(odds) * F.sqrt(F.col("toxic") + 0.05 * F.col("clean"))).alias("worth")).orderBy(F.desc("worth"), "f").limit(vocabulary)
    names = sorted({r.f for r in chosen.collect()} | set(SWAP))
    at = {f: i for i, f in enumerate(names)}

    def vectors(batches):
        for pdf in batches:
            out = []
            for d, text, y in zip(pdf.doc_id, pdf.text, pdf.y, strict=True):
                ws = WORD.findall((text or "").lower())
                seed = zlib.crc32(str(d).encode())
                one, two, put_in = counterfactual(ws, seed)
                a, b = features(one, at), features(two, at)
                # Learnt from as it is, or, every other time, with the term that was put in.
                own = features(ws, at) if put_in and seed >> 16 & 1 else a
                d = {f: math.log1p(b[f]) - math.log1p(a[f]) for f in a.keys() | b.keys() if a[f] != b[f]}
                out.append((int(y > 0), [at[f] for f in own], [math.log1p(v) for v in own.values()], [at[f] for f in d], list(d.values())))
            yield pd.DataFrame(out, columns=["y", "i", "v", "si", "sv"])

    got = rows.mapInPandas(vectors, "y int, i array<int>, v array<double>, si array<int>, sv array<double>").toPandas()
    got["key"] = [zlib.crc32(np.concatenate([i, v]).tobytes()) for i, v in zip(got.i, got.v, strict=True)]
    got = got.sort_values(["key", "y"], kind="stable").reset_index(drop=True)  # rows come in any order
    x, changes = np.zeros((len(got), len(names)), "f4"), np.zeros((len(names), len(names)), "f4")
    for r, row in enumerate(got.itertuples()):
        x[r, row.i] = row.v
        changes[np.ix_(row.si, row.si)] += np.outer(row.sv, row.sv)
    y, changes = got.y.to_numpy("f4"), changes / len(got)
    # The cut is set on rows that the model didn't see.
    part, z = np.arange(len(y)) % 3, np.zeros(len(y), "f4")
    for k in range(3):
        w, b = fit(x[part != k], y[part != k], changes, penalty)
        z[part == k] = x[part == k] @ w + b
    w, b = fit(x, y, changes, penalty)
    cut = best_cut(z, y)
    return {"weights": {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4}, "intercept": b, "cut": cut}


def scorer(model: dict | None):
    """Tells the score of a whole text, 0.7 at the model's cut."""
    if model is None:
        return lambda t: 0.5
    lift, weights = math.log(CUT / (1 - CUT)), model["weights"]
    # A word's whole effect depends on its features' counts; most words have none.
    heads = {f[:-1] for f in weights if f.endswith("|")}

    def score(t: str | None) -> float:
        ws = [w for w in WORD.findall(t.lower()) if w in weights or (len(w) > 4 and (w[:4] in heads or w[:5] in heads or w[:6] in heads or w[:7] in heads))] if t else []
        z = model["intercept"] + sum(weights[f] * math.log1p(n) for f, n in sorted(features(ws, weights).items()))
        return float(sigmoid(z - model["cut"] + lift))

    return score


def scores(texts, model: dict | None) -> list[float]:
    return list(map(scorer(model), texts))


def score_column(model: dict | None, text_col: str = "text", arrow: bool = True) -> Column:
    """The score of each text. Without Arrow, workers hold 100 texts at a time, not a batch of 10,000."""
    if not arrow:
        return F.udf(scorer(model), "double", useArrow=False)(F.col(text_col))
    return F.pandas_udf(lambda text: pd.Series(scores(text, model), index=text.index, dtype="f8"), "double")(F.col(text_col))


def score_toxicity(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """docs with columns score (0 to 1) and predicted (1 from 0.7 on)."""
    return docs.withColumn("score", score_column(model, text_col)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
