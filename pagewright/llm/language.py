"""Language identification by prediction by partial matching.

Each language has a context tree of bytes of variable order: every context of up to `order` bytes that its texts hold, and the
bytes seen after it. A byte is coded in the longest context that exists; one not seen there escapes to the next shorter one,
with the escape probability of method C (kinds of bytes seen, by all seen and kinds) and without what the longer context has
already ruled out, down to 256 bytes that are all as likely; so code lengths are those of a proper code. The statistics are
frozen after training, so they are compiled once a worker: the trees of all languages are laid over each other into one, each
node of which has a number of bits for each language, such that a text's code length is a sum over the longest nodes that
match it byte by byte. The language with the shortest code is predicted. The trees are learnt from the whole texts of at most
about `per_language` documents of each language.

Edge cases: null text and text without a letter give `und` and score 0; ties go to the smaller name; with no labelled
text every prediction is `und`; repeated rows are each returned; rows with a null id are predicted and their crc is
that of the empty text; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.llm.common import fold

#: Texts of a language from which its tree is learnt, at most; bytes of the longest context.
PER_LANGUAGE, ORDER = 400, 3
#: Bytes scored at once; entries of a table of steps up to which it is laid out in full, rather than searched.
BLOCK, FULL = 1 << 20, 1 << 24


def strings(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different strings of so many bytes (as big-endian numbers) and how often each is seen."""
    b = np.frombuffer(raw, "u1").astype("i8")
    keys = np.zeros(max(len(b) - size + 1, 0), "i8")
    for k in range(size):
        keys = (keys << 8) | b[k : k + len(keys)]
    return np.unique(keys, return_counts=True)


def learn_languages(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, order: int = ORDER) -> dict:
    """The frozen statistics: names and, for strings of 1 to order + 1 bytes, what is seen how often in each language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return {"names": [], "order": order, "seen": []}
    share = F.create_map(*[F.lit(x) for lang, n in there.items() for x in (lang, min(1.0, 1.5 * per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    few = rows.where(draw < share[F.col("lang")]).select("lang", "text", "doc_id")
    few = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))).where(F.col("k") <= per_language)

    def counts(batches):
        seen: dict = {}
        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text, strict=True):
                raw = text.encode("utf-8", "replace")
                for size in range(1, order + 2):
                    mine = seen.setdefault((lang, size), {})
                    for k, n in zip(*(x.tolist() for x in strings(raw, size)), strict=True):
                        mine[k] = mine.get(k, 0) + n
        for (lang, size), mine in seen.items():
            yield pd.DataFrame({"lang": lang, "size": size, "key": list(mine), "n": list(mine.values())})

    got = few.select("lang", "text").mapInPandas(counts, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got.lang.unique())
    return {"names": names, "order": order, "seen": [[(m.key.to_numpy("i8"), m.n.to_numpy("i8")) for name in names for m in (got[(got.lang == name) & (got["size"] == size)],)] for size in range(1, order + 2)]}


class Trees:
    """All languages' trees, laid over each other.

    Level k (0 to order + 1) has one node for each string of k bytes that any language has; nodes are numbered level by
    level from the empty string, node 0. A node's code length in a language is that of its last byte after those before it.
    """

    def __init__(self, model: dict):
        names, self.order = model["names"], model["order"]
        many, keys = len(names), [np.zeros(1, "i8")]
        for level in model["seen"]:
            keys.append(np.unique(np.concatenate([k for k, _ in level])))
        self.first = np.cumsum([0, *map(len, keys)])
        find = lambda level, what: np.searchsorted(keys[level], what)
        bits, escapes, prefixes, cuts = [np.full((1, many), 8.0)], [], [np.zeros(1, "i8")], [np.zeros(1, "i8")]
        likely = np.full((1, many), 1 / 256)  # of the level before
        for k in range(1, len(keys)):
            context, shorter = find(k - 1, keys[k] >> 8), find(k - 1, keys[k] & ((1 << 8 * (k - 1)) - 1))
            n = np.zeros((len(keys[k]), many))
            for j, (what, often) in enumerate(model["seen"][k - 1]):
                n[find(k, what), j] = often
            # In the context one shorter, of which there is none above the first level.
            below = likely[shorter] if k > 1 else np.full((len(n), many), 1 / 256)
            total, kinds, gone = (np.zeros((len(keys[k - 1]), many)) for _ in range(3))
            np.add.at(total, context, n)
            np.add.at(kinds, context, n > 0)
            np.add.at(gone, context, np.where(n > 0, below, 0))
            rest = 1 - gone
            kinds[rest < 1e-9] = 0  # nothing is left to escape to
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, kinds / (total + kinds) / np.where(rest < 1e-9, 1, rest), 1)
                likely = np.where(n > 0, n / (total + kinds)[context], escape[context] * below)
                bits.append(np.minimum(-np.log2(likely), 64))
                own = np.minimum(-np.log2(escape), 64)
            # All escapes from a context down to the empty one.
            if k > 1:
                own = own + escapes[-1][find(k - 2, keys[k - 1] & ((1 << 8 * (k - 2)) - 1))]
            escapes.append(own)
            prefixes.append(self.first[k - 1] + context)
            cuts.append(self.first[k] + np.arange(len(keys[k])) if k <= self.order else self.first[k - 1] + shorter)
        escapes = np.concatenate(escapes)
        prefix, cut = np.concatenate(prefixes), np.concatenate(cuts)
        # What a match at one byte adds: its own length, less the escapes that its context didn't need, and the escapes
        # of the context that it is for the next byte.
        own = np.concatenate(bits)
        own[1:] -= escapes[prefix[1:]]
        self.start, self.last, self.each = escapes[0], escapes[cut].astype("f4"), (own + escapes[cut]).astype("f4")
        # Steps: from a string of k bytes and one more byte to the string of all; 0 where there is none.
        self.steps = []
        for k in range(len(keys) - 1):
            have = (find(k, keys[k + 1] >> 8) << 8) | (keys[k + 1] & 255)
            if len(keys[k]) << 8 <= FULL:
                table = np.zeros(len(keys[k]) << 8, "i4")
                table[have] = np.arange(1, len(have) + 1)
                self.steps.append((table, None))
            else:
                self.steps.append((np.arange(1, len(have) + 1, dtype="i4"), have))

    def matches(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The longest node at each byte of texts that lie one after the other; none goes across a start."""
        found, before = np.zeros(len(raw), "i4"), np.ones(len(raw), "i4")
        for k, (table, have) in enumerate(self.steps):
            # before: 1 and up is a string of k bytes that ends before this byte, 0 is none.
            where = np.flatnonzero(before)
            at = ((before[where].astype("i8") - 1) << 8) | raw[where]
            if have is None:
                here = table[at]
            else:
                i = np.minimum(np.searchsorted(have, at), len(have) - 1)
                here = np.where(have[i] == at, table[i], 0)
            found[where] = np.where(here > 0, self.first[k + 1] + here - 1, found[where])
            now = np.zeros(len(raw), "i4")
            now[where] = here
            before = np.concatenate([[0], now[:-1]]).astype("i4")
            before[starts] = 0
        return found

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each (non-empty) text in each language."""
        starts = np.cumsum([0, *map(len, texts[:-1])])
        raw = np.frombuffer(b"".join(texts), "u1")
        found = self.matches(raw, starts)
        ends = np.append(starts[1:], len(raw)) - 1
        out = self.start - self.last[found[ends]].astype("f8")
        if len(texts) > 1:
            return out + np.add.reduceat(self.each[found], starts, axis=0)
        for lo in range(0, len(found), BLOCK):  # one giant text: block after block
            out[0] += self.each[found[lo : lo + BLOCK]].sum(0, dtype="f8")
        return out


_compiled: dict = {}


def compiled(model: dict, key: str) -> Trees:
    """The trees, once a worker."""
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Trees(model)
    return _compiled[key]


def predict(texts: list[str | None], model: dict, key: str) -> tuple[list[str], list[float]]:
    names = model["names"]
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if names else []
    at = 0
    while at < len(todo):
        part, raw, size = [], [], 0
        while at < len(todo) and (not part or size < BLOCK):
            part.append(todo[at])
            raw.append(texts[todo[at]].encode("utf-8", "replace"))
            size += len(raw[-1])
            at += 1
        bits = compiled(model, key).lengths(raw)
        best = bits.argmin(1)
        odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
        for i, b, s in zip(part, best, 1 / odds.sum(1), strict=True):
            langs[i], scores[i] = names[b], float(s)
    return langs, scores


def predict_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of the shortest code among all languages, as probabilities)."""
    key = uuid.uuid4().hex

    def run(batches):
        for pdf in batches:
            langs, scores = predict([t if isinstance(t, str) else None for t in pdf.text], model, key)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "lang_pred": langs, "score": scores})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn_languages(docs, fold("doc_id", 4) != 2)
    return predict_languages(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
