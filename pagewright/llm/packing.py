"""Best-fit packing of tokenised documents into sequences of fixed capacity, with large-item matching.

Only the number of pieces of each length decides how to pack, so the plan is made from a histogram with at most
`capacity` entries, whatever the number of documents. Lengths above a third of the capacity are matched first:
greedily, from the longest down, each with the longest one that still fits beside it, so at most two share a
sequence. Shorter ones then go, from the longest down, to the smallest gap that takes them; what is left opens new
sequences. Pieces find their place by their rank among the pieces of their length; ranks are counted within hash
buckets first, as many as the commonest length asks for, so that a length which many pieces share is never in one task.

Edge cases: null text counts as empty; every document ends with the id that closes it, so an empty one is one token
long; documents longer than the capacity are cut into full pieces and a rest; rows that repeat, or share an id, are
packed each on its own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import os
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.llm.common import remember
from pagewright.session import stored

CAPACITY, CLOSE = 4096, 1
#: Pieces of a length in a hash bucket, about, within which ranks are counted; words that a worker remembers; entries of a plan that may go to every task.
BUCKET, MEMORY, MOST_STEPS = 20_000, 700_000, 4_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of texts word by word: no token goes across a space or a line end."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.stops = {c: np.array(self.model.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ".,"}

    def packed(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        if new := set().union(*parts).difference(known):
            extra = self.encoded(new)
            if len(known) + len(extra) <= self.memory:
                known.update(extra)
            else:
                return [b"".join([known[w] if w in known else extra[w] for w in p]) for p in parts]
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def encoded(self, new: set[str]) -> dict[str, bytes]:
        """Many new words are known ones with a capital or a stop: letters and stops are coded apart, in lower case."""
        known, stops, plain, odd = self.known, self.stops, {}, []
        for w in new:
            stem, stop = (w[:-1], stops[w[-1]]) if w[-1] in stops else (w, b"")
            if stem.isalpha() and not ("Σ" in stem or "İ" in stem):
                plain[w] = stem.lower(), stop
            else:
                odd.append(w)
        fresh = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(odd, self.model.encode_batch_fast(odd, add_special_tokens=False), strict=True)}
        stems = list({stem for stem, _ in plain.values()}.difference(known))
        for lo in range(0, len(stems), 1000):
            part = stems[lo : lo + 1000]
            # Words of letters are one unit each, whose last token alone ends a word.
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't code words of letters apart")
            raw = ids.tobytes()
            fresh.update((w, raw[4 * x : 4 * y]) for w, x, y in zip(part, [0, *ends], ends, strict=False))
        for w, (stem, stop) in plain.items():
            fresh[w] = (known[stem] if stem in known else fresh[stem]) + stop
        return fresh


_loaded: dict[tuple[str, int], Words] = {}


def loaded(path: str, memory: int) -> Words:
    remember(_loaded)
    if (path, memory) not in _loaded:
        _loaded.clear()
        _loaded[path, memory] = Words(path, memory)
    return _loaded[path, memory]


def tokenised(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, close: int = CLOSE, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; if asked for, also ids (little-endian 32-bit numbers) and piece_key,
    which tells every piece of the table from all others once it is stored."""
    path, end = tokenizer or default_tokenizer(), np.array([close], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary, piece_key binary" * ids

    def run(batches):
        words = loaded(path, memory)
        for pdf in batches:
            keys, texts = pdf.doc_id.astype("Int64"), [t if isinstance(t, str) else "" for t in pdf.text]
            for lo in range(0, len(pdf), 256):
                out = []
                for d, raw in zip(keys[lo : lo + 256], words.packed(texts[lo : lo + 256]), strict=True):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        out.append((d, p, at // 4, len(part) // 4, zlib.crc32(part), *([part, uuid.uuid4().bytes] if ids else [])))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids", "piece_key"] * ids]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, number of sequences, pieces in each, first sequence, offset), by length and rank.

    A step puts `pieces in each` pieces of one length into each of a run of sequences, from `offset` on.
    """
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = {}
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    sizes: list[int] = []
    n_seq = 0

    def put(n, runs, each, offset):
        steps.append((n, used.get(n, 0), runs[1], each, runs[0], offset))
        used[n] = used.get(n, 0) + runs[1] * each

    def free(gap, run):
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append(run)

    # Matching: keys above a third, longest first, each with the longest partner that fits.
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        count = left[a]
        i = bisect.bisect_right(large, capacity - a) - 1
        if i < 0:
            b, pairs = 0, count
        elif (b := large[i]) == a:
            b, pairs = (a, count // 2) if count > 1 else (0, 1)
            if b == 0 and i > 0:  # the last one of its length meets the next length below
                b = large[i - 1]
        else:
            pairs = min(count, left[b])
        run = (n_seq, pairs)
        n_seq += pairs
        if b == a:
            put(a, run, 2, 0)
        else:
            put(a, run, 1, 0)
            if b:
                put(b, run, 1, a)
        free(capacity - a - b, run)
        for n, took in ((a, pairs * (2 if a == b else 1)), (b, pairs if b and b != a else 0)):
            if took:
                left[n] -= took
                if not left[n]:
                    large.pop(bisect.bisect_left(large, n))
    # Best fit: the smallest gap that takes the piece; having taken one, it is smaller still.
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                each = capacity // n
                full = max(1, count // each)
                run = (n_seq, full)
                n_seq += full
                free(capacity, run)
                continue
            gap = sizes[i]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
            each = min(gap // n, count)
            take = min(many, count // each)
            if take < many:
                free(gap, (first + take, many - take))
            put(n, (first, take), each, capacity - gap)
            free(gap - each * n, (first, take))
            count -= take * each
    return sorted(steps)


def packed(pieces: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) and their sequence_id and offset. Stored pieces with ids keep them: these
    are left out of all sorts, and meet their places by piece_key in a join that doesn't sort them either."""
    whole, pieces = pieces, pieces.drop("ids")
    keys = ["doc_id", "piece", "ids_crc32", "start"]
    # One row for each length at most: bounded by the capacity.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = plan(histogram, capacity)
    if len(steps) > MOST_STEPS:
        raise ValueError(f"the plan has {len(steps)} steps; choose a smaller capacity")
    buckets = max(1, -(-max(histogram.values(), default=1) // bucket))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "bucket", before.alias("before"))
    length, first, _, each, seq, offset = np.array(steps, "i8").reshape(-1, 6).T
    key = (length << 44) | first

    # Rows that repeat within a bucket stay together; their rank follows all of the bucket's keys.
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*keys)) - 1
    ranked = rows.withColumn("r", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r"))

    # Only these two columns go to Python; ids stay where they are.
    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy("i8"), r.to_numpy("i8")
        at = np.searchsorted(key, (n << 44) | r, "right") - 1
        q = r - first[at]
        return pd.DataFrame({"sequence_id": seq[at] + q // each[at], "offset": offset[at] + q % each[at] * n})

    names = [c for c in pieces.columns if c != "piece_key"]
    placed = ranked.select(*pieces.columns, place("length", "rank").alias("at")).select(*pieces.columns, "at.*")
    if "ids" not in whole.columns:
        return placed
    met = whole.select("piece_key", "ids").join(placed.hint("shuffle_hash"), "piece_key")
    return met.select(*names, "ids", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """The pieces of docs and their places; with ids, what is trained on: each piece's token ids."""
    return packed(stored(tokenised(docs, tokenizer, capacity, ids=ids, memory=memory), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
