"""N-gram Jaccard join by MinHash banding, down to one class a document.

Texts with the same set of word n-grams are one node, whatever their number. Each node's MinHash signature is cut
into bands, whose number and rows are chosen for a target recall; nodes meet by a shuffle on the bands' hashes. Within
a bucket every node is tested against the bucket's smallest node (its hub), on the full sets; small buckets test all
their nodes against each other. Nodes of a larger bucket that haven't come into their hub's class that way are tested
exactly, against all nodes of their bucket that are in another class: in blocks of about BLOCK n-grams a side, within
which the sets' common n-grams are counted without a row for any pair, so only links come out. So no two nodes that
meet in a bucket and are linked end in different classes. Classes are the connected components of the links found, by
repeated contraction onto the smallest neighbour (nodes are named by hashes, so a constant share goes each time). Links
are counted last: all pairs of a class are tested in blocks, whatever buckets they met in.

Edge cases: rows with a null id take no part (class and links null); null texts and texts without a word are a class
each; texts of fewer than n words are linked only to equal ones; rows that repeat are each returned; rows that share an
id with different texts are told apart (their classes may show the same id); an empty table gives no rows; other columns
of the input are ignored by classes() and kept by one_of_each(), whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import WORD, hot_left_join, remember, small_batches
from pagewright.session import Scratch, stored

N, SIMILAR, RECALL, HASHES = 5, 0.8, 0.9995, 128
#: Buckets up to this size test all their pairs; pairs that share a copy of their hub's set; words that a worker remembers.
SMALL, SHARE, MEMORY = 8, 128, 200_000
#: n-grams of a block, about, on each side of the exact test.
BLOCK = 1 << 18
#: Least and largest number of bits, and bits for each id, of the filter that goes before the join with the texts.
BITS = 1 << 16, 1 << 28, 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def banding(similar: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at the least similarity are still met at the target recall."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)) if similar < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY:
            self[word] = found
        return found


_hashes = WordHashes()


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted hashes of the text's different word n-grams; of all its words together, if they are fewer than n."""
    ws = WORD.findall(text.lower()) if isinstance(text, str) else []
    if not ws:
        return np.empty(0, "u8")
    remember(_hashes)
    h = np.fromiter(map(_hashes.__getitem__, ws), "u8", len(ws))
    size = min(n, len(ws))
    out = np.full(len(h) - size + 1, size if len(ws) < n else n, "u8")
    for i in range(size):
        out = (out ^ h[i : len(h) - size + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band."""
    draw = np.random.default_rng(20240229)
    flips = draw.integers(0, 1 << 32, bands * rows, dtype="u4")
    factors = draw.integers(0, 1 << 31, bands * rows, dtype="u4") * np.uint32(2) + np.uint32(1)
    h = (grams >> np.uint64(32)).astype("u4")
    least = np.full(bands * rows, 0xFFFFFFFF, "u4")
    for lo in range(0, len(h), 2048):
        np.minimum(least, ((h[lo : lo + 2048, None] ^ flips) * factors).min(0), out=least)
    out = np.arange(1, bands + 1, dtype="u8") * MIX
    for column in least.reshape(bands, rows).T:
        out = (out ^ column) * MIX
        out ^= out >> np.uint64(31)
    return out.view("i8")


def node_of(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def sketches(docs: DataFrame, n: int, bands: int, rows: int, similar: float) -> DataFrame:
    # Sets smaller than this are similar enough only to equal ones.
    least = similar / (1 - similar) - 1e-9 if similar < 1 else math.inf

    def run(batches):
        for pdf in batches:
            nodes, keys, sizes = [], [], []
            for t in pdf.text:
                g = gram_set(t, n)
                nodes.append(node_of(g))
                sizes.append(len(g))
                keys.append(signature(g, bands, rows) if len(g) >= least else None)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "fp": pdf.fp, "node": nodes, "n_grams": sizes, "bands": keys})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).mapInPandas(run, "doc_id long, fp long, node binary, n_grams long, bands array<long>")


def filtered(docs: DataFrame, ids: DataFrame, many: int) -> DataFrame:
    """docs whose id may be among ids, `many` of them: by a bitmap, which alone is broadcast; its largest size is fixed."""
    least, most, each = BITS
    width = min(most, max(least, 1 << (each * max(many, 1)).bit_length()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(width))
    bits = ids.select(h.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
    met = docs.withColumn("h", h).join(F.broadcast(bits), F.floor(F.col("h") / 64) == F.col("w"))
    return met.where(F.expr("(shiftright(bits, cast(h % 64 as int)) & 1L) = 1L")).select("doc_id", "text")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node and its set, for the wanted nodes (a stored table), each read from its first document."""
    texts = filtered(docs, wanted.select("doc_id"), wanted.count()).join(wanted, "doc_id").select("node", "text")

    def run(batches):
        for pdf in batches:
            got = [(node, g.tobytes()) for node, t in zip(pdf.node, pdf.text, strict=True) if node_of(g := gram_set(t, n)) == node]
            yield pd.DataFrame(got, columns=["node", "grams"])

    return texts.mapInPandas(run, "node binary, grams binary").dropDuplicates(["node"])


def links_of(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """a, b of the stored pairs (a, b, cnt) that are similar enough. The set of a hub with many pairs is dealt out in copies."""
    pairs = pairs.withColumn("copies", F.ceil(F.col("cnt") / SHARE)).withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies"))).drop("cnt")
    hubs = pairs.groupBy("a", "copies", "copy").agg(F.count("*").alias("_n")).drop("_n").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").join(hubs, ["a", "copies", "copy"]).select("a", "b", "x", "y")

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf.x, pdf.y, strict=True):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                # No set can share more than the smaller one has.
                possible = min(len(x), len(y)) >= similar * max(len(x), len(y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if possible else 0
                keep.append(possible and common / (len(x) + len(y) - common) >= similar)
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a binary, b binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the same for a whole component) of every node in links (a, b)."""
    edges, labels = scratch.stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges"), None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.stored(both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("a", "least").alias("parent"), "n"), "parents")
        step = lambda rows, key, n="n": hot_left_join(rows, parents.select(F.col("node").alias(key), "n", "parent"), key, "n", key, ["parent"])  # noqa: E731, B023
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            labels = scratch.stored(step(labels, "label").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        left = step(edges, "a").select(F.col("parent").alias("pa"), "b")
        moved = step(left, "b").select(F.least("pa", "parent").alias("a"), F.greatest("pa", "parent").alias("b")).where("a <> b")
        edges = scratch.stored(moved.distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def first_pairs(members: DataFrame, most: int) -> DataFrame:
    """(a, b, cnt), each once: all pairs in buckets of at most `most` nodes, hub and node in larger ones."""
    lists = members.where((F.col("cnt") > 2) & (F.col("cnt") <= most)).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    small = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b", F.lit(1).cast("long").alias("cnt"))
    under_hub = members.where("node <> hub AND (cnt = 2 OR cnt > %d)" % most).select(F.col("hub").alias("a"), F.col("node").alias("b"), "cnt")
    return small.union(under_hub).groupBy("a", "b").agg(F.max("cnt").alias("cnt"))


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (key, node, hub, cnt) with node_label and hub_label; nodes without a link are their own class."""
    sized = hot_left_join(labels, labels.groupBy("label").agg(F.count("*").alias("n")), "label", "n", "node", ["n"])
    for key, spread in (("hub", "node"), ("node", "key")):
        named = sized.select(F.col("node").alias(key), "n", F.col("label").alias(f"{key}_label"))
        members = hot_left_join(members, named, key, "n", spread, [f"{key}_label"]).withColumn(f"{key}_label", F.coalesce(f"{key}_label", key))
    return members


def common_counts(x: np.ndarray, values: np.ndarray, owners: np.ndarray, many: int) -> np.ndarray:
    """How many of x's hashes each of `many` sets has; values are all their hashes, sorted, beside their owners."""
    lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
    runs = hi - lo
    at = np.arange(runs.sum()) + np.repeat(lo - np.cumsum(runs) + runs, runs)
    return np.bincount(owners[at], minlength=many)


class Block:
    """Sets of n-grams side by side, to be met by one set at a time."""

    def __init__(self, grams: list[bytes]):
        sets = [np.frombuffer(g, "u8") for g in grams]
        self.sizes, values = np.array([len(g) for g in sets]), np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similarities(self, grams: bytes) -> np.ndarray:
        g = np.frombuffer(grams, "u8")
        common = common_counts(g, self.values, self.owners, len(self.sizes))
        return common / (len(g) + self.sizes - common)


def completed(marked: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """a, b: labels of classes that links join, between a node that is apart from its hub's class and a node of its bucket in
    another class: of each group's links as many as hold its classes together.

    marked: key, node, node_label, hub_label, n_grams. Both sides are dealt out into blocks by hash, and each pair of blocks
    is a group of its own, so that no bucket goes to one task and memory is bounded by a block's sets.
    """
    apart = F.col("node_label") != F.col("hub_label")
    blocks = lambda grams: F.greatest(F.ceil(grams / BLOCK), F.lit(1).cast("long"))
    counts = marked.groupBy("key").agg(F.count("*").alias("all"), blocks(F.sum("n_grams")).alias("columns"), blocks(F.sum(F.when(apart, F.col("n_grams")))).alias("rows"), F.count_if(apart).alias("apart")).where("apart > 0")
    met = hot_left_join(marked, counts, "key", "all", "node", ["columns", "rows", "apart"]).where("apart IS NOT NULL")
    met = met.select("key", "node", F.col("node_label").alias("label"), apart.alias("is_apart"), "columns", "rows").join(sets, "node")
    here = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = met.where("is_apart").withColumn("i", here("rows")).withColumn("j", every("columns"))
    right = met.withColumn("j", here("columns")).withColumn("i", every("rows"))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).select("key", "i", "j", "side", "node", "label", "grams")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, out = pdf[pdf.side == 0], pdf[pdf.side == 1], []
        if len(x) and len(y):
            block = Block(list(y.grams))
            names, at = np.unique(pdf.label.to_numpy(), return_inverse=True)
            mine, theirs = at[(pdf.side == 0).to_numpy()], at[(pdf.side == 1).to_numpy()]
            # Of the links between classes only those come out that join what no other link here has joined.
            part = np.arange(len(names))
            for k, g in zip(mine, x.grams, strict=True):
                for j in np.unique(theirs[block.similarities(g) >= similar]):
                    if part[j] != part[k]:
                        out.append((min(names[j], names[k]), max(names[j], names[k])))
                        part[part == part[j]] = part[k]
        return pd.DataFrame(out, columns=["a", "b"])

    return both.groupBy("key", "i", "j").applyInPandas(run, "a binary, b binary").distinct()


def degrees(labels: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """node and n_links: how many texts of its class each node is linked to, each pair of a class tested on the full sets.

    labels: node, label, n_grams. The nodes of a class are dealt out into blocks by hash, and each pair of blocks is a group
    of its own, which gives one count a node and no row for a link; so no class goes to one task. The work grows with the
    square of a class's texts.
    """
    sized = hot_left_join(labels, labels.groupBy("label").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.sum("n_grams") / BLOCK), F.lit(1).cast("long")).alias("blocks")), "label", "n", "node", ["n", "blocks"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    met = sized.where("n > 2").join(sets, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "grams")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        x, y = pdf[pdf.own == i], pdf[pdf.own == j]
        ours, theirs = np.zeros(len(x), "i8"), np.zeros(len(y), "i8")
        if len(x) and len(y):
            block = Block(list(y.grams))
            for k, g in enumerate(x.grams):
                alike = block.similarities(g) >= similar
                if i == j:
                    alike[k] = False
                ours[k] = alike.sum()
                theirs += alike
        # Within a block each pair is met from both sides.
        counts = [(x, ours)] if i == j else [(x, ours), (y, theirs)]
        return pd.concat([pd.DataFrame({"node": side.node.to_numpy(), "n_links": n}) for side, n in counts])

    many = met.groupBy("label", "i", "j").applyInPandas(run, "node binary, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return many.unionByName(sized.where("n = 2").select("node", F.lit(1).cast("long").alias("n_links")))


def classified(docs: DataFrame, n: int, similar: float, recall: float, hashes: int) -> DataFrame:
    """doc_id, fp (a hash of the text), label (null for texts without a word), class_id, n_links, n_copies of docs (doc_id, text)."""
    bands, rows = banding(similar, recall, hashes)
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        told = scratch.stored(sketches(docs, n, bands, rows, similar), "sketches", keep=True)
        nodes = told.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.any_value("n_grams").alias("n_grams"), F.any_value("bands").alias("bands"))
        nodes = scratch.stored(nodes, "nodes")
        at = nodes.select("node", "n_grams", F.explode("bands").alias("key"))
        buckets = at.groupBy("key").agg(F.count("*").alias("cnt"), F.min("node").alias("hub")).where("cnt > 1")
        members = scratch.stored(hot_left_join(at, scratch.stored(buckets, "buckets"), "key", "cnt", "node", ["hub", "cnt"]).where("hub IS NOT NULL"), "members")
        wanted = scratch.stored(nodes.select("node", "doc_id").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
        sets = scratch.stored(full_sets(docs, wanted, n), "sets")
        pairs = scratch.stored(first_pairs(members, SMALL), "pairs")
        labels = components(links_of(pairs, sets, similar), scratch)
        larger = members.where(F.col("cnt") > SMALL)
        if not larger.isEmpty():
            joined = components(completed(scratch.stored(with_labels(larger, labels), "marked"), sets, similar), scratch).select(F.col("node").alias("old"), F.col("label").alias("new"))
            # A class that is joined to others takes their label; so does a node that was alone, whose label is its own name.
            size = joined.join(labels.groupBy(F.col("label").alias("old")).agg(F.count("*").alias("n")), "old", "left").select(F.col("old").alias("label"), "new", F.coalesce("n", F.lit(1)).cast("long").alias("n"))
            moved = hot_left_join(labels, scratch.stored(size, "joined"), "label", "n", "node", ["new"]).select("node", F.coalesce("new", "label").alias("label"))
            lone = joined.join(labels.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
            labels = scratch.stored(moved.unionByName(lone), "labels")
        labels = scratch.stored(labels.join(nodes.select("node", "doc_id", "n_grams"), "node"), "labelled")
        linked = scratch.stored(labels.join(degrees(labels.select("node", "label", "n_grams"), sets, similar), "node").select("node", "doc_id", "label", "n_links"), "linked")
        first = linked.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
        linked = hot_left_join(linked, first, "label", "size", "node", ["class_id"]).select("node", "label", "class_id", "n_links")
        whole = nodes.select("node", "doc_id", "copies").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies"))
        whole = scratch.stored(whole, "classes", keep=True)
    out = hot_left_join(told.select("doc_id", "fp", "node"), whole, "node", "n_copies", "doc_id", ["label", "class_id", "n_links", "n_copies"])
    known, alone = F.col("doc_id").isNotNull(), F.col("doc_id").isNotNull() & F.col("node").isNull()
    only = lambda c, own: F.when(alone, own).when(known, F.col(c)).cast("long").alias(c)
    return out.select("doc_id", "fp", F.when(known, F.col("label")).alias("label"), only("class_id", F.col("doc_id")), only("n_links", F.lit(0)), only("n_copies", F.lit(1)))


def classes(docs: DataFrame, n: int = N, similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of the class), n_links (other texts of the class that its text is linked to), n_copies."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return classified(few, n, similar, recall, hashes).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, n: int = N, similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that with the smallest id (of rows with the same id: by hash of the text, of equal
    rows any one, of rows that differ elsewhere the smallest as JSON). Rows with a null id and texts without a word stay."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(classified(few, n, similar, recall, hashes), "classified")
    chosen = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.*")
    many = found.join(chosen, ["doc_id", "fp"], "left_semi").groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    bare = found.where("label IS NULL").select("doc_id", "fp", F.lit(1).cast("long").alias("n")).where("doc_id IS NOT NULL").distinct()
    tag = "_kept"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    keep = many.unionByName(bare).select(F.col("doc_id").alias(f"{tag}_id"), F.col("fp").alias(f"{tag}_fp"), F.col("n").alias(f"{tag}_n"))
    met = docs.join(keep, (F.col(id_col).cast("long") == F.col(f"{tag}_id")) & (F.xxhash64(text_col) == F.col(f"{tag}_fp")))
    again = met.where(F.col(f"{tag}_n") > 1)
    row = F.struct(*docs.columns)
    # Rows that repeat are brought down to one by partial sums, so that a row of any number of copies is no single task's.
    single = again.groupBy(f"{tag}_id", f"{tag}_fp").agg(F.min_by(row, F.to_json(row)).alias(tag)).select(f"{tag}.*")
    return met.where(F.col(f"{tag}_n") == 1).select(*docs.columns).unionByName(single).unionByName(docs.where(F.col(id_col).isNull()))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
