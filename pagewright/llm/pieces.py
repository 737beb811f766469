"""SentencePiece encoding and decoding as a max-plus parallel scan.

A sequence of pieces is the byte-pair encoding of a text exactly when each piece encodes to itself and each two
neighbours encode to themselves. So encoding is a best-path problem whose edges weigh 0 (the two pieces may stand
side by side) or minus infinity, over nodes (piece, place). A giant text is cut into chunks at any character. The
state at a cut is the piece that covers the character before it. Each chunk yields, on its own, the max-plus
transfer matrix from the states at its left cut to those at its right cut. The matrices of a text are multiplied in a tree,
FAN neighbours at a time and level by level, so that a text of any number of chunks spreads over tasks; back down the tree,
the states at a product's two ends tell those at the cuts within it, and each chunk is then traced back on its own between
its two states. Short texts are one chunk.

Edge cases: null text counts as empty; empty text gives no ids; characters that no piece has become byte pieces;
a literal U+2581 decodes to a space, as in the public library; repeated rows are each returned, other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import stored

BAR = "▁"
NEVER = -np.inf
#: Characters of a chunk, of the context that a chunk sees on either side, and words that a worker remembers.
CHUNK, MEMORY = 32_768, 800_000
#: Neighbouring matrices that are multiplied in one group.
FAN = 8


class Memo(dict):
    """word -> little-endian ids, computed once; full, it computes without keeping."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, word):
        found = self.compute(word)
        if len(self) < MEMORY:
            self[word] = found
        return found


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.rank = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = {i: p.replace(BAR, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.ids))
        self.inside = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        # Pieces that encode to themselves, and all beginnings of theirs.
        self.coded = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.starts = {p[:i] for p in self.coded for i in range(1, len(p) + 1)}
        self.side_by_side: dict[tuple[str, str], bool] = {}
        # Words can be told apart by spaces and line ends if no piece goes across them.
        self.by_words = not any("\n" in x or (x[1] == BAR and x[0] != BAR) for x in self.inside)
        self.word = Memo(self.packed)

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition, for texts of a few characters."""
        parts = list(text)
        while True:
            best = max(((self.rank[x], -i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.rank), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Weight 0 rather than minus infinity."""
        if a[-1] + b[0] not in self.inside:
            return True
        if (found := self.side_by_side.get((a, b))) is None:
            if len(self.side_by_side) > MEMORY:
                self.side_by_side.clear()
            found = self.side_by_side[a, b] = self.merged(a + b) == [a, b]
        return found

    def forward(self, text: str, begin: int, end: int, before: str | None) -> list[str | None]:
        """For each place up to end, the piece that ends there on the finite path from begin (after piece `before`), if any."""
        last: list[str | None] = [None] * (end + 1)
        coded, starts, inside, known = self.coded, self.starts, self.inside, self.side_by_side
        for j in range(begin, end):
            if (left := last[j]) is None and j > begin:
                continue
            if left is None:
                left = before
            free = left is None or left[-1] + text[j] not in inside
            if last[j + 1] is None and (free or self.fits(left, text[j])):
                last[j + 1] = text[j]
            for i in range(j + 2, min(end, j + self.longest) + 1):
                piece = text[j:i]
                if piece not in starts:
                    break
                if piece in coded and last[i] is None:
                    if free or (fit := known.get((left, piece))) or (fit is None and self.fits(left, piece)):
                        last[i] = piece
        return last

    def back(self, last: list[str | None], begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def pack(self, pieces: list[str]) -> bytes:
        ids = []
        for p in pieces:
            if p in self.ids:
                ids.append(self.ids[p])
            else:
                ids += [self.bytes[b] for b in p.encode()]
        return np.array(ids, "<u4").tobytes()

    def packed(self, segment: str) -> bytes:
        """Ids of a text that may stand on its own."""
        if len(segment) > 1 and self.by_words and segment[-2:] not in self.inside:  # a stop after a word
            return self.word[segment[:-1]] + self.word[segment[-1]]
        return self.pack(self.back(self.forward(segment, 0, len(segment), None), 0, len(segment)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        if not text:
            return b""
        return self.free((BAR + text).replace(" ", BAR))

    def free(self, s: str) -> bytes:
        """Ids of escaped text between two places where a piece must begin and end."""
        if not self.by_words:
            return self.packed(s)
        word, out = self.word, []
        for i, line in enumerate(s.split("\n")):
            if i:
                out.append(word["\n"])
            if not line:
                continue
            if BAR * 2 in line or line[-1] == BAR:
                out += map(word.__getitem__, re.findall(f"{BAR}*[^{BAR}]+|{BAR}+", line))
            else:
                first, *rest = line.split(BAR)
                if first:
                    out.append(word[first])
                out += [word[BAR + w] for w in rest]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text, with the space that encoding puts before it."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))

    # Chunks. s: escaped text around the chunk; its cuts lie at lo and hi in s.

    def states(self, s: str, cut: int) -> list[tuple[int, int]]:
        """Places, from the cut, of the pieces that may cover the character before it."""
        return [(a - cut, b - cut) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(s), a + self.longest) + 1) if b - a == 1 or s[a:b] in self.coded]

    def forced(self, s: str, begin: int, end: int) -> int:
        """The first place from begin on where no piece can cross, or end."""
        return next((i for i in range(begin, end) if 0 < i < len(s) and s[i - 1 : i + 1] not in self.inside), end)

    def transfer(self, s: str, lo: int, hi: int, opening: bool, closing: bool) -> np.ndarray:
        """Max-plus transfer matrix of a chunk. The text's start and end are one state each."""
        into = [(0, 0)] if opening else self.states(s, lo)
        out = [(0, 0)] if closing else self.states(s, hi)
        matrix = np.full((len(into), len(out)), NEVER)
        reach = hi if closing else min(len(s), hi + self.longest)
        # Every path goes through each place that no piece can cross: up to the first one rows differ, from the last one columns do.
        meet = self.forced(s, min(lo + self.longest, hi), hi)
        leave = next((i for i in range(hi - 1, meet, -1) if s[i - 1 : i + 1] not in self.inside), meet)
        common = self.forward(s, leave, reach, None) if meet < hi else None
        for r, (a, b) in enumerate(into):
            before, begin = None if opening else s[lo + a : lo + b], lo + b
            if common is None:
                last, at = self.forward(s, begin, reach, before), begin
            elif begin == meet or self.forward(s, begin, meet, before)[meet] is not None:
                last, at = common, leave
            else:
                continue
            for k, (x, y) in enumerate(out):
                if closing:
                    matrix[r, k] = 0 if at == hi or last[hi] is not None else NEVER
                elif (hi + x, hi + y) == (lo + a, lo + b) or (hi + y <= reach and hi + x >= at and last[hi + y] == s[hi + x : hi + y]):
                    matrix[r, k] = 0
        return matrix

    def trace(self, s: str, begin: int, end: int, before: str | None) -> bytes:
        """Ids after the piece that ends at begin, up to the one that ends at end."""
        if begin == end:
            return b""
        meet = self.forced(s, begin + 1, end)
        # Up to the first place that none can cross, and from the last one: within, words stand on their own.
        tail = next((i for i in range(end - 1, meet, -1) if s[i - 1 : i + 1] not in self.inside), meet)
        head = self.pack(self.back(self.forward(s, begin, meet, before), begin, meet))
        return head + (self.free(s[meet:tail]) if tail > meet else b"") + (self.packed(s[tail:end]) if tail < end else b"")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[:, :, None] + b[None]).max(1) if a.shape[1] else np.full((len(a), b.shape[1]), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = times(out, m)
    return out


def inner_states(matrices: list[np.ndarray], left: int, right: int) -> list[int]:
    """The state at each cut between neighbouring matrices on a best path from state `left` before to `right` after them all."""
    ahead = [matrices[0][left]]
    for m in matrices[1:-1]:
        ahead.append((ahead[-1][:, None] + m).max(0))
    out: list[int] = []
    for k in range(len(matrices) - 1, 0, -1):
        right = int((ahead[k - 1] + matrices[k][:, right]).argmax())
        out.append(right)
    return out[::-1]


@lru_cache(2)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def crc32_joined(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the second one's length. Associative."""

    def square(m):
        return [apply(m, x) for x in m]

    def apply(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = square(square([0xEDB88320] + [1 << i for i in range(31)]))
    while length:
        m = square(m)
        if length & 1:
            a = apply(m, a)
        length >>= 1
    return a ^ b


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables, of texts of up to `chunk` characters and of longer ones, which are scanned.

    Both: row (tells the longer ones apart, else null), doc_id, chunk_no, ids (array<int>), decoded (the chunk's part
    of the text, decoded from its ids). With digests, in place of the last two: n_ids, ids_crc32, decoded_chars,
    decoded_bytes, decoded_crc32.
    """
    model = model or default_model()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    schema = "row string, doc_id long, chunk_no int, " + ("n_ids long, ids_crc32 long, decoded_chars long, decoded_bytes long, decoded_crc32 long" if digests else "ids array<int>, decoded string")

    def told(p, row, doc_id, chunk_no, packed, first):
        ids = np.frombuffer(packed, "<u4")
        decoded = p.decode(ids)
        decoded = decoded[1:] if first else decoded
        if digests:
            return row, doc_id, chunk_no, len(ids), zlib.crc32(packed), len(decoded.decode("utf-8", "replace")), len(decoded), zlib.crc32(decoded)
        return row, doc_id, chunk_no, ids.astype("i4"), decoded.decode("utf-8", "replace")

    names = [f.split()[0] for f in schema.split(", ")]

    def short(batches):
        p = loaded(model)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                yield pd.DataFrame([told(p, None, d, 0, p.encode(t), True) for d, t in zip(part.doc_id, part.text, strict=True)], columns=names).astype({"doc_id": "Int64"})

    def transfers(batches):
        p = loaded(model)
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                m = p.transfer(x.s.replace(" ", BAR), x.lo, x.hi, x.chunk_no == 0, x.chunk_no == x.n - 1)
                out.append((x.row, x.chunk_no, m.shape[0], m.shape[1], np.isfinite(m).astype("u1").tobytes()))
            yield pd.DataFrame(out, columns=["row", "at", "n_in", "n_out", "finite"])

    unpacked = lambda pdf: [np.where(np.frombuffer(x.finite, "u1").reshape(x.n_in, x.n_out) > 0, 0.0, NEVER) for x in pdf.itertuples()]

    def combined(pdf):
        pdf = pdf.sort_values("at")
        m = product(unpacked(pdf))
        return pd.DataFrame({"row": pdf.row[:1], "at": [pdf["at"].iloc[0] // FAN], "n_in": [m.shape[0]], "n_out": [m.shape[1]], "finite": [np.isfinite(m).astype("u1").tobytes()]})

    def parted(pdf):
        pdf = pdf.sort_values("at")
        cuts = inner_states(unpacked(pdf), pdf.left.iloc[0], pdf.right.iloc[0])
        return pd.DataFrame({"row": pdf.row, "at": pdf["at"], "left": [pdf.left.iloc[0], *cuts], "right": [*cuts, pdf.right.iloc[0]]})

    def traced(batches):
        p = loaded(model)
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                s = x.s.replace(" ", BAR)
                begin, before, end = x.lo, None, x.hi
                if x.chunk_no:
                    a, b = p.states(s, x.lo)[x.left]
                    begin, before = x.lo + b, s[x.lo + a : x.lo + b]
                if x.chunk_no < x.n - 1:
                    end = x.hi + p.states(s, x.hi)[x.right][1]
                out.append(told(p, x.row, x.doc_id, x.chunk_no, p.trace(s, begin, end, before), x.chunk_no == 0))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    giant = rows.where(F.length("text") > chunk)
    around = 2 * loaded(model).longest + 2
    # The same text under the same id is the same row twice: such rows get numbers.
    giant = giant.groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.any_value("text").alias("text"), F.count("*").alias("copies")) if chunk else giant
    s = F.concat(F.lit(BAR), "text")
    cut = giant.withColumn("s", s).withColumn("n", F.ceil(F.length("s") / chunk).cast("int")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    begin = F.greatest(F.lit(0), F.col("chunk_no") * chunk - around)
    chunks = cut.select(
        F.concat_ws("/", F.col("doc_id").cast("string"), "sha").alias("row"), "doc_id", "copies", "n", "chunk_no",
        F.substring("s", begin + 1, F.lit(chunk + 2 * around)).alias("s"),
        (F.col("chunk_no") * chunk - begin).cast("int").alias("lo"),
        (F.least(F.length("s"), (F.col("chunk_no") + 1) * chunk) - begin).cast("int").alias("hi"),
    )
    chunks = stored(chunks.repartition(F.col("row"), F.col("chunk_no")), "chunks")
    kind = "row string, at int, n_in int, n_out int, finite binary"
    levels = [stored(chunks.select("row", "chunk_no", "n", "s", "lo", "hi").mapInPandas(transfers, kind), "matrices")]
    most = chunks.agg(F.max("n")).first()[0] or 1
    while (most := -(-most // FAN)) > 1:
        levels.append(stored(levels[-1].groupBy("row", F.floor(F.col("at") / FAN).alias("g")).applyInPandas(combined, kind), "matrices"))
    # Of the whole text, one state is before it and one after it.
    states = levels[-1].groupBy("row").agg(F.lit(0).alias("up"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    for level in levels[::-1]:
        below = level.withColumn("up", F.floor(F.col("at") / FAN).cast("int")).join(states, ["row", "up"])
        states = below.groupBy("row", "up").applyInPandas(parted, "row string, at int, left int, right int").withColumnRenamed("at", "up")
    states = states.withColumnRenamed("up", "chunk_no")
    long_ones = chunks.join(states, ["row", "chunk_no"]).mapInPandas(traced, schema)
    copies = chunks.where("chunk_no = 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    long_ones = long_ones.join(copies, "row").withColumn("row", F.concat_ws("/", "row", "copy")).drop("copy")
    return rows.where(F.length("text") <= chunk).mapInPandas(short, schema), long_ones


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: number of ids, their crc32, number of chunks, and the length and crc32 of the decoded text."""
    short, chunks = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
    whole = short.select("doc_id", "n_ids", "ids_crc32", F.lit(1).cast("long").alias("n_chunks"), "decoded_chars", "decoded_crc32")

    def joined(pdf):
        pdf = pdf.sort_values("chunk_no")
        ids = text = 0
        for x in pdf.itertuples():
            ids, text = crc32_joined(ids, x.ids_crc32, 4 * x.n_ids), crc32_joined(text, x.decoded_crc32, x.decoded_bytes)
        return pd.DataFrame({"doc_id": pdf.doc_id[:1], "n_ids": [pdf.n_ids.sum()], "ids_crc32": [ids], "n_chunks": [len(pdf)], "decoded_chars": [pdf.decoded_chars.sum()], "decoded_crc32": [text]}).astype({"doc_id": "Int64"})

    giant = chunks.groupBy("row").applyInPandas(joined, whole.schema)
    return whole.unionByName(giant)
