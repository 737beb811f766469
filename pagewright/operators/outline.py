"""Printed contents, heading candidates and outlines, over OCR word tables.

Words: doc_id, page, block_num, par_num, line_num, word_num, left, top, width, height, text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagewright.functions import text as tx

LINE = ["doc_id", "page", "block_num", "par_num", "line_num"]
#: Ranks of numbering classes of the same height and indent.
CLASS_RANK = {"paren_double_upper": 0, "paren_double_lower": 0, "roman": 1, "letter_upper": 2, "arabic": 3, "letter_lower": 4, "greek_lower": 5, "arabic_dotted": 6, "none": 7}


def line_text(words: DataFrame) -> DataFrame:
    """One row a line: its words in order, smallest left edge, largest height, number of words."""
    order = F.array_sort(F.collect_list(F.struct("word_num", "left", "text")))
    return words.groupBy(*LINE).agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"), F.min("left").alias("indent"), F.max("height").alias("height"), F.count("*").alias("n_words"))


def toc_lines(words: DataFrame) -> DataFrame:
    """Lines of a printed contents page: text, page_hint, indent, height, numbering class."""
    lines = line_text(words).withColumn("raw", tx.roman_repaired(F.trim("text"))).where("raw <> ''")
    return lines.select(*LINE, tx.without_page_number(F.col("raw")).alias("text"), tx.page_number(F.col("raw")).alias("page_hint"), "indent", "height").where("text <> ''").withColumn("prefix", tx.numbering_class(F.col("text")))


def style_levels(lines: DataFrame, indent_size: int = 30, height_size: int = 6) -> DataFrame:
    """doc_id, prefix, indent_bucket, height_bucket and level: styles ranked by height, indent and class, each its own level."""
    rank = F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv])
    styles = lines.select("doc_id", "prefix", tx.floored(F.col("indent"), indent_size).alias("indent_bucket"), tx.floored(F.col("height"), height_size).alias("height_bucket")).distinct()
    order = W.partitionBy("doc_id").orderBy(F.desc("height_bucket"), "indent_bucket", rank[F.col("prefix")], "prefix")
    return styles.withColumn("level", F.row_number().over(order))


#: What is said above an outline that is to be corrected by hand.
OUTLINE_HEAD = "// Draft of the printed contents: levels are guessed from type and indent.\n// Correct the number of # signs and the page after @ where they are wrong.\n// Lines that begin with // are left out.\n"


def toc_outline(lines: DataFrame, indent_size: int = 30, height_size: int = 6) -> DataFrame:
    """doc_id and the outline text of its contents lines, with a comment above."""
    marked = lines.withColumn("indent_bucket", tx.floored(F.col("indent"), indent_size)).withColumn("height_bucket", tx.floored(F.col("height"), height_size))
    joined = marked.join(style_levels(lines, indent_size, height_size), ["doc_id", "prefix", "indent_bucket", "height_bucket"])
    line = F.concat(F.expr("repeat('#', level)"), F.lit(" "), "text", F.coalesce(F.concat(F.lit(" @ "), F.col("page_hint").cast("string")), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("page", "block_num", "par_num", "line_num", line.alias("line"))))
    return joined.groupBy("doc_id").agg(F.concat(F.lit(OUTLINE_HEAD), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("outline"))


def upper_median(c: str):
    """The element at half the count, rounded down: no mean of the two middle ones."""
    return F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))


def heading_candidates(words: DataFrame, threshold: float = 1.4, min_words: int = 1, keep_noise: bool = False) -> DataFrame:
    """doc_id, page, rel (largest height by the page's upper median), text. One shuffle by page: lines are within it."""
    page = W.partitionBy("doc_id", "page")
    ranked = words.withColumn("_k", F.row_number().over(page.orderBy("height"))).withColumn("_n", F.count("height").over(page)).withColumn("_nulls", F.count("*").over(page) - F.col("_n"))
    # Rows without a height come first in the order.
    median = F.max(F.when(F.col("_k") - F.col("_nulls") == F.floor(F.col("_n") / 2) + 1, F.col("height"))).over(page)
    large = ranked.withColumn("_median", median).where((F.col("_median") > 0) & (F.col("height") >= threshold * F.col("_median")))
    order = F.array_sort(F.collect_list(F.struct("word_num", "left", "text")))
    lines = large.groupBy(*LINE).agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"), (F.max("height") / F.first("_median")).alias("rel"), F.count("*").alias("_many"))
    found = lines.where(F.col("_many") >= min_words).select(*LINE, "rel", "text")
    return found if keep_noise else found.where(~tx.heading_noise(F.col("text")))


def draft_level(rel):
    return F.when(rel >= 2.0, "#").when(rel >= 1.7, "##").otherwise("###")


def draft_outline(candidates: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", draft_level(F.col("rel")), "text", F.lit("@"), F.col("page").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("page", "block_num", "par_num", "line_num", line.alias("line"))))
    return candidates.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("outline"))


def parse_outline(texts: DataFrame) -> DataFrame:
    """doc_id, seq, level, title, page of outline texts; blank, comment and other lines go."""
    lines = texts.select("doc_id", F.posexplode(F.split("outline", "\n")).alias("seq", "line")).where("trim(line) <> '' AND NOT startswith(trim(line), '//')")
    return lines.select("doc_id", "seq", tx.outline_line(F.col("line")).alias("o")).where("o IS NOT NULL").select("doc_id", "seq", "o.*")


def with_parents(entries: DataFrame, deepest: int = 12) -> DataFrame:
    """entries (doc_id, seq, level up to `deepest`, ...) and parent: seq of the last earlier entry of a smaller level."""
    before = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    # The last entry of each level before this one, level by level: no list of all earlier entries.
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(before)) for k in range(1, deepest)]
    return entries.withColumn("parent", F.greatest(*last))


def place_headings(entries: DataFrame, shows: DataFrame, reach: int = 20) -> DataFrame:
    """entries (doc_id, seq, title and, if there is one, a hint: page) with found_page, placed document by document in order.

    shows: doc_id, page, seq, text; hints count pages as they do. An entry is sought from its hint, or else from the page of
    the entry found before, and with a hint that misses from the first page on. It is on the first page on which up to
    `reach` text pieces, with spaces between and no more than it takes, begin with the title (from character 1 to 3).
    """
    hint = F.col("page") if "page" in entries.columns else F.lit(None)
    wanted = entries.select("doc_id", F.col("seq").alias("entry"), tx.normalised(F.col("title")).alias("t"), hint.cast("long").alias("hint"))
    pieces = shows.select("doc_id", F.col("page").alias("at"), F.col("seq").alias("piece"), tx.normalised(F.col("text")).alias("text")).where("text <> '' AND at IS NOT NULL")
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, df, c in (("doc_id", entries, "doc_id"), ("entry", entries, "seq"), ("found_page", shows, "page"))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("entry"), right.sort_by([("at", "ascending"), ("piece", "ascending")])
        pages: dict = {}
        for at, text in zip(right["at"].to_pylist(), right["text"].to_pylist(), strict=True):
            pages.setdefault(at, []).append(text)
        order = list(pages)

        def begins(texts: list[str], t: str) -> bool:
            for i in range(len(texts)):
                joined = texts[i]
                for more in texts[i + 1 : i + reach]:
                    if len(joined) >= len(t):
                        break
                    joined += " " + more
                if 0 <= joined.find(t, 0, len(t) + 2) <= 2:
                    return True
            return False

        def found(t: str, start):
            return next((p for p in order if (start is None or p >= start) and begins(pages[p], t)), None)

        cursor, got = None, []
        for t, hint in zip(left["t"].to_pylist(), left["hint"].to_pylist(), strict=True):
            at = None
            if t and order:
                at = found(t, cursor if hint is None else min(hint, order[-1]))
                if at is None and hint is not None:
                    at = found(t, None)
            cursor = cursor if at is None else at
            got.append(at)
        return left.select(["doc_id", "entry"]).append_column("found_page", pa.array(got, right.schema.field("at").type))

    # Columns of their own, as both may come from one table.
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).where("doc_id IS NOT NULL").groupBy("doc_id")
    placed = fresh(wanted).cogroup(fresh(pieces)).applyInArrow(run, schema)
    return entries.join(placed.select("doc_id", F.col("entry").alias("seq"), "found_page"), ["doc_id", "seq"], "left")
