"""Operators over recognised words of pages: heights, raised markers, paragraphs of notes, continued paragraphs, copy text.

Words: doc_id, page, block_num, par_num, line_num, word_num, left, top, height, text. Partitions are a page's at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions import text as tx

PAGE = ["doc_id", "page"]
PAR = [*PAGE, "block_num", "par_num"]
LINE = [*PAR, "line_num"]
# Markers that are words of their own, markers at the end of a word, and labels that open a note.
MARKER = r"^[0-9*†‡¹²³⁴⁵⁶⁷⁸⁹⁰]{1,3}$"
GLUED = r"(?<=[A-Za-z]{4})([.,;:!?)\]’”\"']+)(?:\d{1,3})$|(?<=[A-Za-z.,;:!?)\]’”\"'])[*†‡]+$|[¹²³⁴⁵⁶⁷⁸⁹⁰]+$"
NOTE_LABEL = r"^(?:\d{1,3}\.?|[*†‡]+)$"


def upper_median(values: Column) -> Column:
    """The middle one of an array's values in order, the upper of two; null if it is empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def body_heights(words: DataFrame) -> DataFrame:
    """doc_id, page, body: upper median of heights in the upper three fifths of the page's text."""
    page = W.partitionBy(*PAGE)
    top, bottom = F.min("top").over(page), F.max(F.col("top") + F.col("height")).over(page)
    upper = words.withColumn("_cut", top + F.lit(0.6) * (bottom - top)).where("top <= _cut")
    return upper.groupBy(*PAGE).agg(upper_median(F.collect_list("height")).alias("body"))


def _of_others(values: str, own: str) -> Column:
    """Upper median of a sorted array without one occurrence of `own`."""
    at, k = F.array_position(values, F.col(own)) - 1, F.floor((F.size(values) - 1) / 2)
    return F.get(F.col(values), (k + F.when(k >= at, 1).otherwise(0)).cast("int"))


def without_markers(words: DataFrame) -> DataFrame:
    """words without small raised markers of notes; markers at a word's end are cut off."""
    line, page = W.partitionBy(*LINE), W.partitionBy(*PAGE)
    w = words.withColumn("_bottom", F.col("top") + F.col("height"))
    w = w.withColumn("_bottoms", F.array_sort(F.collect_list("_bottom").over(line))).withColumn("_heights", F.array_sort(F.collect_list("height").over(line)))
    w = w.withColumn("_usual", upper_median(F.collect_list("height").over(page)))
    base, tall = _of_others("_bottoms", "_bottom"), _of_others("_heights", "height")
    raised = (F.col("_bottom") < base - 0.25 * tall) & (F.col("height") < 0.75 * tall)
    drop = F.col("text").rlike(MARKER) & F.when(F.size("_heights") > 1, raised).otherwise(F.col("height") < 0.6 * F.col("_usual"))
    cut = F.regexp_replace("text", GLUED, "$1")
    return w.where(~F.coalesce(drop, F.lit(False))).withColumn("text", F.when(cut != "", cut).otherwise(F.col("text"))).select(*words.columns)


def note_paragraphs(words: DataFrame, share: float = 0.9) -> DataFrame:
    """words with part: paragraphs set smaller than the body are parted at lines that open with a label."""
    par, line = W.partitionBy(*PAR), W.partitionBy(*LINE).orderBy("word_num")
    w = words.join(body_heights(words), PAGE).withColumn("_usual", upper_median(F.collect_list("height").over(par)))
    w = w.withColumn("_first", F.first("text").over(line)).withColumn("_nth", F.row_number().over(line))
    opens = (F.col("_nth") == 1) & (F.col("_usual") < share * F.col("body")) & F.col("_first").rlike(NOTE_LABEL) & (F.col("line_num") > F.min("line_num").over(par))
    w = w.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int"))
    return w.withColumn("part", F.sum("_opens").over(par.orderBy("line_num", "word_num"))).select(*words.columns, "part")


def lines_of(words: DataFrame) -> DataFrame:
    """doc_id, page, block_num, par_num, line_num, line, left, top, bottom, heights."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "left", "text"))), lambda x: x["text"]), " ")
    return words.groupBy(*LINE).agg(texts.alias("line"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.collect_list("height").alias("heights"))


def _middle(values: list) -> float:
    return sorted(values)[len(values) // 2]


def merged_paragraphs(words: DataFrame) -> DataFrame:
    """Lines with paragraph (from 0 in each page): a paragraph goes on in the next one if the gap is a line's at most, the
    left edges agree and the sizes are alike; the first one doesn't, if it is a running head."""
    lines = lines_of(words).withColumn("head", F.coalesce(tx.running_head(F.col("line")), F.lit(False)))
    schema = "doc_id long, page int, block_num int, par_num int, line_num int, line string, paragraph int"

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        number, sizes, last, out = -1, [], None, {}
        for key, par in pdf.sort_values(["block_num", "par_num", "line_num"]).groupby(["block_num", "par_num"], sort=True):
            first, own = par.iloc[0], [h for hs in par.heights for h in hs]
            goes_on = False
            if last is not None:
                unit = _middle([*last.heights, *first.heights])
                a, b = sorted((_middle(sizes), _middle(own)))
                goes_on = first.top - last.bottom <= 1.2 * unit and abs(last.left - first.left) <= 0.5 * unit and a >= 0.85 * b and unit > 0 and not (number == 0 and lone_head)
            if goes_on:
                sizes, lone_head = sizes + own, False
            else:
                number, sizes, lone_head = number + 1, own, len(par) == 1 and bool(first["head"])
            out[key], last = number, par.iloc[-1]
        pdf["paragraph"] = [out[k] for k in zip(pdf.block_num, pdf.par_num, strict=True)]
        return pdf[["doc_id", "page", "block_num", "par_num", "line_num", "line", "paragraph"]]

    return lines.groupBy(*PAGE).applyInPandas(joined, schema)


def copy_text(lines: Column) -> Column:
    """An array of lines as running text: hyphens at line ends go where a lower-case letter follows."""
    whole = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return tx.spaced_dashes(F.replace(F.regexp_replace(whole, r"(?<=\p{L})-\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" ")))


def hex_text(c: Column) -> Column:
    """Text as the hexadecimal digits of its big-endian UTF-16 form, with its mark."""
    return F.concat(F.lit("FEFF"), F.hex(F.encode(c, "UTF-16BE")))
