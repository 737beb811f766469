"""From drawn characters to visual rows of glyphs, in reading order.

Characters: schemas.CHAR. Only the boxes of a page's lines, a few numbers a line, go to one call a page, which tells the
columns and which lines stand beside each other; all that concerns glyphs is told in columns, in windows of a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions import runs as rn
from pagewright.functions import style
from pagewright.operators import blocks as bl
from pagewright.operators import rows as rw

PAGE = ["doc_id", "page"]
LINE, ROW = [*PAGE, "line_no"], [*PAGE, "row_no"]
# Where a gutter is sought; lines that columns need, how wide, how long on average; share of all lines.
GUTTER, COLUMN_LINES, COLUMN_WIDE, COLUMN_LONG, COLUMN_SHARE, FEWEST = (0.3, 0.7), 4, 0.25, 0.3, 0.5, 8
# Overlap that puts lines in one row; gap that is a space; sizes of the main glyphs and of raised ones, and how high those are.
OVERLAP, SPACE, MAIN, RAISED, LIFT = 0.5, 0.15, 0.85, 0.8, 0.2
# Single capitals of a letterspaced row: how many, which share; the gap that parts its words.
SINGLES, SINGLE_SHARE, WORD_GAP = 4, 0.6, 0.15


def line_glyphs(chars: DataFrame) -> DataFrame:
    """Upright characters as glyphs: ligatures and expert characters as what they show, raised digits marked; a space that no
    character stands for lies at the end of the glyph before it and doesn't open a line."""
    w = W.partitionBy(*LINE).orderBy("glyph_no").rowsBetween(W.unboundedPreceding, -1)
    real = ~F.col("anno")
    c = chars.where("upright OR anno").withColumn("_end", F.last(F.when(real, F.col("x1")), True).over(w)).withColumn("_low", F.last(F.when(real, F.col("y0")), True).over(w))
    c = c.where(real | ((F.col("text") == " ") & F.col("_end").isNotNull()))
    shown = style.plain_character(F.col("text"))
    sup = real & (F.length(shown) == 1) & F.lit(style.RAISED).contains(shown)
    own = lambda name, other: F.when(real, F.col(name)).otherwise(other).alias(name)
    return c.select(*LINE, "glyph_no", F.when(sup, F.translate(shown, style.RAISED, "0123456789")).otherwise(shown).alias("text"), own("italic", F.lit(False)), own("bold", F.lit(False)), own("size", F.lit(0.0)), own("x0", F.col("_end")), own("x1", F.col("_end")), own("y0", F.col("_low")), sup.alias("sup"))


def gutter_of(x0: np.ndarray, x1: np.ndarray) -> float | None:
    """x of the gap between two columns of lines, or nothing: of the strip that fewest lines cross, the middle of its first run."""
    lo, hi = x0.min(), x1.max()
    wide = hi - lo
    if len(x0) < FEWEST or wide <= 0:
        return None
    xs = np.arange(lo + GUTTER[0] * wide, lo + GUTTER[1] * wide + 1e-9, 1.0)
    crossed = ((x0[:, None] < xs - 1) & (x1[:, None] > xs + 1)).sum(0)
    fewest = np.flatnonzero(crossed == crossed.min())
    run = fewest[: int(np.argmax(np.diff(fewest, append=fewest[-1] + 2) > 1)) + 1]
    x = float(xs[run[0]] + xs[run[-1]]) / 2
    for side in (x1 <= x, x0 >= x):
        length = (x1 - x0)[side]
        if (length >= COLUMN_WIDE * wide).sum() < COLUMN_LINES or length.mean() < COLUMN_LONG * wide:
            return None
    return x if (x1 <= x).sum() + (x0 >= x).sum() >= COLUMN_SHARE * len(x0) else None


def beside(top: float, bottom: float, tops, bottoms) -> np.ndarray:
    """Which of some boxes overlap one in height by more than half of the lower one's."""
    return np.minimum(top, tops) - np.maximum(bottom, bottoms) > OVERLAP * np.minimum(top - bottom, tops - bottoms)


def reading_order(lines: pd.DataFrame) -> pd.DataFrame:
    """lines (x0, x1, top, bottom) of a page with group (in reading order) and the sides of their column, if there are any."""
    x0, x1, top, bottom = (lines[c].to_numpy(float) for c in ("x0", "x1", "top", "bottom"))
    x = gutter_of(x0, x1) if len(lines) else None
    if x is None:
        return lines.assign(group=0, frame_lo=np.nan, frame_hi=np.nan)
    across = (x0 < x - 1) & (x1 > x + 1)
    full = across | np.array([beside(t, b, top[across], bottom[across]).any() for t, b in zip(top, bottom, strict=True)])
    order = np.argsort(-top, kind="stable")
    # Down the page, each change between full lines and columns begins a band; within a band, left comes before right.
    band = np.zeros(len(lines), int)
    band[order] = np.cumsum(np.diff(full[order].astype(int), prepend=int(full[order[0]])) != 0)
    left = x1 <= x + 1
    frame_lo = np.where(full | left, x0.min(), x)
    frame_hi = np.where(full | ~left, x1.max(), x)
    return lines.assign(group=band * 2 + (~full & ~left), frame_lo=frame_lo, frame_hi=frame_hi)


def visual_rows(lines: pd.DataFrame) -> np.ndarray:
    """A number for each line: lines that stand beside each other have one. A line goes to the first row that it overlaps."""
    tops, bottoms, out = np.empty(len(lines)), np.empty(len(lines)), np.zeros(len(lines), int)
    many = 0
    for i in np.lexsort((lines.x0, -lines.top)):
        t, b = lines.top.iat[i], lines.bottom.iat[i]
        met = np.flatnonzero(beside(t, b, tops[:many], bottoms[:many]))
        k = met[0] if len(met) else many
        tops[k], bottoms[k] = (max(t, tops[k]), min(b, bottoms[k])) if len(met) else (t, b)
        many += not len(met)
        out[i] = k
    return out


def placed_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, group and row_no (in reading order), frame_lo, frame_hi, top and bottom of the row, of lines (x0, x1, top, bottom)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = reading_order(pdf.sort_values("line_no", ignore_index=True))
        out["k"] = -1
        for _, group in out.groupby("group"):
            out.loc[group.index, "k"] = visual_rows(group)
        row = out.groupby(["group", "k"])
        out["row_top"], out["row_bottom"] = row.top.transform("max"), row.bottom.transform("min")
        rank = out[["group", "k", "row_top"]].drop_duplicates().sort_values(["group", "row_top"], ascending=[True, False], kind="stable").reset_index(drop=True)
        number = {(g, k): n for n, (g, k) in enumerate(zip(rank.group, rank.k, strict=True))}
        out["row_no"] = [number[g, k] for g, k in zip(out.group, out.k, strict=True)]
        return out[["doc_id", "page", "line_no", "group", "row_no", "frame_lo", "frame_hi", "row_top", "row_bottom"]]

    few = lines.select(*LINE, "x0", "x1", "top", "bottom")
    return few.groupBy(*PAGE).applyInPandas(run, "doc_id long, page int, line_no int, group int, row_no int, frame_lo double, frame_hi double, row_top double, row_bottom double")


def respaced(glyphs: DataFrame) -> DataFrame:
    """glyphs (with row_size) of rows of letterspaced capitals with a space only where words part; other rows as they are."""
    g = rw.without_false_spaces(glyphs)
    row = W.partitionBy(*ROW)
    w = row.orderBy("glyph_no")
    solid = F.trim("text") != ""
    g = g.withColumn("_solid", solid).withColumn("_token", F.sum((~solid).cast("int")).over(w))
    token = W.partitionBy(*ROW, "_token")
    alone = solid & (F.count_if("_solid").over(token) == 1) & F.col("text").rlike(r"^[\p{Lu}\p{N}]$")
    opens = solid & (F.row_number().over(token.orderBy(~F.col("_solid"), "glyph_no")) == 1)
    g = g.withColumn("_single", alone).withColumn("_opens", opens)
    g = g.withColumn("_singles", F.count_if("_single").over(row)).withColumn("_tokens", F.count_if("_opens").over(row))
    before = F.last(F.when(F.col("_solid"), F.col("x1")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    g = g.withColumn("_gap", F.when(F.col("_solid"), F.col("x0") - before)).withColumn("_before", before).withColumn("_least", F.min("_gap").over(row))
    tracked = F.coalesce((F.col("_singles") >= SINGLES) & (F.col("_singles") >= SINGLE_SHARE * F.col("_tokens")) & (F.col("_least") <= WORD_GAP * F.col("row_size")), F.lit(False))
    g = g.withColumn("_tracked", tracked).where("NOT _tracked OR _solid")
    word = F.coalesce(F.col("_tracked") & (F.col("_gap") > F.col("_least") + WORD_GAP * F.col("row_size")), F.lit(False))
    space = F.struct((F.col("glyph_no") - 0.5).alias("glyph_no"), F.lit(" ").alias("text"), F.lit(False).alias("italic"), F.lit(False).alias("bold"), F.lit(0.0).alias("size"), F.col("_before").alias("x0"), F.col("x0").alias("x1"), F.col("y0").alias("y0"), F.lit(False).alias("sup"))
    own = F.struct(F.col("glyph_no").cast("double").alias("glyph_no"), "text", "italic", "bold", "size", "x0", "x1", "y0", "sup")
    out = g.select(*ROW, "row_size", F.explode(F.when(word, F.array(space, own)).otherwise(F.array(own))).alias("g"))
    return out.select(*ROW, "row_size", "g.*")


def glyph_rows(chars: DataFrame) -> DataFrame:
    """Rows (schemas.ROW) of characters, in reading order."""
    glyphs = line_glyphs(chars).withColumn("_solid", F.trim("text") != "")
    lines = chars.where("upright AND NOT anno").groupBy(*LINE).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max(F.col("y0") + F.col("size")).alias("top"), F.min("y0").alias("bottom"), F.max(F.trim("text") != "").alias("shows")).where("shows")
    g = glyphs.join(placed_lines(lines).drop("group"), LINE)
    # Lines of a row from left to right, with a space between those that stand apart.
    line = W.partitionBy(*LINE)
    g = g.withColumn("_line_x", F.min_by("x0", "glyph_no").over(line)).withColumn("_largest", F.max("size").over(line))
    w = W.partitionBy(*ROW).orderBy("_line_x", "line_no", "glyph_no")
    near = F.greatest("_largest", F.max("size").over(w.rowsBetween(-3, -1)))
    joins = (F.lag("line_no").over(w) != F.col("line_no")) & (F.col("x0") - F.lag("x1").over(w) > SPACE * near) & F.lag("_solid").over(w) & F.col("_solid")
    g = g.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_from", F.lag("x1").over(w)).withColumn("_at", F.row_number().over(w))
    own = F.struct((2 * F.col("_at")).alias("glyph_no"), "text", "italic", "bold", "size", "x0", "x1", "y0", "sup")
    space = F.struct((2 * F.col("_at") - 1).alias("glyph_no"), F.lit(" ").alias("text"), F.lit(False).alias("italic"), F.lit(False).alias("bold"), F.lit(0.0).alias("size"), F.col("_from").alias("x0"), F.col("x0").alias("x1"), F.col("y0").alias("y0"), F.lit(False).alias("sup"))
    sides = ["frame_lo", "frame_hi", "row_top", "row_bottom"]
    g = g.select(*ROW, *sides, F.explode(F.when(F.col("_joins"), F.array(space, own)).otherwise(F.array(own))).alias("g")).select(*ROW, *sides, "g.*")
    # Sizes and baseline, by the glyphs that show; raised ones are small and high.
    row = W.partitionBy(*ROW)
    shows = F.trim("text") != ""
    g = g.withColumn("row_size", F.median(F.when(shows, F.col("size"))).over(row))
    g = g.withColumn("baseline", F.median(F.when(shows & (F.col("size") >= MAIN * F.col("row_size")), F.col("y0"))).over(row))
    g = g.withColumn("sup", F.col("sup") | (shows & (F.col("size") <= RAISED * F.col("row_size")) & (F.col("y0") > F.col("baseline") + LIFT * F.col("row_size"))))
    frame = g.groupBy(*ROW).agg(*[F.first(c).alias(c) for c in (*sides, "baseline")], F.min(F.when(shows, F.col("x0"))).alias("x0"), F.max(F.when(shows, F.col("x1"))).alias("x1"))
    styled = rw.styled_through_words(respaced(g.select(*ROW, "row_size", "glyph_no", "text", "italic", "bold", "size", "x0", "x1", "y0", "sup")))
    return frame.join(runs_of(styled), ROW).select(
        *ROW, "runs", "x0", "x1", F.col("row_top").alias("top"), F.col("row_bottom").alias("bottom"), "size", "baseline",
        F.nanvl("frame_lo", F.lit(None).cast("double")).alias("frame_lo"), F.nanvl("frame_hi", F.lit(None).cast("double")).alias("frame_hi"), F.lit(False).alias("fuzzy"), "hang",
    )


def runs_of(glyphs: DataFrame, ocr: bool = False) -> DataFrame:
    """doc_id, page, row_no, runs, size, hang of glyphs: neighbours of one style are a run; a space goes with what is before it."""
    w = W.partitionBy(*ROW).orderBy("glyph_no")
    solid = F.trim("text") != ""
    key = F.when(solid, F.struct("italic", "bold", "sup"))
    g = glyphs.withColumn("_key", F.coalesce(F.last(key, True).over(w), key)).withColumn("_opens", F.lag("_key").over(w).isNull() | (F.lag("_key").over(w) != F.col("_key")))
    g = g.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(w))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "text"))), lambda x: x["text"]), "")
    runs = g.groupBy(*ROW, "_run").agg(texts.alias("t"), F.first("_key").alias("k"))
    runs = runs.where("k IS NOT NULL").groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("_run", rn.run(F.col("t"), F.coalesce("k.italic", F.lit(False)), F.coalesce("k.bold", F.lit(False)), F.coalesce("k.sup", F.lit(False)), ocr).alias("r")))).alias("rs"))
    told = glyphs.groupBy(*ROW).agg(F.first("row_size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "text", "x0", "sup"))), lambda x: F.struct(x["text"].alias("text"), x["x0"].alias("x0"), x["sup"].alias("sup"))).alias("gs"))
    return runs.join(told, ROW).select(*ROW, F.transform("rs", lambda x: x["r"]).alias("runs"), "size", bl.hang_at(F.col("gs")).alias("hang"))


def scan_glyphs(lines: DataFrame) -> DataFrame:
    """Glyphs of a scan's lines (schemas.SCAN_LINE): letters dealt out over their word, spaces between words, raised labels small
    and high. A word without text is a figure that was read apart and joins what is before it."""
    w = W.partitionBy(*LINE).orderBy("k")
    words = lines.select(*LINE, "baseline", F.col("size").alias("row_size"), F.posexplode("words").alias("k", "v")).select(*LINE, "baseline", "row_size", "k", "v.*")
    lone = (F.col("text") == "") & (F.col("k") > 0)
    words = words.withColumn("sup_before", F.when(lone, F.coalesce("sup_before", "sup_after", F.lit("?"))).otherwise(F.col("sup_before"))).withColumn("sup_after", F.when(~lone, F.col("sup_after")))
    words = words.withColumn("_opening", F.lag("k").over(w).isNull())
    space = F.when((F.col("text") == "") & (F.col("k") > 0) | F.col("_opening"), "").otherwise(" ")
    inner = F.when(F.col("sup_before").isNotNull() & ~lone & (F.col("text") != ""), " ").otherwise("")
    piece = lambda text, up, lean, a, b: F.struct(F.coalesce(text, F.lit("")).alias("t"), F.lit(up).alias("up"), lean.alias("lean"), a.alias("a"), b.alias("b"))
    no = F.lit(False)
    parts = F.array(piece(space, False, no, F.col("x0"), F.col("x0")), piece(F.col("sup_before"), True, no, F.col("x0"), F.col("x0")), piece(inner, False, no, F.col("x0"), F.col("x0")), piece(F.col("text"), False, F.coalesce("italic", no), F.col("x0"), F.col("x1")), piece(F.col("sup_after"), True, no, F.col("x1"), F.col("x1")))
    p = words.select(*LINE, "baseline", "row_size", "k", F.posexplode(F.filter(parts, lambda x: x["t"] != "")).alias("n", "p")).select(*LINE, "baseline", "row_size", "k", "n", "p.*")
    # Raised pieces that touch are one label, unread if they aren't all figures.
    order = W.partitionBy(*LINE).orderBy("k", "n")
    p = p.withColumn("_opens", ~(F.col("up") & F.coalesce(F.lag("up").over(order), no))).withColumn("_label", F.sum(F.col("_opens").cast("int")).over(order))
    label = W.partitionBy(*LINE, "_label").orderBy("k", "n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = F.array_join(F.collect_list("t").over(label), "")
    p = p.withColumn("_many", F.count("*").over(label)).withColumn("t", F.when(F.col("up") & (F.col("_many") > 1), F.when(whole.rlike(r"^\d+$"), whole).otherwise("?")).otherwise(F.col("t"))).withColumn("a", F.when(F.col("up"), F.last("a").over(label)).otherwise(F.col("a"))).where("_opens")
    chars = p.select(*LINE, "baseline", "row_size", "k", "n", "up", "lean", "a", "b", "t", F.posexplode(F.split("t", "(?!^)(?!$)")).alias("i", "c"))
    first = F.length(F.regexp_extract("t", r"^([^\p{L}\p{N}]*)", 1))
    last = F.length("t") - F.length(F.regexp_extract("t", r"([^\p{L}\p{N}]*)$", 1)) - 1
    step = (F.col("b") - F.col("a")) / F.length("t")
    letter = ~F.col("up") & (F.col("c") != " ")
    return chars.select(
        *PAGE, F.col("line_no").alias("row_no"), F.row_number().over(W.partitionBy(*LINE).orderBy("k", "n", "i")).alias("glyph_no"), F.col("c").alias("text"),
        (F.col("lean") & F.col("i").between(first, last)).alias("italic"), no.alias("bold"), F.when(F.col("up"), 0.6 * F.col("row_size")).when(letter, F.col("row_size")).otherwise(0.0).alias("size"),
        (F.col("a") + F.col("i") * step).alias("x0"), (F.col("a") + (F.col("i") + 1) * step).alias("x1"), F.when(F.col("up"), F.col("baseline") + 0.4 * F.col("row_size")).otherwise(F.col("baseline")).alias("y0"), F.col("up").alias("sup"), "row_size",
    )


def scan_rows(lines: DataFrame) -> DataFrame:
    """Rows (schemas.ROW) of a scan's lines, in reading order: one row a line."""
    glyphs = scan_glyphs(lines)
    placed = placed_lines(lines.select(*LINE, "x0", "x1", "top", "bottom")).select(*LINE, "group", "frame_lo", "frame_hi")
    order = F.row_number().over(W.partitionBy(*PAGE).orderBy("group", F.desc("top"), "line_no")) - 1
    own = lines.join(placed, LINE).withColumn("n", order).join(runs_of(glyphs, ocr=True).select(*PAGE, F.col("row_no").alias("line_no"), "runs", "hang"), LINE)
    side = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
    return own.select(*PAGE, F.col("n").alias("row_no"), "runs", "x0", "x1", "top", "bottom", "size", "baseline", side("frame_lo"), side("frame_hi"), F.lit(True).alias("fuzzy"), "hang")


def page_scans(images: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, width, height) with scan: the box of their largest image, if it covers half of the page or more."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    largest = images.withColumn("_area", area).groupBy(*PAGE).agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), "_area").alias("scan"), F.max("_area").alias("_area"))
    met = pages.join(largest, PAGE, "left")
    return met.withColumn("scan", F.when(F.col("_area") >= 0.5 * F.col("width") * F.col("height"), F.col("scan"))).drop("_area")


def without_covers(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, scanned, n_rows) without one or two pictures in front of a typeset book."""
    w = W.partitionBy("doc_id")
    p = pages.withColumn("_front", F.min("scanned").over(w.orderBy("page"))).withColumn("_covers", F.count_if(F.col("_front")).over(w)).withColumn("_typeset", F.count_if(~F.col("scanned") & (F.col("n_rows") > 0)).over(w))
    goes = F.col("_front") & F.col("_covers").between(1, 2) & (F.col("_typeset") >= F.greatest(F.lit(5), 4 * F.col("_covers")))
    return p.where(~goes).drop("_front", "_covers", "_typeset")
