"""Scans as tables of inked pixels (image_id, x, y): runs of columns, slants, rules, skew, and points of turned regions.

A pixel is a row. Runs and slants deal the pixels by image, a bounded number a task (an image isn't parted, and what doesn't
fit a task's memory is spilled); what is counted per line is combined before the shuffle. Only the search for a page's skew takes
a whole page's ink in one group, whose size a page bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Slants tried, in degrees; smallest crop and least ink of a word whose slant is told.
SLANTS = (-8, 24, 2)
LEAST_HEIGHT, LEAST_WIDTH, LEAST_INK = 8, 4, 20
# A rule's least length in inches and as a part of the width; rows of a line that may touch a rule; pixels and part of an inch that a rule may be thick.
RULE_INCHES, RULE_PART, TOUCH, THICK, THICK_PART = 0.8, 12, 2, 3, 60
# Pixels of a task that seeks runs, and of one that seeks slants.
RUN_PIXELS, SLANT_PIXELS = 500_000, 100_000
# Degrees searched either way, coarse and fine steps, least ink, ink kept, bins an inch.
SKEW, COARSE, FINE, SKEW_INK, SKEW_KEPT, SKEW_BINS = 5.0, 0.1, 0.01, 500, 200_000, 150


def islands(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows, one for each keys and `at`, with `island`: equal for neighbours at consecutive places."""
    return rows.withColumn("island", F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at)))


def by_image(pixels: DataFrame, each: int, counted: DataFrame | None = None) -> DataFrame:
    """pixels dealt by image over as many tasks as hold `each` pixels, so that a task's memory doesn't grow with the table.
    counted: a table of as many rows that is cheaper to count."""
    parts = max(-(-(pixels if counted is None else counted).count() // each), pixels.sparkSession.sparkContext.defaultParallelism)
    return pixels.repartition(parts, "image_id")


def ink_runs(pixels: DataFrame) -> DataFrame:
    """image_id, c0, c1 (exclusive), top, bottom: unbroken runs of inked columns."""
    columns = by_image(pixels.select("image_id", "x", "y"), RUN_PIXELS).groupBy("image_id", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
    runs = islands(columns, ["image_id"], "x").groupBy("image_id", "island")
    return runs.agg(F.min("x").alias("c0"), (F.max("x") + 1).alias("c1"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("island")


def slants(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, slant (degrees at which the columns are sharpest, null for too small a crop), gain over upright.

    sizes: image_id, width, height. Of equally sharp slants the smallest is taken.
    """
    lo, hi, step = SLANTS
    # Each pixel counts once for each slant, all of them in one task.
    sized = pixels.select("image_id", "x", "y").join(sizes.select("image_id", "height"), "image_id")
    sheared = by_image(sized, SLANT_PIXELS, pixels).withColumn("slant", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))
    column = F.col("x") - F.bround((F.col("height") - 1 - F.col("y")) * F.tan(F.radians("slant"))).cast("long")
    heights = sheared.groupBy("image_id", "slant", column.alias("column")).agg(F.count("*").alias("n"))
    sharp = heights.groupBy("image_id", "slant").agg(F.sum(F.col("n") * F.col("n")).alias("sharp"), F.sum("n").alias("ink"))
    best = sharp.groupBy("image_id").agg(
        F.max(F.struct("sharp", (-F.col("slant")).alias("back"))).alias("best"),
        F.max(F.when(F.col("slant") == 0, F.col("sharp"))).alias("upright"),
        F.max("ink").alias("ink"),
    )
    told = (F.col("height") >= LEAST_HEIGHT) & (F.col("width") >= LEAST_WIDTH) & (F.col("ink") >= LEAST_INK)
    return sizes.join(best, "image_id", "left").select(
        "image_id",
        F.when(told, -F.col("best.back").cast("double")).alias("slant"),
        F.when(told, F.col("best.sharp") / F.col("upright")).otherwise(F.lit(0.0)).alias("gain"),
    )


def rules(pixels: DataFrame, sizes: DataFrame, boxes: DataFrame, dpi: int) -> DataFrame:
    """image_id, x0, x1, y of thin horizontal rules outside lines of text. boxes: image_id, top, bottom of the lines."""
    least = F.greatest(F.lit(int(RULE_INCHES * dpi)), F.floor(F.col("width") / RULE_PART).cast("int"))
    needed = sizes.select("image_id", least.alias("least"))
    long_rows = pixels.groupBy("image_id", "y").agg(F.count("*").alias("n")).join(needed, "image_id").where("n >= least")
    bands = islands(long_rows, ["image_id"], "y")
    spans = boxes.select(F.col("image_id").alias("_image"), (F.col("top") + TOUCH).alias("_from"), (F.col("bottom") - TOUCH).alias("_to"))
    free = bands.join(spans, (F.col("image_id") == F.col("_image")) & (F.col("y") >= F.col("_from")) & (F.col("y") < F.col("_to")), "left_anti")
    ends = bands.groupBy("image_id", "island").agg((F.max("y") + 1).alias("end"))
    starts = free.groupBy("image_id", "island").agg(F.min("y").alias("start"))
    thin = starts.join(ends, ["image_id", "island"]).where(F.col("end") - F.col("start") <= max(THICK, dpi // THICK_PART))
    middle = thin.select("image_id", F.floor((F.col("start") + F.col("end")) / 2).alias("y"))
    inked = islands(pixels.join(middle, ["image_id", "y"], "left_semi"), ["image_id", "y"], "x")
    runs = inked.groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return runs.join(needed, "image_id").where(F.col("x1") - F.col("x0") >= F.col("least")).select("image_id", "x0", "x1", "y")


def sharpness(x: np.ndarray, y: np.ndarray, degrees: float, bin_height: float) -> int:
    turn = np.radians(degrees)
    height = y * np.cos(turn) - x * np.sin(turn)
    lines = np.bincount(((height - height.min()) // bin_height).astype(int))
    return int((lines * lines).sum())


def skews(pixels: DataFrame, sizes: DataFrame, dpi: int) -> DataFrame:
    """image_id, skew: the turn in degrees that levels the lines of print; 0 for images with little ink."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = 0.0
        if len(pdf) >= SKEW_INK:
            pdf = pdf.sort_values(["y", "x"]).iloc[:: max(1, len(pdf) // SKEW_KEPT)]
            x, y = pdf.x.to_numpy(float) - pdf.width.iloc[0] / 2, pdf.y.to_numpy(float)
            for reach, step in ((SKEW, COARSE), (COARSE, FINE)):
                tried = found + np.linspace(-reach, reach, round(2 * reach / step) + 1)
                found = float(tried[np.argmax([sharpness(x, y, t, max(1.0, dpi / SKEW_BINS)) for t in tried])])
        return pd.DataFrame({"image_id": pdf.image_id.iloc[:1], "skew": [round(found, 2)]})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.join(sizes.select("image_id", "width"), "image_id").groupBy("image_id").applyInPandas(run, f"image_id {kind}, skew double")


def turned(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """A point after a turn about the middle of its image."""
    dx, dy, turn = x - width / 2, y - height / 2, F.radians(degrees)
    return width / 2 + dx * F.cos(turn) - dy * F.sin(turn), height / 2 + dx * F.sin(turn) + dy * F.cos(turn)


def to_source(x: Column, y: Column, region: Column) -> tuple[Column, Column]:
    """A point of a region (struct x0, angle, width, height) in its source image."""
    px, py = turned(x, y, region["width"], region["height"], region["angle"])
    return px + region["x0"], py


def from_source(x: Column, y: Column, region: Column) -> tuple[Column, Column]:
    """A point of the source image in a region."""
    return turned(x - region["x0"], y, region["width"], region["height"], -region["angle"])


def numbered_spreads(pages: DataFrame) -> DataFrame:
    """pages (doc_id, pdf_page, half: 0 left or whole, 1 right) with number: each right half moves all later pages by one."""
    before = W.partitionBy("doc_id").orderBy("pdf_page", "half").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages.withColumn("number", F.col("pdf_page") + F.sum("half").over(before))


def page_range(spec: Column) -> Column:
    """'12-18' or '3,5,9-11' as the sorted array of its different pages; null for null or empty text. Reversed ranges are empty."""

    def pages(part: Column) -> Column:
        first, last = F.trim(F.split_part(part, F.lit("-"), F.lit(1))).cast("int"), F.trim(F.element_at(F.split(part, "-", 2), -1)).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.when(spec != "", F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), pages)))))
