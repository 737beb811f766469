"""Grey page images: two-page spreads, copier shadows, tilt, and the rows that a page's content spans.

Images are rows: keys, width, height, image (binary, a byte a pixel). Each image is one row and is worked on whole, in
NumPy, an image at a time; batches of images are as small as Arrow's settings make them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright import schemas
from pagewright.functions import text as tx
from pagewright.operators import ink as ik

# Grey below which a pixel is ink; tilt that is left alone.
INK, LEAST_TILT = 140, 0.1
# Fixed values of spreads: shape; band of the height that is looked at; share of ink in print; parts of the width: print needed, zone of the gutter, margins; share of the usual level that print and gaps have; least share of print on a side; dark band's ink and width.
SPREAD, BAND, PRINTED, NEEDED, ZONE, EDGE, LOW, GAP, SIDE, DARK, DARK_WIDE = 1.15, (0.1, 0.9), (0.02, 0.5), 0.2, (0.35, 0.65), 0.05, 0.3, 0.25, 0.3, 0.6, 0.1
# Fixed values of shadows: block at 300 dots an inch; ink of an empty block and of a dark one; edges of dither; shape and length of lines; how far from an edge shadow begins.
BLOCK, EMPTY_INK, DARK_INK, DITHERED, LINE_LONG, LINE_THIN, LINE_BLOCKS, REACH = 24, 0.004, 0.6, 1.0, 0.9, 0.6, 3, 0.08
EMPTY, PRINT, DARK_BAND, DITHER, UPRIGHT_LINE, LEVEL_LINE = range(6)
# Fixed values of crops: least area, edge strips, content and dilation as parts of the page; least height beside a line; window and offset of the threshold.
AREA, STRIP, CONTENT, DILATE, TALL, WINDOW, OFFSET = 0.0005, 0.02, 0.40, 0.02, 0.5, (15, 30), 15


def smoothed(v: np.ndarray, n: int) -> np.ndarray:
    """Moving average of n values, ends counted as followed by zeros."""
    n = max(1, n)
    # An even window reaches one further back.
    sums = np.cumsum(np.concatenate([[0.0], np.pad(v.astype(float), (n // 2, n - 1 - n // 2))]))
    return (sums[n:] - sums[:-n]) / n


def islands_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and (exclusive) ends of the runs that hold."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype("i1"), [0]])))
    return edges[::2], edges[1::2]


def gutter(inked: np.ndarray, dpi: int) -> int | None:
    """The column at which a sheet with two pages is cut: the widest gap or else the fold's dark band, with print on both sides."""
    h, w = inked.shape
    if w < SPREAD * h:
        return None
    profile = smoothed(inked[int(BAND[0] * h) : int(BAND[1] * h)].mean(0), dpi // 12)
    print_ = profile[(profile > PRINTED[0]) & (profile < PRINTED[1])]
    if len(print_) < NEEDED * w:
        return None
    level, lo = float(np.median(print_)), int(ZONE[0] * w)
    zone, first = profile[lo : int(ZONE[1] * w)], int(EDGE * w)
    last, margin = int((1 - EDGE) * w), dpi // 6
    lively = (profile > LOW * level) & (profile < PRINTED[1])

    def parts(cut: int) -> bool:
        left, right = lively[first : max(first + 1, cut - margin)], lively[min(cut + margin, last - 1) : last]
        return left.mean() > SIDE and right.mean() > SIDE

    starts, ends = islands_of(zone < GAP * level)
    dark = np.flatnonzero(zone > DARK)
    cuts = []
    if len(starts) and (ends - starts).max() >= dpi / 10:
        widest = int((ends - starts).argmax())
        cuts.append(lo + (starts[widest] + ends[widest]) // 2)
    if len(dark) and dark[-1] - dark[0] < DARK_WIDE * w:
        cuts.append(lo + (dark[0] + dark[-1]) // 2)
    return next((int(c) for c in cuts if parts(c)), None)


def long_runs(flags: np.ndarray, n: int) -> np.ndarray:
    """Cells in a run of n at least along the first axis."""
    flat = np.pad(flags, ((0, 1), (0, 0))).T.ravel()
    starts, ends = islands_of(flat)
    keep = ends - starts >= n
    out = np.zeros(len(flat) + 1, "i4")
    np.add.at(out, starts[keep], 1)
    np.add.at(out, ends[keep], -1)
    return (np.cumsum(out[:-1]) > 0).reshape(flags.shape[1], -1)[:, :-1].T


def block_classes(inked: np.ndarray, size: int) -> np.ndarray:
    """The class of each block of so many pixels a side, by its ink, its edges, and whether it is part of a long line."""
    nh, nw = inked.shape[0] // size, inked.shape[1] // size
    a = inked[: nh * size, : nw * size]
    blocks = lambda m: m.reshape(nh, size, nw, size)
    edges = np.zeros(a.shape)
    edges[:, 1:] += a[:, 1:] != a[:, :-1]
    edges[1:] += a[1:] != a[:-1]
    n = blocks(a).sum((1, 3)).astype(float)
    share, lively = n / size**2, blocks(edges).sum((1, 3)) / 2 / np.maximum(n, 1)
    high, wide = blocks(a).any(3).sum(1), blocks(a).any(1).sum(2)
    upright = (share >= EMPTY_INK) & (high >= LINE_LONG * size) & (wide <= LINE_THIN * size)
    level = (share >= EMPTY_INK) & (wide >= LINE_LONG * size) & (high <= LINE_THIN * size)
    return np.select(
        [share > DARK_INK, (share >= EMPTY_INK) & (lively >= DITHERED), long_runs(level.T, LINE_BLOCKS).T, long_runs(upright, LINE_BLOCKS), share < EMPTY_INK],
        [DARK_BAND, DITHER, LEVEL_LINE, UPRIGHT_LINE, EMPTY], PRINT,
    ).astype("u1")


def shadow_from_edge(row: np.ndarray, reach: int, line: int) -> np.ndarray:
    """Which blocks of a row, from its beginning on, are shadow: bands, dither and lines along the edge that begin near it, up to
    the first print. A mark by itself at the very edge or at the shadow's inner rim goes too; shadow that touches print stays."""
    across = LEVEL_LINE if line == UPRIGHT_LINE else UPRIGHT_LINE
    dark, printed = np.isin(row, (DARK_BAND, DITHER, line)), np.isin(row, (PRINT, across))
    goes = np.zeros(len(row), bool)
    for i in np.flatnonzero(dark | printed):
        rim = i > 0 and goes[i - 1]
        if dark[i]:
            if not goes.any() and i >= reach:
                break
            goes[i] = True
        elif i + 3 < len(row) and not printed[i + 1 : i + 4].any() and (i <= 1 or rim):
            goes[i] = True
        else:
            if rim:
                goes[i - 1] = False
            break
    return goes


def without_shadows(gray: np.ndarray, dpi: int) -> np.ndarray:
    """The image with shadows that reach in from its edges whitened; the same one if there are none."""
    size = max(8, round(BLOCK * dpi / 300))
    classes = block_classes(gray < INK, size)
    noise = np.zeros(classes.shape, bool)
    if not noise.size:
        return gray
    for turned, marks, line in ((classes, noise, UPRIGHT_LINE), (classes.T, noise.T, LEVEL_LINE)):
        reach = max(2, int(REACH * turned.shape[1]))
        for row, mark in zip(turned, marks, strict=True):
            mark |= shadow_from_edge(row, reach, line) | shadow_from_edge(row[::-1], reach, line)[::-1]
    if not noise.any():
        return gray
    # Strips past the last whole block go with the block beside them.
    cover = np.kron(noise, np.ones((size, size), bool))
    cover = np.pad(cover, ((0, gray.shape[0] - cover.shape[0]), (0, gray.shape[1] - cover.shape[1])), mode="edge")
    return np.where(cover, 255, gray).astype("u1")


def rotated(gray: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned counter-clockwise about its middle, white where nothing comes in; between pixels by their distances."""
    if not degrees:
        return gray
    h, w = gray.shape
    turn, cy, cx = np.radians(degrees), h / 2, w / 2
    ys, xs = np.mgrid[0:h, 0:w].astype("f4") + 0.5
    sx = cx + (xs - cx) * np.cos(turn) - (ys - cy) * np.sin(turn) - 0.5
    sy = cy + (xs - cx) * np.sin(turn) + (ys - cy) * np.cos(turn) - 0.5
    framed = np.pad(gray, 1, constant_values=255).astype("f4")
    x, y = np.clip(sx + 1, 0, w + 0.999), np.clip(sy + 1, 0, h + 0.999)
    i, j = y.astype(int), x.astype(int)
    a, b = (y - i)[..., None], x - j
    i2, j2 = np.minimum(i + 1, h + 1), np.minimum(j + 1, w + 1)
    above, below = framed[i, j] * (1 - b) + framed[i, j2] * b, framed[i2, j] * (1 - b) + framed[i2, j2] * b
    return np.rint(above * (1 - a[..., 0]) + below * a[..., 0]).astype("u1")


def tilt(inked: np.ndarray, dpi: int) -> float:
    """Degrees that level the lines of print."""
    ys, xs = np.nonzero(inked)
    if len(ys) < ik.SKEW_INK:
        return 0.0
    step = max(1, len(ys) // ik.SKEW_KEPT)
    y, x, found = ys[::step].astype(float), xs[::step] - inked.shape[1] / 2, 0.0
    for reach, by in ((ik.SKEW, ik.COARSE), (ik.COARSE, ik.FINE)):
        tried = found + np.linspace(-reach, reach, round(2 * reach / by) + 1)
        found = float(tried[np.argmax([ik.sharpness(x, y, t, max(1.0, dpi / ik.SKEW_BINS)) for t in tried])])
    return round(found, 2)


def regions_of(gray: np.ndarray, dpi: int, split: bool = True, clean: bool = True, level: bool = True) -> list[dict]:
    """One or two book pages of a sheet: image (cleaned and level), plain (level), x0, angle."""
    cut = gutter(gray < INK, dpi) if split else None
    out = []
    for lo, hi in [(0, gray.shape[1])] if cut is None else [(0, cut), (cut, gray.shape[1])]:
        part = gray[:, lo:hi]
        cleaned = without_shadows(part, dpi) if clean else part
        angle = tilt(cleaned < INK, dpi) if level else 0.0
        angle = angle if abs(angle) >= LEAST_TILT else 0.0
        out.append({"x0": lo, "angle": angle, "image": rotated(cleaned, angle), "plain": rotated(part, angle)})
    return out


def prepared_scans(images: DataFrame, dpi: int, split: bool = True, clean: bool = True, level: bool = True) -> DataFrame:
    """schemas.REGION of images (doc_id, page, width, height, image): each sheet's pages, the right one of two as part b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = regions_of(np.frombuffer(r.image, "u1").reshape(r.height, r.width), dpi, split, clean, level)
                parts = ["a", "b"] if len(found) == 2 else [""]
                yield pd.DataFrame([(r.doc_id, r.page, p, f["x0"], f["angle"], f["image"].shape[1], f["image"].shape[0], f["image"].tobytes(), f["plain"].tobytes()) for p, f in zip(parts, found, strict=True)], columns=["doc_id", "page", "part", "x0", "angle", "width", "height", "image", "plain"])

    return images.select("doc_id", "page", "width", "height", "image").mapInPandas(run, schemas.REGION)


def layer_into_regions(layer: DataFrame, regions: DataFrame, dpi: int) -> DataFrame:
    """Lines of another reading (doc_id, page, layer_no, x0, y0, x1, y1 in points, ox, oy: the scan's upper left corner, tokens)
    cut to the regions of their page and turned with them."""
    s = dpi / 72.0
    of = regions.select("doc_id", "page", "part", F.col("x0").alias("rx"), "angle", "width", "height", F.count("*").over(W.partitionBy("doc_id", "page")).alias("many"))
    met = layer.join(of, ["doc_id", "page"])
    cx, cy = ((F.col("x0") + F.col("x1")) / 2 - F.col("ox")) * s, (F.col("oy") - (F.col("y0") + F.col("y1")) / 2) * s
    here = met.where((F.col("many") == 1) | ((cx >= F.col("rx")) & (cx < F.col("rx") + F.col("width"))))
    px, py = ik.from_source(cx, cy, F.struct(F.col("rx").alias("x0"), "angle", "width", "height"))
    dx, dy = (px + F.col("rx") - cx) / s, (py - cy) / s
    moved = {"x0": F.col("x0") + dx, "x1": F.col("x1") + dx, "y0": F.col("y0") - dy, "y1": F.col("y1") - dy}
    return here.select("doc_id", "page", "part", "layer_no", *[c.alias(n) for n, c in moved.items()], "tokens")


def words_on_source(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words (doc_id, page, part, left, top, width, height) of regions at their places in the page's own image."""
    of = regions.select("doc_id", "page", "part", F.struct("x0", "angle", "width", "height").alias("_region"))
    met = words.join(of, ["doc_id", "page", "part"])
    x, y = ik.to_source(F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2, F.col("_region"))
    stays = (F.col("_region.angle") == 0) & (F.col("_region.x0") == 0)
    place = lambda at, size, own: F.when(stays, F.col(own)).otherwise(F.bround(at - F.col(size) / 2).cast("int"))
    return met.withColumns({"left": place(x, "width", "left"), "top": place(y, "height", "top")}).select(*words.columns)


def median3(gray: np.ndarray) -> np.ndarray:
    """Each pixel's median with its eight neighbours, edges repeated."""
    p = np.pad(gray, 1, mode="edge")
    return np.median(np.stack([p[i : i + gray.shape[0], j : j + gray.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype("u1")


def box_mean(gray: np.ndarray, n: int) -> np.ndarray:
    """Mean of the n by n pixels about each, edges repeated."""
    p = np.pad(gray.astype("f8"), n // 2, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / n**2


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, width, height, area of the connected parts (corners count), by runs of each row joined with those above."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs, above = [], []
    for y, row in enumerate(mask):
        here, k = [], 0
        for a, b in zip(*islands_of(row), strict=True):
            n = len(parent)
            parent.append(n)
            runs.append((int(a), y, int(b)))
            while k < len(above) and above[k][1] < a:
                k += 1
            for c, d, m in above[k:]:
                if c > b:
                    break
                if d >= a:
                    x, z = sorted((root(m), root(n)))
                    parent[z] = x
            here.append((int(a), int(b), n))
        above = here
    boxes: dict = {}
    for n, (a, y, b) in enumerate(runs):
        x0, y0, x1, y1, area = boxes.get(root(n), (a, y, b, y, 0))
        boxes[root(n)] = min(x0, a), min(y0, y), max(x1, b), max(y1, y), area + b - a
    return [(x0, y0, x1 - x0, y1 - y0 + 1, area) for x0, y0, x1, y1, area in boxes.values()]


def text_block(gray: np.ndarray) -> dict:
    """The rows that a page's content spans (top, bottom, null if none), and the boxes that were kept and rejected."""
    h, w = gray.shape
    inked = median3(gray)
    inked = inked <= np.rint(box_mean(inked, max(WINDOW[0], (min(h, w) // WINDOW[1]) | 1))) - OFFSET
    wide = max(3, int(w * DILATE))
    sums = np.pad(inked.astype("i4").cumsum(1), ((0, 0), (1, 0)))
    xs = np.arange(w)
    lines = sums[:, np.minimum(xs + (wide - 1) // 2 + 1, w)] - sums[:, np.maximum(xs - wide // 2, 0)] > 0
    found = components(lines)
    edge = [x == 0 or y == 0 or x + bw >= w or y + bh >= h for x, y, bw, bh, _ in found]
    large = [area >= AREA * h * w for *_, area in found]
    heights = [b[3] for b, e, big in zip(found, edge, large, strict=True) if big and not e]
    least = TALL * float(np.median(heights)) if heights else np.inf
    text = [(big or b[3] >= least) and not (e and b[3] < STRIP * h) for b, e, big in zip(found, edge, large, strict=True)]
    kept, rejected = ([dict(zip("xywh", b[:4], strict=True)) for b, t in zip(found, text, strict=True) if t == yes] for yes in (True, False))
    return {"top": min((b["y"] for b in kept), default=None), "bottom": max((b["y"] + b["h"] for b in kept), default=None), "kept": kept, "rejected": rejected}


def detected(images: DataFrame) -> DataFrame:
    """images (file, width, height, image) with schemas.DETECTION."""

    @F.pandas_udf(schemas.DETECTION)
    def blocks(width: pd.Series, height: pd.Series, image: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_block(np.frombuffer(i, "u1").reshape(h, w)) for w, h, i in zip(width, height, image, strict=True)], columns=["top", "bottom", "kept", "rejected"]).astype({"top": "Int32", "bottom": "Int32"})

    return images.withColumn("d", blocks("width", "height", "image")).select("*", "d.*").drop("d")


def crops(detections: DataFrame, skip: DataFrame | None = None, pad: float = 0.02, least_gain: float = 0.03) -> DataFrame:
    """file, action (cropped, unchanged, skipped, failed), height, top_cut, bottom_cut, in the files' natural order by name."""
    h = F.col("height")
    margin = F.bround(F.lit(pad) * h).cast("int")
    top, bottom = F.greatest(F.lit(0), F.col("top") - margin), F.least(h, F.col("bottom") + margin)
    d = detections.join(skip.select(F.col("name").alias("file"), F.lit(True).alias("_skip")).distinct(), "file", "left") if skip is not None else detections.withColumn("_skip", F.lit(None).cast("boolean"))
    d = d.withColumn("_cuts", F.struct(top.alias("top"), (h - bottom).alias("bottom")))
    poor = F.col("top").isNull() | (F.col("bottom") - F.col("top") < CONTENT * h)
    action = F.when(F.col("_skip"), "skipped").when(poor, "failed").when(F.col("_cuts.top") + F.col("_cuts.bottom") < least_gain * h, "unchanged").otherwise("cropped")
    d = d.withColumn("action", action)
    cut = lambda side: F.when(F.col("action") == "cropped", F.col(f"_cuts.{side}")).otherwise(0).alias(f"{side}_cut")
    return d.select("file", "action", "height", cut("top"), cut("bottom"), tx.natural_key(F.col("file")).alias("order"))


def cropped_images(images: DataFrame, log: DataFrame) -> DataFrame:
    """images (file, width, height, image) with the rows cut off that the log says."""
    met = images.join(log.select("file", "top_cut", "bottom_cut"), "file", "left")
    top, rest = F.coalesce("top_cut", F.lit(0)), F.col("height") - F.coalesce("top_cut", F.lit(0)) - F.coalesce("bottom_cut", F.lit(0))
    return met.select("file", "width", rest.alias("height"), F.substring("image", top * F.col("width") + 1, rest * F.col("width")).alias("image"))


def box_outline(box: Column, width: int) -> Column:
    """The four strips of a box's frame, as boxes: what a preview paints."""
    x, y, w, h = (box[k] for k in "xywh")
    strip = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    t = F.lit(width)
    return F.array(strip(x, y, w, t), strip(x, y + h - t, w, t), strip(x, y, t, h), strip(x + w - t, y, t, h))
