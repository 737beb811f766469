"""Pages of recognised words as PDF files with invisible, selectable text, and the text beside them.

A paragraph is one text object; its lines stand where they were read, stretched to their width, and an ActualText span says what
copying gives. Content streams are made in columns; a document's pages are put into one file by one call, whose size a document
bounds. Only what the format's built-in font can show is shown; the ActualText span keeps all letters.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions import text as tx
from pagewright.operators import paragraphs as pg

PAR = ["doc_id", "page", "paragraph"]
LINE = [*PAR, "line_num"]
# Text that is neither filled nor stroked; the mean width of the built-in font's letters in sizes.
INVISIBLE, MEAN_WIDTH = 3, 0.5


def dehyphenated(words: DataFrame) -> DataFrame:
    """words (PAR, line_num, word_num, text, ...) in which a word parted at a line's end stands whole on the first line."""
    w = W.partitionBy(*PAR).orderBy("line_num", "word_num")
    last = F.coalesce(F.lead("line_num").over(w) == F.col("line_num") + 1, F.lit(False))
    soft = last & F.col("text").rlike(r"\p{L}-$") & F.lead("text").over(w).rlike(r"^\p{Ll}")
    d = words.withColumn("_soft", F.coalesce(soft, F.lit(False))).withColumn("_next", F.lead("text").over(w))
    d = d.withColumn("_took", F.coalesce(F.lag("_soft").over(w), F.lit(False))).withColumn("text", F.when(F.col("_soft"), F.concat(F.expr("left(text, length(text) - 1)"), "_next")).otherwise(F.col("text")))
    return d.where("NOT _took").select(*words.columns)


def literal(c: Column) -> Column:
    """Text as a string of a content stream, in Latin-1; other characters as question marks."""
    shown = F.regexp_replace(c, r"[^\x20-\x7E\xA0-\xFF]", "?")
    return F.concat(F.lit("("), F.regexp_replace(shown, r"([\\()])", r"\\$1"), F.lit(")"))


def page_streams(words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, stream of words (PAR, line_num, word_num, text, left, top, width, height in px); pages: doc_id, page, width
    and height in points, px_width and px_height of the image that was read."""
    d = dehyphenated(words)
    lines = d.groupBy(*LINE).agg(
        tx.spaced_dashes(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "left", "text"))), lambda x: x["text"]), " ")).alias("text"),
        F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("right"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"),
    )
    par = W.partitionBy(*PAR)
    first = F.min("line_num").over(par)
    # All lines begin at the margin of those after the first, which may be set in.
    lines = lines.withColumn("margin", F.coalesce(F.min(F.when(F.col("line_num") > first, F.col("left"))).over(par), F.col("left")))
    p = lines.join(pages, ["doc_id", "page"]).withColumn("sx", F.col("width") / F.col("px_width")).withColumn("sy", F.col("height") / F.col("px_height"))
    size = F.greatest((F.col("bottom") - F.col("top")) * F.col("sy"), F.lit(1.0))
    target, natural = (F.col("right") - F.col("margin")) * F.col("sx"), MEAN_WIDTH * size * F.length("text")
    stretch = F.when((natural > 0) & (target > 0), 100 * target / natural).otherwise(100.0)
    shown = F.format_string("1 0 0 1 %.2f %.2f Tm /F1 %.2f Tf %.2f Tz %s Tj", F.col("margin") * F.col("sx"), F.col("height") - F.col("bottom") * F.col("sy"), size, stretch, literal(F.concat("text", F.lit(" "))))
    put = p.where(F.trim("text") != "").groupBy(*PAR).agg(F.array_sort(F.collect_list(F.struct("line_num", shown.alias("op"), "text"))).alias("ls"))
    copied = pg.hex_text(pg.copy_text(F.transform("ls", lambda x: x["text"])))
    text = F.concat(F.lit("/Span << /ActualText <"), copied, F.lit(f"> >> BDC\nBT {INVISIBLE} Tr\n"), F.array_join(F.transform("ls", lambda x: x["op"]), "\n"), F.lit("\nET\nEMC"))
    return put.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", text.alias("t")))), lambda x: x["t"]), "\n").alias("stream"))


def assembled(pages: list[dict]) -> bytes:
    """A PDF file of pages (width, height, stream and, if there is one, a grey image with px_width and px_height)."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]

    def stream(head: str, data: bytes) -> int:
        packed = zlib.compress(data)
        objects.append(f"<< {head} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream")
        return len(objects)

    kids = []
    for p in pages:
        draw, resources = b"", "/Font << /F1 3 0 R >>"
        if p.get("image"):
            n = stream(f"/Type /XObject /Subtype /Image /Width {p['px_width']} /Height {p['px_height']} /ColorSpace /DeviceGray /BitsPerComponent 8", p["image"])
            draw, resources = f"q {p['width']:.2f} 0 0 {p['height']:.2f} 0 0 cm /Im{n} Do Q\n".encode(), f"{resources} /XObject << /Im{n} {n} 0 R >>"
        content = stream("", draw + (p["stream"] or "").encode("latin-1", "replace"))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {p['width']:.2f} {p['height']:.2f}] /Resources << {resources} >> /Contents {content} 0 R >>".encode())
        kids.append(len(objects))
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, at = bytearray(b"%PDF-1.5\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{x:010d} 00000 n \n".encode() for x in at)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())


def text_pdfs(words: DataFrame, pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, pdf: a file for each document of pages, with their images (doc_id, page, image) behind the text, if given."""
    p = pages.join(page_streams(words, pages), ["doc_id", "page"], "left")
    p = p.join(images.select("doc_id", "page", "image"), ["doc_id", "page"], "left") if images is not None else p.withColumn("image", F.lit(None).cast("binary"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("page").to_dict("records")
        return pd.DataFrame({"doc_id": pdf.doc_id[:1], "pdf": [assembled(rows)]})

    few = p.select("doc_id", "page", "width", "height", "px_width", "px_height", "stream", "image")
    return few.groupBy("doc_id").applyInPandas(run, "doc_id long, pdf binary")


def text_sidecars(words: DataFrame) -> DataFrame:
    """doc_id, text: each document's text, page by page under a heading, words parted at line ends put together."""
    lines = dehyphenated(words).groupBy(*LINE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "left", "text"))), lambda x: x["text"]), " ").alias("line"))
    pars = lines.groupBy(*PAR).agg(pg.copy_text(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "line"))), lambda x: x["line"])).alias("t"))
    pages = pars.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "t"))), lambda x: x["t"]), "\n\n").alias("t"))
    shown = F.concat(F.lit("===== PAGE "), F.col("page").cast("string"), F.lit(" =====\n"), "t")
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", shown.alias("t")))), lambda x: x["t"]), "\n\n\n").alias("text"))
