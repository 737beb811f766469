"""The tools, each as one call on tables: what a user of the engine begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions import runs as rn
from pagewright.functions import text as tx
from pagewright.operators import assemble, documents, glyphs, images, ink, outline, paragraphs, scans
from pagewright.session import stored
from pagewright.sinks import pdf as sink
from pagewright.sources import pdf as source
from pagewright.sources import words as word_sources


def asked(spec: str | None) -> set[int] | None:
    """Pages of '12-18' or '3,5,9-11'; nothing for all."""
    if not spec:
        return None
    ends = [[int(x) for x in part.split("-", 1)] for part in spec.split(",")]
    return {n for e in ends for n in range(e[0], e[-1] + 1)}


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, doc (a path), content: files with numbers made of their names."""
    return source.files(spark, path).select(F.xxhash64("doc").alias("doc_id"), "doc", "content")


def markdown_of_pdfs(pdfs: DataFrame, pages: str | None = None, records: DataFrame | None = None, dictionary: DataFrame | None = None, page_markers: bool = False) -> DataFrame:
    """doc_id, markdown of pdfs (doc_id, content). records: doi, record (JSON) fetched beforehand, or nothing to go without."""
    wanted = asked(pages)
    shown = stored(source.pdf_pages(pdfs, wanted), "pdf-pages")
    rows = stored(glyphs.glyph_rows(stored(source.pdf_characters(pdfs, wanted), "characters")), "rows")
    text = rows.withColumn("t", rn.text_of(F.col("runs")))
    flat = text.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("row_no", "t"))).alias("ts")).select("doc_id", "page", tx.squeezed(F.array_join(F.transform("ts", lambda x: x["t"]), " ")).alias("flat"))
    covers = flat.withColumn("c", tx.journal_cover(F.col("flat"))).where("c IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("page", "c"), "page").alias("f")).select("doc_id", "f.page", "f.c.*")
    first = flat.where("page <= 10").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "flat"))), lambda x: x["flat"]), "\n").alias("text"))
    info = source.page_counts(pdfs).select("doc_id", tx.info_fields(tx.info_text(F.col("title")), tx.info_text(F.col("author"))).alias("i")).select("doc_id", "i.*")
    none = pdfs.sparkSession.createDataFrame([], "doi string, record string")
    told = documents.document_metadata(first, info, records if records is not None else none)
    front = stored(documents.merged_front_matter(told, covers.drop("page"), info), "front")
    kept = rows.join(covers.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    sheets = shown.select("doc_id", "page", F.col("page").alias("pdf_page"), F.lit("").alias("part"), "width", "height", "rules", F.lit(None).cast("string").alias("folio"), F.lit(False).alias("scanned"))
    filled = front.where(" OR ".join(f"{k} <> ''" for k in documents.FRONT_KEYS))
    return assemble.to_markdown(kept, sheets, filled, covers, dictionary, page_markers)


def layer_warnings(pdfs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, warning: what is wrong with a file's text layer; rows: those read from it."""
    shares = source.pdf_pages(pdfs).groupBy("doc_id").agg((F.sum("invisible") / F.greatest(F.sum("glyphs"), F.lit(1))).alias("invisible_share")).withColumn("recognised", F.lit(False))
    lines = rows.select("doc_id", rn.text_of(F.col("runs")).alias("text"), F.lit(False).alias("scanned")).where(~tx.stamp(F.col("text")))
    return scans.text_layer_warnings(lines, shares)


def paragraphs_of(words: DataFrame, drop_running_heads: bool = False) -> DataFrame:
    """words without markers of notes, with paragraph: continued ones merged, notes apart, the page's head left out if asked."""
    clean = stored(paragraphs.without_markers(words), "words")
    merged = paragraphs.merged_paragraphs(clean).select("doc_id", "page", "block_num", "par_num", "line_num", "line", F.col("paragraph").cast("long").alias("_p"))
    parts = paragraphs.note_paragraphs(clean).join(merged, ["doc_id", "page", "block_num", "par_num", "line_num"])
    if drop_running_heads:
        heads = merged.where("_p = 0").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.first("line").alias("line")).where((F.col("n") == 1) & tx.running_head(F.col("line"))).select("doc_id", "page", F.lit(0).cast("long").alias("_p"))
        parts = parts.join(heads, ["doc_id", "page", "_p"], "left_anti")
    # Lines are numbered through their paragraph, which may take in several of the reader's.
    line = F.col("par_num") * 1_000_000 + F.col("line_num") + F.col("block_num") * 1_000_000_000
    return parts.withColumn("paragraph", F.col("_p") * 1000 + F.col("part")).withColumn("line_num", F.dense_rank().over(W.partitionBy("doc_id", "page", "paragraph").orderBy(line))).drop("_p", "part", "line")


def searchable_pdfs(words: DataFrame, pages: DataFrame, scans_: DataFrame | None = None, drop_running_heads: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files (doc_id, pdf) and sidecar texts (doc_id, text) of recognised words (schemas.WORD). pages: doc_id, page, width, height,
    px_width, px_height; scans_: their images (doc_id, page, image). A page without words keeps its place."""
    told = stored(paragraphs_of(words, drop_running_heads), "paragraphs")
    return sink.text_pdfs(told, pages, scans_), sink.text_sidecars(told)


def regions(images_: DataFrame, dpi: int = 300, cleanup: bool = True) -> DataFrame:
    """schemas.REGION of page images, prepared for recognition, or as they are."""
    return images.prepared_scans(images_, dpi, cleanup, cleanup, cleanup)


def outlined(outline_texts: DataFrame, pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of outlines (doc_id, outline) with the pages on which they were found and their parents, and those not found."""
    entries = stored(outline.with_parents(outline.parse_outline(outline_texts)), "entries")
    shows = source.text_shows(pdfs)
    placed = stored(outline.place_headings(entries.withColumn("page", F.col("page") - 1), shows), "placed")
    return placed, placed.where("found_page IS NULL")


def heading_candidates(words: DataFrame, pages: str | None = None, threshold: float = 1.4, min_words: int = 1, keep_noise: bool = False, draft: bool = False) -> DataFrame:
    """Lines of large type (doc_id, page, ..., rel, text), or outlines drafted of them (doc_id, outline)."""
    wanted = asked(pages)
    few = words if wanted is None else words.where(F.col("page").isin(sorted(wanted)))
    found = outline.heading_candidates(few, threshold, min_words, keep_noise)
    return outline.draft_outline(found) if draft else found


def printed_contents(words: DataFrame, pages: str, indent_bucket: int = 30, height_bucket: int = 6) -> DataFrame:
    """doc_id, outline: a draft of the printed contents on the pages named."""
    lines = outline.toc_lines(words.where(F.col("page").isin(sorted(asked(pages) or set()))))
    return outline.toc_outline(stored(lines, "contents"), indent_bucket, height_bucket)


def carried_annotations(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new pages with the old ones' annotations, and a count of them with what doesn't fit."""
    pages = documents.carried_annotations(new, old)
    count = pages.agg(F.sum(F.coalesce(F.size("annots"), F.lit(0))).alias("annotations"), F.count_if(F.size("annots") > 0).alias("pages"), F.count_if("size_differs").alias("sizes_differ"), F.count_if("beyond").alias("beyond"))
    return pages, count


def cropped_folder(images_: DataFrame, skip: DataFrame | None = None, pad: float = 0.02, least_gain: float = 0.03) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cropped images, the log of what was done to each (in the names' natural order by `order`), and the count by action."""
    log = stored(images.crops(images.detected(images_), skip, pad, least_gain), "crops")
    return images.cropped_images(images_, log), log, documents.crop_summary(log)


def reading_report(gold: DataFrame, readings: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """The errors of every reading (doc_id, name, text) against its gold text (doc_id, text)."""
    return documents.compared_readings(gold, readings, dictionary)


def words_of(spark: SparkSession, path: str, min_conf: float = 0.0) -> DataFrame:
    return word_sources.ocr_words(spark, path, min_conf)


def page_numbers(spec):
    return ink.page_range(spec)
