"""Sources of the layout engine: recognition output, outline texts, word lists."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_FIELDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf string, text string"


def ocr_words(spark: SparkSession, path: str, min_conf: float = 0.0) -> DataFrame:
    """Words of tab-separated recognition output; a confidence that is no number counts as -1."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(WORD_FIELDS).csv(path)
    words = raw.withColumn("conf", F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))).withColumnRenamed("page_num", "page")
    return words.where((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") >= min_conf)).withColumn("doc_id", F.col("_metadata.file_path"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def skip_list(spark: SparkSession, path: str) -> DataFrame:
    """Base names, one a line."""
    return spark.read.text(path).select(F.regexp_extract(F.trim("value"), r"([^/]*)$", 1).alias("name")).where("name <> ''").distinct()


def outline_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("outline"))


class _Lines(HTMLParser):
    """Collects lines and their words from recognition output in HTML."""

    LINES = {"ocr_line", "ocr_header", "ocr_caption", "ocr_textfloat"}

    def __init__(self):
        super().__init__()
        self.lines: list[dict] = []
        self.word: dict | None = None

    @staticmethod
    def properties(title: str) -> dict[str, list[float]]:
        out = {}
        for part in filter(str.strip, title.split(";")):
            name, *values = part.split()
            try:
                out[name] = [float(v) for v in values]
            except ValueError:
                continue
        return out

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        kind, p = a.get("class") or "", self.properties(a.get("title") or "")
        if kind in self.LINES:
            self.lines.append({"bbox": p.get("bbox", []), "baseline": p.get("baseline", [0.0, 0.0]), "x_size": p.get("x_size", [0.0])[0], "words": []})
        elif kind == "ocrx_word" and self.lines:
            self.word = {"bbox": p.get("bbox", []), "conf": p.get("x_wconf", [0.0])[0], "text": ""}

    def handle_data(self, data):
        if self.word is not None:
            self.word["text"] += data

    def handle_endtag(self, tag):
        if self.word is not None and tag == "span":
            if self.word["text"].strip():
                self.lines[-1]["words"].append(self.word | {"text": self.word["text"].strip()})
            self.word = None


def hocr_lines(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, hocr) -> one row a line, with its words."""
    schema = "doc_id long, page int, line_no int, bbox array<double>, slope double, offset double, x_size double, words array<struct<bbox:array<double>,conf:double,text:string>>"

    def parse(batches):
        for pdf in batches:
            out = []
            for d, p, text in zip(pdf.doc_id, pdf.page, pdf.hocr, strict=True):
                parser = _Lines()
                parser.feed(text or "")
                for i, x in enumerate(y for y in parser.lines if y["words"]):
                    out.append((d, p, i, x["bbox"], x["baseline"][0], x["baseline"][1] if len(x["baseline"]) > 1 else 0.0, x["x_size"], x["words"]))
            yield pd.DataFrame(out, columns=["doc_id", "page", "line_no", "bbox", "slope", "offset", "x_size", "words"])

    return pages.mapInPandas(parse, schema)
