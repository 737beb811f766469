"""Operators over lines and records of documents: furniture, vocabulary, front matter, notes, annotations, metrics."""

from __future__ import annotations

import unicodedata
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagewright.functions import text as tx

#: Endings that may be taken off a word, and what stands in their place.
ENDINGS = [("'s", ""), ("’s", ""), ("ies", "y"), ("ied", "y"), ("es", ""), ("s", ""), ("ed", ""), ("ed", "e"), ("d", ""), ("ing", ""), ("ing", "e"), ("ly", ""), ("er", ""), ("est", ""), ("ness", ""), ("ity", "e"), ("al", "")]
EDGES = "\"'“”‘’()[]{}.,;:!?*—–-"
#: What is cut off a word of a reading before it is looked up.
READING_EDGES = ".,;:!?()[]„“”\"'‚‘’»«-–—/"
#: Kinds of records that are scholarly, those that are books, a publisher's name that has its place glued on, an imprint.
SCHOLARLY = ["journal-article", "book", "monograph", "edited-book", "reference-book", "book-chapter", "book-section", "book-part", "proceedings-article", "dissertation", "report", "posted-content"]
BOOKS = ["book", "monograph", "edited-book", "reference-book"]
GLUED_PLACE = r"^(.+\b(?:Press|Publishers|Publishing|Verlag|Books))([A-Z][\w ]+)$"
IMPRINT = r"This (.{2,60}?) imprint is published by"
#: Share of a record's long title words that must stand on a document's first pages.
TITLE_SHARE = 0.6
#: Different words, the commonest ones, that are sent to all tasks.
COMMON = 10_000
FRONT_KEYS = ["type", "title", "subtitle", "author", "editor", "date", "journal", "volume", "issue", "booktitle", "series", "publisher", "place", "edition", "pages", "isbn", "doi", "url", "citation"]


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, n_lines; blank lines are left out."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", kept.alias("ls")).select("doc_id", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("line_no", "line"))


def interior_vocabulary(lines: DataFrame) -> DataFrame:
    """word: different lower-cased words of letters that are neither first nor last of their line; parts of compounds too."""
    tokens = F.split(F.trim("line"), r"\s+")
    inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    words = lines.select(F.explode(inner).alias("t")).select(F.lower(F.btrim("t", F.lit(EDGES))).alias("w"))
    parts = words.select(F.explode(F.split("w", "-")).alias("word"))
    return parts.where("word rlike '^\\\\p{L}+$'").distinct()


def known_words(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tokens (word) with known: in the dictionary as it is or with an ending taken off.

    Each different word is judged once; the commonest ones' verdicts are broadcast, so that a word that a large part of all
    rows hold is no single task's."""
    stems = [F.struct(F.col("word").alias("stem"))] + [F.struct(F.when(F.col("word").endswith(e) & (F.length("word") > len(e) + 1), F.concat(F.expr(f"left(word, length(word) - {len(e)})"), F.lit(r))).alias("stem")) for e, r in ENDINGS]
    counts = tokens.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    each = counts.select("word", F.inline(F.array(*stems))).where("stem IS NOT NULL")
    found = each.join(dictionary.select(F.col("word").alias("stem")).distinct(), "stem", "left_semi").select("word").distinct().withColumn("known", F.lit(True))
    told = counts.join(found, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    common = F.broadcast(told.orderBy(F.desc("n"), "word").limit(COMMON).select("word", F.col("known").alias("_common")))
    met = tokens.join(common, "word", "left")
    rare = met.where("_common IS NULL").join(told.select("word", "known"), "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return met.where("_common IS NOT NULL").withColumn("known", F.col("_common")).unionByName(rare).select(*tokens.columns, "known")


def merged_front_matter(strong: DataFrame, cover: DataFrame, weak: DataFrame) -> DataFrame:
    """Records keyed by doc_id: the first non-empty value of strong, cover and weak, key by key."""
    def renamed(df, name):
        have = set(df.columns)
        return df.select("doc_id", *[(F.nullif(F.col(k), F.lit("")) if k in have else F.lit(None).cast("string")).alias(f"{name}_{k}") for k in FRONT_KEYS])

    joined = renamed(strong, "s").join(renamed(cover, "c"), "doc_id", "full").join(renamed(weak, "w"), "doc_id", "full")
    return joined.select("doc_id", *[F.coalesce(f"s_{k}", f"c_{k}", f"w_{k}").alias(k) for k in FRONT_KEYS])


def yaml_front_matter(records: DataFrame) -> DataFrame:
    """doc_id and yaml: the keys in fixed order, empty ones left out, white space collapsed."""
    lines = F.array_compact(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}: "), tx.squeezed(F.col(k)))) for k in FRONT_KEYS]))
    return records.select("doc_id", F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---")).alias("yaml"))


def crossref_fields(records: DataFrame) -> DataFrame:
    """doc_id and front matter of a JSON bibliographic record (column record). With a column text, the document's first pages,
    a title in capitals takes the letter case printed there, and the publisher is the imprint that they name."""
    person = "array<struct<name:string,given:string,family:string>>"
    schema = f"type string, title array<string>, subtitle array<string>, `container-title` array<string>, author {person}, editor {person}, issued struct<`date-parts`:array<array<int>>>, page string, volume string, issue string, publisher string, `publisher-location` string, `edition-number` string, ISBN array<string>, DOI string"
    shown = F.col("text") if "text" in records.columns else F.lit("")
    r = records.select("doc_id", F.coalesce(shown, F.lit("")).alias("_shown"), F.from_json("record", schema).alias("r")).select("doc_id", "_shown", "r.*")
    imprint = F.regexp_extract(F.regexp_replace("_shown", r"\s+", " "), IMPRINT, 1)
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    people = lambda c: F.coalesce(F.array_join(F.transform(F.col(c), tx.person), " & "), F.lit(""))
    parts = F.filter(F.get(F.col("issued.date-parts"), F.lit(0)), lambda x: x.isNotNull() & (x != 0))
    box = F.transform(F.coalesce("container-title", F.array().cast("array<string>")), tx.tags_stripped)
    article, book = F.col("type") == "journal-article", F.col("type").isin(BOOKS)
    glued = GLUED_PLACE
    house, place = F.coalesce("publisher", F.lit("")), F.coalesce(F.col("publisher-location"), F.lit(""))
    only = lambda test, c: F.coalesce(F.when(test, c), F.lit(""))
    return r.select(
        "doc_id", only(F.col("type").isin(SCHOLARLY), F.lit("academic")).alias("type"),
        F.regexp_replace(tx.as_in_text(tx.tags_stripped(first("title")), F.col("_shown")), r"^[IVXLC]+\.\s*[—–-]\s*", "").alias("title"), tx.tags_stripped(first("subtitle")).alias("subtitle"),
        people("author").alias("author"), people("editor").alias("editor"),
        F.coalesce(F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-"), F.lit("")).alias("date"),
        only(article, F.get(box, F.lit(0))).alias("journal"), only(article, F.col("volume")).alias("volume"), only(article, F.col("issue")).alias("issue"),
        only(~article & ~book, F.try_element_at(box, F.lit(-1))).alias("booktitle"), only(book | (~article & (F.size(box) > 1)), F.get(box, F.lit(0))).alias("series"),
        only(~article, F.when(imprint != "", imprint).when(house.rlike(glued), F.regexp_extract(house, glued, 1)).otherwise(house)).alias("publisher"),
        only(~article, F.when(house.rlike(glued) & (place == ""), F.regexp_extract(house, glued, 2)).otherwise(place)).alias("place"),
        only(~article, F.col("edition-number")).alias("edition"), F.replace(F.coalesce("page", F.lit("")), F.lit("-"), F.lit("–")).alias("pages"),
        only(~article, F.array_join("ISBN", ", ")).alias("isbn"), F.coalesce("DOI", F.lit("")).alias("doi"), F.lit("").alias("url"), F.lit("").alias("citation"),
    )


def document_metadata(first_pages: DataFrame, info: DataFrame, records: DataFrame) -> DataFrame:
    """Front matter of each document (doc_id and FRONT_KEYS): that of the record of the identifier on its first pages, if the
    record's title stands there, above the document's own information.

    first_pages: doc_id, text; info: doc_id, title, author; records: doi, record (JSON), fetched beforehand. An identifier
    without a record is front matter itself; one whose record's title isn't on the first pages was only cited."""
    pages = first_pages.select("doc_id", "text", tx.doi(F.col("text")).alias("_doi"))
    held = pages.join(records.select(F.col("doi").alias("_doi"), "record").where("_doi IS NOT NULL").dropDuplicates(["_doi"]), "_doi", "left")
    fields = crossref_fields(held.where("record IS NOT NULL")).join(pages, "doc_id")
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"(?U)\w{4,}"), F.lit(0))
    there = F.size(F.filter(words, lambda w: F.lower("text").contains(w)))
    own = fields.where((F.size(words) > 0) & (there >= TITLE_SHARE * F.size(words))).withColumn("doi", F.col("_doi")).select("doc_id", *FRONT_KEYS)
    bare = held.where("record IS NULL AND _doi IS NOT NULL").select("doc_id", *[(F.col("_doi") if k == "doi" else F.lit(None).cast("string")).alias(k) for k in FRONT_KEYS])
    nothing = first_pages.select("doc_id").limit(0)
    return merged_front_matter(own.unionByName(bare), nothing, first_pages.select("doc_id").join(info, "doc_id", "left"))


def linked_notes(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """refs (doc_id, page, seq, label) with note_id: the n-th reference of a label on a page is the n-th note of it, but for '?'.
    Then, document by document in order, those left over whose label is a number, '?' or marks take the first free note of
    their page, of the next or of the one before, which lend only if they have more notes than such references."""
    nth = lambda df, by, name: df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy("seq")))
    by_label, page = ["doc_id", "page", "label"], ["doc_id", "page"]
    notes = notes.select(*by_label, "seq", "note_id")
    named = nth(notes.where(F.col("label").cast("string") != "?"), by_label, "k").select(*by_label, "k", "note_id")
    first = nth(refs, by_label, "k").join(named, [*by_label, "k"], "left").select(*refs.columns, "note_id")
    free = notes.where("doc_id IS NOT NULL AND page IS NOT NULL").join(first.where("note_id IS NOT NULL").select("doc_id", "note_id"), ["doc_id", "note_id"], "left_anti")
    meant = F.coalesce(F.col("label").cast("string").rlike(r"^(?:\d{1,3}|\?|[*∗†‡]+)\z"), F.lit(False)) & F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    sizes = notes.groupBy(*page).agg(F.count("*").alias("_notes")).join(refs.where(meant).groupBy(*page).agg(F.count("*").alias("_refs")), page, "left")
    lent = free.join(sizes.select(*page, (F.col("_notes") > F.coalesce("_refs", F.lit(0))).alias("lends")), page).select("doc_id", "page", "seq", "note_id", "lends")
    late = first.where("note_id IS NULL").select(*refs.columns, meant.alias("_meant"))
    schema = T.StructType([*refs.schema.fields, T.StructField("note_id", notes.schema["note_id"].dataType)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, here = left.sort_by([("page", "ascending"), ("seq", "ascending")]), {}
        for r in right.sort_by("seq").to_pylist():
            here.setdefault(r["page"], deque()).append((r["note_id"], r["lends"]))
        got = []
        for at in left["page"].to_pylist():
            # All free notes of a page have the same `lends`.
            found = next((q for p in (at, at + 1, at - 1) if (q := here.get(p)) and (p == at or q[0][1])), None)
            got.append(found.popleft()[0] if found else None)
        return left.append_column("note_id", pa.array(got, right.schema.field("note_id").type))

    # Columns of their own, as both may come from one table.
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    paired = fresh(late.where("_meant").drop("_meant")).groupBy("doc_id").cogroup(fresh(lent).groupBy("doc_id")).applyInArrow(run, schema)
    rest = late.where("NOT _meant").select(*refs.columns, F.lit(None).cast(schema["note_id"].dataType).alias("note_id"))
    return first.where("note_id IS NOT NULL").unionByName(paired).unionByName(rest)


def carried_annotations(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pages (page_no, width, height) of the new file with the old file's annots by page number, and whether the sizes differ."""
    o = old.select("page_no", "annots", F.col("width").alias("old_width"), F.col("height").alias("old_height"))
    off = (F.abs(F.col("width") - F.col("old_width")) > 1) | (F.abs(F.col("height") - F.col("old_height")) > 1)
    return new.join(o, "page_no", "left").select("page_no", "width", "height", "annots", F.coalesce(off, F.lit(False)).alias("size_differs"), F.col("old_width").isNull().alias("beyond"))


def merged_runs(rows: DataFrame, key: str, order: str, gap: float) -> DataFrame:
    """rows with run: a new one begins where `order` leaves more than `gap` to the row before."""
    w = W.partitionBy(key).orderBy(order, *[c for c in rows.columns if c not in (key, order)][:1])
    opens = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn("run", F.sum("_opens").over(w)).drop("_opens")


def edit_path(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest edit of a into b as (kind, place in a, place in b): replace, insert, delete.

    Distances are told row by row within a band about the diagonal, which is doubled until the distance fits into it; so the
    work grows with the length times the distance."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(w, len(code)) for w in ws[start : len(ws) - end]]) for ws in (a, b))
    n, m, far = len(x), len(y), len(a) + len(b) + 1
    reach = 8
    while True:
        reach = min(max(reach, abs(n - m) + 1), n + m + 1)
        # Column k of a row i is place i - reach + k of y.
        width = 2 * reach + 1
        rows = np.full((n + 1, width), far, "i4")
        places = np.arange(width) - reach
        rows[0] = np.where((places >= 0) & (places <= m), places, far)
        for i in range(1, n + 1):
            j = places + i
            inside = (j >= 0) & (j <= m)
            same = np.zeros(width, bool)
            ok = (j >= 1) & (j <= m)
            same[ok] = y[j[ok] - 1] == x[i - 1]
            best = np.minimum(np.where(j >= 1, rows[i - 1] + ~same, far), np.append(rows[i - 1][1:], far) + 1)
            best = np.where(inside, best, far)
            rows[i] = np.where(inside, np.minimum.accumulate(best - np.arange(width)) + np.arange(width), far)
        distance = rows[n][m - n + reach]
        if distance <= reach or reach > n + m:
            break
        reach *= 2
    out, i, j = [], n, m
    while i or j:
        k = j - i + reach
        here = rows[i][k]
        if i and j and rows[i - 1][k] + (x[i - 1] != y[j - 1]) == here:
            if x[i - 1] != y[j - 1]:
                out.append(("replace", start + i - 1, start + j - 1))
            i, j = i - 1, j - 1
        elif j and k and rows[i][k - 1] + 1 == here:
            j -= 1
            out.append(("insert", start + i, start + j))
        else:
            i -= 1
            out.append(("delete", start + i, start + j))
    return out[::-1]


def nfc(c: Column) -> Column:
    """White space collapsed, letters and their accents put together; pure ASCII doesn't go to Python."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    odd = c.rlike(r"[^\x00-\x7F]")
    return tx.squeezed(F.when(odd, composed(F.when(odd, c))).otherwise(F.coalesce(c, F.lit(""))))


def reading_errors(pairs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """pairs (name, gold, reading) with cer, cer_letters, wer, subs (array of struct gold, read), ins, dels and, with a
    dictionary (word), plausible: how many words were put in or for others that are words themselves."""
    texts = pairs.select("name", nfc(F.col("gold")).alias("g"), nfc(F.col("reading")).alias("o"))

    @F.pandas_udf("subs array<struct<gold:string,read:string>>, ins array<string>, dels array<string>")
    def edited(gold: pd.Series, reading: pd.Series) -> pd.DataFrame:
        out = []
        for g, o in zip(gold, reading, strict=True):
            g, o = g.split(), o.split()
            ops = edit_path(g, o)
            out.append(([{"gold": g[i], "read": o[j]} for kind, i, j in ops if kind == "replace"], [o[j] for kind, _, j in ops if kind == "insert"], [g[i] for kind, i, _ in ops if kind == "delete"]))
        return pd.DataFrame(out, columns=["subs", "ins", "dels"])

    p = texts.withColumn("e", edited("g", "o")).select("name", "g", "o", "e.*")
    rate = lambda a, b: F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))
    letters = lambda c: tx.without_punctuation(F.col(c))
    n = F.greatest(F.size(F.filter(F.split("g", " "), lambda x: x != "")), F.lit(1))
    out = p.select("name", rate(F.col("g"), F.col("o")).alias("cer"), rate(letters("g"), letters("o")).alias("cer_letters"), ((F.size("subs") + F.size("ins") + F.size("dels")) / n).alias("wer"), "subs", "ins", "dels")
    if dictionary is None:
        return out
    low = lambda c: F.lower(tx.without_punctuation(c))
    wrong = F.concat(F.transform(F.filter("subs", lambda s: low(s["gold"]) != low(s["read"])), lambda s: s["read"]), F.col("ins"))
    words = out.select("name", F.explode(wrong).alias("w")).select("name", F.btrim("w", F.lit(READING_EDGES)).alias("word")).where(r"word rlike '^\\p{L}+$'")
    counts = words.join(dictionary.select("word").distinct(), "word", "left_semi").groupBy("name").agg(F.count("*").alias("plausible"))
    return out.join(counts, "name", "left").withColumn("plausible", F.coalesce("plausible", F.lit(0).cast("long")))


def compared_readings(gold: DataFrame, readings: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """The errors of every reading (doc_id, name, text) against its document's gold text (doc_id, text)."""
    pairs = readings.join(gold.select("doc_id", F.col("text").alias("gold")), "doc_id").select(F.concat_ws("/", F.col("doc_id").cast("string"), "name").alias("name"), "gold", F.col("text").alias("reading"))
    return reading_errors(pairs, dictionary)


def crop_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("files"))
