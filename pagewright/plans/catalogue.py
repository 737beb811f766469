"""Queries of the layout engine and the SQL that they are held against.

The driver's tables hold no pages or glyphs. Queries over documents and pages use the operators as they are meant;
those marked (shape) borrow an operator's relational shape on other tables; those marked (values) run on a few rows
given here, with the results to be expected.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions import text as tx
from pagewright.operators import documents as dc
from pagewright.operators import folios, ink, outline, paragraphs, render, scans, voting
from pagewright.operators import rows as rw
from pagewright.plans import pages  # noqa: F401  (registers its queries)
from pagewright.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401

FLAGSHIP = "toc_style_levels"
LINES = "WITH d AS (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), l AS (SELECT doc_id, lang, len(ls) AS n, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM d)"


# (shape) styles of contents lines: class by the first word of a part's type.
@query("""
WITH s AS (SELECT DISTINCT p_size % 7 AS doc_id, regexp_extract(p_type, '^\\w+') AS prefix, CAST(floor(p_size / 30) * 30 AS INTEGER) AS indent_bucket, CAST(floor(floor(p_retailprice / 10) / 6) * 6 AS INTEGER) AS height_bucket FROM part)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY height_bucket DESC, indent_bucket, prefix) AS INTEGER) AS level FROM s""")
def toc_style_levels(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("doc_id"), F.regexp_extract("p_type", r"^\w+", 0).alias("prefix"), F.col("p_size").alias("indent"), F.floor(F.col("p_retailprice") / 10).cast("int").alias("height"))
    return outline.style_levels(lines)


@query(LINES + """, t AS (SELECT regexp_split_to_array(trim(line), '\\s+') AS ts FROM l), i AS (SELECT lower(trim(unnest(ts[2:len(ts) - 1]), '""" + dc.EDGES.replace("'", "''") + """')) AS w FROM t), p AS (SELECT unnest(string_split(w, '-')) AS word FROM i)
SELECT DISTINCT word FROM p WHERE regexp_matches(word, '^\\p{L}+$')""")
def interior_vocabulary(spark, sf_dir):
    return dc.interior_vocabulary(dc.document_lines(table(spark, sf_dir, "documents")))


def _words(spark, sf_dir, name):
    return table(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''")


_STEMS = " UNION ALL ".join(["SELECT word, word AS stem FROM t"] + [f"SELECT word, left(word, length(word) - {len(e)}) || '{r}' FROM t WHERE ends_with(word, '{e.replace(chr(39), chr(39) * 2)}') AND length(word) > {len(e) + 1}" for e, r in dc.ENDINGS])


@query(f"""
WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM conversations), t AS (SELECT DISTINCT word FROM w WHERE word <> ''),
b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS stem FROM benchmark), s AS ({_STEMS}), k AS (SELECT DISTINCT word FROM s SEMI JOIN b USING (stem))
SELECT known, count(*) AS n FROM (SELECT w.word, k.word IS NOT NULL AS known FROM w LEFT JOIN k ON w.word = k.word WHERE w.word <> '') GROUP BY known""")
def known_word_share(spark, sf_dir):
    found = dc.known_words(_words(spark, sf_dir, "conversations"), _words(spark, sf_dir, "benchmark"))
    return found.groupBy("known").agg(F.count("*").alias("n"))


@query(LINES + """, c AS (SELECT *, len(regexp_extract_all(line, '\\p{L}')) AS a, len(regexp_extract_all(line, '\\p{Lu}')) AS u FROM l)
SELECT lang, count(*) AS lines, CAST(count(*) FILTER ((a > 0 AND u / a >= 0.8) OR regexp_matches(line, '^\\d{1,4}\\s') OR regexp_matches(line, '\\s\\d{1,4}$')) AS BIGINT) AS heads FROM c GROUP BY lang""")
def running_heads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("lang", F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(tx.running_head(F.col("line"))).alias("heads"))


_PAIRS = "|".join(c * 2 for c in string.ascii_uppercase)
_CLASSES = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in [("paren_double_upper", rf"^\(({_PAIRS})\.\)"), ("paren_double_lower", rf"^\(({_PAIRS.lower()})\.\)"), *tx.NUMBERING[2:]])


@query(LINES + f"""SELECT CASE {_CLASSES} ELSE 'none' END AS prefix, count(*) AS lines, CAST(count(*) FILTER (regexp_matches(line, '{tx.LINE_NUMBER}')) AS BIGINT) AS numbered FROM l GROUP BY 1""")
def numbering_classes(spark, sf_dir):
    lines = dc.document_lines(table(spark, sf_dir, "documents"))
    return lines.groupBy(tx.numbering_class(F.col("line")).alias("prefix")).agg(F.count("*").alias("lines"), F.count(tx.page_number(F.col("line"))).alias("numbered"))


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""
WITH p AS (SELECT page_id, {_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title, {_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS h1 FROM pages)
SELECT page_id, title, title = h1 AND title <> '' AS same FROM p""")
def page_titles(spark, sf_dir):
    inner = lambda tag: tx.tags_stripped(F.regexp_extract("html", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return table(spark, sf_dir, "pages").select("page_id", inner("title").alias("title"), inner("h1").alias("h1")).select("page_id", "title", ((F.col("title") == F.col("h1")) & (F.col("title") != "")).alias("same"))


# (shape) lines of an order as words of a page: those 1.4 times as large as the upper median.
@query("""
WITH m AS (SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, l_linenumber AS block_num, max(l_quantity) / median AS rel FROM lineitem JOIN m USING (l_orderkey) WHERE median > 0 AND l_quantity >= 1.4 * median GROUP BY l_orderkey, l_linenumber, median""")
def heading_candidates(spark, sf_dir):
    one = F.lit(1)
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), one.alias("page"), F.col("l_linenumber").alias("block_num"), one.alias("par_num"), one.alias("line_num"), one.alias("word_num"), one.alias("left"), F.col("l_quantity").alias("height"), F.lit("Heading").alias("text"))
    return outline.heading_candidates(words).select("doc_id", "block_num", "rel")


_PAGES = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pdf_page, o_orderkey FROM orders"


# (shape) a customer's orders as pages, some without a number.
@query(f"""
WITH p AS (SELECT doc_id, pdf_page, CASE WHEN o_orderkey % 3 <> 0 THEN pdf_page + o_orderkey % 2 END AS n FROM ({_PAGES})),
s AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN n - pdf_page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pdf_page RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN n IS NOT NULL THEN n - pdf_page END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pdf_page RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM p)
SELECT doc_id, pdf_page, CAST(coalesce(n, CASE WHEN (a IS NULL OR b IS NULL OR a = b) AND coalesce(b, a) + pdf_page >= 1 THEN coalesce(b, a) + pdf_page END) AS VARCHAR) AS folio FROM s""")
def folio_inference(spark, sf_dir):
    at = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), at.alias("pdf_page"), F.lit("").alias("part"), "o_orderkey")
    pages = pages.withColumn("folio", F.when(F.col("o_orderkey") % 3 != 0, (F.col("pdf_page") + F.col("o_orderkey") % 2).cast("string")))
    return folios.infer_folios(pages.drop("o_orderkey")).select("doc_id", "pdf_page", "folio")


# (shape) a user's events as references and notes.
@query("""
WITH r AS (SELECT user_id, event_id AS seq, event_id % 4 AS label, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 0),
n AS (SELECT user_id, event_id AS note_id, event_id % 4 - event_id % 4 % 2 AS label, event_id AS seq FROM events WHERE event_id % 2 = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY seq) AS k FROM n),
f AS (SELECT r.user_id, r.seq, r.label, note_id FROM r LEFT JOIN m ON r.user_id = m.user_id AND r.label = m.label AND r.k = m.k),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM f WHERE note_id IS NULL),
g AS (SELECT user_id, note_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM n WHERE note_id NOT IN (SELECT note_id FROM f WHERE note_id IS NOT NULL))
SELECT user_id AS doc_id, seq, label, note_id FROM f WHERE note_id IS NOT NULL UNION ALL SELECT l.user_id, l.seq, l.label, g.note_id FROM l LEFT JOIN g ON l.user_id = g.user_id AND l.k = g.k""")
def linked_notes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("label"))
    notes = events.where("seq % 2 = 1").withColumn("note_id", F.col("seq")).withColumn("label", F.col("label") - F.col("label") % 2)
    return dc.linked_notes(events.where("seq % 2 = 0"), notes).drop("page")


# (shape) a user's events as paragraphs that continue unless the gap is too large.
@query("""
WITH e AS (SELECT event_id, user_id, epoch(ts) AS ts_s FROM events), o AS (SELECT *, CASE WHEN ts_s - lag(ts_s) OVER w <= 3600 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts_s, event_id))
SELECT event_id, user_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts_s, event_id) AS BIGINT) AS run FROM o""")
def merged_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return dc.merged_runs(events, "user_id", "at", 3600).drop("at")


# (shape) orders as pages of a new file, shipped orders as those of an old one.
@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey AS page_no, coalesce(n, 0) AS n_annots, coalesce(abs(o_totalprice - q * 1000) > 1 OR abs(o_custkey - l_orderkey) > 1, false) AS size_differs, l_orderkey IS NULL AS beyond FROM orders LEFT JOIN o ON o_orderkey = l_orderkey""")
def carried_annotations(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_no"), F.col("o_totalprice").alias("width"), F.col("o_custkey").alias("height"))
    old = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("page_no")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("annots"), (F.sum("l_quantity") * 1000).alias("width"), F.first("l_orderkey").alias("height"))
    return dc.carried_annotations(new, old).select("page_no", F.coalesce(F.size("annots"), F.lit(0)).cast("long").alias("n_annots"), "size_differs", "beyond")


@query("""SELECT s_name, array_to_string(list_transform(regexp_extract_all(s_name, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE lower(p) END), '') AS natural_key FROM supplier""")
def natural_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_name", tx.natural_key(F.col("s_name")).alias("natural_key"))


# (shape) nations as records of three sources.
@query("""
SELECT n_nationkey AS doc_id, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name) AS title, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS publisher, n_name AS author FROM nation JOIN region ON n_regionkey = r_regionkey""")
def merged_front_matter(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").alias("doc_id")
    strong = nation.select(key, F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise("").alias("title"))
    cover = nation.where("n_nationkey % 2 = 0").select(key, F.col("r_name").alias("title"), F.col("r_name").alias("publisher"))
    weak = nation.select(key, F.col("r_name").alias("title"), F.col("n_name").alias("author"))
    return dc.merged_front_matter(strong, cover, weak).select("doc_id", "title", "publisher", "author")


@query("""
SELECT item_id AS name, levenshtein(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(replace(text, 'the', 'teh,'), '\\s+', ' ', 'g'))) / greatest(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1) AS cer FROM benchmark WHERE regexp_full_match(text, '[\\x00-\\x7F]*')""")
def reading_errors(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    pairs = gold.select(F.col("item_id").alias("name"), F.col("text").alias("gold"), F.replace("text", F.lit("the"), F.lit("teh,")).alias("reading"))
    return dc.reading_errors(pairs).select("name", "cer")


#: DuckDB's levenshtein counts bytes: letters of several become one each, namely a control character that no text has.
_ACCENTED = "ÄÇÈÉÊÑÖÜßäçèéêíñóöü"
_SINGLE = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)][: len(_ACCENTED)])


# All rows of the benchmark, beside the query above, which has only those in ASCII.
@query(f"""
WITH b AS (SELECT item_id, translate(nfc_normalize(text), '{_ACCENTED}', {_SINGLE}) AS text FROM benchmark),
t AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS gold, trim(regexp_replace(replace(text, 'the', 'teh,'), '\\s+', ' ', 'g')) AS reading FROM b)
SELECT item_id AS name, levenshtein(gold, reading) / greatest(length(gold), 1) AS cer FROM t""")
def reading_errors_all(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), F.col("text").alias("gold"), F.replace("text", F.lit("the"), F.lit("teh,")).alias("reading"))
    return dc.reading_errors(pairs).select("name", "cer")


@query("SELECT l_returnflag AS action, count(*) AS files FROM lineitem GROUP BY 1")
def crop_summary(spark, sf_dir):
    return dc.crop_summary(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("action")))


# (shape) a user's events as text pieces; the titles are pairs of event types.
@query("""
WITH s AS (SELECT user_id, event_id // 100 AS page, event_id AS seq, lower(string_agg(event_type, '') OVER (PARTITION BY user_id, event_id // 100 ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS joined FROM events),
t AS (SELECT DISTINCT user_id, a.event_type || b.event_type AS title FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b)
SELECT t.user_id AS doc_id, t.title, min(s.page) AS found_page FROM t LEFT JOIN s ON s.user_id = t.user_id AND instr(s.joined, t.title) BETWEEN 1 AND 3 GROUP BY 1, 2""")
def placed_headings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    shows = events.select(F.col("user_id").alias("doc_id"), F.floor(F.col("event_id") / 100).alias("page"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    kinds = events.select("event_type").distinct()
    # The kinds of events are a handful; each user gets the array of their pairs.
    titles = kinds.agg(F.collect_set("event_type").alias("k")).select(F.flatten(F.transform("k", lambda a: F.transform("k", lambda b: F.concat_ws(" ", a, b)))).alias("titles"))
    # Each pair is sought from the first page (the hint), in the pieces with spaces between; the pair is named without one.
    entries = events.select(F.col("user_id").alias("doc_id")).distinct().join(F.broadcast(titles)).select("doc_id", F.posexplode("titles").alias("seq", "title"), F.lit(0).alias("page"))
    return outline.place_headings(entries, shows).select("doc_id", F.replace("title", F.lit(" "), F.lit("")).alias("title"), "found_page")


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


_TOC = [("VIIL. The Problem of Evil 27", "VIII. The Problem of Evil", 27, "roman"), ("1.1 Bar . 17", "1.1 Bar", 17, "arabic_dotted"), ("(AA.) Reason", "(AA.) Reason", None, "paren_double_upper"), ("L. Logic 3", "I. Logic", 3, "roman"), ("a. Being", "a. Being", None, "letter_lower"), ("Preface", "Preface", None, "none"), ("I11. Notion 101", "III. Notion", 101, "roman"), ("title.....27", "title.....27", None, "none")]
_quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"{x}::DOUBLE" if isinstance(x, float) else "'" + x.replace("'", "''") + "'"
_sql = lambda rows, names: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in rows)}) AS t({names})"


# (values) lines of a printed contents page.
@query(_sql([(i, *r[1:]) for i, r in enumerate(_TOC)], "line_num, text, page_hint, prefix"))
def toc_lines(spark, sf_dir):
    words = [(1, 1, 1, 1, i, k, 100 + 10 * k, 24, w) for i, r in enumerate(_TOC) for k, w in enumerate(r[0].split(" "))]
    return outline.toc_lines(_rows(spark, words, "doc_id long, page int, block_num int, par_num int, line_num int, word_num int, left int, height int, text string")).select("line_num", "text", "page_hint", "prefix")


_FOLIOS = [("8", "8"), ("9", "9"), ("09", "9"), ("II", "11"), ("12", "12"), ("3", "13"), (None, None), ("15", "15"), ("I6", "16")]


# (values) printed numbers misread in a run of pages.
@query(_sql([(i, want) for i, (_, want) in enumerate(_FOLIOS)], "seq, folio"))
def repaired_folios(spark, sf_dir):
    pages = [(1, i, i, "", read) for i, (read, _) in enumerate(_FOLIOS)]
    return folios.repair_folios(_rows(spark, pages, "doc_id long, seq int, pdf_page int, part string, folio string")).select("seq", "folio")


_SOURCES = [("Mind, New Series, Vol. 72, No. 288 (Oct., 1963), pp. 481-501", "Mind, New Series", "72", "288", "1963", "481–501", ""), ("An odd line", "", "", "", "", "", "An odd line"), ("Noûs, Vol. 3 (1969)", "Noûs", "3", "", "1969", "", "")]


# (values) source lines of journals.
@query(_sql(_SOURCES, "source, journal, volume, issue, date, pages, citation"))
def journal_sources(spark, sf_dir):
    return _rows(spark, [(r[0],) for r in _SOURCES], "source string").withColumn("s", tx.journal_source(F.col("source"))).select("source", "s.*")


_DOIS = [("see 10.1000/182, and DOI: 10.1093/mind/fzv001.", "10.1093/mind/fzv001"), ("at 10.1000/xyz).", "10.1000/xyz"), ("none", None)]


# (values) identifiers in running text.
@query(_sql(_DOIS, "text, doi"))
def found_dois(spark, sf_dir):
    return _rows(spark, [(r[0],) for r in _DOIS], "text string").withColumn("doi", tx.doi(F.col("text")))


_NOISE = [("opinion,!", 1), ("Being-there?", 1), ("word.1", 1), ("L AL AR", 1), ("II.", 1), ("cognition.", 1), ("Preface", 0), ("Bibliography", 0), ("The Idea of It", 0)]


# (values) heading candidates that are body text.
@query(_sql(_NOISE, "text, noise"))
def heading_noise(spark, sf_dir):
    return _rows(spark, [(r[0],) for r in _NOISE], "text string").withColumn("noise", tx.heading_noise(F.col("text")).cast("int"))


_LINE_ROWS = "SELECT l_suppkey AS doc_id, CAST(l_linenumber AS INTEGER) AS page, l_quantity AS x0, l_extendedprice AS x1, 10 + l_discount * 50 AS size FROM lineitem"


# (shape) lines of an order as rows of a page: their size from the discount, their edges from quantity and price.
@query(f"""
WITH r AS ({_LINE_ROWS}), b AS (SELECT *, size > 9.2 AND size < 11.5 AS b FROM r), k AS (SELECT * FROM (SELECT *, max(CAST(b AS INTEGER)) OVER (PARTITION BY doc_id, page) AS any_b FROM b) WHERE b OR any_b = 0),
c AS (SELECT doc_id, page, round_even(x0, 0) AS x, count(*) AS n FROM k GROUP BY 1, 2, 3), l AS (SELECT doc_id, page, x, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, x) AS k FROM c),
e AS (SELECT doc_id, page, list_sort(list(x1)) AS ends FROM k GROUP BY 1, 2)
SELECT doc_id, page, CAST(x AS DOUBLE) AS "left", CAST(ends[CAST(floor(0.9 * (len(ends) - 1)) AS INTEGER) + 1] AS DOUBLE) AS "right" FROM l JOIN e USING (doc_id, page) WHERE k = 1""")
def page_margins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("x1"), (10 + F.col("l_discount") * 50).alias("size"), F.lit(10.0).alias("body"), F.lit(False).alias("fuzzy"))
    return rw.page_margins(rows)


# (shape) lines of an order as glyphs.
@query("""
WITH s AS (SELECT l_suppkey AS doc_id, round_even(CAST(l_quantity AS DOUBLE) * 2, 0) / 2 AS body, count(*) AS n, min((l_orderkey, l_linenumber)) AS f FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT doc_id, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM s) WHERE k = 1""")
def body_sizes(spark, sf_dir):
    glyphs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("row_no"), F.lit(1).alias("glyph_no"), F.lit("x").alias("text"), F.col("l_quantity").cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("sup"))
    return rw.body_size(glyphs)


# (shape) lines of an order as words of a page.
@query("""
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS top, CAST(l_quantity AS DOUBLE) AS height FROM lineitem), c AS (SELECT *, min(top) OVER p + 0.6 * (max(top + height) OVER p - min(top) OVER p) AS cut FROM w WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, CAST(1 AS INTEGER) AS page, list_sort(list(height))[count(*) // 2 + 1] AS body FROM c WHERE top <= cut GROUP BY doc_id""")
def body_heights(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("top"), F.col("l_quantity").cast("double").alias("height"))
    return paragraphs.body_heights(words)


_LINE_ENDS = [("be-|ning and", "bening and"), ("self-|Consciousness", "self- Consciousness"), ("one|two—three", "one two – three"), ("10-|year", "10- year"), (" a | |b", "a b")]


# (values) lines of paragraphs as running text.
@query(_sql(_LINE_ENDS, "lines, text"))
def copy_texts(spark, sf_dir):
    return _rows(spark, [(r[0],) for r in _LINE_ENDS], "lines string").withColumn("text", paragraphs.copy_text(F.split("lines", r"\|")))


#: Word, left, top, height, and the word that is left of it.
_MARKED = [("Being", 0, 100, 20, "Being"), ("1", 60, 96, 9, None), ("mediation,2", 80, 100, 20, "mediation,"), ("§78", 160, 100, 20, "§78"), ("end*", 200, 100, 20, "end"), ("1", 240, 101, 19, "1")]


# (values) words of a line, some of them markers of notes.
@query(_sql([(i, r[4]) for i, r in enumerate(_MARKED) if r[4]], "word_num, text"))
def unmarked_words(spark, sf_dir):
    rows = [(1, 1, 1, 1, 1, i, *r[1:4], r[0]) for i, r in enumerate(_MARKED)]
    return paragraphs.without_markers(_rows(spark, rows, "doc_id long, page int, block_num int, par_num int, line_num int, word_num int, left int, top int, height int, text string")).select("word_num", "text")


#: Text, label, left edge, size, whether it is a note: a page's foot with a note carried over from the page before.
_FOOT = [("Body text", None, 50, 10.0, 0), ("A small quote", None, 90, 8.0, 0), ("of the last note.", None, 50, 8.0, 1), ("1 See there.", "1", 50, 8.0, 1), ("198 Avenue", "198", 50, 8.0, 1)]


# (values) rows at the foot of a page.
@query(_sql([(i, r[4]) for i, r in enumerate(_FOOT)], "row_no, note"))
def foot_notes(spark, sf_dir):
    rows = [(1, 1, i, t, label, False, float(x), 500.0 - 12 * i, 490.0 - 12 * i, 492.0 - 12 * i, size, 10.0, False, [], ["1"]) for i, (t, label, x, size, _) in enumerate(_FOOT)]
    schema = "doc_id long, page int, row_no int, text string, label string, label_raised boolean, x0 double, top double, bottom double, baseline double, size double, body double, fuzzy boolean, rules array<double>, refs array<string>"
    return rw.split_notes(_rows(spark, rows, schema)).select("row_no", F.col("note").cast("int").alias("note"))


@query(LINES + f""", t AS (SELECT doc_id, regexp_split_to_array(trim(line), '\\s+') AS ts FROM l), i AS (SELECT doc_id, lower(trim(unnest(ts[2:len(ts) - 1]), '{render.EDGES.replace("'", "''")}')) AS w FROM t),
k AS (SELECT *, contains(trim(w, '-'), '-') AS c FROM i), p AS (SELECT doc_id, unnest(string_split(w, '-')) AS w FROM k WHERE c), a AS (SELECT doc_id, w, c FROM k WHERE c OR w <> '' UNION SELECT doc_id, w, false FROM p WHERE w <> '')
SELECT doc_id, count(*) FILTER (NOT c) AS words, count(*) FILTER (c) AS compounds FROM a GROUP BY doc_id""")
def document_vocabulary(spark, sf_dir):
    rows = dc.document_lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line").alias("text"))
    return render.vocabulary(rows).groupBy("doc_id").agg(F.count_if(~F.col("compound")).alias("words"), F.count_if("compound").alias("compounds"))


# (shape) line items as blocks of a document, those with a return as headings.
@query("""
SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN CAST(least(dense_rank() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_quantity DESC), 4) AS INTEGER) END AS level FROM lineitem""")
def heading_levels(spark, sf_dir):
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "h").otherwise("p").alias("kind"), F.col("l_quantity").alias("size"))
    return render.heading_levels(blocks).select("doc_id", "seq", "level")


# (shape) nations as headings and customers' orders as notes of a document.
@query("""
WITH p AS (SELECT n_regionkey AS doc_id, 1 AS r, n_nationkey AS place, '# ' || n_name AS part FROM nation UNION ALL SELECT s_nationkey % 5, 2, s_suppkey, '[^' || s_suppkey || ']: ' || s_name FROM supplier)
SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY r, place) || chr(10) AS markdown FROM p GROUP BY doc_id""")
def markdown_documents(spark, sf_dir):
    blocks = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("seq"), F.lit("h").alias("kind"), F.lit(1).alias("level"), F.col("n_name").alias("text"))
    notes = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("doc_id"), F.col("s_suppkey").alias("note"), F.col("s_name").alias("text"))
    return render.markdown_documents(blocks, notes)


_HYPHENS = [("specu", "lative", 0), ("self", "consciousness", 1), ("in", "itself", 1), ("it", "self", 0), ("Being", "for-self", 1), ("so", "called", 1), ("omnis", "cient", 0), ("sequence", "aligned", 1), ("under", "stood", 0)]


# (values) words parted at a line's end: 1 where the hyphen stays.
@query(_sql(_HYPHENS, "head, tail, keep"))
def line_end_hyphens(spark, sf_dir):
    words = _rows(spark, [(1, w, False) for w in ("sequence", "aligned", "understood", "under", "stood")], "doc_id long, word string, compound boolean")
    known = _rows(spark, [(w,) for w in ("so", "called", "omniscient")], "word string")
    ends = _rows(spark, [(1, h, t) for h, t, _ in _HYPHENS], "doc_id long, head string, tail string")
    return render.kept_hyphens(ends, words, known).select("head", "tail", F.col("keep").cast("int").alias("keep"))


_STARTS = [("# x", "\\# x"), ("1. x", "1\\. x"), ("- x", "\\- x"), ("-x", "-x"), ("/a", "\\/a"), ("plain", "plain"), ("12) y", "12\\) y")]


# (values) paragraphs that begin like Markdown's syntax.
@query(_sql(_STARTS, "text, safe"))
def block_starts(spark, sf_dir):
    return _rows(spark, [(r[0],) for r in _STARTS], "text string").withColumn("safe", render.block_start_escaped(F.col("text")))


_TOKENS = [("omniscient,", 1), ("fan", 0), ("12.5", 1), ("xiv", 1), ("don’t", 1), ("self-same", 1), ("b", 1), ("...", 1), ("caf\u00e9", 0), ("sames", 1)]


# (values) tokens that read as words.
@query(_sql(_TOKENS, "token, valid"))
def valid_tokens(spark, sf_dir):
    known = _rows(spark, [(w,) for w in ("omniscient", "don", "self", "same")], "word string")
    return voting.valid_tokens(_rows(spark, [(t,) for t, _ in _TOKENS], "token string"), known).select("token", F.col("valid").cast("int").alias("valid"))


# (shape) conversations' words as a reading, the benchmark's as dictionary: how many are valid.
@query("""
WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM conversations), b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS stem FROM benchmark),
w AS (SELECT token AS word FROM t WHERE token <> ''), s AS (""" + _STEMS.replace("FROM t", "FROM w") + """), k AS (SELECT DISTINCT word FROM s SEMI JOIN b USING (stem))
SELECT count(*) AS tokens, count(*) FILTER (regexp_matches(word, '^(m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})|[a-z])$') OR word IN (SELECT word FROM k)) AS valid FROM w""")
def valid_share(spark, sf_dir):
    tokens = _words(spark, sf_dir, "conversations").withColumnRenamed("word", "token")
    return voting.valid_tokens(tokens, _words(spark, sf_dir, "benchmark")).agg(F.count("*").alias("tokens"), F.count_if("valid").alias("valid"))


# (shape) line items as inked pixels of their orders' images.
@query("""
WITH c AS (SELECT l_orderkey AS image_id, CAST(l_quantity AS BIGINT) AS x, min(l_linenumber) AS top, max(l_linenumber) AS bottom FROM lineitem GROUP BY 1, 2),
i AS (SELECT *, x - row_number() OVER (PARTITION BY image_id ORDER BY x) AS island FROM c)
SELECT image_id, min(x) AS c0, max(x) + 1 AS c1, min(top) AS top, max(bottom) AS bottom FROM i GROUP BY image_id, island""")
def ink_runs(spark, sf_dir):
    return ink.ink_runs(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_quantity").cast("long").alias("x"), F.col("l_linenumber").alias("y")))


# (shape) line items as inked pixels of their suppliers' images.
@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS image_id, CAST(l_quantity AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS y FROM lineitem),
h AS (SELECT image_id, a AS slant, x - CAST(round_even((10 - y) * tan(radians(a)), 0) AS BIGINT) AS col, count(*) AS n FROM p, (SELECT unnest(range(-8, 25, 2)) AS a) GROUP BY 1, 2, 3),
s AS (SELECT image_id, slant, sum(n * n) AS sharp, sum(n) AS ink FROM h GROUP BY 1, 2),
b AS (SELECT image_id, arg_max(slant, sharp * 100 - slant) AS slant, max(sharp) AS sharp, max(sharp) FILTER (slant = 0) AS upright, max(ink) AS ink FROM s GROUP BY 1)
SELECT image_id, CASE WHEN ink >= 20 THEN CAST(slant AS DOUBLE) END AS slant, CASE WHEN ink >= 20 THEN CAST(sharp AS DOUBLE) / CAST(upright AS DOUBLE) ELSE 0.0 END AS gain FROM b""")
def word_slants(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_quantity").cast("long").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y")).distinct()
    return ink.slants(pixels, pixels.select("image_id").distinct().select("image_id", F.lit(51).alias("width"), F.lit(11).alias("height")))


# (shape) orders as pages of their customers' scans, urgent ones as right halves.
@query("SELECT o_custkey AS doc_id, o_orderkey AS pdf_page, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS half, o_orderkey + CAST(sum(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS number FROM orders")
def spread_numbers(spark, sf_dir):
    return ink.numbered_spreads(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pdf_page"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("half")))


_RANGES = [("12-15", "12 13 14 15"), ("3,5,9-11", "3 5 9 10 11"), ("7", "7"), ("4,2-4", "2 3 4"), ("", None), ("9-7", "")]


# (values) pages asked for.
@query(_sql(_RANGES, "spec, pages"))
def page_ranges(spark, sf_dir):
    return _rows(spark, [(r[0],) for r in _RANGES], "spec string").withColumn("pages", F.array_join(ink.page_range(F.col("spec")), " "))


# (shape) line items as words of a page, their slant from the quantity and their gain from the discount.
@query("""
WITH w AS (SELECT l_orderkey AS page_id, l_linenumber AS word_num, CASE l_returnflag WHEN 'N' THEN 'no' ELSE 'back' END AS text, CAST(l_quantity AS DOUBLE) - 20 AS slant, 1 + CAST(l_discount AS DOUBLE) * 2 AS gain FROM lineitem),
p AS (SELECT page_id, coalesce(quantile_cont(slant, 0.5) FILTER (len(regexp_replace(text, '\\W', '', 'g')) >= 3), 0) AS middle FROM w GROUP BY 1)
SELECT w.page_id, word_num, text, slant - middle BETWEEN 8 AND 20 AND gain >= CASE WHEN len(text) <= 2 THEN 1.12::DOUBLE ELSE 1.1::DOUBLE END AS italic FROM w JOIN p USING (page_id)""")
def italic_words(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("word_num"), F.when(F.col("l_returnflag") == "N", "no").otherwise("back").alias("text"), (F.col("l_quantity").cast("double") - 20).alias("slant"), (F.col("l_discount").cast("double") * 2 + 1).alias("gain"))
    return scans.italic_words(words).select("page_id", "word_num", "text", "italic")


_MARKS = [(0.95, 0.45, "sup"), (0.8, 0.6, "quote"), (0.2, -0.3, "sub"), (0.2, -0.1, "comma"), (0.15, 0.0, "period"), (0.9, 0.0, "glyph")]


# (values) marks beside a word.
@query(_sql(_MARKS, "top, bottom, kind"))
def mark_kinds(spark, sf_dir):
    return _rows(spark, [r[:2] for r in _MARKS], "top double, bottom double").withColumn("kind", scans.mark_kind(F.col("top"), F.col("bottom")))


@query(LINES + f""", t AS (SELECT doc_id, line_no, trim(line) AS line, regexp_split_to_array(trim(line), '\\s+') AS ts FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, len(list_filter(ts, lambda t: length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 3)) = 0 OR (len(ts) = 1 AND (regexp_matches(line, '{tx.FOOTNOTE_TAIL.replace("'", "''")}') OR regexp_matches(line, '[.,;:]$'))) AS noise FROM t""")
def noisy_lines(spark, sf_dir):
    """Every line of the documents as a heading candidate: whether it is noise."""
    return dc.document_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", tx.heading_noise(F.col("line")).alias("noise"))


@query(LINES + f""", e AS (SELECT doc_id, line_no, replace(regexp_replace(line, '([\\\\*_`~^$])', '\\\\\\1', 'g'), '==', '\\=\\=') AS t FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN regexp_matches(t, '^(#{{1,6}}\\s|>|[-+*]\\s|/|\\+\\+\\+|\\{{\\{{)') THEN '\\' || t ELSE regexp_replace(t, '^(\\d+)([.)]\\s)', '\\1\\\\\\2') END AS safe FROM e""")
def safe_lines(spark, sf_dir):
    """Every line of the documents as a Markdown paragraph that reads as it is."""
    return dc.document_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", render.block_start_escaped(tx.escaped(F.col("line"))).alias("safe"))


# (shape) an order's line items as entries of an outline, their level from the quantity.
@query("""
WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, CAST(1 + max(l_quantity) % 5 AS INTEGER) AS level FROM lineitem GROUP BY 1, 2)
SELECT doc_id, seq, level, (SELECT max(b.seq) FROM e b WHERE b.doc_id = e.doc_id AND b.seq < e.seq AND b.level < e.level) AS parent FROM e""")
def outline_parents(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg((1 + F.max("l_quantity") % 5).cast("int").alias("level"))
    return outline.with_parents(entries)
