"""Pages: glyph rows, columns, notes, blocks, Markdown, images, scans, PDF files; worked examples and brute force."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright import entries, schemas
from pagewright.functions import runs as rn
from pagewright.functions import style
from pagewright.functions import text as tx
from pagewright.operators import assemble, documents, furniture, glyphs, images, notes, readings, tidying
from pagewright.operators import blocks as bl
from pagewright.plans import catalogue
from pagewright.session import stored
from pagewright.sources import pdf as source


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def row(page, no, runs, x0=72.0, x1=400.0, size=10.0, y=None, fuzzy=False, frame=(None, None), hang=None, doc=1):
    """A row of runs: text, or (text, style letters i b ^)."""
    rs = [(t, "i" in s, "b" in s, "^" in s, fuzzy, None) for t, s in ((r, "") if isinstance(r, str) else r for r in runs)]
    y = 700.0 - 12 * no if y is None else y
    return (doc, page, no, rs, x0, x1, y + size, y - 2, size, y, *frame, fuzzy, hang)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, schemas.ROW)


def pages_of(spark, n, doc=1):
    return spark.createDataFrame([(doc, p, p, "", 500.0, 800.0, [], None, False) for p in range(1, n + 1)], schemas.PAGE)


def test_styles(spark):
    cases = [("ABCDEF+MinionPro-BoldIt", 0, 0.0, 0, None, (True, True)), ("CMTI10", 0, 0.0, 0, None, (True, False)), ("cmbx12", 0, 0.0, 0, None, (False, True)), ("Plain", 1 << 6, 0.0, 0, None, (True, False)), ("Plain", 0, -12.0, 700, None, (True, True)), ("Plain", 0, 0.0, 0, [1.0, 0.0, 0.2, 1.0], (True, False)), ("Times,Bold", 0, 0.0, 0, None, (False, True)), ("Times", 0, 1.0, 400, [1.0, 0.0, 0.1, 1.0], (False, False))]
    df = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(cases)], "k int, name string, flags int, angle double, weight int, m array<double>")
    got = {r.k: (r.s.italic, r.s.bold) for r in df.select("k", style.font_style(*map(F.col, ("name", "flags", "angle", "weight", "m"))).alias("s")).collect()}
    assert got == {k: c[5] for k, c in enumerate(cases)}
    assert tuple(one(spark, style.style_part(F.lit("ABCDEF+MinionPro-BoldIt")))) == ("minionpro", "boldit")
    shown = [r.c for r in spark.createDataFrame([(k, c) for k, c in enumerate("ﬁx")], "k int, c string").orderBy("k").select(style.plain_character(F.col("c")).alias("c")).collect()]
    assert shown == ["A", "1", "fi", "x"]


def test_scalars(spark):
    assert one(spark, tx.title_case(F.lit("JEAN-LUC O'NEIL"))) == "Jean-Luc O'Neil"
    assert one(spark, tx.as_in_text(F.lit("ON DENOTING"), F.lit("in  On\n Denoting, he"))) == "On\n Denoting"
    assert one(spark, tx.as_in_text(F.lit("ON DENOTING"), F.lit("ON DENOTING"))) == "ON DENOTING"
    assert one(spark, tx.quotes_cleaned(F.lit("‘“a”’ ““b””"))) == "“a” “b”"
    assert one(spark, tx.entities_resolved(F.lit("<i>a</i> &amp;&eacute;&nbsp;b"))) == "a &é b" and one(spark, tx.entities_resolved(F.lit("a &lt; b"))) == "a < b"
    cover = tx.journal_cover(F.lit("On Being Author(s): A. Smith and B. Jones Source: Mind, Vol. 72, No. 288 (Oct., 1963), pp. 481- 501 Published by: OUP Stable URL: http://x/1 JSTOR is"))
    c = one(spark, cover)
    assert (c.title, c.author, c.journal, c.volume, c.date, c.pages, c.url) == ("On Being", "A. Smith & B. Jones", "Mind", "72", "1963", "481–501", "http://x/1")
    info = lambda t, a: one(spark, tx.info_fields(F.lit(t), F.lit(a)))
    assert tuple(info("thesis.docx", "X")) == (None, None) and tuple(info("On Being", "X")) == ("On Being", "X")
    assert one(spark, tx.info_text(F.lit(b"\xfe\xff\x00A\x00b"))) == "Ab" and one(spark, tx.info_text(F.lit(b"\xe9"))) == "é"


def test_runs(spark):
    r = F.array(rn.run("1", sup=True), rn.run("2", sup=True), rn.run(" See ", italic=True), rn.run("x"), rn.run("3", sup=True))
    assert one(spark, rn.leading_mark(r)) == "12" and one(spark, rn.plain_of(r)) == "See x"
    assert [(m.at, m.label) for m in one(spark, rn.marks(r))] == [(0, "12"), (4, "3")]
    assert [x.text for x in one(spark, rn.without_first(r, F.lit(3)))] == ["ee ", "x", "3"]
    assert [x.text for x in one(spark, rn.sliced(r, F.lit(1), F.lit(4)))] == ["2", " S"]


def test_columns():
    """Two columns under a full-width title and over a full-width foot; a folio beside the title; a page without a gutter."""
    import pandas as pd

    lines = [(50, 450, 700, 690), (455, 470, 700, 690)] + [(50, 240, 680 - 12 * k, 670 - 12 * k) for k in range(6)] + [(260, 450, 680 - 12 * k, 670 - 12 * k) for k in range(6)] + [(50, 450, 500, 490)]
    pdf = pd.DataFrame(lines, columns=["x0", "x1", "top", "bottom"], dtype=float)
    out = glyphs.reading_order(pdf)
    order = out.sort_values(["group", "top"], ascending=[True, False])
    assert order.index.tolist() == [0, 1, *range(2, 8), *range(8, 14), 14] and out.group.nunique() == 4
    assert out.frame_hi[2] == out.frame_lo[8] and 240 <= out.frame_hi[2] <= 260
    assert glyphs.reading_order(pdf.iloc[2:8]).frame_lo.isna().all()
    # Lines that overlap by more than half stand in one row.
    beside = pd.DataFrame([(0, 10, 20, 10), (20, 30, 18, 9), (0, 10, 12, 2), (40, 50, 11, 1)], columns=["x0", "x1", "top", "bottom"], dtype=float)
    assert glyphs.visual_rows(beside).tolist() == [0, 0, 1, 1]


def chars_of(text, x=50.0, y=100.0, size=10.0, line=0, wide=5.0, gap=0.0, italic=False, page=1):
    out = []
    for k, c in enumerate(text):
        out.append((1, page, line, k, c, True, c == " ", italic, False, size, x, x + (0 if c == " " else wide), y))
        x += 4.0 if c == " " else wide + gap
    return out


def test_glyph_rows(spark):
    """A head whose folio is a line of its own, a raised figure, letterspaced capitals, turned text, a ligature, a raised digit."""
    chars = chars_of("THE HEAD", y=200.0) + chars_of("17", x=300.0, y=200.0, line=1)
    chars += chars_of("Being", y=150.0, line=2) + chars_of("12", x=75.0, y=154.5, size=6.0, line=3, wide=3.0)
    tracked, x = [], 50.0
    for k, c in enumerate("Y U J I  N A G A"):
        tracked.append((1, 1, 4, k, c, True, c == " ", False, False, 10.0, x, x + (0 if c == " " else 5), 100.0))
        x += 5.0 if c != " " else 1.0 if k != 8 else 7.0
    chars += tracked + [(1, 1, 5, 0, "S", False, False, False, False, 10.0, 10.0, 15.0, 120.0)] + [(1, 1, 6, 0, "ﬁ", True, False, False, False, 10.0, 50.0, 55.0, 50.0), (1, 1, 6, 1, "²", True, False, False, False, 10.0, 55.0, 60.0, 50.0)]
    got = {r.row_no: r for r in glyphs.glyph_rows(spark.createDataFrame(chars, schemas.CHAR)).collect()}
    texts = {k: " ".join("".join(x.text for x in r.runs).split()) for k, r in got.items()}
    assert texts == {0: "THE HEAD 17", 1: "Being12", 2: "YUJI NAGA", 3: "fi2"}
    assert [(x.text, x.sup) for x in got[1].runs] == [("Being", False), ("12", True)] and got[1].baseline == 150.0 and got[1].size == 10.0
    assert [(x.text, x.sup) for x in got[3].runs] == [("fi", False), ("2", True)]


def test_furniture(spark):
    """Heads by page of one document; two documents that open alike lose nothing; a footer with notice and identifier goes."""
    rows = []
    for p in (1, 2, 3):
        rows += [row(p, 0, ["On Being" if p > 1 else "Chapter"], y=730.0, size=9.0 if p > 1 else 18.0), row(p, 1, [str(p + 10)] if p > 1 else ["It begins"], x0=400.0 if p > 1 else 72.0, y=730.0 if p > 1 else 700.0)]
        rows += [row(p, 2 + k, ["Body text goes on"], y=690.0 - 12 * k) for k in range(4)]
    rows += [row(1, 7, ["A Book. © A. Author 2024."], y=100.0, size=8.0), row(1, 8, ["DOI: 10.1093/oso/97801.003.0001"], y=90.0, size=8.0)]
    rows += [row(1, 9, ["13"], y=60.0), row(2, 9, ["This content downloaded from 1.2.3.4"], y=50.0)]
    rows += [row(1, k, [t], doc=d) for d in (2, 3) for k, t in enumerate(["Same opening", "then other words", "of this one"])]
    r = rows_of(spark, rows).withColumn("text", rn.text_of(F.col("runs"))).withColumn("plain", rn.plain_of(F.col("runs"))).withColumn("body", F.lit(10.0))
    got = furniture.strip_furniture(r).collect()
    texts = lambda d, p: [x.text for x in sorted(got, key=lambda x: x.row_no) if (x.doc_id, x.page) == (d, p)]
    assert texts(1, 1) == ["Chapter", "It begins", *["Body text goes on"] * 4, "A Book. © A. Author 2024.", "DOI: 10.1093/oso/97801.003.0001"]
    assert texts(1, 2) == texts(1, 3) == ["Body text goes on"] * 4
    assert {(x.page, x.folio) for x in got if x.doc_id == 1} == {(1, "13"), (2, "12"), (3, "13")}
    assert texts(2, 1) == texts(3, 1) == ["Same opening", "then other words", "of this one"]
    footer = r.where("doc_id = 1 AND page = 1 AND row_no < 9")
    assert [x.text for x in furniture.strip_furniture(footer).orderBy("row_no").collect()] == ["Chapter", "It begins", *["Body text goes on"] * 4]


def test_notes(spark):
    """Labels raised, at full size and misread; several notes on a line; a note carried over a page; numbers that nothing refers to."""
    def foot(p, no, runs, x0=72.0, fuzzy=False):
        return row(p, no, runs, x0=x0, size=7.0, fuzzy=fuzzy)

    rows = [row(1, 0, ["Being is", ("1", "^"), " not", ("2", "^")]), row(1, 1, ["More text"]), foot(1, 2, [("1", "^"), "See there"]), foot(1, 3, ["and on."]), foot(1, 4, ["2 Ibid."])]
    rows += [row(2, 0, ["Next page"]), foot(2, 1, ["198 Madison"]), foot(2, 2, [("3", "^"), "Third"])]
    rows += [row(3, k, ["scanned body"], fuzzy=True) for k in range(4)] + [foot(3, 5, ["65 Ibid., p. 112. 66 Ibid., p. 164."], fuzzy=True), foot(3, 6, ["8°T am indebted"], fuzzy=True)]
    r = rows_of(spark, rows).withColumn("body", F.lit(10.0)).withColumn("rules", F.array().cast("array<double>"))
    split = notes.split_footnotes(r)
    told = notes.numbered(split.where("note"))
    got = [(x.page, x.note_id, x.label, "".join(t.text for t in x.runs).strip()) for x in sorted(told.collect(), key=lambda x: (x.note_id, x.page, x.row_no, x.piece))]
    assert got == [(1, 1, "1", "See there"), (1, 1, None, "and on."), (1, 2, "2", "Ibid."), (2, 3, "3", "Third"), (3, 4, "65", "Ibid., p. 112."), (3, 5, "66", "Ibid., p. 164."), (3, 6, "?", "T am indebted")] or got == [(1, 1, "1", "See there"), (1, 1, None, "and on."), (1, 2, "2", "Ibid."), (2, 2, None, "198 Madison"), *got[4:]]
    linked = notes.with_references(split.where("NOT note").withColumn("block", F.col("row_no").cast("long")), told)
    assert {x.text: x.note for r in linked.collect() for x in r.runs if x.sup} == {"1": 1, "2": 2}
    assert notes.cuts_of("p. vi. 6° The Meaning", []) == [7] and notes.cuts_of("1 a 2 b", []) == [] and notes.cuts_of("See.2 Next", [(4, "2")]) == [4]


BLOCKS = [
    ("h", [("A Title", 72, 200, 16.0, 700)]),
    ("p", [("First line of it is", 72, 400, 10.0, 660), ("and goes on to the end", 72, 400, 10.0, 648), ("here.", 72, 100, 10.0, 636)]),
    ("p", [("Another one is set in", 84, 400, 10.0, 624), ("and goes on.", 72, 400, 10.0, 612)]),
    ("quote", [("A quotation is set in", 100, 380, 10.0, 590), ("on both of its sides", 100, 380, 10.0, 578), ("here", 100, 200, 10.0, 566)]),
    ("p", [("Body goes on after it", 72, 400, 10.0, 554), ("as before.", 72, 400, 10.0, 542)]),
    ("item", [("1. The first premise", 84, 400, 10.0, 520), ("hangs under its label", 98, 400, 10.0, 508)]),
    ("item", [("2. The second one", 84, 300, 10.0, 496)]),
    ("h", [("II", 230, 242, 10.0, 470)]),
    ("p", [("The last paragraph of all", 72, 400, 10.0, 440), ("ends.", 72, 100, 10.0, 428)]),
]


def test_blocks(spark):
    rows, want, no = [], [], 0
    for kind, lines in BLOCKS:
        want.append((kind, len(lines)))
        for text, x0, x1, size, y in lines:
            rows.append(row(1, no, [text], x0=float(x0), x1=float(x1), size=size, y=float(y), hang=98.0 if text[0] in "12" else None))
            no += 1
    rows += [row(3, 0, ["1.1 ", ("Introduction", "")], y=700.0), row(3, 1, ["plain text of the page"], y=680.0)]
    r = rows_of(spark, rows).withColumn("body", F.lit(10.0)).withColumn("pdf_page", F.col("page"))
    got = bl.build_blocks(r).orderBy("block").collect()
    assert [(b.kind, b.n_rows) for b in got][: len(want)] == want
    assert [b.level for b in got if b.kind == "h"] == [1, 2] and got[7].roman == "II"


def test_sections(spark):
    """A bold numbered line is a heading below its chapter; its second bold line belongs to it; a third page jumps."""
    rows = [row(1, 0, ["Chapter"], size=16.0, y=700.0), row(1, 1, [("2.2 Being a Theist Is Neither Necessary nor", "b")], y=670.0, x1=380.0), row(1, 2, [("Sufficient for Being a Target", "b")], x0=100.0, x1=330.0, y=658.0), row(1, 3, ["Body text follows it now"], y=630.0), *[row(1, 4 + k, ["and goes on for rows"], y=618.0 - 12 * k) for k in range(5)], row(1, 9, [("1.1.1 Deeper", "b")], y=540.0, x1=160.0)]
    got = bl.build_blocks(rows_of(spark, rows).withColumn("body", F.lit(10.0)).withColumn("pdf_page", F.col("page"))).orderBy("block").collect()
    assert [(b.kind, b.level, b.n_rows) for b in got] == [("h", 1, 1), ("h", 2, 2), ("p", None, 6), ("h", 3, 1)]


def test_interrupted_paragraph(spark):
    """A short line at a column's foot stands between the parts of a sentence: the paragraph goes on in the next column."""
    left, right = (50.0, 250.0), (250.0, 450.0)
    rows = [row(1, k, ["words of a column here"], x0=50.0, x1=240.0, frame=left) for k in range(4)] + [row(1, 4, ["Purdue University"], x0=50.0, x1=120.0, frame=left, y=600.0)]
    rows += [row(1, 5 + k, ["received by the reader" if k == 0 else "and then more of it"], x0=260.0, x1=440.0, frame=right, y=700.0 - 12 * k) for k in range(4)]
    told = bl.with_blocks(rows_of(spark, rows).withColumn("body", F.lit(10.0)).withColumn("pdf_page", F.col("page")))
    assert [r.block for r in told.orderBy("row_no").collect()] == [0, 0, 0, 0, 1, 0, 0, 0, 0]


def test_blocks_followed_in_batches(spark):
    """Documents go to Python many at a time and are measured once: their blocks are the same however rows are dealt in batches."""
    rows = [(d, 1 + k // 4, k % 4, 72.0 if k % 3 else 84.0, 400.0, 72.0, 400.0, 10.0, None, None if k else True, k % 3 == 0, False, k % 4 > 0, False, d % 2 == 0 and k == 0, False, False, True, True, str(k // 4)) for d in range(5) for k in range(9)]
    table = pa.table(dict(zip(bl.COLUMNS, map(list, zip(*rows, strict=True)), strict=True)))
    told = [pa.Table.from_batches(bl.followed(table.to_batches(max_chunksize=n)), bl.TOLD).to_pylist() for n in (1, 4, 45)]
    assert told[0] == told[1] == told[2] and [t["block"] for t in told[0]] == [k // 3 for k in range(9)] * 5
    assert {t["kind"] for t in told[0] if t["doc_id"] == 2 and t["block"] == 0} == {"h"}
    one = rows_of(spark, [row(1, k, ["plain text of the page"]) for k in range(3)]).withColumn("body", F.lit(10.0)).withColumn("pdf_page", F.col("page"))
    plan = bl.with_blocks(one)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan and "Window" not in plan


#: Texts whose words alone would mislead: paragraphs of two rows throughout, last rows that read as numbers, lone words longer
#: than the prose, nothing but lone words.
MISLEADING = ["\n".join(["house and go on", "river of words"] * 60), "\n".join(["so vi", "Title", "to im"] * 40), "Internationalization\na b", "Title\nim\nvi", "im", "\n".join(["vi", "im"] * 50)]


@pytest.mark.parametrize("name", ["pages_without_furniture", "paragraph_blocks", "typeset_markdown"])
def test_misleading_texts(spark, tmp_path, name):
    docs = pd.DataFrame({"doc_id": range(len(MISLEADING)), "text": MISLEADING})
    docs.to_parquet(tmp_path / "documents.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
    sql = duckdb.connect()
    sql.register("documents", docs)
    want = sql.sql(catalogue.ORACLES[name]).df()
    listed = lambda df: sorted(df[list(want.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None), key=repr)
    assert listed(got) == listed(want)


def test_markdown(spark):
    """Hyphens, styles, notes, page marks, a subtitle, a slash, quotes of a scan, the front matter."""
    body = [(1, "Notes on it, first page to page"), (2, "next")]
    rows = [row(1, 0, ["The Problem"], size=20.0, y=760.0, x1=200.0), row(1, 1, ["Its Structure"], size=16.0, y=730.0, x1=200.0)]
    rows += [row(1, 2, ["It is ", ("specu-", "i")], y=690.0), row(1, 3, [("lative", "i"), " of the atheists/"], y=678.0), row(1, 4, ["non-theists", ("1", "^"), " all."], y=666.0, x1=200.0)]
    rows += [row(1, 5 + k, [f"plain row {w} of body text to fill"], y=640.0 - 12 * k) for k, w in enumerate("abcd")] + [row(1, 9, ["1 A note on it."], size=7.0, y=500.0)]
    rows += [row(2, k, ["on a page that follows the first"], y=700.0 - 12 * k) for k in range(3)]
    front = spark.createDataFrame([(1, "The Problem", "A. Author")], "doc_id long, title string, author string")
    full = documents.merged_front_matter(front, front.select("doc_id").limit(0), front)
    got = assemble.to_markdown(rows_of(spark, rows), pages_of(spark, 2), full, page_markers=True).first().markdown
    parts = got.strip("\n").split("\n\n")
    assert parts[0] == "---\ntitle: The Problem\nauthor: A. Author\n---" and parts[1:3] == ["{p. pdf 1}", "# The Problem: Its Structure"]
    assert parts[3] == "It is *speculative* of the atheists/non-theists[^1] all."
    assert "{p. pdf 2}" in parts[4] and parts[-1] == "[^1]: A note on it." and len(body) == 2


def test_tidy(spark):
    for text, want in [("not- 1 and ( 1 ) .", "not-1 and (1)."), ("justified in. maintaining", "justified in maintaining"), ("“it is so’ he", "“it is so” he"), ("‘it is’ so", "‘it is’ so"), ("“a ‘b’ c”", "“a ‘b’ c”")]:
        assert one(spark, tidying.tidied(F.lit(text), F.lit(True))) == want and one(spark, tidying.tidied(F.lit(text), F.lit(False))) == text
    rows = [row(1, k, [(t, s), " is"], fuzzy=True) for k, (t, s) in enumerate([("OG", "i"), ("OG", "i"), ("OG", ""), ("G.", "i"), ("G.", ""), ("G.", "i")])]
    got = tidying.harmonised(rows_of(spark, rows)).orderBy("row_no").collect()
    assert [r.runs[0].italic for r in got] == [True, True, True, True, False, True]


def test_edit_path_brute():
    draw = random.Random(7)
    for n in range(120):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(0, 25 if n % 10 else 120))] for _ in range(2))
        if n % 3 == 0:
            b = [w for w in a if draw.random() < 0.9] + ["z"] * draw.randrange(2)
        row_ = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row_[0] = row_[0], i
            for j, y in enumerate(b, 1):
                last, row_[j] = row_[j], min(row_[j] + 1, row_[j - 1] + 1, last + (x != y))
        ops = documents.edit_path(a, b)
        assert len(ops) == row_[-1]
        made, at = [], 0
        for kind, i, j in ops:
            made += a[at:i]
            at = i + (kind != "insert")
            made += [b[j]] if kind != "delete" else []
        assert made + a[at:] == b


def test_readings(spark):
    gold = spark.createDataFrame([(1, "Kant schrieb das Buch")], "doc_id long, text string")
    readings = spark.createDataFrame([(1, "x", "Hand schrieb das Buch Haus"), (1, "y", "Kant schrieb das Buch")], "doc_id long, name string, text string")
    known = spark.createDataFrame([("Hand",), ("Haus",)], "word string")
    got = {r.name: r for r in entries.reading_report(gold, readings, known).collect()}
    assert (got["1/x"].plausible, [tuple(s) for s in got["1/x"].subs], got["1/x"].ins, got["1/x"].dels, got["1/x"].wer) == (2, [("Kant", "Hand")], ["Haus"], [], 0.5)
    assert got["1/y"].plausible == 0 and got["1/y"].cer == 0


def test_metadata(spark):
    pages = spark.createDataFrame([(1, "On Denoting by Russell. DOI: 10.1093/mind/xiv.4.479."), (2, "cites 10.1093/mind/xiv.4.479 only"), (3, "doi:10.9999/none"), (4, "nothing")], "doc_id long, text string")
    info = spark.createDataFrame([(1, "scan", "X"), (2, "Other", "Y")], "doc_id long, title string, author string")
    records = spark.createDataFrame([("10.1093/mind/xiv.4.479", '{"type":"journal-article","title":["ON DENOTING"],"container-title":["Mind"],"DOI":"10.1093/MIND"}')], "doi string, record string")
    got = {r.doc_id: (r.title, r.author, r.journal, r.doi) for r in documents.document_metadata(pages, info, records).collect()}
    assert got == {1: ("On Denoting", "X", "Mind", "10.1093/mind/xiv.4.479"), 2: ("Other", "Y", None, None), 3: (None, None, None, "10.9999/none"), 4: (None, None, None, None)}


def test_image_kernels():
    def column_runs(m, n):
        out = np.zeros_like(m)
        for c in range(m.shape[1]):
            for hold, group in itertools.groupby(range(m.shape[0]), key=lambda r: bool(m[r, c])):
                group = list(group)
                if hold and len(group) >= n:
                    out[group, c] = True
        return out

    rng = np.random.default_rng(5)
    for _ in range(20):
        m = rng.random((9, 7)) < 0.6
        assert (images.long_runs(m, 3) == column_runs(m, 3)).all()
    for n in (1, 2, 5, 8):
        v = rng.random(40)
        assert np.allclose(images.smoothed(v, n), np.convolve(v, np.ones(n) / n, "same"))
    # Connected parts against a flood fill.
    mask = rng.random((30, 40)) < 0.4
    left, parts = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        ys, xs = zip(*part, strict=True)
        parts.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    assert sorted(images.components(mask)) == sorted(parts)
    m = rng.integers(0, 255, (12, 15)).astype("u1")
    p = np.pad(m, 2, mode="edge")
    assert np.allclose(images.box_mean(m, 5), [[p[y : y + 5, x : x + 5].mean() for x in range(15)] for y in range(12)])


def printed(h, w, left, right, top=40, bottom=None):
    """A page of lines of print: letters as strokes."""
    a = np.full((h, w), 255, "u1")
    for y in range(top, bottom or h - 40, 16):
        for x in range(left, right, 8):
            a[y : y + 9, x : x + 4] = 0
    return a


def test_scans_prepared(spark):
    spread = np.hstack([printed(500, 350, 30, 310), printed(500, 350, 40, 320)])
    assert 310 <= images.gutter(spread < images.INK, 150) <= 390 and images.gutter(printed(600, 500, 40, 460) < images.INK, 150) is None
    page = printed(500, 400, 80, 360)
    shadowed = page.copy()
    shadowed[:, :30] = 0
    cleared = images.without_shadows(shadowed, 150)
    assert (cleared[:, :24] == 255).all() and (cleared[:, 60:] == page[:, 60:]).all() and images.without_shadows(page, 150) is page
    assert (images.rotated(page, 0.0) == page).all() and np.abs(images.tilt(images.rotated(page, -2.0) < images.INK, 150) - 2.0) < 0.3
    df = spark.createDataFrame([(1, 1, spread.shape[1], spread.shape[0], spread.tobytes()), (1, 2, 400, 500, page.tobytes())], "doc_id long, page int, width int, height int, image binary")
    got = entries.regions(df, 150).orderBy("page", "part").collect()
    assert [(r.page, r.part, r.x0) for r in got][::2] == [(1, "a", 0), (2, "", 0)] and got[1].part == "b" and got[0].width + got[1].width == 700
    layer = spark.createDataFrame([(1, 1, 0, 10.0, 300.0, 60.0, 310.0, 0.0, 400.0, ["left"]), (1, 1, 1, 250.0, 300.0, 300.0, 310.0, 0.0, 400.0, ["right"])], "doc_id long, page int, layer_no int, x0 double, y0 double, x1 double, y1 double, ox double, oy double, tokens array<string>")
    assert {(r.tokens[0], r.part) for r in images.layer_into_regions(layer, entries.regions(df, 150), 150).collect()} == {("left", "a"), ("right", "b")}


def test_crops(spark):
    pages = {"p2.png": printed(600, 400, 60, 340, 150, 480), "p10.png": printed(600, 400, 60, 340, 5, 595), "blank.png": np.full((600, 400), 255, "u1"), "skip.png": printed(600, 400, 60, 340, 150, 480)}
    df = spark.createDataFrame([(n, a.shape[1], a.shape[0], a.tobytes()) for n, a in pages.items()], "file string, width int, height int, image binary")
    cut, log, counts = entries.cropped_folder(df, spark.createDataFrame([("skip.png",)], "name string"))
    got = {r.file: r for r in log.collect()}
    assert {n: r.action for n, r in got.items()} == {"p2.png": "cropped", "p10.png": "unchanged", "blank.png": "failed", "skip.png": "skipped"}
    r = got["p2.png"]
    assert abs(r.top_cut - (150 - 12)) <= 3 and abs(r.bottom_cut - (600 - 487 - 12)) <= 12 and got["skip.png"].top_cut == 0
    image = next(x for x in cut.collect() if x.file == "p2.png")
    assert bytes(image.image) == pages["p2.png"][r.top_cut : 600 - r.bottom_cut].tobytes() and image.height == 600 - r.top_cut - r.bottom_cut
    assert sum(x.files for x in counts.collect()) == 4 and [x.file for x in log.orderBy("order").collect()] == ["blank.png", "p2.png", "p10.png", "skip.png"]


def test_marks_of_words():
    told = readings.decorated
    assert told("evil.1", ["glyph"] * 4 + ["period", "sup"]) == ("evil.", None, "1", False)
    assert told("1See", ["sup", "glyph", "glyph", "glyph"]) == ("See", "1", None, False)
    assert told("s1", ["glyph", "sub"]) == ("s₁", None, None, True) and told("51", ["glyph", "sub"]) == ("s₁", None, None, True)
    assert told("evil.", ["glyph"] * 4 + ["period", "sup"]) == ("evil", None, "?", False) or told("evil.", ["glyph"] * 4 + ["period", "sup"])[2] == "?"
    assert told("30", ["sup", "sup"]) == ("", "30", None, False) and told("word", ["glyph"] * 4) == ("word", None, None, False)


def test_scan_votes(spark):
    """Marks stay with their words; unread figures are named by the other reading; words made anew share out their box."""
    w = lambda t, a, b, before=None, after=None, sub=False: (t, a, b, before, after, sub)
    lines = [
        (1, 1, 1, [w("b°ing", 0, 50), w("is", 60, 80, None, "?")], ["being", "is7"]),
        (1, 1, 2, [w("Anomniscient,", 0, 130), w("", 140, 145, None, "4")], ["An", "omniscient,"]),
        (1, 1, 3, [w("5₁", 0, 20, sub=True), w("evil.", 30, 80)], ["s1", "evil.3"]),
        (1, 1, 4, [w("alone", 0, 40)], None),
    ]
    df = spark.createDataFrame(lines, f"doc_id long, page int, line_no int, words array<{readings.MARKED}>, layer array<string>")
    valid = spark.createDataFrame([(1, 1, n, ["being", "is", "An", "omniscient,", "evil."]) for n in (1, 2, 3)], "doc_id long, page int, line_no int, valid array<string>")
    got: dict = {}
    for r in sorted(readings.voted_words(df, valid).collect(), key=lambda r: (r.line_no, r.n)):
        got.setdefault(r.line_no, []).append((r.text, r.sup_after))
    assert got[1] == [("being", None), ("is", "7")] and got[2] == [("An", None), ("omniscient,", None), ("", "4")] and got[4] == [("alone", None)]
    assert got[3][0] == ("s₁", None) and got[3][1][0] == "evil."


def test_scan_page(spark):
    """Words of two lines with their ink, through the votes, to rows."""
    letter = np.zeros((20, 10), "u1")
    letter[6:20, 2:8] = 1
    words = []
    for line, (y, ts) in enumerate([(100, ["the", "being"]), (140, ["is", "it"]), (180, ["all", "so"])]):
        x = 10
        for k, t in enumerate(ts):
            crop = np.tile(letter, len(t))
            words.append((1, 1, line, k, t, x, y, x + crop.shape[1] - 1, y + 19, 90.0, crop.tobytes(), float(y + 19), 28.0, 0.0, 1.0, 10, y, 200, y + 19, float(y + 19)))
            x += crop.shape[1] + 10
    schema = "doc_id long, page int, line_no int, word_no int, text string, left int, top int, right int, bottom int, conf double, crop binary, base double, x_size double, slant double, gain double, line_left int, line_top int, line_right int, line_bottom int, line_base double"
    layer = spark.createDataFrame([(1, 1, 1, 10.0, 100.0, 200.0, 119.0, ["the", "being"])], "doc_id long, page int, layer_no int, x0 double, y0 double, x1 double, y1 double, tokens array<string>")
    lines = readings.scan_lines(spark.createDataFrame(words, schema), layer, spark.createDataFrame([("is",), ("it",), ("all",), ("so",)], "word string"), 144)
    got = {r.row_no: r for r in glyphs.scan_rows(stored(lines, "lines")).collect()}
    assert {k: "".join(x.text for x in r.runs).strip() for k, r in got.items()} == {0: "the being", 1: "is it", 2: "all so"}
    assert all(r.fuzzy for r in got.values()) and got[0].x0 == 5.0 and got[0].baseline == pytest.approx(-59.5)


def test_pdf_round_trip(spark):
    """Words written as a file's invisible text are read back at their places; what the font can't show is in the copied text."""
    words = [(1, 1, 1, 1, 1, 1, 100, 100, 60, 20, 90.0, "Being"), (1, 1, 1, 1, 1, 2, 180, 100, 60, 20, 90.0, "specu-"), (1, 1, 1, 1, 2, 1, 100, 130, 80, 20, 90.0, "lative"), (1, 1, 1, 1, 2, 2, 200, 130, 60, 20, 90.0, "(Δ)"), (1, 2, 1, 1, 1, 1, 100, 100, 60, 20, 90.0, "Next")]
    pages = spark.createDataFrame([(1, p, 300.0, 400.0, 600, 800) for p in (1, 2, 3)], "doc_id long, page int, width double, height double, px_width int, px_height int")
    scans = spark.createDataFrame([(1, 2, bytes(600 * 800))], "doc_id long, page int, image binary")
    files, texts = entries.searchable_pdfs(spark.createDataFrame(words, schemas.WORD), pages, scans)
    pdf = bytes(files.first().pdf)
    assert texts.first().text == "===== PAGE 1 =====\nBeing speculative (Δ)\n\n\n===== PAGE 2 =====\nNext"
    df = spark.createDataFrame([(7, pdf)], "doc_id long, content binary")
    shows = source.text_shows(df).orderBy("page", "seq").collect()
    assert [(r.page, r.text.strip()) for r in shows] == [(0, "Being speculative"), (0, "(?)"), (1, "Next")]
    assert (shows[0].x, shows[0].y) == (100.0, 340.0)
    told = source.pdf_pages(df).orderBy("page").collect()
    assert [(r.width, r.height, len(r.images), r.glyphs == r.invisible) for r in told] == [(300.0, 400.0, 0, True), (300.0, 400.0, 1, True), (300.0, 400.0, 0, True)]
    assert source.page_counts(df).first().pages == 3 and [r.page for r in source.pdf_pages(df, {2}).collect()] == [2]
    placed, lost = entries.outlined(spark.createDataFrame([(7, "# Being Speculative @ 1\n## Next\n# Absent")], "doc_id long, outline string"), df)
    assert [(r.title, r.found_page, r.parent) for r in placed.orderBy("seq").collect()] == [("Being Speculative", 0, None), ("Next", 1, 0), ("Absent", None, None)] and lost.count() == 1
    with pytest.raises(PermissionError):
        source.Document(b"1 0 obj << /Type /Catalog >> endobj trailer << /Encrypt 5 0 R /Root 1 0 R >> startxref 0")


def test_markdown_of_pdf(spark):
    """A typeset file from its bytes to Markdown."""
    lines = [("F1", 16, 72, 700, "A Title"), ("F1", 10, 72, 660, "The first paragraph of this page is"), ("F1", 10, 72, 648, "of two lines."), ("F2", 10, 72, 620, "Slanted words here stand by themselves"), ("F1", 10, 72, 608, "and plain ones.")]
    stream = "\n".join(f"BT /{f} {s} Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET" for f, s, x, y, t in lines) + "\n50 500 200 1 re f"
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 500 800] >>", "<< /Type /Page /Resources << /Font << /F1 4 0 R /F2 5 0 R >> >> /Contents 6 0 R >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Times-Italic >>", f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream", "<< /Title (On Titles) /Author (A. Author) >>"]
    pdf = "%PDF-1.4\n" + "".join(f"{n} 0 obj\n{o}\nendobj\n" for n, o in enumerate(objects, 1)) + "trailer\n<< /Root 1 0 R /Info 7 0 R >>\nstartxref\n0\n%%EOF"
    df = spark.createDataFrame([(1, pdf.encode())], "doc_id long, content binary")
    assert len(source.pdf_pages(df).first().rules) == 1
    assert entries.markdown_of_pdfs(df).first().markdown == "---\ntitle: On Titles\nauthor: A. Author\n---\n\n# A Title\n\nThe first paragraph of this page is of two lines.\n\n*Slanted words here stand by themselves* and plain ones.\n"
