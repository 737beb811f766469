"""Scalar text operators as Column functions; all run inside the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Readings of roman numerals that recognition gets wrong, in the order in which they are tried.
ROMAN_MISREAD = [("VIIL", "VIII"), ("VIL", "VII"), ("VL", "VI"), ("I11", "III"), ("IL", "II"), ("LL", "II"), ("L", "I")]
# Numbering classes by pattern, first match wins.
NUMBERING = [
    ("paren_double_upper", r"^\(([A-Z])\1\.\)"),
    ("paren_double_lower", r"^\(([a-z])\1\.\)"),
    ("arabic_dotted", r"^\d+\.\d+(?:\.\d+)*(?:\s|$)"),
    ("arabic", r"^\d+\.(?:\s|$)"),
    ("roman", r"^[IVX]+\.(?:\s|$)"),
    ("letter_upper", r"^[A-Z]\.(?:\s|$)"),
    ("letter_lower", r"^[a-z]\.(?:\s|$)"),
    ("greek_lower", r"^[αβγδεζηθικ]\.(?:\s|$)"),
]
# What a printed page number looks like, and the number at the end of a contents line.
FOLIO = r"^(?:\d{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7}|(?=.*\d)[\dIl]{2,4})$"
LINE_NUMBER = r"\s+\.{0,}\s*(\d{1,4})\s*$"
DOI = r"(10\.\d{4,9}/[^\s\"<>]+)"
STAMP = r"(?i)This content downloaded from|All use subject to https?://about\.jstor\.org/terms|^\(?cid:\d+\)|^\d{1,3}(\.\d{1,3}){3} on \w{3}, \d"
FOOTNOTE_TAIL = r"[a-zA-Z][.,:;]?(?:['!?\"*‘’“”†‡]+|\.\d+|\.[!?'\"‘’“”]+)\s*$"


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    out = F.when(*cases[0])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def squeezed(c: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalised(c: Column) -> Column:
    return F.lower(squeezed(c))


def ascii_letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def without_punctuation(c: Column) -> Column:
    return squeezed(F.regexp_replace(c, r"(?U)[^\w\s]", ""))


def roman_repaired(c: Column) -> Column:
    return first_match([(c.rlike(rf"^{bad}\."), F.regexp_replace(c, rf"^{bad}(?=\.)", good)) for bad, good in ROMAN_MISREAD], c)


def numbering_class(c: Column) -> Column:
    return first_match([(c.rlike(pattern), F.lit(name)) for name, pattern in NUMBERING], F.lit("none"))


def page_number(c: Column) -> Column:
    """The number that ends a contents line, or null."""
    return F.regexp_extract(c, LINE_NUMBER, 1).try_cast("int")


def without_page_number(c: Column) -> Column:
    return F.when(c.rlike(LINE_NUMBER), F.rtrim(F.regexp_replace(c, LINE_NUMBER, ""), F.lit(" ."))).otherwise(F.trim(c))


def floored(c: Column, size: int) -> Column:
    return (F.floor(c / size) * size).cast("int")


def heading_noise(c: Column) -> Column:
    """Whether a heading candidate is most likely body text."""
    text = F.trim(F.coalesce(c, F.lit("")))
    tokens = F.split(text, r"\s+")
    wordless = ~F.exists(tokens, lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 3)
    single = (F.size(tokens) == 1) & (text.rlike(FOOTNOTE_TAIL) | text.rlike("[.,;:]$"))
    return (text == "") | wordless | single


def authors_joined(c: Column) -> Column:
    parts = F.transform(F.split(c, r",\s*(?:and\s+)?|\s+and\s+"), lambda p: F.trim(p))
    return F.array_join(F.filter(parts, lambda p: p != ""), " & ")


def journal_source(c: Column) -> Column:
    """struct(journal, volume, issue, date, pages, citation) of a journal's source line."""
    shape = r"^(.*?),\s*Vol\.\s*([\w.]+)(?:,\s*No\.\s*([\w./-]+))?(?:,?\s*\(([^)]*)\))?(?:,\s*pp?\.\s*([\w-]+))?"
    part = lambda i: F.regexp_extract(c, shape, i)
    fits = c.rlike(shape)
    kept = lambda x: F.when(fits, x).otherwise("")
    return F.struct(
        kept(F.trim(part(1))).alias("journal"), kept(part(2)).alias("volume"), kept(part(3)).alias("issue"),
        kept(F.regexp_extract(part(4), r"\b(1[5-9]\d\d|20\d\d)\b", 1)).alias("date"),
        kept(F.replace(part(5), F.lit("-"), F.lit("–"))).alias("pages"), F.when(fits, "").otherwise(F.coalesce(c, F.lit(""))).alias("citation"),
    )


def doi(c: Column) -> Column:
    """The labelled identifier before any other; null if there is none."""
    flat = F.regexp_replace(c, r"(?i)(doi\.org/|DOI:?)\s+", "$1")
    found = lambda p: F.nullif(F.regexp_extract(flat, p, 1), F.lit(""))
    return F.rtrim(F.coalesce(found(rf"(?i)(?:doi\.org/|\bdoi:?\s*){DOI}"), found(rf"(?i)\b{DOI}")), F.lit(".,;)]"))


def tags_stripped(c: Column) -> Column:
    """Without tags, with the five basic entities and the hard space resolved; all of it in the JVM."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def entities_resolved(c: Column) -> Column:
    """tags_stripped() with every entity resolved; only texts that hold others than the basic ones go to Python."""

    @F.pandas_udf("string")
    def resolved(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    other = F.regexp_replace(bare, "&(lt|gt|quot|#39|amp|nbsp);", "").rlike(r"&#?\w+;?")
    return F.when(other, squeezed(resolved(F.when(other, bare)))).otherwise(tags_stripped(c))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def title_case(c: Column) -> Column:
    """Each letter that follows no letter as a capital, all others small."""
    state = F.aggregate(F.split(c, "(?!^)(?!$)"), F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")), lambda s, x: F.struct(F.concat(s["out"], F.when(s["inside"], F.lower(x)).otherwise(F.upper(x))).alias("out"), x.rlike(r"^\p{L}$").alias("inside")))
    return state["out"]


def name_case(c: Column) -> Column:
    """A name that is all capitals in title case; other names as they are."""
    return F.when(is_upper(c), title_case(c)).otherwise(c)


def person(p: Column) -> Column:
    """The name of a record's person or organisation (struct name, given, family)."""
    parts = F.filter(F.array(p["given"], p["family"]), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.nullif(p["name"], F.lit("")), F.array_join(F.transform(parts, name_case), " "))


def as_in_text(title: Column, text: Column) -> Column:
    """A title in capitals in the letter case in which the text prints it, if it does."""
    words = F.regexp_extract_all(title, F.lit(r"(?U)\w+"), F.lit(0))
    found = F.call_function("regexp_extract", text, F.concat(F.lit("(?iuU)"), F.array_join(words, r"\W+")), F.lit(0))
    printed = is_upper(title) & (F.size(words) > 0) & (found != "") & ~is_upper(found)
    return F.when(F.coalesce(printed, F.lit(False)), found).otherwise(title)


def quotes_cleaned(c: Column) -> Column:
    """Doubled curly quotes as one: recognition doubles the strokes of double ones."""
    return F.regexp_replace(F.regexp_replace(c, "[“‘]{2,}", "“"), "[”’]{2,}", "”")


def info_text(c: Column) -> Column:
    """A document's information field (binary) as text: UTF-16 where a mark says so, else Latin-1."""
    marked = F.hex(F.substring(c, 1, 2)).isin("FEFF", "FFFE")
    return squeezed(F.when(marked, F.decode(c, "UTF-16")).otherwise(F.decode(c, "ISO-8859-1")))


def info_fields(title: Column, author: Column) -> Column:
    """struct(title, author) of a document's information: file names, numbers and placeholders are no titles; without a title
    there is no author. Empty ones are null."""
    odd = title.rlike(r"(?i)\.(docx?|pdf|indd|tex|dvi|rtf|odt)$|^(microsoft word|untitled)\b|^\d+$")
    real = F.when(~odd & (title != ""), title)
    return F.struct(real.alias("title"), F.when(real.isNotNull() & (author != ""), author).alias("author"))


def journal_cover(flat: Column) -> Column:
    """struct of front matter that an archive's cover page gives (its text with white space collapsed); null for other pages."""
    between = lambda a, b: F.trim(F.regexp_extract(flat, rf"{a}\s*(.*?)\s*(?={b})", 1))
    source = journal_source(F.regexp_replace(between("Source:", "Published by:|Stable URL:"), r"(\d)-\s+(\d)", "$1-$2"))
    cover = flat.contains("Stable URL") & flat.contains("JSTOR") & flat.contains("Author(s)")
    fields = {"type": F.lit("academic"), "title": F.trim(F.split_part(flat, F.lit("Author(s):"), F.lit(1))), "author": authors_joined(between(r"Author\(s\):", "Source:")), **{k: source[k] for k in ("journal", "volume", "issue", "date", "pages", "citation")}, "url": F.regexp_extract(flat, r"Stable URL:\s*(\S+)", 1)}
    return F.when(cover, F.struct(*[F.nullif(v, F.lit("")).alias(k) for k, v in fields.items()]))


def straight_quotes(c: Column) -> Column:
    """Quotes and dashes unified; runs of quotes are one."""
    return F.regexp_replace(F.translate(c, "‘’“”\"—–", "'''''--"), "'+", "'")


def spaced_dashes(c: Column) -> Column:
    return squeezed(F.replace(c, F.lit("—"), F.lit(" – ")))


def stamp(c: Column) -> Column:
    """Whether a line is an archive's download stamp or undecoded glyph codes."""
    codes = F.regexp_count(c, F.lit(r"\(cid:")) >= 3
    return c.rlike(STAMP) | (codes & (F.length(F.trim(F.regexp_replace(c, r"\(cid:\d+\)", ""))) < 20))


def capital_share(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def running_head(c: Column) -> Column:
    """Whether a lone line is mostly capitals or has a page number at either end."""
    return (capital_share(c) >= 0.8) | c.rlike(r"^\d{1,4}\s") | c.rlike(r"\s\d{1,4}$")


def size_class(size: Column, body: Column, scanned: Column) -> Column:
    large, small = F.when(scanned, 1.2).otherwise(1.15), F.when(scanned, 0.87).otherwise(0.92)
    return F.when(size >= body * large, "h").when(size <= body * small, "s").otherwise("b")


def escaped(c: Column) -> Column:
    """Text that Markdown would otherwise read as markup."""
    marked = F.replace(F.regexp_replace(c, r"([\\*_`~^$])", r"\\$1"), F.lit("=="), F.lit("\\=\\="))
    return F.regexp_replace(marked, r"\[(?=[\^#%])", r"\\[")


def roman(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999."""
    digits = [("", "m", "mm", "mmm"), *[("", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c) for a, b, c in (("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x"))]]
    place = lambda k, row: F.element_at(F.array(*map(F.lit, row)), (F.floor(n / 10**k) % 10).cast("int") + 1)
    return F.concat(*[place(3 - i, row) for i, row in enumerate(digits)])


def roman_value(c: Column) -> Column:
    """Value of a well-formed roman numeral of either case, else null."""
    low = F.lower(c)
    worth = F.create_map(*[F.lit(x) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in pair])
    values = F.transform(F.split(low, ""), lambda x: worth[x])
    total = F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + v - F.when(v > a["last"], 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a["sum"])
    return F.when(low.rlike("^[ivxlcdm]+$"), F.when(roman(total) == low, total))


def natural_key(c: Column) -> Column:
    """A key by which names sort with their numbers as numbers."""
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def outline_line(c: Column) -> Column:
    """struct(level, title, page) of an outline line, null for others."""
    shape = r"^(#+)\s+(.+?)(?:\s+@\s+(\d+))?\s*$"
    return F.when(c.rlike(shape), F.struct(F.length(F.regexp_extract(c, shape, 1)).alias("level"), F.regexp_extract(c, shape, 2).alias("title"), F.regexp_extract(c, shape, 3).try_cast("int").alias("page")))
