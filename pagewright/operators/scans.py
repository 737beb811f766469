"""What recognised lines of a scan are told by: slant, size, handwriting, kinds of marks; symbols set in italics; warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import first_match

# Degrees that italics lean beyond their page; least gain of words, and of words of at most two characters; letters of a word that tells its page's slant.
LEAN, GAIN, SHORT_GAIN, TELLING = (8, 20), 1.1, 1.12, 3
# X-heights needed; x-height, capitals and recogniser's size as parts of the type size.
X_HEIGHTS, X_PART, CAPITAL_PART, OTHER_PART = 3, 0.45, 0.68, 0.7
# Confidence below which a short word, a line, a doubtful line is handwriting; least known share; least mean length.
SHORT_CONF, SURE_CONF, POOR_CONF, KNOWN, MEAN_LETTERS = 25, 50, 35, 0.6, 3.2
# Least number of a symbol and of its italic share; invisible share and unmapped glyphs that call for a warning.
SYMBOLS, ITALIC_SHARE, INVISIBLE, UNMAPPED = 3, 0.6, 0.5, 20


def letters_of(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\W", "")


def core_of(c: Column) -> Column:
    """A word without what isn't a letter at its end: what the dictionary is asked for."""
    return F.regexp_replace(c, r"[^A-Za-z’'-]+$", "")


def italic_words(words: DataFrame) -> DataFrame:
    """words (page_id, text, slant, gain) with italic: clearly more slanted than their page's median."""
    telling = F.when(F.length(letters_of(F.col("text"))) >= TELLING, F.col("slant"))
    pages = words.groupBy("page_id").agg(F.coalesce(F.percentile(telling, 0.5), F.lit(0.0)).alias("page_slant"))
    enough = F.when(F.length("text") <= 2, SHORT_GAIN).otherwise(GAIN)
    italic = F.col("slant").isNotNull() & (F.col("slant") - F.col("page_slant")).between(*LEAN) & (F.col("gain") >= enough)
    return words.join(pages, "page_id").withColumn("italic", F.coalesce(italic, F.lit(False))).drop("page_slant")


def type_sizes(lines: DataFrame) -> DataFrame:
    """lines (x_heights and capitals: arrays of pixels, x_size) with size in pixels."""
    middle = lambda c: F.expr(f"(array_sort({c})[cast(floor((size({c}) - 1) / 2) as int)] + array_sort({c})[cast(floor(size({c}) / 2) as int)]) / 2.0")
    return lines.withColumn(
        "size",
        F.when(F.size("x_heights") >= X_HEIGHTS, middle("x_heights") / X_PART)
        .when(F.size("capitals") > 0, middle("capitals") / CAPITAL_PART)
        .otherwise(F.col("x_size") / OTHER_PART),
    )


def handwritten_lines(words: DataFrame) -> DataFrame:
    """page_id, line_num, handwritten, of words (page_id, line_num, text, conf, valid: whether core_of(text) is a word)."""
    text, valid = F.col("text"), F.coalesce("valid", F.lit(False))
    alpha, lettered = text.rlike("[A-Za-z]{2}"), text.rlike("[A-Za-z]")
    lines = words.groupBy("page_id", "line_num").agg(
        F.count("*").alias("n"),
        F.every(text.rlike(r"^(?U)\W*\d{1,3}\W*$")).alias("figures"),
        F.some(text.rlike(r"(?U)\w")).alias("readable"),
        F.every(text.rlike(r"^[.\s]+$")).alias("dots"),
        F.avg("conf").alias("conf"),
        F.max(F.length("text")).alias("longest"),
        F.count_if(alpha).alias("alpha"),
        F.count_if(alpha & valid).alias("known"),
        F.count_if(alpha & valid & (F.length(letters_of(core_of(text))) >= 4)).alias("long_known"),
        F.count_if(lettered).alias("lettered"),
        F.avg(F.when(lettered, F.length(letters_of(text)))).alias("mean_letters"),
    )
    share = F.coalesce(F.try_divide(F.col("known"), F.col("alpha")), F.lit(0.0))
    meagre = (F.col("lettered") >= 3) & (F.col("mean_letters") < MEAN_LETTERS)
    told = first_match(
        [
            (F.col("figures"), F.lit(False)),
            (~F.col("readable") & ~F.col("dots"), F.lit(True)),
            ((F.col("n") == 1) & (F.col("longest") <= 4), F.col("conf") < SHORT_CONF),
            ((F.col("alpha") <= 2) & (F.col("long_known") > 0), F.lit(False)),
            (F.col("conf") >= SURE_CONF, F.lit(False)),
        ],
        (F.col("conf") < POOR_CONF) | (share < KNOWN) | F.coalesce(meagre, F.lit(False)),
    )
    return lines.select("page_id", "line_num", told.alias("handwritten"))


def mark_kind(top: Column, bottom: Column) -> Column:
    """Kind of a mark by its extent above the baseline, in x-sizes."""
    # The extents of each kind, first match wins.
    height = top - bottom
    return first_match(
        [
            (bottom.between(0.16, 0.56) & (top >= 0.6) & height.between(0.33, 0.58), F.lit("sup")),
            ((bottom >= 0.3) & (top >= 0.55), F.lit("quote")),
            ((top <= 0.25) & (bottom <= -0.24) & (height >= 0.32), F.lit("sub")),
            ((top <= 0.24) & (bottom <= -0.07), F.lit("comma")),
            ((top <= 0.2) & (bottom >= -0.06), F.lit("period")),
        ],
        F.lit("glyph"),
    )


def figure_like(mark: Column, beside_digit: Column) -> Column:
    """Whether a raised mark can be a figure."""
    # Letters that figures are misread as, the second only beside a digit.
    return ~mark.rlike(r"^\p{L}$") | mark.isin(*"lIi") | (beside_digit & mark.isin(*"oOSsz"))


def symbols_in_italics(words: DataFrame) -> DataFrame:
    """words (doc_id, text, italic) in which symbols of up to three capitals are italic throughout, if they mostly are.

    An initial ('G.') is no symbol. Each symbol's count is made once per document and joined back, so that a frequent
    symbol's words never meet in one window.
    """
    key = F.regexp_replace("text", r"[^\p{L}]", "")
    symbol = F.when(key.rlike(r"^\p{Lu}{1,3}$") & ~((F.length(key) == 1) & F.col("text").endswith(".")), key)
    marked = words.withColumn("_symbol", symbol)
    counts = marked.where("_symbol IS NOT NULL").groupBy("doc_id", "_symbol").agg(F.count("*").alias("_n"), F.count_if("italic").alias("_italic"))
    mostly = counts.where((F.col("_n") >= SYMBOLS) & (F.col("_italic") >= ITALIC_SHARE * F.col("_n"))).select("doc_id", "_symbol", F.lit(True).alias("_mostly"))
    return marked.join(mostly, ["doc_id", "_symbol"], "left").withColumn("italic", F.col("italic") | F.col("_mostly").isNotNull()).select(*words.columns)


def text_layer_warnings(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and warning (invisible, empty or unmapped), where there is one.

    rows: doc_id, text, scanned (stamps left out); documents: doc_id, invisible_share, recognised.
    """
    told = rows.groupBy("doc_id").agg(
        F.some(~F.col("scanned") & (F.trim("text") != "")).alias("text"),
        F.some("scanned").alias("scanned"),
        F.sum(F.when(~F.col("scanned"), F.regexp_count("text", F.lit(r"\(cid:")))).alias("unmapped"),
    )
    text, scanned = F.coalesce("text", F.lit(False)), F.coalesce("scanned", F.lit(False))
    warning = (
        F.when(text & (F.col("invisible_share") > INVISIBLE) & ~F.col("recognised"), "invisible")
        .when(~text & ~scanned, "empty")
        .when(F.col("unmapped") > UNMAPPED, "unmapped")
    )
    return documents.join(told, "doc_id", "left").select("doc_id", warning.alias("warning")).where("warning IS NOT NULL")
