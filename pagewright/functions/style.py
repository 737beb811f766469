"""Styles of fonts and characters as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in font names, TeX prefixes, bits of the descriptor, least angle, least shear, least weight.
ITALIC_NAMES = "italic|oblique|slanted|kursiv"
BOLD_NAMES = "bold|black|heavy|semibold|demi"
TEX_ITALIC = r"^(cmti|cmbxti|cmsl|cmbxsl|cmitt|lmromanslant)"
TEX_BOLD = r"^(cmbx|cmb\d)"
ITALIC_BIT, BOLD_BIT, LEAN, SHEAR, WEIGHT = 6, 18, 4, 0.12, 600
# Ligatures and their letters; raised digits.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"
# The private range in which small capitals and old figures stand, and how far it is shifted.
EXPERT_RANGE, EXPERT_SHIFT = (0xF721, 0xF7FF), 0xF700


def style_part(name: Column) -> Column:
    """struct(base, style) of a font name in lower case: 'ABCDEF+Minion-BoldIt' is minion and boldit."""
    own = F.lower(F.regexp_replace(name, r"^[^+]*\+", ""))
    cut = lambda sign, k: F.regexp_extract(own, rf"(?s)^(.*){sign}([^{sign}]*)$", k)
    pick = lambda k, none: F.when(own.contains("-"), cut("-", k)).when(own.contains(","), cut(",", k)).otherwise(none)
    return F.struct(pick(1, own).alias("base"), pick(2, F.lit("")).alias("style"))


def font_style(name: Column, flags: Column, angle: Column, weight: Column, matrix: Column) -> Column:
    """struct(italic, bold) by a font's name, its descriptor and the text matrix (array a, b, c, d)."""
    low, part = F.lower(F.coalesce(name, F.lit(""))), style_part(F.coalesce(name, F.lit("")))
    told = F.when(part["base"] != "", part["base"]).otherwise(low)
    bit = lambda k: F.shiftright(F.coalesce(flags, F.lit(0)), k).bitwiseAND(F.lit(1)) == 1
    leans = F.abs(F.coalesce(angle, F.lit(0.0))) >= LEAN
    a = lambda k: F.get(matrix, F.lit(k))
    sheared = F.coalesce((a(1) == 0) & (a(3) != 0) & (F.abs(a(2) / F.nullif(a(3), F.lit(0.0))) > SHEAR), F.lit(False))
    italic = low.rlike(ITALIC_NAMES) | part["style"].endswith("it") | told.rlike(TEX_ITALIC) | bit(ITALIC_BIT) | leans | sheared
    bold = low.rlike(BOLD_NAMES) | told.rlike(TEX_BOLD) | bit(BOLD_BIT) | (F.coalesce(weight, F.lit(0)) >= WEIGHT)
    return F.struct(italic.alias("italic"), bold.alias("bold"))


def plain_character(c: Column) -> Column:
    """A character of the expert range as the capital or figure that it shows, a ligature as its letters."""
    code = F.ascii(c)
    base = F.char(code - EXPERT_SHIFT)
    shown = F.when(base.rlike(r"^\p{L}$"), F.upper(base)).otherwise(base)
    letters = F.create_map(*[F.lit(x) for kv in LIGATURES.items() for x in kv])
    return F.when((F.length(c) == 1) & code.between(*EXPERT_RANGE), shown).otherwise(F.coalesce(letters[c], c))
