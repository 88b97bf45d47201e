"""Normalising and cleaning product lines.

Java's ``trim`` knows U+0020 alone and its classes are ASCII without ``(?U)``; every
pattern here says what it means for Arabic and for no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative words that carry no identity.
ADMIN_WORDS = ["offer", "free", "promo", "sample", "pack", "pck", "box", "piece", "pcs", "item", "eye", "dispersible"]
# Dotted abbreviations that are noise.
NOISE_ABBREVIATIONS = [r"\bf\.?\s*c\.?\b", r"\bn\.?\s*p\.?\b"]
# Units in the order in which they are tried, and their translations.
UNIT_PATTERNS = ["mcg", "iu", "mg", "ml", "gm", r"g\b", "%"]
UNIT_NAMES = [
    ("mcg", "ميكروجرام"), ("iu", "وحدة دولية"), ("mg", "مجم"), ("ml", "مل"), ("gm", "جم"), (r"g\b", "جم"),
]

# White space as Unicode has it, spelled out: a pattern with ``(?U)`` asks each character's properties. In ``_RUNS`` a letter
# below U+1680 fails at two tests, and most texts have no run but single spaces, so nothing to replace.
SPACES = "".join(map(chr, [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RARE = r"\t-\r\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_RUNS = rf"[{_RARE}][ {_RARE}]*| [ {_RARE}]+"

UNITS = "(?iU)" + "|".join(rf"\d+(?:\.\d+)?\s*{u}" for u in UNIT_PATTERNS)
_ADMIN = r"(?iU)\b(?:" + "|".join(ADMIN_WORDS) + r")\b"
_NOISE = "(?iU)" + "|".join(NOISE_ABBREVIATIONS)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def collapse(x: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(x, _RUNS, " "))  # U+0020 is all that is left to trim


def key_upper(x: Column) -> Column:
    return F.upper(collapse(x))


def key_lower(x: Column) -> Column:
    return F.lower(collapse(x))


def key_folded(x: Column) -> Column:
    """Trimmed and case-folded, inner white space kept: letters of one upper case are one (ß as ss, both sigmas, a dotless ı as i)."""
    upper = F.replace(F.upper(strip(x)), F.lit("ẞ"), F.lit("SS"))
    return F.replace(F.lower(upper), F.lit("ς"), F.lit("σ"))


def extract_units(x: Column) -> Column:
    """Every unit token, left to right."""
    return F.transform(F.regexp_extract_all(x, F.lit(UNITS), F.lit(0)), strip)


def strip_units(x: Column) -> Column:
    return F.regexp_replace(x, UNITS, " ")


def translate_unit(token: Column) -> Column:
    """``500mg`` as number and unit name; tokens of no listed unit stay."""
    number = F.regexp_extract(token, r"(?U)\d+(\.\d+)?", 0)
    out = F.when(F.lit(False), token)
    for pattern, name in UNIT_NAMES:
        out = out.when(token.rlike(f"(?iU){pattern}"), strip(F.concat(number, F.lit(f" {name}"))))
    return out.otherwise(token)


def translate_units(tokens: Column) -> Column:
    return F.transform(tokens, translate_unit)


def strip_abbreviations(x: Column) -> Column:
    return F.regexp_replace(x, _NOISE, " ")


def strip_orphan_dots(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)(?<!\d)\.(?!\d)", " ")


def strip_admin_words(x: Column) -> Column:
    return F.regexp_replace(x, _ADMIN, " ")


def join_separators(x: Column) -> Column:
    return collapse(F.regexp_replace(x, r"[\-_/,]+", " "))


def clean_line(raw: Column) -> Column:
    """struct(core_text, extracted_units, extracted_units_ar, original_text)."""
    text = collapse(raw)
    units = extract_units(text)
    core = join_separators(strip_admin_words(strip_orphan_dots(strip_abbreviations(strip_units(text)))))
    return F.struct(
        core.alias("core_text"), units.alias("extracted_units"), translate_units(units).alias("extracted_units_ar"), raw.alias("original_text")
    )


def is_arabic(x: Column) -> Column:
    """More letters of the Arabic block than Latin ones."""
    arabic = F.length(F.regexp_replace(x, r"[^؀-ۿ]", ""))
    return F.coalesce(arabic > F.length(F.regexp_replace(x, "[^A-Za-z]", "")), F.lit(False))


def parse_number(x: Column) -> Column:
    """The first number of a cell, commas removed; null if there is none."""
    found = F.regexp_extract(F.replace(x.cast("string"), F.lit(",")), r"-?\d+(\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def tokens(x: Column) -> Column:
    """White-space tokens; none for a blank text."""
    return F.filter(F.split(collapse(F.coalesce(x, F.lit(""))), " "), lambda t: t != "")
