"""Features of names that matching compares; each is computed once for a distinct name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let, tokens

# Words of form, dose and packing, which do not tell products apart.
FILLER_WORDS = [
    "مجم", "مجم/مل", "جم", "جرام", "مل", "مكجم", "وحدة", "وحدات",
    "قرص", "أقراص", "كبسول", "كبسولة", "كبسولات", "شراب", "كريم", "مرهم",
    "جل", "لوشن", "بخاخ", "بخاخة", "حقن", "أمبول", "أمبولة", "فيال",
    "محلول", "معلق", "معلقة", "لبوس", "نقط", "نقطة", "قطرة", "قطرات",
    "عبوة", "علبة", "شريط", "شرائط", "باكيت", "حبة", "حبوب", "فوار",
    "مضغوط", "سائل", "سعر", "جديد", "للأطفال", "للكبار",
]
# Words of each dosage form.
FORM_GROUPS = {
    "solid_oral": ["قرص", "أقراص", "كبسول", "كبسولة", "كبسولات", "فوار", "مضغوط"],
    "liquid_oral": ["شراب", "معلق", "معلقة"],
    "topical": ["كريم", "مرهم", "جل", "لوشن"],
    "injectable": ["حقن", "أمبول", "أمبولة", "فيال"],
    "drops": ["نقط", "نقطة", "قطرة", "قطرات"],
    "suppository": ["لبوس"],
    "spray": ["بخاخ", "بخاخة"],
}
# Notices of a new price, and words used for one another.
NOTICES = r"\(?\s*سعر\s*جديد\s*\)?|\bس\s*\.\s*ج\b|\bجديد\b"
SYNONYMS = [("نقط", "قطرة"), ("بخاخة", "بخاخ")]


def core_tokens(name: Column, filler: list[str] | None = None) -> Column:
    """Tokens that are neither filler nor numbers; all tokens if none are left."""
    words = F.array(*map(F.lit, FILLER_WORDS if filler is None else filler))

    def both(every: Column) -> Column:
        core = F.filter(every, lambda t: ~F.array_contains(words, t) & ~t.rlike(r"(?U)^\d+$"))
        return F.struct(every.alias("every"), core.alias("core"))

    # One let after the other: an inner lambda that names an outer one's variable cannot be a Python function's argument.
    return let(let(tokens(name), both), lambda x: F.when(F.size(x["core"]) > 0, x["core"]).otherwise(x["every"]))


def numbers(text: Column) -> Column:
    """The distinct runs of digits."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\d+"), F.lit(0)))


def form_group(name: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """The form of the first token that names one, or null."""
    groups = FORM_GROUPS if groups is None else groups
    known = F.create_map(*(F.lit(x) for group, words in groups.items() for word in words for x in (word, group)))
    return F.get(F.filter(F.transform(tokens(name), lambda t: F.try_element_at(known, t)), lambda g: g.isNotNull()), 0)


def search_key(name: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(name, F.lit("")), "(?U)" + NOTICES, " "))


def variants(text: Column) -> Column:
    """The text and its spellings with synonyms exchanged, as substrings, in order of first appearance."""
    out = F.array(text)
    for a, b in SYNONYMS:
        def both(x: Column, a=F.lit(a), b=F.lit(b)) -> Column:
            return F.array(x, F.replace(x, a, b), F.replace(x, b, a))
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: both(x))))
    return out


def anchor(name: Column) -> Column:
    """The longest core token, the first of equal ones."""
    ranked = F.transform(core_tokens(name), lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("t")))
    return F.array_max(ranked)["t"]
