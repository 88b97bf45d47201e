"""Transliteration of Latin words to Arabic letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Word endings, longest first.
SUFFIXES = {
    "prazole": "برازول", "statin": "ستاتين", "cillin": "سيلين", "moxil": "موكسيل", "zole": "زول", "stat": "ستات",
    "tion": "شن", "cine": "زين", "zine": "زين", "phen": "فين", "ceph": "سيف", "mox": "موكس", "fen": "فين",
    "cef": "سيف", "ol": "ول", "in": "ين",
}
# Letter pairs and letters.
DIGRAPHS = {"th": "ث", "ph": "ف", "sh": "ش", "gh": "غ", "kh": "خ", "ck": "ك"}
LETTERS = {
    "a": "ا", "b": "ب", "d": "د", "f": "ف", "g": "ج", "h": "ه", "i": "ي", "j": "ج", "k": "ك", "l": "ل", "m": "م",
    "n": "ن", "o": "و", "p": "ب", "q": "ك", "r": "ر", "s": "س", "t": "ت", "u": "و", "v": "ف", "w": "و", "z": "ز",
}

_ENDING = "(" + "|".join(SUFFIXES) + ")$"
_UNITS = "ch|" + "|".join(DIGRAPHS) + "|."


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def transliterate_word(word: Column) -> Column:
    """Arabic spelling of the letters of ``word``; a word without letters stays as it is."""
    simple, endings = _map(DIGRAPHS | LETTERS), _map(SUFFIXES)

    def letter(t: Column, i: Column, units: Column, suffix: Column) -> Column:
        first, last = i == 0, (i == F.size(units) - 1)
        following = F.substring(F.coalesce(F.get(units, i + 1), suffix), 1, 1)
        return (
            F.when(t == "ch", F.when(following.isin("l", "r"), "ك").otherwise("ش"))
            .when(t == "c", F.when(following.isin("e", "i", "y"), "س").otherwise("ك"))
            .when(t == "x", F.when(first, "ز").otherwise("كس"))
            .when(t == "y", F.when(first, "إي").otherwise("ي"))
            .when(t == "e", F.when(last & (suffix == ""), "").when(first, "اي").otherwise("ي"))
            .when((t == "i") & first, "اي")
            .when(t.isin("o", "u") & first, "او")
            .otherwise(F.coalesce(F.try_element_at(simple, t), F.lit("")))
        )

    def with_suffix(letters: Column, suffix: Column) -> Column:
        stem = F.substring(letters, F.lit(1), F.length(letters) - F.length(suffix))
        spelled = let(
            F.regexp_extract_all(stem, F.lit(_UNITS), F.lit(0)),
            lambda units: F.array_join(F.transform(units, lambda t, i: letter(t, i, units, suffix)), ""),
        )
        return F.concat(spelled, F.coalesce(F.try_element_at(endings, suffix), F.lit("")))

    def of_letters(letters: Column) -> Column:
        spelled = let(F.regexp_extract(letters, _ENDING, 1), lambda suffix: with_suffix(letters, suffix))
        return F.when(F.length(letters) == 0, word).otherwise(spelled)

    return let(F.lower(F.regexp_replace(word, "[^A-Za-z]", "")), of_letters)


def transliterate_words(words: Column) -> Column:
    return F.array_join(F.transform(words, transliterate_word), " ")
