"""Mapping of known words to Arabic: longest phrase first, left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, tokens
from .translit import transliterate_word

# Words and phrases with their Arabic forms.
LEXICON = {
    "tab": "أقراص", "tablet": "أقراص", "tabs": "أقراص",
    "cap": "كبسول", "capsule": "كبسول", "caps": "كبسول",
    "syr": "شراب", "syrup": "شراب",
    "amp": "أمبول", "ampoule": "أمبول",
    "vial": "فيال", "vials": "فيال",
    "sachet": "أكياس", "sachets": "أكياس", "sach": "أكياس",
    "susp": "معلق", "sosp": "معلق", "suspension": "معلق",
    "cream": "كريم", "crm": "كريم",
    "oint": "مرهم", "ointment": "مرهم",
    "gel": "جل",
    "drop": "نقط", "drops": "نقط", "drp": "نقط",
    "supp": "لبوس", "suppository": "لبوس",
    "eff": "فوار", "effervescent": "فوار",
    "spray": "بخاخ", "spr": "بخاخ",
    "infant": "رضع", "infants": "رضع",
    "baby": "أطفال / رضع",
    "pediatric": "أطفال", "pedia": "أطفال", "ped": "أطفال",
    "children": "أطفال",
    "adult": "بالغين", "adults": "بالغين",
    "junior": "ناشئين / أطفال",
    "senior": "كبار السن",
    "vaginal": "مهبلي", "vag": "مهبلي",
    "rectal": "شرجي", "anal": "شرجي",
    "soap": "صابون",
    "shampoo": "شامبو",
    "lotion": "لوشن",
    "wipes": "مناديل مبللة",
    "syringe": "سرنجة", "syrg": "سرنجة",
    "cannula": "كانيولا",
    "cotton": "قطن",
    "alcohol": "كحول",
    "gauze": "شاش",
    "bandage": "رباط ضاغط",
    "strip": "شرائط", "strips": "شرائط",
    "lancet": "شكاكات", "lancets": "شكاكات",
    "sugar free": "خالي من السكر", "sf": "خالي من السكر",
    "patch": "لصقة", "patches": "لصقة",
    "mouthwash": "مضمضة / غسول فم",
    "toothpaste": "معجون أسنان",
    "orange": "برتقال",
    "lemon": "ليمون",
    "strawberry": "فراولة",
    "mint": "نعناع",
    "inhaler": "بخاخ / استنشاق", "inh": "بخاخ / استنشاق",
    "nebulizer": "جلسات / نيبولايزر", "neb": "جلسات / نيبولايزر",
    "infusion": "تسقيط / محلول", "inf": "تسقيط / محلول",
    "injection": "حقن / حقنة", "inj": "حقن / حقنة",
    "iv": "وريد (وريدي)",
    "im": "عضل (عضلي)",
    "sc": "تحت الجلد",
    "comp": "مركب", "compound": "مركب", "complex": "مركب",
    "co": "مركب",
    "cup": "كوب", "measuring cup": "كوب (أو كوب معيار)",
    "cough": "كحة / للسعال",
    "milk": "لبن",
    "evohaler": "بخاخة",
    "dose": "جرعة",
}
ARTICLE, ARTICLE_AR = "el", "ال"


def token_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z]", "")


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def lexical_map(text: Column, entries: dict[str, str] | None = None) -> Column:
    """array<struct(kind, value)>: ``ar`` for what the lexicon gives, ``en`` for raw tokens.

    One pass decides for each token whether it begins a unit of two tokens (the article and
    its word, or a phrase), and skips the second; the units are then looked up.
    """
    entries = LEXICON if entries is None else entries
    words = _map({k: v for k, v in entries.items() if " " not in k})
    phrases = _map({k: v for k, v in entries.items() if " " in k} or {"": ""})
    none = F.array().cast("array<int>")

    def pair(keys: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(keys, i), F.get(keys, i + 1))

    def width(keys: Column, i: Column) -> Column:
        two = (i + 1 < F.size(keys)) & ((F.get(keys, i) == ARTICLE) | F.map_contains_key(phrases, pair(keys, i)))
        return F.when(two, 2).otherwise(1)

    def begins(keys: Column) -> Column:
        places = F.when(F.size(keys) > 0, F.sequence(F.lit(0), F.size(keys) - 1)).otherwise(none)
        return F.aggregate(
            places, F.struct(none.alias("begins"), F.lit(0).alias("next")),
            lambda s, i: F.when(i < s["next"], s).otherwise(
                F.struct(F.concat(s["begins"], F.array(i)).alias("begins"), (i + width(keys, i)).cast("int").alias("next"))
            ),
            lambda s: s["begins"],
        )

    def unit(raw: Column, keys: Column, i: Column) -> Column:
        key, token, following = F.get(keys, i), F.get(raw, i), F.get(raw, i + 1)
        found = F.try_element_at(words, key)
        return (
            F.when((width(keys, i) == 2) & (key == ARTICLE), _kind("ar", F.concat(F.lit(ARTICLE_AR), transliterate_word(following))))
            .when(width(keys, i) == 2, _kind("ar", F.try_element_at(phrases, pair(keys, i))))
            .when(found.isNotNull(), _kind("ar", found))
            .otherwise(_kind("en", token))
        )

    def units(raw: Column) -> Column:
        return let(F.transform(raw, token_key), lambda keys: F.transform(begins(keys), lambda i: unit(raw, keys, i)))

    return let(tokens(text), units)


def _kind(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def candidate(core_text: Column, units_ar: Column, arabic: Column, entries: dict[str, str] | None = None) -> Column:
    """The Arabic name to look for: mapped and transliterated words, units at the end."""
    parts = F.transform(lexical_map(core_text, entries), lambda p: F.when(p["kind"] == "ar", p["value"]).otherwise(transliterate_word(p["value"])))
    named = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return F.array_join(F.filter(F.concat(F.array(F.when(arabic, core_text).otherwise(named)), units_ar), lambda p: p != ""), " ")
