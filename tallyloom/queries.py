"""A query for each operator over the test tables, and DuckDB SQL for the same result.

Catalog: ``part``, named by its name, brand, type and size in mg. Lines: ``lineitem`` with
deterministic noise of case, units and administrative words. Arabic cases are literal rows.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import MatchConfig
from .functions import features, lexicon, text, translit
from .functions import similarity as sim
from .operators import decide, feedback, lookups, merges, semijoins, similar
from .plans import cascade
from .sources import invoices, layout, tables, versions
from .staging import checkpoint_dir, stage
from .streaming.files import missing_stream

CONFIG = MatchConfig()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TASK_ROWS = 100_000  # of a task, where each line becomes several rows that are sorted


def _tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks that grow with a table, whose rows the files' footers tell."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_read(spark, sf_dir, name).count() // TASK_ROWS))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.col("p_size").cast("string"), F.lit("mg")))
    return part.select(
        F.col("p_partkey").alias("idx"), F.col("p_partkey").cast("string").alias("code"), name.alias("name"), F.col("p_retailprice").alias("price")
    )


CATALOG = """(SELECT p_partkey AS idx, CAST(p_partkey AS VARCHAR) AS code,
    p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || 'mg' AS name, p_retailprice AS price FROM part)"""


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(invoice, pos, text, raw, invoice_price, quantity): a line of each lineitem row."""
    cat = catalog(spark, sf_dir).select(F.col("idx").alias("l_partkey"), "name")
    rows = _read(spark, sf_dir, "lineitem").join(cat, "l_partkey")
    n = F.col("l_orderkey") % 5
    raw = (
        F.when(n == 0, F.upper("name")).when(n == 1, F.concat(F.lit("  Free Sample - "), F.col("name"), F.lit("  F.C.")))
        .when(n == 2, F.regexp_replace("name", "mg$", " MG tab.")).when(n == 3, F.concat(F.col("name"), F.lit("_Offer, 5 % ")))
        .otherwise(F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")))
    )
    return rows.select(
        F.col("l_orderkey").alias("invoice"), F.col("l_linenumber").alias("pos"), "name", raw.alias("text"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("invoice_price"), F.col("l_quantity").alias("quantity"),
    )


NOISY = f"""(SELECT l_orderkey AS invoice, l_linenumber AS pos, c.name,
    CASE l_orderkey % 5 WHEN 0 THEN upper(c.name) WHEN 1 THEN '  Free Sample - ' || c.name || '  F.C.'
      WHEN 2 THEN regexp_replace(c.name, 'mg$', ' MG tab.') WHEN 3 THEN c.name || '_Offer, 5 % '
      ELSE substr(c.name, 1, 3) || substr(c.name, 5) END AS text,
    l_extendedprice / l_quantity AS invoice_price, l_quantity AS quantity
    FROM lineitem JOIN {CATALOG} c ON c.idx = l_partkey)"""

# Pieces of SQL: white space, cleaning steps in their order, and LCS by bit vectors.
COLLAPSE = "trim(regexp_replace({x}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
UNIT = r"\d+(?:\.\d+)?\s*(?:mcg|iu|mg|ml|gm|g\b|%)"


def sql_collapse(x: str) -> str:
    return COLLAPSE.format(x=x)


def sql_core(x: str) -> str:
    out = f"regexp_replace({sql_collapse(x)}, '(?i){UNIT}', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)\\bf\\.?\\s*c\\.?\\b|\\bn\\.?\\s*p\\.?\\b', ' ', 'g')"
    for _ in range(2):  # RE2 has no look-behind; adjacent dots need a second pass
        out = f"regexp_replace({out}, '(^|[^0-9])\\.([^0-9]|$)', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '(?i)\\b({'|'.join(text.ADMIN_WORDS)})\\b', ' ', 'g')"
    return sql_collapse(f"regexp_replace({out}, '[-_/,]+', ' ', 'g')")


def sql_ratio(a: str, b: str) -> str:
    """Indel ratio; b has at most 62 characters."""
    full = f"((CAST(1 AS BIGINT) << length({b})) - 1)"
    mask = f"list_sum(list_transform(range(1, length({b}) + 1), lambda i: CASE WHEN substr({b}, CAST(i AS BIGINT), 1) = c.ch THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END))"
    step = f"list_reduce(list_prepend({{'ch': '', 'v': {full}}}, list_transform(string_split({a}, ''), lambda s: {{'ch': s, 'v': CAST(0 AS BIGINT)}})), lambda s, c: {{'ch': '', 'v': ((s.v + (s.v & CAST({mask} AS BIGINT))) | (s.v & ~CAST({mask} AS BIGINT))) & {full}}})"
    return f"(CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * (length({b}) - bit_count(({step}).v)) / (length({a}) + length({b})) END)"


def sql_sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({sql_collapse(x)}, ' '), lambda t: t <> '')), ' ')"


QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _on_lines(name: str, spark_column, sql_column: str) -> None:
    """A column over every line's text."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return noisy(spark, sf_dir).select("invoice", "pos", spark_column(F.col("text")).alias("value"))

    query(name, f"SELECT invoice, pos, {sql_column} AS value FROM {NOISY}")(run)


_joined = lambda a: F.array_join(a, "|")
_sql_units = f"regexp_extract_all({sql_collapse('text')}, '(?i){UNIT}')"
_sql_unit_ar = """CASE WHEN regexp_matches(u, '(?i)mcg') THEN regexp_extract(u, '[0-9]+([.][0-9]+)?') || ' ميكروجرام'
    WHEN regexp_matches(u, '(?i)iu') THEN regexp_extract(u, '[0-9]+([.][0-9]+)?') || ' وحدة دولية'
    WHEN regexp_matches(u, '(?i)mg') THEN regexp_extract(u, '[0-9]+([.][0-9]+)?') || ' مجم'
    WHEN regexp_matches(u, '(?i)ml') THEN regexp_extract(u, '[0-9]+([.][0-9]+)?') || ' مل'
    WHEN regexp_matches(u, '(?i)gm|g\\b') THEN regexp_extract(u, '[0-9]+([.][0-9]+)?') || ' جم' ELSE u END"""
_on_lines("whitespace_normalize", text.collapse, sql_collapse("text"))
_on_lines("unit_extract", lambda x: _joined(text.extract_units(text.collapse(x))), f"array_to_string({_sql_units}, '|')")
_on_lines("unit_strip", lambda x: text.strip_units(text.collapse(x)), f"regexp_replace({sql_collapse('text')}, '(?i){UNIT}', ' ', 'g')")
_on_lines("unit_translate", lambda x: _joined(text.translate_units(text.extract_units(text.collapse(x)))), f"array_to_string(list_transform({_sql_units}, lambda u: {_sql_unit_ar}), '|')")
_on_lines("noise_abbrev_strip", text.strip_abbreviations, "regexp_replace(text, '(?i)\\bf\\.?\\s*c\\.?\\b|\\bn\\.?\\s*p\\.?\\b', ' ', 'g')")
_on_lines("admin_word_strip", text.strip_admin_words, f"regexp_replace(text, '(?i)\\b({'|'.join(text.ADMIN_WORDS)})\\b', ' ', 'g')")
_on_lines("separator_normalize", text.join_separators, sql_collapse("regexp_replace(text, '[-_/,]+', ' ', 'g')"))
_on_lines("clean_line", lambda x: text.clean_line(x)["core_text"], sql_core("text"))
_on_lines("key_upper", text.key_upper, f"upper({sql_collapse('text')})")
_on_lines("key_lower", text.key_lower, f"lower({sql_collapse('text')})")
_on_lines("number_set", lambda x: _joined(F.array_sort(features.numbers(x))), "array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), '|')")
_on_lines("search_key", features.search_key, sql_collapse("text"))
_on_lines("core_tokens", lambda x: _joined(features.core_tokens(x)), "array_to_string((SELECT CASE WHEN len(c) > 0 THEN c ELSE t END FROM (SELECT t, list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+')) AS c FROM (SELECT list_filter(string_split(" + sql_collapse("text") + ", ' '), lambda x: x <> '') AS t))), '|')")
_on_lines("anchor_token", features.anchor, "(SELECT list_reduce(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+')), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) FROM (SELECT list_filter(string_split(" + sql_collapse("text") + ", ' '), lambda x: x <> '') AS t))")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def _golden(name: str, rows: list[tuple[str, str | None]], column) -> None:
    """Literal inputs with the results that hold for them, in both engines."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(a,) for a, _ in rows], "input string").select("input", column(F.col("input")).alias("value"))

    query(name, f"SELECT * FROM (VALUES {_values(rows)}) v(input, value)")(run)


WORDS = [
    ("Ondalenz", "اوندالينز"), ("Ezogast", "ايزوجاست"), ("GARAMYCIN", "جاراميسين"), ("Panadol", "بانادول"), ("Omeprazole", "اوميبرازول"),
    ("Amoxicillin", "اموكسيسيلين"), ("Xanax", "زاناكس"), ("Chlor", "كلور"), ("Yasmin", "إياسمين"), ("B12", "ب"), ("123", "123"), ("e", ""),
]
LINES = [
    ("Panadol Extra 500mg Tab", "بانادول ايكسترا أقراص 500 مجم"), ("  Free Sample Cough  Syrup ", "كحة / للسعال شراب"),
    ("Ceftriaxone 1g Vial IM", "سيفترياكسون فيال عضل (عضلي) 1 جم"), ("BEPRA 20MG 28 F.C. TAB.", "بيبرا 28 أقراص 20 مجم"),
    ("HISTAZINE-1 20TAB", "هيستازين 1 أقراص"), ("GLIMET FORTE 5/800 MG 30 TAB", "جليميت فورت 5 30 أقراص 800 مجم"),
    ("Measuring cup 2.5 ml", "كوب (أو كوب معيار) 2.5 مل"), ("Eye drops 0.5% N.P 10ml", "نقط 0.5% 10 مل"), ("لبن هيرو 2 400 جرام", "لبن هيرو 2 400 جرام"),
]
_golden("transliterate_word", WORDS, translit.transliterate_word)


def _candidate(x):
    cleaned = text.clean_line(x)
    return lexicon.candidate(cleaned["core_text"], cleaned["extracted_units_ar"], text.is_arabic(cleaned["core_text"]))


_golden("candidate_assemble", LINES, _candidate)
_golden("lexical_map", [("El Nile", "ar:النيل"), ("Sugar Free Gum", "ar:خالي من السكر|en:Gum"), ("Omega tabs 30", "en:Omega|ar:أقراص|en:30"), ("", "")],
        lambda x: _joined(F.transform(lexicon.lexical_map(x), lambda p: F.concat_ws(":", p["kind"], p["value"]))))

# Arabic words of a dosage form, as packing notices and as a word that has a synonym, by a product's size.
ARABIC = ["قرص", "شراب", "كريم", "نقطة", "بخاخة", "سعر جديد", "لبوس", "أمبول"]
_named = f"p_name || ' ' || [{', '.join(repr(w) for w in ARABIC)}][p_size % 8 + 1] || ' ' || [{', '.join(repr(w) for w in ARABIC)}][p_partkey % 8 + 1]"
_forms = "CASE WHEN {w} = 'قرص' THEN 'solid_oral' WHEN {w} = 'شراب' THEN 'liquid_oral' WHEN {w} = 'كريم' THEN 'topical' WHEN {w} = 'أمبول' THEN 'injectable' WHEN {w} = 'نقطة' THEN 'drops' WHEN {w} = 'لبوس' THEN 'suppository' WHEN {w} = 'بخاخة' THEN 'spray' END"
_form = "list_extract(list_filter(list_transform(string_split({x}, ' '), lambda w: " + _forms.format(w="w") + "), lambda g: g IS NOT NULL), 1)"


def _arabic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ARABIC))
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(words, F.col("p_size") % 8), F.get(words, (F.col("p_partkey") % 8).cast("int"))).alias("text"))


@query("form_group", f"SELECT p_partkey, {_form.format(x='text')} AS form FROM (SELECT p_partkey, {_named} AS text FROM part)")
def form_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arabic_names(spark, sf_dir).select("p_partkey", features.form_group(F.col("text")).alias("form"))


# Both synonym pairs exchanged at once or apart, either way round: every spelling, sorted.
_spelled = "list_distinct(flatten(list_transform(list_distinct([text, replace(text, 'نقط', 'قطرة'), replace(text, 'قطرة', 'نقط')]), lambda x: [x, replace(x, 'بخاخة', 'بخاخ'), replace(x, 'بخاخ', 'بخاخة')])))"


@query("synonym_variants", f"SELECT p_partkey, array_to_string(list_sort({_spelled}), '|') AS spelled FROM (SELECT p_partkey, {_named} AS text FROM part)")
def synonym_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arabic_names(spark, sf_dir).select("p_partkey", _joined(F.array_sort(features.variants(F.col("text")))).alias("spelled"))


@query("script_detect", """SELECT doc_id, length(regexp_replace(text, '[^؀-ۿ]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS arabic
    FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES (-1, true), (-2, false)) v(doc_id, arabic)""")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    literal = spark.createDataFrame([(-1, "لبن هيرو A"), (-2, "اب ab")], "doc_id long, text string")
    return docs.union(literal).select("doc_id", text.is_arabic(F.col("text")).alias("arabic"))


@query("catalog_scan_alias", f"SELECT idx, code, name, price FROM {CATALOG}")
def catalog_scan_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = catalog(spark, sf_dir).select("idx", F.col("code").alias("كود"), F.col("name").alias("Product"), F.col("price").alias("سعر"))
    return tables.catalog(other)


OVERRIDES = "(SELECT p_name AS raw, 'mapped ' || p_brand AS mapped, p_partkey AS version FROM part)"


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_name").alias("raw"), F.concat(F.lit("mapped "), "p_brand").alias("mapped"), F.col("p_partkey").alias("version"))


@query("override_lookup", f"""WITH o AS (SELECT lower({sql_collapse('raw')}) AS key, arg_max(mapped, version) AS mapped FROM {OVERRIDES} GROUP BY ALL)
    SELECT p_partkey, mapped FROM part JOIN o ON lower({sql_collapse('p_name')}) = key""")
def override_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = lookups.overrides(_overrides(spark, sf_dir))
    part = _read(spark, sf_dir, "part").select("p_partkey", text.key_lower(F.upper("p_name")).alias("key"))
    return part.join(keyed, "key").select("p_partkey", "mapped")


@query("reference_map_lookup", f"""WITH m AS (SELECT upper({sql_collapse('p_name')}) AS key, CAST(max(p_partkey) AS VARCHAR) AS code FROM part GROUP BY ALL)
    SELECT invoice, pos, m.code, c.name AS catalog_name FROM (SELECT l_orderkey AS invoice, l_linenumber AS pos, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) l
    JOIN m ON m.key = upper({sql_collapse('l.p_name')}) JOIN {CATALOG} c ON c.code = m.code""")
def reference_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    mapped = lookups.reference_map(part.select(F.col("p_name").alias("english"), F.col("p_partkey").alias("code"), F.col("p_partkey").alias("version")))
    rows = lookups.by_code(catalog(spark, sf_dir)).select(F.col("code_key").alias("code"), F.col("name").alias("catalog_name"))
    named = _read(spark, sf_dir, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    named = named.select(F.col("l_orderkey").alias("invoice"), F.col("l_linenumber").alias("pos"), text.key_upper(F.lower("p_name")).alias("key"))
    return named.join(mapped.join(rows, "code"), "key").select("invoice", "pos", "code", "catalog_name")


@query("code_lookup_last_wins", "SELECT p_brand AS code, max(p_partkey) AS idx, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_brand")
def code_lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("code"), F.col("p_name").alias("name"))
    return lookups.by_code(rows).select(F.col("code_key").alias("code"), "idx", "name")


@query("exact_name_first_wins", "SELECT l.p_partkey, m.idx FROM part l JOIN (SELECT p_name, min(p_partkey) AS idx FROM part GROUP BY p_name) m USING (p_name)")
def exact_name_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    first = lookups.by_name(part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("idx")))
    return part.join(first, F.col("p_name") == F.col("name")).select("p_partkey", "idx")


@query("exact_key_first_wins", f"""SELECT invoice, pos, m.idx FROM {NOISY} n
    JOIN (SELECT name AS k, min(idx) AS idx FROM {CATALOG} GROUP BY name) m ON m.k = n.name""")
def exact_key_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lookups.by_search_key(lookups.catalog_features(catalog(spark, sf_dir))).select("search_key", "idx")
    lines = noisy(spark, sf_dir).select("invoice", "pos", features.search_key(F.concat(F.lit(" سعر جديد "), "name")).alias("search_key"))
    return lines.join(first, "search_key").select("invoice", "pos", "idx")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("a"))
    b = part.select((F.col("p_partkey") + 1).alias("k"), F.concat_ws(" ", "p_type", "p_name").alias("b"))
    return a.join(b, "k")


PAIRS = """(SELECT x.p_partkey AS k, x.p_name || ' ' || x.p_type AS a, y.p_type || ' ' || y.p_name AS b FROM part x JOIN part y ON y.p_partkey + 1 = x.p_partkey)"""


@query("indel_ratio", f"SELECT k, round({sql_ratio('a', 'b')}, 4) AS score FROM {PAIRS}")
def indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("k", F.round(sim.ratio(F.col("a"), F.col("b")), 4).alias("score"))


@query("token_sort_ratio", f"SELECT k, round({sql_ratio('a', 'b')}, 4) AS score FROM (SELECT k, {sql_sorted('a')} AS a, {sql_sorted('b')} AS b FROM {PAIRS})")
def token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("k", F.round(sim.token_sort_ratio(F.col("a"), F.col("b")), 4).alias("score"))


# The fuzzy queries ask for the products whose id 20 divides, with a letter dropped, against every product.
ASKED = f"""(SELECT substr(name, 1, 3) || substr(name, 5) AS q FROM {CATALOG} WHERE idx % 20 = 0)"""
RANKED = f"""(WITH q AS (SELECT DISTINCT q, {sql_sorted('q')} AS a FROM {ASKED}), s AS (
    SELECT q, idx, name, code, price, {sql_ratio('a', 'b')} AS score FROM q, (SELECT *, {sql_sorted('name')} AS b FROM {CATALOG}))
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, idx) AS r FROM s QUALIFY r <= 8)"""


# With ``whole`` (queries named ..._whole, which have no SQL) they ask for every product.
def _asked(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    named = catalog(spark, sf_dir)
    if not whole:
        named = named.where("idx % 20 = 0")
    return named.select(F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")).alias("candidate")).distinct()


def _ranked(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return cascade.rank(_asked(spark, sf_dir, whole), stage(lookups.catalog_features(catalog(spark, sf_dir)), "catalog"), CONFIG)


@query("fuzzy_top8", f"SELECT q AS candidate, CAST(r AS INTEGER) AS rank, idx, round(score, 4) AS score FROM {RANKED}")
def fuzzy_top8(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    rows = _ranked(spark, sf_dir, whole).select("candidate", F.posexplode("ranked").alias("at", "c"))
    return rows.select("candidate", (F.col("at") + 1).alias("rank"), "c.idx", F.round("c.score", 4).alias("score"))


_numbers = "regexp_extract_all({x}, '[0-9]+')"
_sql_guard = f"len(list_filter({_numbers.format(x='q')}, lambda n: NOT list_contains({_numbers.format(x='name')}, n))) = 0"
_longest = "list_reduce(list_filter(string_split({x}, ' '), lambda t: NOT regexp_full_match(t, '[0-9]+')), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"
GUARDED = f"""(SELECT *, {_sql_guard} AS same_numbers, {sql_ratio('qa', 'na')} >= 80 AS alike
    FROM (SELECT *, {_longest.format(x='q')} AS qa, {_longest.format(x='name')} AS na FROM {RANKED}))"""


@query("guard_numbers", f"SELECT q AS candidate, idx, same_numbers FROM {GUARDED}")
def guard_numbers(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    rows = _ranked(spark, sf_dir, whole).select("candidate", F.explode("ranked").alias("c"))
    same = F.size(F.array_except(features.numbers(F.col("candidate")), features.numbers(F.col("c.name")))) == 0
    return rows.select("candidate", "c.idx", same.alias("same_numbers"))


@query("guard_anchor", f"SELECT q AS candidate, idx, alike FROM {GUARDED}")
def guard_anchor(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    rows = _ranked(spark, sf_dir, whole).select("candidate", F.explode("ranked").alias("c"))
    alike = sim.ratio(features.anchor(F.col("candidate")), features.anchor(features.search_key(F.col("c.name")))) >= CONFIG.anchor_ratio
    return rows.select("candidate", "c.idx", alike.alias("alike"))


@query("guard_form", f"""WITH n AS (SELECT p_partkey, {_form.format(x='text')} AS form FROM (SELECT p_partkey, {_named} AS text FROM part))
    SELECT a.p_partkey AS a, b.p_partkey AS b, coalesce(a.form = b.form, true) AS same_form FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1""")
def guard_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _arabic_names(spark, sf_dir).select(F.col("p_partkey").alias("a"), features.form_group(F.col("text")).alias("form"))
    other = forms.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("form").alias("other"))
    return forms.join(other, "a").select("a", "b", F.coalesce(F.col("form") == F.col("other"), F.lit(True)).alias("same_form"))


@query("closest_suggestion", f"SELECT q AS candidate, arg_min(idx, r) AS idx FROM {GUARDED} WHERE same_numbers AND alike GROUP BY q")
def closest_suggestion(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    found = _ranked(spark, sf_dir, whole).select("candidate", decide.closest(F.col("ranked"))["idx"].alias("idx"))
    return found.where("idx is not null")


@query("threshold_qualify", f"SELECT q AS candidate, count(*) FILTER (WHERE score >= 80) AS qualified FROM {RANKED} GROUP BY q")
def threshold_qualify(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    fit = F.filter("ranked", lambda c: c["score"] >= CONFIG.threshold)
    return _ranked(spark, sf_dir, whole).select("candidate", F.size(fit).cast("long").alias("qualified"))


@query("price_tiebreak", f"""WITH p AS (SELECT q, max(price) FILTER (WHERE score >= 80) AS paid FROM {RANKED} GROUP BY q)
    SELECT q AS candidate, arg_min(idx, r) FILTER (WHERE score >= 80 AND abs(price - paid) <= 1.0) AS idx FROM {RANKED} JOIN p USING (q) GROUP BY q HAVING max(score) >= 80""")
def price_tiebreak(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    ranked = _ranked(spark, sf_dir, whole)
    paid = F.array_max(F.transform(F.filter("ranked", lambda c: c["score"] >= CONFIG.threshold), lambda c: c["price"]))
    return ranked.withColumn("paid", paid).select("candidate", decide.choose(F.col("ranked"), F.col("paid"), CONFIG)["idx"].alias("idx")).where("idx is not null")


for _run in (fuzzy_top8, guard_numbers, guard_anchor, closest_suggestion, threshold_qualify, price_tiebreak):
    query(f"{_run.__name__}_whole")(partial(_run, whole=True))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("score"), (F.col("l_discount") > 0.05).alias("verified"))


@query("price_bonus_cap", "SELECT l_orderkey, l_linenumber, least(98.0, CASE WHEN l_discount > 0.05 THEN least(100.0, l_quantity * 2 + 10) ELSE l_quantity * 2 END) AS score FROM lineitem")
def price_bonus_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("l_orderkey", "l_linenumber", decide.cap(decide.with_bonus(F.col("score"), F.col("verified"))).alias("score"))


@query("confidence_color", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 > 90 THEN 'green' WHEN l_quantity * 2 >= 70 THEN 'yellow' ELSE 'red' END AS color FROM lineitem")
def confidence_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("l_orderkey", "l_linenumber", decide.confidence_color(F.col("score")).alias("color"))


def _arabic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog under the names that its own lines transliterate to."""
    rows = catalog(spark, sf_dir)
    named = cascade.candidates(rows.select(F.col("name").alias("text")).distinct()).select(F.col("text").alias("name"), "candidate")
    return stage(rows.join(named, "name").select("idx", "code", F.col("candidate").alias("name"), "price"), "catalog")


@query("match_cascade")
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    dims = cascade.Dimensions(
        _arabic_catalog(spark, sf_dir),
        overrides=part.where("p_size = 1").select(F.col("p_name").alias("raw"), F.col("p_brand").alias("mapped"), F.col("p_partkey").alias("version")),
        reference_map=part.where("p_size = 2").select(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("2mg")).alias("english"), F.col("p_partkey").alias("code"), F.col("p_partkey").alias("version")),
        ignored=part.where("p_size = 3").select(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("3mg")).alias("item")),
    )
    return cascade.match(noisy(spark, sf_dir).drop("name"), dims, CONFIG)


ITEMS = f"(SELECT p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size || 'mg' AS item FROM part)"


def _ignored(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    """The ignore list is every product, its words in another order; asked are the products whose id 20 divides, or all."""
    rows = catalog(spark, sf_dir) if whole else catalog(spark, sf_dir).where("idx % 20 = 0")
    texts = rows.select(F.col("name").alias("text")).distinct()
    items = _read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("mg"))).alias("item"))
    hits = semijoins.ignored(texts, items, CONFIG).withColumn("hit", F.lit(True))
    return texts.join(hits, "text", "left").select("text", F.coalesce("hit", F.lit(False)).alias("ignored"))


query("ignored_flag", f"""WITH k AS (SELECT DISTINCT lower({sql_collapse('item')}) AS b FROM {ITEMS}), t AS (SELECT DISTINCT name AS text, lower(name) AS a FROM {CATALOG} WHERE idx % 20 = 0),
    m AS (SELECT DISTINCT text FROM t, k WHERE 200.0 * least(length(a), length(b)) >= 90 * (length(a) + length(b)) AND {sql_ratio('a', 'b')} >= 90)
    SELECT text, text IN (SELECT text FROM m) AS ignored FROM t""")(partial(_ignored, whole=False))
query("ignored_flag_whole")(partial(_ignored, whole=True))


# Every line's text against a list of every product name, a letter of its longest word lost.
LISTED = "(SELECT DISTINCT regexp_replace(p_name, '([a-z]{5})[a-z]', '\\1') AS entry FROM part)"
_words = "list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+')))"


@query("controlled_flag", f"""WITH e AS (SELECT entry, unnest({_words.format(x=sql_collapse('entry'))}) AS listed FROM {LISTED}),
    t AS (SELECT DISTINCT text FROM {NOISY}), w AS (SELECT text, unnest({_words.format(x=sql_collapse('text'))}) AS word FROM t),
    a AS MATERIALIZED (SELECT word, listed FROM (SELECT DISTINCT word FROM w), (SELECT DISTINCT listed FROM e) WHERE {sql_ratio('word', 'listed')} >= 88),
    m AS (SELECT text, entry FROM w JOIN a USING (word) JOIN e USING (listed) JOIN (SELECT entry, count(*) AS n FROM e GROUP BY entry) USING (entry) GROUP BY text, entry, n HAVING count(DISTINCT listed) = n)
    SELECT text, text IN (SELECT text FROM m) AS controlled FROM t""")
def controlled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = stage(noisy(spark, sf_dir).select("text").distinct(), "texts")
    names = _read(spark, sf_dir, "part").select(F.regexp_replace("p_name", "([a-z]{5})[a-z]", "$1").alias("name"))
    hits = semijoins.controlled(texts, semijoins.controlled_entries(names), CONFIG).withColumn("hit", F.lit(True))
    return texts.join(hits, "text", "left").select("text", F.coalesce("hit", F.lit(False)).alias("controlled"))


# Of each supplier a header for every tier: its code, its first segment, its code with a wrong letter, and a code of nobody.
HEADERS = """(SELECT unnest(['Invoice ' || s_suppkey || ' To: PTY' || s_suppkey || '/Stock end', 'Given to PTY' || s_suppkey || ', here',
    'To: PTX' || s_suppkey || '/Stock', 'To: Q/' || s_suppkey || 'ZZZZZZZZZZ end']) AS header FROM supplier)"""


@query("party_resolve", f"""WITH d AS (SELECT s_suppkey AS pos, 'PTY' || s_suppkey || '/Stock' AS code, 'pty' || s_suppkey AS short, s_name AS name FROM supplier),
    h AS (SELECT DISTINCT header, regexp_extract(CASE WHEN instr(lower(header), 'to:') > 0 THEN substr(header, CAST(instr(lower(header), 'to:') AS BIGINT), 250) ELSE header END, '{semijoins.CODE}') AS token FROM {HEADERS}),
    t1 AS (SELECT header, arg_min(name, (-length(code), pos)) AS name FROM h, d WHERE contains(lower(header), lower(code)) GROUP BY header),
    t2 AS (SELECT header, arg_min(name, pos) AS name FROM h, d WHERE regexp_matches(lower(header), '(^|[^a-z0-9])' || short || '([^a-z0-9]|$)') GROUP BY header),
    s AS (SELECT header, pos, name, {sql_ratio('token', 'code')} AS score FROM h, d WHERE token <> '' AND header NOT IN (SELECT header FROM t1) AND header NOT IN (SELECT header FROM t2)),
    t3 AS (SELECT header, arg_min(name, (-score, pos)) AS name FROM s WHERE score >= 75 GROUP BY header)
    SELECT header, coalesce(t1.name, t2.name, t3.name, token, '') AS party, coalesce(t1.name, t2.name, t3.name) IS NOT NULL AS matched,
        CASE WHEN t1.name IS NOT NULL THEN 1 WHEN t2.name IS NOT NULL THEN 2 WHEN t3.name IS NOT NULL THEN 3 ELSE 4 END AS tier
    FROM h LEFT JOIN t1 USING (header) LEFT JOIN t2 USING (header) LEFT JOIN t3 USING (header)""")
def party_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _read(spark, sf_dir, "supplier")
    directory = supplier.select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("PTY"), "s_suppkey", F.lit("/Stock")).alias("code"), F.col("s_name").alias("name"))
    of = lambda before, after: F.concat(F.lit(before), "s_suppkey", F.lit(after))
    kinds = F.array(F.concat(of("Invoice ", " To: PTY"), F.col("s_suppkey"), F.lit("/Stock end")), of("Given to PTY", ", here"), of("To: PTX", "/Stock"), of("To: Q/", "ZZZZZZZZZZ end"))
    return semijoins.resolve_party(supplier.select(F.explode(kinds).alias("header")), directory, CONFIG)


# A table's head for each line: six cells, turned by the line's number.
_cells = "['#', 'Code', 'Product' || chr(10) || 'Name', NULL, 'Lot  QTY', 'Unit' || chr(10) || 'Price', 'سعر']"
_turned = f"list_concat({_cells}[l_linenumber % 7 + 1:], {_cells}[:l_linenumber % 7])"
_hit = "coalesce(list_position(list_transform(list_transform({c}, lambda x: lower(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g'))), lambda x: {t}), true), 0) - 1"


@query("header_detect", f"""SELECT l_orderkey, l_linenumber, {_hit.format(c='cells', t="contains(x, 'product')")} AS product,
    {_hit.format(c='cells', t="contains(x, 'price') OR contains(x, 'سعر')")} AS price, {_hit.format(c='cells', t="contains(x, 'quantity') OR contains(x, 'qty') OR contains(x, 'كمية')")} AS quantity
    FROM (SELECT l_orderkey, l_linenumber, {_turned} AS cells FROM lineitem)""")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*(F.lit(c) for c in ("#", "Code", "Product\nName", None, "Lot  QTY", "Unit\nPrice", "سعر")))
    by = (F.col("l_linenumber") % 7).cast("int")
    turned = F.when(by == 0, cells).otherwise(F.concat(F.slice(cells, by + 1, F.lit(7)), F.slice(cells, F.lit(1), by)))
    found = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", turned.alias("header"))
    kinds = {"product": invoices.PRODUCT_HINTS, "price": invoices.PRICE_HINTS, "quantity": invoices.QUANTITY_HINTS}
    found = found.select("l_orderkey", "l_linenumber", invoices.find_columns(F.col("header"), kinds).alias("at"))
    return found.select("l_orderkey", "l_linenumber", *(F.coalesce(F.col("at")[name], F.lit(-1)).alias(name) for name in kinds))


@query("price_parse", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit(" EGP "), F.format_number("l_extendedprice", 2), F.lit(" "))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.parse_number(shown).alias("price"))


@query("quantity_parse", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN -l_quantity WHEN 2 THEN NULL ELSE l_quantity + 0.5 END AS quantity FROM lineitem""")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("l_linenumber") % 4, F.col("l_quantity")
    shown = F.when(n == 0, F.format_number(c * 1000, 0)).when(n == 1, F.concat(F.lit(" -"), F.format_number(c, 2), F.lit(" kg"))).when(n == 2, "none").otherwise(F.format_number(c + 0.5, 1))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.parse_number(shown).alias("quantity"))


# An invoice of each order: odd ones have a table, even ones the same lines as text.
@query("scan_fallback", """SELECT CAST(l_orderkey AS VARCHAR) AS path, CASE WHEN l_orderkey % 2 = 1 THEN 'Article of ' || l_partkey ELSE 'Article of ' || l_partkey || ' x' || l_linenumber END AS name,
    CASE WHEN l_orderkey % 2 = 1 THEN l_quantity END AS quantity, CASE WHEN l_orderkey % 2 = 1 THEN l_extendedprice END AS unit_price FROM lineitem""")
def scan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, head = _read(spark, sf_dir, "lineitem"), F.array(F.lit("#"), F.lit("Product"), F.lit("Quantity"), F.lit("Unit Price"))
    article = F.concat(F.lit("Article of "), F.col("l_partkey").cast("string"))
    cells = F.array(F.col("l_linenumber").cast("string"), article, F.format_number("l_quantity", 0), F.format_number("l_extendedprice", 2))
    typed = F.concat(article, F.lit(" x"), F.col("l_linenumber").cast("string"))
    files = lines.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_list(cells).alias("rows"), F.collect_list(typed).alias("typed"))  # an order's lines
    total = F.array(F.lit(None).cast("string"), F.lit("Grand Total"), F.lit("1"), F.lit("1"))
    found = files.where("cast(path as long) % 2 = 1").select("path", F.lit(0).alias("page"), F.lit(0).alias("n"), F.concat(F.array(head), "rows", F.array(total)).alias("cells"))
    pages = files.select("path", F.lit(0).alias("page"), F.concat(F.lit("Invoice 1\n"), F.array_join("typed", "\n"), F.lit("\nPage 1\n12 34")).alias("text"))
    return invoices.item_rows(found, pages).select("path", "name", "quantity", "unit_price")


# A page of each order: a title, and its lines as words at places; of the longer names the last word stands a line lower.
@query("layout_tables", """SELECT CAST(l_orderkey AS VARCHAR) AS path, p_name || ' ' || p_brand AS name, l_quantity AS quantity, l_extendedprice AS unit_price
    FROM lineitem JOIN part ON p_partkey = l_partkey""")
def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    lines = _read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    # An order's lines come together once, and its words stay where they are: by ``path``, in tasks whose words can be sorted in memory.
    lines = lines.withColumn("path", F.col("l_orderkey").cast("string")).repartition(_tasks(spark, sf_dir, "lineitem"), "path")
    at = Window.partitionBy("path").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")  # a few lines
    rows = lines.withColumn("n", F.row_number().over(at)).withColumn("y", F.col("n") * 40 + 100.0)

    def word(shown: str | Column, x: float | Column, y: float | Column = F.col("y")) -> Column:
        shown, x, y = (v if isinstance(v, Column) else F.lit(v) for v in (shown, x, y))
        return F.struct(shown.alias("text"), x.cast("double").alias("x0"), y.alias("top"), (F.length(shown) * 4 + x).cast("double").alias("x1"), (y + 10).alias("bottom"))

    name, after = F.split("p_name", " "), 44 + 4 * F.length(F.substring_index("p_name", " ", 1))
    cells = F.array(
        word(F.col("l_linenumber").cast("string"), 10.0), word(F.get(name, F.lit(0)), 40.0), word(F.get(name, F.lit(1)), after),
        F.when(F.length("p_name") > 10, word(F.col("p_brand"), 40.0, F.col("y") + 12)).otherwise(word(F.col("p_brand"), 44 + 4 * F.length("p_name"))),
        word(F.format_number("l_quantity", 0), 200.0), word(F.format_number("l_extendedprice", 2), 260.0),
    )
    title = [word("Invoice", 10.0, 40.0), word("of a product", 60.0, 40.0)]
    head = [word("#", 10.0, 100.0), word("Product", 40.0, 100.0), word("Name", 72.0, 100.0), word("Quantity", 200.0, 100.0), word("Unit", 260.0, 100.0), word("Price", 260.0, 112.0)]
    above = F.array(*title, *head)
    every = F.concat(F.when(F.col("n") == 1, above).otherwise(F.slice(above, 1, 0)), cells)
    words = rows.select("path", every.alias("words"))  # made before they are gathered, in compiled code
    pages = words.groupBy("path").agg(F.flatten(F.collect_list("words")).alias("words")).select("path", F.lit(0).alias("page"), "words")
    return invoices.table_rows(layout.tables_of(pages, layout.Gaps(table=3.5))).select("path", "name", "quantity", "unit_price")


@query("header_slice", """SELECT CAST(o_orderkey AS VARCHAR) AS path, 'Invoice ' || o_orderkey || chr(10) || 'To: PTY' || o_custkey || '/Stock ' AS header FROM orders""")
def header_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    page = F.concat(F.lit("Invoice "), key, F.lit("\nTo: PTY"), F.col("o_custkey").cast("string"), F.lit("/Stock #  code Product\n1 # Code Product"))
    return invoices.header_text(_read(spark, sf_dir, "orders").select(key.alias("path"), F.lit(0).alias("page"), page.alias("text")))


@query("footer_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (3, 5)")
def footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 3, " Grand Total ").when(F.col("l_linenumber") == 5, "الإجمالي").otherwise("item total")
    rows = _read(spark, sf_dir, "lineitem").withColumn("name", name)
    return invoices.footer_filter(rows).select("l_orderkey", "l_linenumber")


@query("text_line_fallback", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents)
    SELECT doc_id, CAST(row AS INTEGER) AS row, trim(line) AS name FROM l WHERE trim(line) <> '' AND regexp_matches(line, '[A-Za-z؀-ۿ]{3,}')
    AND NOT regexp_matches(lower(line), 'invoice|فاتورة|page|صفحة|total|إجمالي|odoo|date|تاريخ|customer|عميل')""")
def text_line_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("page"), "text")
    return invoices.text_rows(pages).select(F.col("path").alias("doc_id"), "row", "name")


@query("insert_if_absent_merge", """SELECT c_custkey AS key, 'local' AS value FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'remote' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def insert_if_absent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    local, remote = rows.where("key % 3 = 0").withColumn("value", F.lit("local")), rows.where("key % 2 = 0").withColumn("value", F.lit("remote"))
    return merges.insert_if_absent(local, remote, "key")


@query("override_upsert", """SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id""")
def override_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("version"))
    return merges.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), "key", "version")


@query("bucketed_upsert", """SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS mapped, max(event_id) AS version FROM events GROUP BY user_id""")
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events change a table in versions that holds the even ones."""
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("raw"), F.col("event_type").alias("mapped"), F.col("event_id").alias("version"))
    even, path = merges.keyed_overrides(rows.where("version % 2 = 0")), f"{checkpoint_dir(spark)}/tallyloom/overrides-{uuid.uuid4().hex}"
    versions.create(merges.upsert(even.limit(0), even, "key", "version"), path, "key", buckets=8)
    feedback.save_overrides(rows.where("version % 2 = 1"), path)
    return versions.read(spark, path).select("key", "mapped", "version")


@query("streamed_missing_log", """SELECT lower(p_name) AS key, arg_min(p_name, p_partkey) AS original_text, CAST(min(p_partkey) AS BIGINT) AS recorded_at FROM part GROUP BY 1""")
def streamed_missing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a record of four files, in two micro-batches: by rising ids, so the smallest id of a name is the first."""
    root = f"{checkpoint_dir(spark)}/tallyloom/log-{uuid.uuid4().hex}"
    records = _read(spark, sf_dir, "part").select(F.col("p_name").alias("original_text"), F.col("p_partkey").cast("long").alias("recorded_at"))
    feedback.new_log(records.limit(0), f"{root}/table", buckets=8)
    middle = F.lit(records.agg(F.max("recorded_at") / 2).first()[0])
    for batch in (records.where(F.col("recorded_at") < middle), records.where(F.col("recorded_at") >= middle)):
        batch.repartition(2).write.mode("append").parquet(f"{root}/in")
        missing_stream(spark, f"{root}/in", f"{root}/table", f"{root}/state", "original_text string, recorded_at long").awaitTermination()
    return versions.read(spark, f"{root}/table").select("key", "original_text", "recorded_at")


@query("missing_append_dedupe", """WITH l AS (SELECT lower(p_name) AS k, p_name AS original_text, p_partkey AS recorded_at FROM part WHERE p_partkey % 2 = 0),
    r AS (SELECT lower(p_name) AS k, upper(p_name) AS original_text, p_partkey AS recorded_at FROM part WHERE p_partkey % 2 = 1)
    SELECT original_text, recorded_at FROM l UNION ALL SELECT arg_min(original_text, recorded_at), min(recorded_at) FROM r WHERE k NOT IN (SELECT k FROM l) GROUP BY k""")
def missing_append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys are the log, odd ones the new records."""
    part = _read(spark, sf_dir, "part")
    log = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("original_text"), F.col("p_partkey").alias("recorded_at"))
    new = part.where("p_partkey % 2 = 1").select(F.upper("p_name").alias("original_text"), F.col("p_partkey").alias("recorded_at"))
    return merges.append_missing(log, new)


@query("row_status", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'controlled' WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_linenumber = 2 THEN 'ignored'
    WHEN l_discount > 0.05 THEN 'copied' ELSE 'yellow' END AS status FROM lineitem""")
def row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    status = decide.row_status(c("l_quantity") > 45, c("l_returnflag") == "A", c("l_linenumber") == 2, c("l_discount") > 0.05, F.lit("yellow"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


@query("invoice_progress", """WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.03),
    a AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE (l_orderkey, l_linenumber) IN (FROM c)) AS copied FROM lineitem GROUP BY 1)
    SELECT l_orderkey AS invoice, items, copied, items = copied OR l_orderkey % 7 = 0 AS complete FROM a""")
def invoice_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice"), F.col("l_linenumber").alias("pos"), "l_discount")
    copied = lines.where("l_discount > 0.03").select("invoice", "pos", F.lit("copied").alias("action"))
    manual = lines.where("invoice % 7 = 0").select("invoice", F.lit(None).cast("int").alias("pos"), F.lit("complete").alias("action")).distinct()
    return merges.invoice_progress(lines.select("invoice", "pos"), copied.union(manual))


@query("batch_summary", "SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS invoices, (SELECT count(*) FROM part) AS catalog_rows, count(*) FILTER (WHERE l_quantity > 45) AS flagged FROM lineitem")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    parts = _read(spark, sf_dir, "part").agg(F.count("*").alias("catalog_rows"))
    counted = lines.agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("invoices"), F.count_if(F.col("l_quantity") > 45).alias("flagged"))
    return counted.join(F.broadcast(parts)).select("lines", "invoices", "catalog_rows", "flagged")  # one row each


_on_lines("orphan_dot_strip", text.strip_orphan_dots, "regexp_replace(regexp_replace(text, '(^|[^0-9])\\.([^0-9]|$)', '\\1 \\2', 'g'), '(^|[^0-9])\\.([^0-9]|$)', '\\1 \\2', 'g')")


@query("effective_name", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2) THEN l_linestatus ELSE l_returnflag END AS name FROM lineitem""")
def effective_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line's edit is null, the second's is empty; the suggestion stands for both."""
    edited = F.when(F.col("l_linenumber") == 2, "").when(F.col("l_linenumber") > 2, F.col("l_returnflag"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", decide.effective_name(edited, F.col("l_linestatus")).alias("name"))


@query("ignored_append", f"""WITH i AS (SELECT p_name AS item FROM part WHERE p_partkey % 2 = 0),
    a AS (SELECT upper(p_name) AS item FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_brand || ' ' || p_type FROM part WHERE p_partkey % 2 = 1)
    SELECT item FROM i UNION ALL SELECT min(item) FROM a WHERE lower({sql_collapse('item')}) NOT IN (SELECT lower({sql_collapse('item')}) FROM i) GROUP BY lower({sql_collapse('item')})""")
def ignored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even keys are the list; each odd one adds its name, in capitals, and its brand and type."""
    part = _read(spark, sf_dir, "part")
    items = part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("item"))
    actions = part.where("p_partkey % 2 = 1").select(F.upper("p_name").alias("raw"), F.concat_ws(" ", "p_brand", "p_type").alias("matched"))
    return merges.append_ignored(items, actions)


@query("missing_log_scan", """SELECT CAST(p_partkey AS VARCHAR) AS recorded_at, '' AS party, '' AS invoice, p_name AS original_text, p_brand AS suggested,
    CAST(p_size AS VARCHAR) AS invoice_price, '' AS quantity FROM part""")
def missing_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log without three of its columns."""
    names = {"p_partkey": "recorded_at", "p_name": "original_text", "p_brand": "suggested", "p_size": "invoice_price"}
    part = _read(spark, sf_dir, "part")
    return tables.missing_log(part.select(*(F.col(c).alias(tables.MISSING_HEADERS[n][0]) for c, n in names.items())))


@query("missing_truncate", "SELECT count(*) AS held, CAST(0 AS BIGINT) AS remaining FROM part")
def missing_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    left = merges.truncated(part).agg(F.count("*").alias("remaining"))
    return part.agg(F.count("*").alias("held")).join(F.broadcast(left))  # one row each
