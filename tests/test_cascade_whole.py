"""The whole cascade against a plain one: every line of the smallest tables, each asked by itself."""

import re

from pyspark.sql import functions as F

from tallyloom import queries as Q
from tallyloom.functions.features import FILLER_WORDS, FORM_GROUPS, NOTICES, SYNONYMS
from tallyloom.functions.similarity import indel
from tallyloom.plans import cascade

SF_DIR = "/root/testdata/sf0.001"


def key(x):
    return " ".join(re.sub(NOTICES, " ", x).split())


def core(x):
    every = x.split()
    return [t for t in every if t not in FILLER_WORDS and not re.fullmatch(r"\d+", t)] or every


def anchor(x):
    return max(core(x), key=len, default=None)


def form(x):
    return next((g for t in x.split() for g, words in FORM_GROUPS.items() if t in words), None)


def spellings(x):
    out = {x}
    for a, b in SYNONYMS:
        out |= {y for x in out for y in (x.replace(a, b), x.replace(b, a))}
    return out


def ordered(x):
    return " ".join(sorted(x.split()))


class Plain:
    def __init__(self, catalog, overrides, mapped, ignored):
        self.rows = sorted(catalog)
        self.overrides, self.mapped = overrides, mapped
        self.codes = {code: (idx, code, name, price) for idx, code, name, price in self.rows}
        self.ignored, self.seen = {" ".join(i.split()).lower() for i in ignored}, {}
        self.keys = [(r, ordered(key(r[2]))) for r in self.rows]

    def ok(self, candidate, row):
        asked, told = (set(re.findall(r"\d+", x)) for x in (candidate, row[2]))
        a, b = form(candidate), form(row[2])
        x, y = anchor(candidate), anchor(key(row[2]))
        return asked <= told and (a is None or b is None or a == b) and (x is None or y is None or indel(x, y) >= 80)

    def ranked(self, candidate):
        if candidate not in self.seen:
            scores = {}
            for spelled in spellings(candidate):
                asked = ordered(spelled)
                for s, r in sorted(((-indel(asked, k), r) for r, k in self.keys), key=lambda x: (x[0], x[1][0]))[:8]:
                    scores[r] = max(scores.get(r, 0.0), -s)
            best = sorted(scores.items(), key=lambda x: (-x[1], x[0][0]))
            self.seen[candidate] = [(r, s, self.ok(candidate, r)) for r, s in best]
        return self.seen[candidate]

    def is_ignored(self, *texts):
        found = [" ".join(t.split()).lower() for t in texts]
        return any(t in self.ignored or any(indel(t, i) >= 90 for i in self.ignored) for t in found if t)

    def line(self, text, candidate, price):
        """(source, name, score, code, price verified, rejected by a guard)"""
        folded = " ".join(text.split())
        if folded.lower() in self.overrides:
            return "exception", self.overrides[folded.lower()], 100.0, None, False, False
        if folded.upper() in self.mapped and self.mapped[folded.upper()] in self.codes:
            _, code, name, _ = self.codes[self.mapped[folded.upper()]]
            return "reference_map", name, 98.0, code, True, False
        if not candidate:
            return "unmatched", "", 0.0, None, False, False
        exact = next((r for r in self.rows if r[2] == candidate), None) or next((r for r in self.rows if key(candidate) and key(r[2]) == key(candidate)), None)
        if exact:
            return "database", exact[2], 98.0, exact[1], False, False
        ranked = self.ranked(candidate)
        near = lambda r: price is not None and r[3] is not None and abs(r[3] - price) <= 1.0
        fit = [x for x in ranked if x[1] >= 80]
        chosen = next((x for x in fit if near(x[0])), fit[0] if fit else None)
        if chosen and chosen[2]:
            score = min(100.0, chosen[1] + 10) if near(chosen[0]) else chosen[1]
            return "database", chosen[0][2], min(score, 98.0), chosen[0][1], near(chosen[0]), False
        closest = next((r for r, _, ok in ranked if ok), None)
        score = chosen[1] if chosen else ranked[0][1] if ranked else 0.0
        if closest:
            return "database_low_confidence", closest[2], score, closest[1], False, chosen is not None
        return "unmatched", "", score, None, False, chosen is not None


def test_every_line_of_the_smallest_tables(spark):
    got = Q.match_cascade(spark, SF_DIR).collect()
    lines = Q.noisy(spark, SF_DIR).select("invoice", "pos", F.trim("text").alias("text"), "invoice_price")
    texts = cascade.candidates(lines.select("text").distinct()).select("text", "candidate").collect()
    candidates = {r.text: r.candidate for r in texts}
    part = spark.read.parquet(f"{SF_DIR}/part.parquet").orderBy("p_partkey").collect()
    named = lambda r, size: f"{r.p_name} {r.p_brand} {r.p_type} {size}mg"
    plain = Plain(
        [(r.idx, r.code, r.name, r.price) for r in Q._arabic_catalog(spark, SF_DIR).collect()],
        {" ".join(r.p_name.split()).lower(): r.p_brand for r in part if r.p_size == 1},
        {" ".join(named(r, 2).split()).upper(): str(r.p_partkey) for r in part if r.p_size == 2}, [named(r, 3) for r in part if r.p_size == 3],
    )
    given = lambda rows: sorted(map(str, rows))
    assert given((r.invoice, r.pos, r.original_text.strip(), r.invoice_price) for r in got) == given((r.invoice, r.pos, r.text, r.invoice_price) for r in lines.collect())
    ignored, wrong, sources = {}, [], set()
    for r in got:
        text = r.original_text.strip()
        want = plain.line(text, candidates[text], r.invoice_price)
        found = (r.source, r.suggested_arabic, r.score, r.matched_code, r.price_verified, r.rejected_by_guard)
        pair = (text, r.suggested_arabic)
        if pair not in ignored:
            ignored[pair] = plain.is_ignored(*pair)
        color = "green" if want[2] > 90 else "yellow" if want[2] >= 70 else "red"
        color = color if want[0] in ("exception", "reference_map", "database") else "red"
        if (*found[:2], round(found[2], 6), *found[3:], r.color, r.ignored) != (*want[:2], round(want[2], 6), *want[3:], color, ignored[pair]):
            wrong.append((text, found, want, r.ignored))
        sources.add(r.source)
    assert wrong == [] and len(sources) >= 3
