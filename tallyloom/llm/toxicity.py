"""Toxicity by weak supervision.

Many voters read a text: lexicons by theme, a lexicon learned from labelled rows, spelling
and phrase patterns, and signs of a clean text. A generative label model estimates by EM,
from the votes alone, how accurate each voter is and which voters are correlated given the
class; correlated votes are discounted. The label of a labelled row is one more voter, of fixed
accuracy. Of near copies one counts in the learned lexicon. A linear classifier on the
voters' findings and on hashed words is then trained on the
posterior labels, and its scale is set on the labels of the sample.

Defined results: null counts as the empty text, on which no voter but the clean ones votes;
without labelled rows the voters' prior accuracies stand. Repeated rows get equal scores;
extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow, text_buffers
from .words import IS_LETTER, byte_codes, mix, words

# Insulting words by theme, in English, Spanish, French and German.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid dumb imbecile dimwit halfwit dunce idiota estúpido estúpida imbécil imbécile stupide crétin dumm dummkopf trottel blödmann",
    "worth": "worthless pathetic loser losers useless nobody inútil perdedor perdedora patético patética minable pathétique perdant wertlos erbärmlich versager nichtsnutz",
    "filth": "trash garbage scum filth filthy vermin parasite basura escoria ordure racaille déchet abschaum ungeziefer",
    "disgust": "disgusting revolting repulsive vile hideous asqueroso asquerosa repugnante dégoûtant répugnant widerlich ekelhaft abscheulich",
    "ridicule": "clown clowns buffoon laughingstock payaso payasa bouffon hanswurst witzfigur",
    "profanity": "shit bullshit fuck fucking fucker bastard bitch asshole crap dickhead mierda cabrón puta merde salope connard scheiße arschloch hurensohn",
    "hostility": "despise loathe subhuman cretin freak degenerate hideous wretch degenerado dégénéré abartig",
}
# Phrases of two words that attack or threaten a reader.
PHRASES = "shut up|kill yourself|kill you|hurt you|hate you|drop dead|go die|you idiot|you moron|you loser|your kind|get lost|cállate ya|te odio|ta gueule|je te|halt maul|hasse dich"
# Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

BUCKETS = 1 << 15
LEARNED_WORDS = 200
SAME_MINIMA = 4
_DISGUISED = byte_codes({ord(k): ord(v) for k, v in DISGUISES.items()})
_IS_DISGUISED = IS_LETTER.copy()
_IS_DISGUISED[[ord("@"), ord("$")]] = True


def _codes(terms: list[str], is_word=IS_LETTER, **kinds) -> np.ndarray:
    found = [h for *_, h in words(pa.array(terms), is_word, **kinds)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _pairs(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = rows[1:] == rows[:-1]
    return rows[1:][same], mix(h[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + h[1:][same])


class _Lookup:
    """Finds the few words that are in a set of codes: a small table first, then exactly."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.codes & np.uint64(0xFFFF)).astype(np.intp)] = True

    def __call__(self, rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """How many words of each row are in the set."""
        if not len(self.codes) or not len(h):
            return np.zeros(n)
        maybe = np.flatnonzero(self.table[(h & np.uint64(0xFFFF)).astype(np.intp)])
        at = np.minimum(np.searchsorted(self.codes, h[maybe]), len(self.codes) - 1)
        return np.bincount(rows[maybe[self.codes[at] == h[maybe]]], minlength=n).astype(float)


class Reader:
    """Turns texts into findings (one column for each voter) and hashed words."""

    def __init__(self, learned: np.ndarray | None = None):
        lexicons = {name: _codes(terms.split()) for name, terms in LEXICONS.items()}
        every = np.concatenate(list(lexicons.values()))
        self.lookups = {name: _Lookup(codes) for name, codes in lexicons.items()}
        self.lookups["learned"] = _Lookup(np.zeros(0, np.uint64) if learned is None else learned)
        pairs = [_pairs(rows, h)[1] for _, _, rows, h in words(pa.array(PHRASES.split("|")), IS_LETTER)]
        self.phrases = _Lookup(np.concatenate(pairs))
        terms = " ".join(LEXICONS.values()).split()
        self.disguised = _Lookup(_codes(terms, _IS_DISGUISED, codes=_DISGUISED))
        self.plain = _Lookup(every)
        self.names = [*self.lookups, "several", "density", "phrases", "disguised", "shouting", "exclaiming", "none_found", "learned_none"]

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of rows: findings (rows x voters), row and code of each word."""
        data, offsets = text_buffers(column)
        again = words(column, _IS_DISGUISED, _DISGUISED)
        for lo, hi, rows, h in words(column, IS_LETTER):
            n = hi - lo
            # The slices of both readings are the same: they depend on the offsets alone.
            _, _, other_rows, other = next(again)
            counts = [look(rows, h, n) for look in self.lookups.values()]
            hits = sum(counts)
            counts.append(np.maximum(hits - 1, 0))
            counts.append(hits / (1 + np.bincount(rows, minlength=n) / 400))  # long texts have chance hits
            counts.append(self.phrases(*_pairs(rows, h), n))
            plain = self.plain(rows, h, n)
            counts.append(np.maximum(self.disguised(other_rows, other, n) - plain, 0))
            part = data[offsets[lo] : offsets[hi]]
            at = offsets[lo : hi + 1] - offsets[lo]
            length = np.maximum(np.diff(at), 1)

            def share(mask: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(mask)])
                return (total[at[1:]] - total[at[:-1]]) / length

            counts.append(share((part >= 65) & (part <= 90)))
            counts.append(share(part == 33))
            counts.append((plain == 0).astype(float))
            counts.append((counts[len(LEXICONS)] == 0).astype(float))
            yield np.stack(counts, axis=1), rows, h

    def votes(self, findings: np.ndarray) -> np.ndarray:
        """1 toxic, -1 clean, 0 no vote."""
        out = np.zeros(findings.shape, np.int8)
        for k, name in enumerate(self.names):
            if name in ("none_found", "learned_none"):
                out[:, k] = -(findings[:, k] > 0).astype(np.int8)
            elif name == "shouting":
                out[:, k] = findings[:, k] > 0.5
            elif name == "density":
                out[:, k] = findings[:, k] >= 0.5
            elif name == "exclaiming":
                out[:, k] = findings[:, k] > 0.03
            else:
                out[:, k] = findings[:, k] > 0
        return out


@dataclass
class LabelModel:
    """p(vote | class) of each voter, and the share of its evidence that is its own."""

    prior: float = 0.1
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))  # voter, class, vote + 1
    own: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k in range(votes.shape[1]):
            ratio = np.log(self.table[k, 1]) - np.log(self.table[k, 0])
            logit += self.own[k] * ratio[votes[:, k] + 1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    @staticmethod
    def fit(votes: np.ndarray, rounds: int = 25, accuracy: float = 0.85, annotator: float | None = None) -> LabelModel:
        """``annotator``: the last voter is a person's label, of this accuracy, independent of the rest.
        Estimated instead, from 0.95 on, it left all scores at sf0.01 equal."""
        n, voters = votes.shape
        model = LabelModel(0.1, np.full((voters, 2, 3), 1 / 3), np.full(voters, 0.5))
        for k in range(voters):  # before any vote is seen: better than chance
            for c in (0, 1):
                model.table[k, c] = [0.15, 0.6, 0.25]
                model.table[k, c, 2 * c] = 0.4 * accuracy / 0.5
                model.table[k, c, 2 - 2 * c] = 0.4 * (1 - accuracy) / 0.5
            model.table[k] /= model.table[k].sum(axis=1, keepdims=True)
        for _ in range(rounds if n else 0):
            p = model.posterior(votes)
            model.prior = float(np.clip(p.mean(), 1e-3, 0.999))
            masses = np.stack([1 - p, p])
            centred = [votes.astype(float) for _ in masses]
            for c, mass in enumerate(masses):
                for value in (-1, 0, 1):
                    model.table[:, c, value + 1] = ((votes == value) * mass[:, None]).sum(axis=0) + 0.5
                model.table[:, c] /= model.table[:, c].sum(axis=1, keepdims=True)
                centred[c] -= (votes * mass[:, None]).sum(axis=0) / max(mass.sum(), 1e-9)
            covariance = sum((x * m[:, None]).T @ x for x, m in zip(centred, masses)) / n
            deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-6))
            correlation = np.abs(covariance / np.outer(deviation, deviation))
            np.fill_diagonal(correlation, 0)
            model.own = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(axis=1))
            if annotator:
                model.own[-1] = 1
                model.table[-1] = [[annotator, 1e-3, 1 - annotator], [1 - annotator, 1e-3, annotator]]
        return model


@dataclass
class Classifier:
    learned: np.ndarray
    dense: np.ndarray
    hashed: np.ndarray
    offset: float
    label_model: LabelModel | None = None

    def scores(self, reader: Reader, column: pa.Array) -> np.ndarray:
        parts = [self._logits(f, *bag(rows, h, len(f))) for f, rows, h in reader(column)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _logits(self, findings: np.ndarray, rows, buckets, scale) -> np.ndarray:
        words_ = np.bincount(rows, self.hashed[buckets], len(findings)) * scale
        return squash(findings) @ self.dense + words_ + self.offset


def squash(findings: np.ndarray) -> np.ndarray:
    return np.log1p(findings)


def bag(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each distinct (row, bucket), and each row's scale."""
    key = np.unique(rows * BUCKETS + (h >> np.uint64(49)).astype(np.int64))
    rows = key // BUCKETS
    return rows, key % BUCKETS, 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))


def one_of_near_copies(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` texts to keep so that of texts alike one counts: the first of each set of
    SAME_MINIMA minima, taken over all of a text's words."""
    minima = np.zeros((n, SAME_MINIMA), np.uint64)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    for k in range(SAME_MINIMA if len(row) else 0):
        minima[row[first], k] = np.minimum.reduceat(mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)), first)
    _, kept = np.unique(minima, axis=0, return_index=True)
    return np.isin(np.arange(n), kept)


def learn_words(column: pa.Array, labels: np.ndarray, most: int = LEARNED_WORDS) -> np.ndarray:
    """Codes of words that mark the labelled toxic rows: in many of them, in few others. The
    ``most`` frequent ones are taken; they are a feature of the classifier, which stays small."""
    if not len(column):
        return np.zeros(0, np.uint64)
    rows_, codes = [], []
    for lo, _, rows, h in words(column, IS_LETTER):
        rows_.append(rows + lo)
        codes.append(h)
    if not codes or not labels.any() or labels.all():
        return np.zeros(0, np.uint64)
    row, h = np.concatenate(rows_), np.concatenate(codes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    # Near copies would pass off every word of theirs as a mark.
    counted = one_of_near_copies(row, h, len(labels))
    row, h, labels = row[counted[row]], h[counted[row]], np.where(counted, labels, 0)
    others = np.where(counted, 1 - labels, 0)
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    terms, at = np.unique(h[first], return_inverse=True)
    toxic = np.bincount(at, labels[row[first]], len(terms))
    clean = np.bincount(at, others[row[first]], len(terms))
    rate = toxic / max(labels.sum(), 1), (clean + 0.5) / max(others.sum(), 1)
    good = (toxic >= 5) & (rate[0] > 20 * rate[1])
    best = np.flatnonzero(good)[np.argsort(-toxic[good], kind="stable")[:most]]
    return np.sort(terms[best])


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 150, ridge: float = 2e-3) -> Classifier:
    labels = labels.astype(float)
    learned = learn_words(texts, labels)
    reader = Reader(learned)
    parts, at = [], 0
    rows_, buckets_, scales = [], [], []
    for findings, rows, h in reader(texts):
        r, b, s = bag(rows, h, len(findings))
        parts.append(findings)
        rows_.append(r + at)
        buckets_.append(b)
        scales.append(s)
        at += len(findings)
    voters = len(reader.names)
    if not parts:
        return Classifier(learned, np.where([n.endswith("none") or n == "none_found" for n in reader.names], -1.0, 3.0), np.zeros(BUCKETS), -2.0)
    findings, rows, buckets, scale = np.concatenate(parts), np.concatenate(rows_), np.concatenate(buckets_), np.concatenate(scales)
    votes = np.column_stack([reader.votes(findings), np.where(labels > 0, 1, -1).astype(np.int8)])
    model = LabelModel.fit(votes, annotator=0.995)
    target = model.posterior(votes)
    x, n = squash(findings), len(target)
    size = voters + BUCKETS + 1
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        z = x @ theta[:voters] + np.bincount(rows, theta[voters:-1][buckets], n) * scale + theta[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        gradient = np.concatenate([x.T @ slope, np.bincount(buckets, (slope * scale)[rows], BUCKETS), [slope.sum()]])
        gradient[voters:-1] += ridge * theta[voters:-1]
        gradient[:voters] += 1e-5 * theta[:voters]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    z = x @ theta[:voters] + np.bincount(rows, theta[voters:-1][buckets], n) * scale + theta[-1]
    a, b = 1.0, 0.0
    if 0 < labels.sum() < n:  # scale on the labels themselves
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - labels) * z).mean() + 1e-3 * (a - 1), (p - labels).mean()])
            w = p * (1 - p) + 1e-6
            hessian = np.array([[(w * z * z).mean() + 1e-3, (w * z).mean()], [(w * z).mean(), w.mean() + 1e-6]])
            step_ = np.linalg.solve(hessian, g)
            a, b = a - 0.5 * step_[0], b - 0.5 * step_[1]
    return Classifier(learned, a * theta[:voters], a * theta[voters:-1], float(a * theta[-1] + b), model)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic."""
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c != score))  # an older score gives way
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own.learned)
        for batch in batches:
            values = own.scores(reader, batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, score])

    return arrow(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
