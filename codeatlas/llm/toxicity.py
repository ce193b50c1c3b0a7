"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, replaces look-alike letters and digit substitutions, and turns
everything else into spaces; ``l`` folds to ``i`` because ``1`` stands for either.  Exception phrases
are longer patterns that cover a match inside them.  A text's matched weight, absolute and
normalised by its length, goes through a logistic curve.

The lexicon has a few fixed English terms and what ``learn`` finds: word beginnings and whole words
far more frequent in documents labelled toxic than in others.  Learning takes at most
``max_labelled`` labelled documents of each class, chosen by a hash of the id; scoring covers every
whole text.

Stems are beginnings of ``SHORTEST`` to ``LONGEST`` letters; whole words count at any length.  Both limits are part of
what a term is: they bound a word's terms, so that a text's are in proportion to its length.

Defined cases: a null or empty text has no match and scores below 0.5.  Long texts are scored whole, in time in proportion
to their length.  Ids only choose the learning sample and tell rows apart.  Terms of equal evidence go by stems
first, then by length and alphabet; of matches at one word the longest counts.  Without labels of both classes the fixed
lexicon and curve are used.  Rows that repeat an id are scored each; empty tables give empty results; extra columns are
ignored, or pass through ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow

#: Insults any model starts from, and their common harmless phrases.
SEED = ["idiot", "moron", "stupid", "worthless", "scum", "pathetic", "disgusting", "loser", "imbecile", "dumbass", "asshole", "bastard", "bitch", "fuck", "shit", "cunt"]
EXCEPTIONS = ["pond scum", "scum of the pond", "loser takes nothing", "trash can", "trash bin", "trash bag", "clown fish", "circus clown", "idiot proof", "shit happens", "disgusting smell", "bastard sword"]
#: Cyrillic and Greek letters that look like Latin ones, and the Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ь": "b", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ø": "o", "ß": "ss", "æ": "ae", "ł": "i",
}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_SIGN = re.compile(r"[@$](?=\w)")
_KEEP = {chr(c): " " for c in range(128) if not chr(c).isalnum()} | DIGITS | {"l": "i"}
_ASCII = str.maketrans(_KEEP)
_DROPPED = str.maketrans({"@": " ", "$": " "})


@lru_cache(maxsize=1 << 16)
def _folded(ch: str) -> str:
    """What one character above ASCII stands for."""
    base = LOOKALIKES.get(ch) or "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
    base = "".join(LOOKALIKES.get(c, c) for c in base)
    return base if base.isalnum() or not base else " "


def fold(text: str | None) -> str:
    """Folded words between single or more spaces, one at either end."""
    t = _NUMBER.sub(" ", (text or "").lower())
    if "@" in t or "$" in t:
        t = _SIGN.sub(lambda m: DIGITS[m[0]], t).translate(_DROPPED)
    if not t.isascii():
        t = t.translate({ord(c): _folded(c) for c in set(t) if c > "\x7f"})
    return f" {t.translate(_ASCII)} "


@dataclass(frozen=True)
class Model:
    """``terms``: folded pattern to weight; a pattern starts with a space and ends with one if it is a whole word."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)

    def built(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(t, (len(t), None))
        if len(a):
            a.make_automaton()
        return a


def matched(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Summed weight and number of matched words; of matches at one word the longest counts."""
    if not len(automaton):
        return 0.0, 0
    hits: dict[int, tuple[int, float]] = {}
    covered: list[tuple[int, int]] = []
    for end, (n, weight) in automaton.iter(folded):
        start = end - n + 1
        if weight is None:
            covered.append((start, end))
        elif start not in hits or hits[start][0] < n:
            hits[start] = (n, weight)
    if covered:
        # one sweep: of the spans that start no later, the one that reaches furthest
        covered.sort()
        at, furthest, free = 0, -1, {}
        for start in sorted(hits):
            while at < len(covered) and covered[at][0] <= start:
                furthest = max(furthest, covered[at][1])
                at += 1
            if furthest < start + hits[start][0] - 1:
                free[start] = hits[start]
        hits = free
    return sum(w for _, w in hits.values()), len(hits)


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Matched weight, and the same per hundred words (of at least 20), both on a log scale."""
    folded = fold(text)
    weight, _ = matched(folded, automaton)
    if not weight:
        return 0.0, 0.0
    words = max(20, len(folded.split()))
    return math.log1p(weight), math.log1p(100 * weight / words)


def probability(x: tuple[float, float], curve: tuple[float, float, float]) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, curve[0] + curve[1] * x[0] + curve[2] * x[1]))))


#: Letters of a stem.
SHORTEST, LONGEST = 4, 10


def _terms(text: str | None) -> Counter:
    """Patterns of a text and how often they occur: each word's beginnings, and the whole word."""
    out: Counter = Counter()
    for w, n in Counter(fold(text).split()).items():
        out[f" {w} "] += n
        for k in range(SHORTEST, min(len(w), LONGEST) + 1):
            out[f" {w[:k]}"] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By term, for documents with label 1 and 0: how many have it, and its occurrences.

    Occurrences within a document are damped by a logarithm, so that a repeated line doesn't make a term.
    """
    tables = [Counter(), Counter(), Counter(), Counter()]

    def flush():
        terms = list(tables[0].keys() | tables[1].keys())
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], kind) for c, kind in zip(tables, kinds, strict=True))], ["term", "yes", "no", "yes_n", "no_n"])
        for c in tables:
            c.clear()

    for b in batches:
        for text, label in zip(b.column(0), b.column(1), strict=True):
            found = _terms(text.as_py())
            at = 0 if label.as_py() else 1
            tables[at].update(found.keys())
            tables[at + 2].update({t: 1 + math.log2(n) for t, n in found.items()})
            if len(tables[0]) + len(tables[1]) > 300_000:
                yield from flush()
    yield from flush()


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = 4000, evidence: float = 20.0, ratio: float = 4.0,
) -> Model:
    """A model from the documents that ``labels`` labels.

    At most ``max_labelled`` ids of each class are used, so they may be broadcast and no text is shuffled to find
    theirs, and the terms that come to the driver are some of those of so many documents.  Of equal texts one is used.  A term needs a
    log-likelihood ratio of ``evidence`` over documents that have it, and ``ratio`` times as many occurrences
    per toxic document as per other document.  Of a word's beginnings that qualify the one with most evidence
    is kept.
    """
    seeds = {f" {fold(w).strip()}": 3.0 for w in SEED}
    exceptions = tuple(f" {' '.join(fold(p).split())} " for p in EXCEPTIONS)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label")).join(docs.select(id_col).distinct(), id_col, "left_semi")
    order = [F.xxhash64(id_col), F.col(id_col)]
    part = [known.where(F.col("label") == v).orderBy(*order).limit(max_labelled) for v in (0, 1)]
    chosen = checkpointed(part[0].unionByName(part[1]))
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label").dropDuplicates()
    sample = checkpointed(sample)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_no, n_yes = sizes.get(0, 0), sizes.get(1, 0)
    if not n_no or not n_yes:
        return Model(seeds, exceptions)
    counts = map_arrow(sample.repartition(24), _counts, "term string, yes long, no long, yes_n double, no_n double")
    counts = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("yes", "no", "yes_n", "no_n")])
    share, total = n_yes / (n_yes + n_no), F.col("yes") + F.col("no")

    def part_of(k, p):
        return F.when(k > 0, k * F.log(k / (total * p))).otherwise(0.0)

    g = 2 * (part_of(F.col("yes"), share) + part_of(F.col("no"), 1 - share))
    weight = F.log((F.col("yes_n") + 0.5) / (n_yes + 1.0)) - F.log((F.col("no_n") + 0.5) / (n_no + 1.0))
    best = counts.where("yes >= 3").select("term", g.alias("g"), weight.alias("w")).where((F.col("g") >= evidence) & (F.col("w") >= math.log(ratio)))
    terms: dict[str, float] = {}
    begun: set[str] = set()  # every beginning of a term taken
    for r in best.orderBy(F.desc("g"), F.col("term").endswith(" "), F.desc(F.length("term")), "term").collect():
        t = r["term"]
        heads = [t[:k] for k in range(1, len(t) + 1)]
        if t not in begun and not any(h in terms for h in heads):
            terms[t] = float(r["w"])
            begun.update(heads)
    terms = seeds | terms
    model = Model(terms, exceptions)
    automaton = model.built

    def xs(batches):
        a = automaton()
        for b in batches:
            f = [features(t.as_py(), a) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64()), b.column(1).cast(pa.int32())], ["x0", "x1", "label"])

    points = np.array([tuple(r) for r in map_arrow(sample, xs, "x0 double, x1 double, label int").collect()])
    return Model(terms, exceptions, _fit(points[:, :2], points[:, 2]))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic curve by Newton steps, slopes not below zero."""
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    a, y = np.c_[np.ones(len(x)), x][order], y[order]
    w, penalty = np.array([-2.0, 1.0, 0.5]), np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    w[0] = min(w[0], -0.5)
    return tuple(float(v) for v in w)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` (0 to 1), ``weight`` and ``hits`` per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        a = model.built()
        for b in batches:
            s, w, n = [], [], []
            for t in b.column(1):
                folded = fold(t.as_py())
                weight, hits = matched(folded, a)
                x = (math.log1p(weight), math.log1p(100 * weight / max(20, len(folded.split())))) if weight else (0.0, 0.0)
                s.append(probability(x, model.curve))
                w.append(float(weight))
                n.append(hits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(w, pa.float64()), pa.array(n, pa.int64())], [id_col, "score", "weight", "hits"])

    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, score double, weight double, hits long")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``reject``, all columns, in one pass without a shuffle."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        a = model.built()
        for b in batches:
            ok = [probability(features(t.as_py(), a), model.curve) < reject for t in b.column(at)]
            yield b.filter(pa.array(ok))

    return map_arrow(docs, run, docs.schema)
