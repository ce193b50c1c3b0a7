"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence is a log-likelihood ratio from two sources: binned text statistics, and the words and pairs of
words it has, by naive Bayes over hashed slots and averaged over the document, so that long texts are not surer than
short ones.  How much either counts is fitted by logistic regression on rows whose words were not learned from (two folds).
Every document's probability by that evidence is then averaged by site and by path within the site; means of sparse paths are
shrunk toward their site and means of sparse sites toward the whole corpus, by as much as the spread between
sites suggests.  The score combines the evidence with the path's posterior, which leaves the document itself out.

Site and path are host and first path segment of a URL where a document has one, else two given columns.

Defined cases: a null or empty text has its own bins and no words; long texts are taken whole.  A null site or path is the empty
string; a URL without a host counts as none.  Bins and slots never seen in a labelled row add nothing.  Without labels of both
classes every evidence is zero.  Of several labels of an id the largest counts; ties of the sample's hash go by id.  A document
alone in its path has the site's mean, one alone in its site the corpus's.  Rows that repeat an id are scored each; empty tables
give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, lookup, map_arrow

#: Upper limits of the bins of each statistic; values beyond the last have a bin of their own.
BINS = {
    "words": (0, 5, 20, 60, 200, 1000),
    "upper": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6),
    "marks": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.2),
    "bars": (0.0005, 0.005, 0.02, 0.05, 0.1),
    "digits": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.3),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeats": (0.0005, 0.01, 0.05, 0.1, 0.3),
    "word_length": (2, 3, 4, 5, 6, 8, 12),
}
_LIMITS = [np.array(v) for v in BINS.values()]
_WIDTH = max(map(len, _LIMITS)) + 1
MARKS = "!?#$%&*@~^=+<>"
_CAPITAL = regex.compile(r"\p{Lu}")
#: Slots of words and of pairs of words: a table of this size is what a model holds.
SLOTS = 1 << 17
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def statistics(text: str, words: list[str]) -> tuple[float, ...]:
    """In the order of ``BINS``, of one whole text and its words."""
    n, chars = len(words), max(1, len(text))
    repeats = sum(map(str.__eq__, words, words[1:])) / max(1, n)
    digits = sum(map(text.count, "0123456789"))
    return n, len(_CAPITAL.findall(text)) / chars, sum(map(text.count, MARKS)) / chars, text.count("|") / chars, digits / chars, len(set(words)) / max(1, n), repeats, len(text) / max(1, n)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bins in a flat table, and the distinct slots of words and of pairs."""
    t = text or ""
    words = t.split()
    x = statistics(t, words)
    bins = np.array([k * _WIDTH + int(np.searchsorted(lim, v, "left")) for k, (lim, v) in enumerate(zip(_LIMITS, x, strict=True))])
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, t.lower().split()), np.uint64, len(words))
    pairs = (h[:-1] * _PAIR) ^ h[1:]
    return bins, np.unique(np.concatenate([h, pairs]) % np.uint64(SLOTS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by bin and by slot, how much their sums count, and the log-odds of all labels."""

    bins: np.ndarray
    slots: np.ndarray
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    def parts(self, text: str | None) -> tuple[float, float]:
        bins, slots = features(text)
        return float(self.bins[bins].sum()), float(self.slots[slots].mean()) if len(slots) else 0.0

    def evidence(self, text: str | None) -> float:
        x, y = self.parts(text)
        return self.weights[0] + self.weights[1] * x + self.weights[2] * y


def _ratios(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int, smooth: float = 1.0) -> np.ndarray:
    """By place, the log of how much likelier it is in a document of class 1; zero where it was never seen."""
    out = np.log((yes + smooth) / (n_yes + 2 * smooth)) - np.log((no + smooth) / (n_no + 2 * smooth))
    return np.where(yes + no > 0, out, 0.0)


def _counted(batches):
    """By fold, label and place (bins, then slots, then one for the document itself), how many documents have it."""
    size = len(BINS) * _WIDTH + SLOTS + 1
    seen: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for text, label, fold in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            bins, slots = features(text.as_py())
            at = seen.setdefault((fold, label), np.zeros(size, np.int64))
            at[bins] += 1
            at[len(BINS) * _WIDTH + slots] += 1
            at[-1] += 1
    for (fold, label), n in seen.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), fold)), pa.array(np.full(len(at), label)), pa.array(at), pa.array(n[at])], ["fold", "label", "place", "n"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Model:
    """A model from at most ``max_labelled`` labelled ids of each class, chosen by a hash; they are broadcast, so no text is shuffled.

    What comes to the driver are counts by bin and slot, of fixed number, and two numbers for each row of the sample.
    """
    none = Model(np.zeros(len(BINS) * _WIDTH), np.zeros(SLOTS))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    known = checkpointed(known.join(docs.select(id_col).distinct(), id_col, "left_semi"))
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return none
    order = [F.xxhash64(id_col), F.col(id_col)]
    part = [known.where(F.col("label") == v).orderBy(*order).limit(max_labelled) for v in (0, 1)]
    chosen = checkpointed(part[0].unionByName(part[1]))
    fold = F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(2)).cast("int").alias("fold")
    sample = checkpointed(docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col).select("text", "label", fold))
    counts = map_arrow(sample, _counted, "fold long, label long, place long, n long").groupBy("fold", "label", "place").agg(F.sum("n").alias("n")).toArrow()
    dense = np.zeros((2, 2, len(BINS) * _WIDTH + SLOTS + 1), np.int64)
    dense[tuple(counts[c].to_numpy() for c in ("fold", "label", "place"))] = counts["n"].to_numpy()
    cut = len(BINS) * _WIDTH

    def fitted(c: np.ndarray) -> Model:
        r = _ratios(c[1], c[0], c[1, -1], c[0, -1])
        return Model(r[:cut], r[cut:-1])

    by_fold = [fitted(dense[1 - k]) for k in (0, 1)]  # for the rows of a fold, what the other one teaches

    def parts(batches):
        for b in batches:
            x = [by_fold[k].parts(t.as_py()) for t, k in zip(b.column(0), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1)], ["x", "y", "label"])

    points = map_arrow(sample, parts, "x double, y double, label int").toArrow()
    x = np.c_[np.ones(len(points)), points["x"].to_numpy(), points["y"].to_numpy()]
    label = points["label"].to_numpy()
    order = np.lexsort((label, x[:, 2], x[:, 1]))
    w = _logistic(x[order], label[order])
    yes, no = int(label.sum()), int(len(label) - label.sum())
    whole = fitted(dense.sum(0))
    return Model(whole.bins, whole.slots, (float(w[0]) - math.log((yes + 1) / (no + 1)), float(w[1]), float(w[2])), math.log((n[1] + 1) / (n[0] + 1)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps, each halved until the penalised likelihood grows; slopes not below zero."""
    penalty = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    loss = lambda w: np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + w @ penalty @ w / 2
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        while abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step /= 2
        w = w + step
        if abs(step).max() <= 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def site_and_path(site: Column, path: Column, url: Column | None = None) -> tuple[Column, Column]:
    """Host and first path segment of ``url`` where it has a host, else the two others; never null."""
    site, path = F.coalesce(site, F.lit("")), F.coalesce(path, F.lit(""))
    if url is None:
        return site, path
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    segment = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "^/*([^/]*)", 1)
    return F.coalesce(host, site), F.when(host.isNotNull(), segment).otherwise(path)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, within: Column) -> float:
    """Pseudo-documents by which a group's mean is shrunk: method of moments over ``n, s, q`` of the groups.

    ``s`` and ``q`` are sums of probabilities and of their squares; ``within`` is the mean shrunk toward.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - within, 2))
    noise = F.sum(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))
    n, k, n2, d, v, m = groups.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("n") * F.col("n")), spread, noise, F.sum("s")).first()
    if not n or k < 2:
        return 1.0
    tau2 = max((d - v) / max(n - n2 / n, 1.0), 1e-9)
    mean = m / n
    return min(max(mean * (1 - mean) / tau2 - 1, 1.0), 1e6)


def scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", url_col: str | None = None,
) -> DataFrame:
    """Id, ``site, path, evidence, site_mean, path_mean, score`` per row of ``docs``; the means leave the row out."""
    site, path = site_and_path(F.col(site_col), F.col(path_col), F.col(url_col) if url_col else None)
    rows = docs.select(F.col(id_col), site.alias("site"), path.alias("path"), F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("evidence", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = [model.evidence(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.float64())], [*b.schema.names[:3], "evidence"])

    marked = checkpointed(map_arrow(rows, run, schema).withColumn("p", _sigmoid(F.col("evidence") + F.lit(model.prior))))
    p = F.col("p")
    paths = checkpointed(marked.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")))
    sites = checkpointed(paths.groupBy("site").agg(*[F.sum(c).alias(c) for c in "nsq"]))
    n, s = sites.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    mean = s / n if n else 0.5
    k_site = _strength(sites, F.lit(mean))
    sites = sites.select("site", F.col("n").alias("site_n"), F.col("s").alias("site_s"), ((F.col("s") + k_site * mean) / (F.col("n") + k_site)).alias("within"))
    both = checkpointed(paths.join(sites, "site"))
    k_path = _strength(both, F.col("within"))
    groups = both.select(F.concat_ws("\x00", "site", "path").alias("__key"), "n", "s", "site_n", "site_s")
    found = lookup(marked.withColumn("__key", F.concat_ws("\x00", "site", "path")), groups, "__key", "n", n, F.col(id_col))
    others = (F.lit(float(s)) - p) / (n - 1) if n > 1 else F.lit(mean)
    site_mean = (F.col("site_s") - p + k_site * others) / (F.col("site_n") - 1 + k_site)
    path_mean = (F.col("s") - p + k_path * F.col("site_mean")) / (F.col("n") - 1 + k_path)
    found = found.withColumn("site_mean", site_mean).withColumn("path_mean", path_mean)
    return found.select(id_col, "site", "path", "evidence", "site_mean", "path_mean", _sigmoid(F.col("evidence") + _logit(F.col("path_mean"))).alias("score"))
