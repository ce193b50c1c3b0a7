"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code of the 64 fingerprint bits: a product of perfect binary codes on blocks
of bits.  Two Golay codes (bits 0-22 and 23-45, covering radius 3 each) make 2**24 anchors; where these would be
crowded a Hamming code (bits 46-60, radius 1) makes 2**35 of them.  All other bits have the one-word code.  A
fingerprint's home is the anchor it decodes to.  It is replicated to every anchor within the covering radius plus the
threshold, block by block: if two fingerprints differ in ``threshold`` bits at most, one of them is at home at an
anchor that the other visits.  Fingerprints are compared at their anchors only; equal fingerprints are one class
long before.  Which code is used changes the work, never the links.

An anchor with more than ``cap`` fingerprints is not compared in one task.  Its fingerprints take the
exact linear way: two of them differ in at most ``threshold`` (even) bits if they share a point
within half of it, and such a point has a bounded number of neighbours.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked like any
other.  Long texts are taken whole, in blocks of words.  Null ids come after all others.  Rows that repeat an id keep their
own fingerprints; of those that repeat id and text ``deduplicate`` returns one.  An empty table gives an empty result; extra
columns are ignored, or pass through ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gathered, identity, keep_one, lookup, map_arrow, sha_of, shielded
from .components import components

WORDS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code on ``length`` bits from ``shift``: every word is within ``radius`` of one code word."""

    shift: int
    length: int
    generator: int
    radius: int

    @property
    def degree(self) -> int:
        return self.generator.bit_length() - 1

    def word(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.shift) & ((1 << self.length) - 1)


#: Generator polynomials of the binary Golay code of length 23 and the Hamming code of length 15.
GOLAY, HAMMING = 0b101011100011, 0b10011
FEW = (Code(0, 23, GOLAY, 3), Code(23, 23, GOLAY, 3))
MANY = (*FEW, Code(46, 15, HAMMING, 1))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Of one whole text in UTF-8; long texts are taken in blocks of words, so memory stays bounded."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, WORDS_AT_ONCE):
        block = words[at : min(at + WORDS_AT_ONCE, last) + shingle - 1]
        if len(block) <= shingle:
            hashes = [h(b" ".join(block), 42)]
        else:
            line = b" ".join(block)
            ends = np.cumsum([len(w) + 1 for w in block])
            starts = [0, *ends[:-shingle].tolist()]
            hashes = [h(line[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in b.column(2).cast(pa.binary())), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, row, fp`` per row: ``fp`` the 64 bits as a long, ``row`` a string of id and digest that tells rows apart."""
    rows = docs.select(F.col(id_col).alias("id"), identity(id_col, sha_of(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    return map_arrow(rows, lambda it: _fingerprints(it, shingle), f"id {docs.schema[id_col].dataType.simpleString()}, row string, fp long")


@lru_cache
def _syndromes(code: Code) -> tuple[np.ndarray, ...]:
    """By byte of a word, its part of the remainder modulo the generator."""
    unit = []
    for i in range(code.length):
        r = 1 << i
        for k in range(code.length - 1, code.degree - 1, -1):
            if r >> k & 1:
                r ^= code.generator << (k - code.degree)
        unit.append(r)
    tables = []
    for low in (0, 8, 16):
        t = np.zeros(256, np.int64)
        for i in range(max(0, min(8, code.length - low))):
            t[np.arange(256) >> i & 1 == 1] ^= unit[low + i]
        tables.append(t)
    return tuple(tables)


def syndrome(code: Code, words: np.ndarray) -> np.ndarray:
    a, b, c = _syndromes(code)
    return a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]


@lru_cache
def _patterns(code: Code, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, where the error patterns of weight radius + ``extra`` (0: up to the radius) start; the patterns."""
    weights = range(code.radius + 1) if extra == 0 else [code.radius + extra]
    errors = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(code.length), w)], np.int64)
    s = syndrome(code, errors)
    order = np.argsort(s, kind="stable")
    return np.searchsorted(s[order], np.arange((1 << code.degree) + 1)), errors[order]


def anchors(fps: np.ndarray, threshold: int, codes: tuple[Code, ...] = FEW) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint, by position, every anchor within the covering radius plus the threshold."""
    at, left, out = np.arange(len(fps)), np.full(len(fps), threshold), np.zeros(len(fps), np.int64)
    for code in codes:
        words = code.word(fps)
        s, parts = syndrome(code, words), []
        for extra in range(threshold + 1):
            ok = np.flatnonzero(left >= extra)
            first, errors = _patterns(code, extra)
            begin = first[s[at[ok]]]
            n = first[s[at[ok]] + 1] - begin
            pick = np.repeat(ok, n)
            error = errors[np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)]
            parts.append((at[pick], left[pick] - extra, out[pick] | (words[at[pick]] ^ error) << code.shift))
        at, left, out = (np.concatenate(x) for x in zip(*parts, strict=True))
    return at, out


def visits(threshold: int, codes: tuple[Code, ...]) -> float:
    """How many anchors a fingerprint visits on average."""
    by_left = {threshold: 1.0}
    for code in codes:
        new: dict[int, float] = {}
        for left, n in by_left.items():
            for extra in range(left + 1):
                patterns = len(_patterns(code, extra)[1]) / (1 << code.degree)
                new[left - extra] = new.get(left - extra, 0.0) + n * patterns
        by_left = new
    return sum(by_left.values())


def load(n: int, threshold: int, codes: tuple[Code, ...]) -> float:
    """Fingerprints at an anchor on average, if ``n`` were spread evenly."""
    return n * visits(threshold, codes) / 2.0 ** sum(c.length - c.degree for c in codes)


def _replicas(batches: Iterator[pa.RecordBatch], threshold: int, codes: tuple[Code, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i in range(0, len(fps), 2048):
            part = fps[i : i + 2048]
            row, anchor = anchors(part.view(np.int64), threshold, codes)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row].view(np.int64))], ["anchor", "fp"])


def home(fps: np.ndarray, codes: tuple[Code, ...] = FEW) -> np.ndarray:
    return anchors(fps, 0, codes)[1]


def _same_anchor(anchor: np.ndarray, fp: np.ndarray, threshold: int, codes: tuple[Code, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows sorted by anchor; a group's links come as they are if few, else as a star."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    at_home = home(fp, codes) == anchor
    left, right = [], []
    big = sizes > 16
    idx = np.flatnonzero(np.repeat(~big & (sizes > 1), sizes))
    k = 1
    while len(idx):
        idx = idx[idx + k < len(anchor)]
        idx = idx[anchor[idx] == anchor[idx + k]]
        near = (np.bitwise_count(fp[idx].view(np.uint64) ^ fp[idx + k].view(np.uint64)) <= threshold) & (at_home[idx] | at_home[idx + k])
        left.append(fp[idx[near]])
        right.append(fp[idx[near] + k])
        k += 1
    for s, n in zip(starts[big], sizes[big], strict=True):
        f = np.sort(fp[s : s + n])
        h = home(f, codes) == anchor[s]
        label = np.arange(n)
        close = [(np.bitwise_count(f[i].view(np.uint64) ^ f.view(np.uint64)) <= threshold) & (h[i] | h) for i in range(n)]
        near = np.array(close)
        while True:
            new = np.where(near, label, n).min(1)
            new = np.minimum(new, label)
            new = new[new]
            if (new == label).all():
                break
            label = new
        linked = label != np.arange(n)
        left.append(f[linked])
        right.append(f[label[linked]])
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _links(batches: Iterator[pa.RecordBatch], threshold: int, cap: int, codes: tuple[Code, ...]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by anchor: links as ``a, b``; of an overfull anchor each row as ``a`` with null ``b``."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["a", "b"])

    anchor, fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for b in batches:
        x, y = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        if over is not None:
            n = int(np.searchsorted(x, over, "right"))
            if n:
                yield out(y[:n], None)
            x, y = x[n:], y[n:]
            if not len(x):
                continue
            over = None
        anchor, fp = np.r_[anchor, x], np.r_[fp, y]
        if not len(anchor):
            continue
        cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
        yield from _whole(anchor[:cut], fp[:cut], threshold, cap, codes, out)
        anchor, fp = anchor[cut:], fp[cut:]
        if len(anchor) > cap:
            over = anchor[0]
            yield out(fp, None)
            anchor, fp = anchor[:0], fp[:0]
    yield from _whole(anchor, fp, threshold, cap, codes, out)


def _whole(anchor: np.ndarray, fp: np.ndarray, threshold: int, cap: int, codes: tuple[Code, ...], out) -> Iterator[pa.RecordBatch]:
    if len(anchor) < 2:
        return
    _, inverse, n = np.unique(anchor, return_inverse=True, return_counts=True)
    full = n[inverse] > cap
    if full.any():
        yield out(fp[full], None)
    if not full.all():
        a, b = _same_anchor(anchor[~full], fp[~full], threshold, codes)
        if len(a):
            yield out(a, b)


def _crowded(fps: DataFrame, threshold: int) -> DataFrame:
    """Links between fingerprints that share a point within half the threshold of both."""
    half = threshold // 2
    masks = [sum(1 << i for i in c) for w in range(half + 1) for c in combinations(range(64), w)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    points = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    shared = points.groupBy("point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    return shared.select(F.explode("fps").alias("a"), F.col("fps")[0].alias("b")).where("a != b").distinct()


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(home(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))], ["anchor"])


def code_for(fps: DataFrame, threshold: int, cap: int) -> tuple[Code, ...]:
    """The code of few anchors, unless their load would be over ``cap`` / 64 on average, or a third of ``cap`` have their home at one of them."""
    if load(fps.count(), threshold, FEW) > cap / 64:
        return MANY
    most = map_arrow(fps, _homes, "anchor long").groupBy("anchor").count().agg(F.max("count")).first()[0]
    return MANY if (most or 0) > cap / 3 else FEW


def links(fps: DataFrame, threshold: int = 2, cap: int = 1024, codes: tuple[Code, ...] | None = None) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that lose no component.

    All differing fingerprints within ``threshold`` bits are connected through these links, whichever ``codes`` are given.
    """
    if threshold % 2:
        raise ValueError("the threshold must be even")
    codes = codes or code_for(fps, threshold, cap)
    visiting = map_arrow(fps, lambda it: _replicas(it, threshold, codes), "anchor long, fp long")
    found = map_arrow(visiting.repartition("anchor").sortWithinPartitions("anchor"), lambda it: _links(it, threshold, cap, codes), "a long, b long")
    found = checkpointed(found)
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    edges = found.where("b is not null")
    return edges if crowded.isEmpty() else edges.unionByName(_crowded(crowded, threshold))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, cap: int = 1024) -> DataFrame:
    """``id, row, fp, component_id, keep_row`` per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, itself included; ``keep_row`` is the
    ``row`` of one document with that id, the one that stays.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    classes = checkpointed(marked.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    joined = components(links(classes.select("fp"), threshold, cap))
    rooted = checkpointed(classes.join(joined, classes.fp == joined.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    roots = rooted.where("root != fp").select("root").distinct()
    linked = rooted.join(roots, "root", "left_semi")
    best = linked.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("members"))
    total = linked.count()
    bests = lookup(linked.select("fp", "n", "root"), best, "root", "members", total, F.col("fp")).select("fp", "n", "best")
    alone = rooted.join(roots, "root", "left_anti").select("fp", "n", F.col("first").alias("best"))
    by_fp = checkpointed(bests.unionByName(alone))
    found = lookup(marked, by_fp, "fp", "n", marked.count(), F.col("row"))
    return found.select("id", "row", "fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, cap: int = 1024) -> DataFrame:
    """``row, keep_row`` for another operator to verify: rows with the first of their fingerprint, and these with the first of the smallest fingerprint linked to theirs.

    A pair a row at most, and none of the rounds that components take.
    """
    marked = gathered(fingerprints(docs, id_col, text_col, shingle).select("row", "fp"))
    heads = gathered(marked.groupBy("fp").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")))
    own = lookup(marked, heads, "fp", "n", marked.count(), F.col("row")).select("row", F.col("head").alias("keep_row"))
    found = links(heads.select("fp"), threshold, cap).select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("other"))
    found = gathered(found.where("fp <> other").groupBy("fp").agg(F.min("other").alias("other")))
    ends = found.groupBy("other").agg(F.count(F.lit(1)).alias("n")).join(heads.select(F.col("fp").alias("other"), F.col("head").alias("keep_row")), "other")
    near = found.join(heads.select("fp", F.col("head").alias("row")), "fp")
    linked = lookup(near, gathered(ends), "other", "n", found.count(), F.col("row"))
    return own.unionByName(linked.select("row", "keep_row"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the one with the smallest id."""
    return shielded(docs, [id_col, text_col], lambda docs, id_col, text_col: keep_one(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col))
