"""Document fingerprints by MinHash: universal hash permutations over word shingles, in numpy.

A signature keeps, for each of ``PERMUTATIONS`` multiply-shift hash functions, the low 16 bits of the
smallest value over a text's shingles.  The share of equal places estimates the Jaccard similarity.
``near_duplicates`` joins bands of signatures in Spark and verifies every candidate pair by the exact
Jaccard similarity of the shingle sets.

Classes that share a band are candidates.  Within a band's bucket three star turns come first: pairs inside a
component need no comparison.  What they leave apart is compared pair by pair in buckets of up to ``CROWDED``
classes.  Classes of more crowded buckets meet by a prefix filter instead: two sets as similar as asked must
share one of their rarest shingles, early enough in the order of rarity that the rest can still make up for it.  That
loses no pair and spares the classes that share a common passage only.  Pairs whose parity sketches differ by more bits than
the similarity allows shingles are ruled out where they meet; that loses no pair either.

Defined cases: a null text is empty; texts of fewer words than a shingle are one shingle, texts without
words have the signature of the empty set, which equals only itself.  Words are lower-cased and split at
white space; letters of scripts written without spaces are words of their own.  Long texts are taken whole.  Ids may be
of any type that orders; null ids come first.  Rows that repeat an id are taken each, those that repeat id and text are one
document in ``deduplicate``.  Equal ids are ordered by a hash of the text.  An empty table gives an empty result.  Extra columns
are ignored, or pass through ``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_BYTES, bitset, filter_bits, flag, gathered, identity, keep_one, lookup, map_arrow, released, sha_of, shielded
from .components import components

PERMUTATIONS, SHINGLE, SIMILAR = 128, 5, 0.8
BANDS = 32
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ROWS_AT_ONCE = 1024
#: Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    t = (text or "").lower()
    return _WORD.findall(t) if _HAS_UNSPACED.search(t) else t.split()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of a whole text, repeats included."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += w[i : n - k + 1 + i] * _MIX[i]
        h ^= h >> np.uint64(29)
    return h


def signature(h: np.ndarray) -> np.ndarray:
    """``PERMUTATIONS`` values of 16 bits; the empty set's are all ones."""
    if not len(h):
        return np.full(PERMUTATIONS, 0xFFFF, np.uint16)
    x = np.unique(h >> np.uint64(32))  # multiply-shift is universal on 32 bits
    least = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), ROWS_AT_ONCE):
        v = x[i : i + ROWS_AT_ONCE, None] * _A
        v += _B
        np.minimum(least, v.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


#: Ranges of ids at most, so that their bounds stay a small list at any size.
MOST_RANGES = 20_000


def in_order(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = 1 << 23) -> DataFrame:
    """``bucket, copy, id, text``, sorted within partitions: each bucket's rows by id, then the next bucket's first row.

    Buckets are ranges of ids, of about ``part_bytes`` each until there are ``MOST_RANGES``; the last is followed by the very first
    row.  The ranges are found on ids alone; the text is shuffled once.
    """
    at = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = int(min(MOST_RANGES, max(1, -(-size // part_bytes))))
    narrow = docs.select(at.alias("at"))
    spread = narrow.repartitionByRange(n, "at") if n > 1 else narrow.coalesce(1)
    firsts = spread.groupBy(F.spark_partition_id().alias("p")).agg(F.min("at").alias("at"))
    listed = firsts.agg(F.sort_array(F.collect_list("at")).alias("a"))
    bounds, many = listed.select(F.to_json("a"), F.size("a")).first()
    kind = listed.schema["a"].dataType
    known = F.from_json(F.lit(bounds or "[]"), kind)
    # by halves, the number of bounds that are not above the row
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, many.bit_length())))])
    below = F.aggregate(steps, F.lit(0), lambda acc, k: F.when((acc + k <= many) & (F.get(known, acc + k - 1) <= at), acc + k).otherwise(acc))
    placed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), at.alias("at"), (below - 1).alias("bucket"))
    own = F.struct("bucket", F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(max(1, many))).alias("bucket"), F.lit(True).alias("copy"))
    first = F.get(known, F.col("bucket")) == F.col("at")
    out = placed.select("id", "text", "at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("p"))
    out = out.select("p.bucket", "p.copy", "id", "text", F.col("at.h").alias("h"))
    return out.repartitionById(max(1, many), F.col("bucket")).sortWithinPartitions("bucket", "copy", "id", "h", "text").drop("h")


def fingerprints_beside_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint beside that of an edited text and its likeness to that and to the next row's.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or
    all, of the next document in order of id; after the last comes the first.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = [], None  # the row before: bucket, id, text, signature, whether a copy
        for b in batches:
            ids = b.column(2)
            for i, (bucket, copy, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True)):
                text = text.as_py() or ""
                if before and before[0] == bucket and before[4] and copy:
                    continue  # rows that repeat the first id
                sig = signature(shingles(text))
                if before and before[0] == bucket:
                    held.append(row(before, text, sig))
                before = (bucket, ids[i].as_py(), text, sig, copy)
                if len(held) == 512:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    def row(x: tuple, following: str, next_sig: np.ndarray) -> tuple:
        _, number, text, sig, _ = x
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = signature(shingles(edited))
        return number, len(text), hashlib.sha256(edited.encode()).hexdigest(), sig.astype(">u2").tobytes(), other.astype(">u2").tobytes(), likeness(sig, other), likeness(sig, next_sig)

    def out(held: list[tuple]) -> pa.RecordBatch:
        number, *rest = zip(*held, strict=True)
        types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(number, id_type), *(pa.array(c, t) for c, t in zip(rest, types, strict=True))], [id_col, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = ["n_chars", "edited_sha256", "signature", "edited_signature", "near_edited", "near_next"]
    return map_arrow(in_order(docs, id_col, text_col), run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, signature binary, edited_signature binary, near_edited double, near_next double")


#: Longs of a parity sketch.
PARITIES = [f"parity{i}" for i in range(16)]


def parity(h: np.ndarray) -> np.ndarray:
    """For every slot of a sketch, whether an odd number of the distinct shingles ``h`` fall into it.

    Two sets differ by at least as many shingles as their sketches differ by bits.
    """
    width = 64 * len(PARITIES)
    odd = np.bincount((h % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """``id, row, shingles, text_key, bands`` per row: the number of distinct shingles, a 128-bit hash of their set, a hash of each band of the signature;
    and the longs of their parity sketch."""

    def run(batches):
        width = PERMUTATIONS // bands
        for b in batches:
            sizes, keys, cut, odd = [], [], [], []
            for t in b.column(2):
                h = np.unique(shingles(t.as_py()))
                s = signature(h)
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                odd.append(parity(h))
                cut.append([xxhash.xxh64_intdigest(s[i * width : (i + 1) * width].tobytes(), i) - (1 << 63) for i in range(bands)])
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(cut, pa.list_(pa.int64()))]
            columns += map(pa.array, np.array(odd, np.int64).reshape(-1, len(PARITIES)).T)
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "shingles", "text_key", "bands", *PARITIES])

    rows = docs.select(F.col(id_col).alias("id"), identity(id_col, sha_of(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {docs.schema[id_col].dataType.simpleString()}, row string, shingles long, text_key binary, bands array<long>, " + ", ".join(f"{c} long" for c in PARITIES))


#: Star turns; classes in a bucket beyond which pairs are no longer compared one by one; classes of a bucket that a task compares with the others.
TURNS, CROWDED, BLOCK = 3, 64, 512
#: Bytes of shingle sets that a task keeps while it compares pairs.
KEPT_BYTES = 32 << 20
#: Slots by which the frequency of shingles is counted: a fixed number, and only the order of a prefix depends on it.
SLOTS = 1 << 16


def _grouped(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``n``, the rows of its ``bucket``, where there are several."""
    sizes = gathered(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    k, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = filter_bits(k)
    some = flag(keyed, gathered(bitset(sizes, "bucket", bits)), F.col("bucket"), bits, "__some").where("__some").drop("__some")
    return gathered(lookup(some, sizes, "bucket", "n", total, F.col("text_key")).where("n is not null"))


def _banded(classes: DataFrame) -> DataFrame:
    """``text_key, shingles, bucket, n`` per class and band that another class has too."""
    keyed = classes.select("text_key", "shingles", F.posexplode("bands").alias("i", "band"))
    return _grouped(keyed.select("text_key", "shingles", F.xxhash64("i", "band").alias("bucket")))


def _alike(a: str, b: str, similar: float) -> Column:
    """Whether the numbers of shingles allow the similarity."""
    return F.least(a, b) >= F.lit(similar) * F.greatest(a, b) - 1e-9


def stars(members: DataFrame, similar: float, turns: int = TURNS) -> DataFrame:
    """``a, b``: in every bucket, up to ``turns`` of its classes with each of the others."""
    pivot = lambda turn: F.min(F.struct(F.xxhash64(F.lit(turn), "text_key").alias("h"), "text_key", "shingles"))
    pivots = gathered(members.groupBy("bucket").agg(*[pivot(i).alias(f"p{i}") for i in range(turns)], F.count(F.lit(1)).alias("n")))
    total = pivots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = lookup(members.select("bucket", "text_key", "shingles"), pivots, "bucket", "n", total, F.col("text_key"))
    each = found.select("text_key", "shingles", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(turns)]))).alias("p"))
    pairs = each.where("p.text_key <> text_key").select(F.col("p.text_key").alias("a"), F.col("text_key").alias("b"), F.col("p.shingles").alias("sa"), F.col("shingles").alias("sb"))
    return pairs.where(_alike("sa", "sb", similar)).select("a", "b").distinct()


def _close(x: str, y: str, similar: float) -> Column:
    """Whether the parity sketches allow the similarity: sets of m and n shingles that differ by d have one of (m + n - d) / (m + n + d)."""
    differ = sum((F.bit_count(F.col(f"{c}_{x}").bitwiseXOR(F.col(f"{c}_{y}"))) for c in PARITIES), F.lit(0))
    return differ <= (F.col(f"shingles_{x}") + F.col(f"shingles_{y}")) * F.lit((1 - similar) / (1 + similar)) + 1e-9


def all_pairs(members: DataFrame, similar: float) -> DataFrame:
    """``a, b``: the pairs of classes with different roots that share a bucket and may be as similar as asked.

    ``members`` may have ``most``, the number of shingles of a class's partner there at most, and parity sketches, which rule out most pairs
    inside the join.  Every class is held against its whole bucket: that is for buckets of up to ``CROWDED``, and for what all
    else has left.  A task takes ``BLOCK`` classes of a bucket on one side.
    """
    extra = [c for c in ("most", *PARITIES) if c in members.columns]
    parts = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("text_key"), parts)
    each = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    side = lambda x, part: members.select("bucket", part.alias("part"), *[F.col(c).alias(f"{c}_{x}") for c in ("text_key", "shingles", "root", *extra)])
    fits = _alike("shingles_a", "shingles_b", similar)
    if "most" in extra:
        fits = fits & F.expr("most_a >= shingles_b and most_b >= shingles_a")
    if len(extra) >= len(PARITIES):
        fits = fits & _close("a", "b", similar)
    pairs = side("a", own).join(side("b", each), ["bucket", "part"]).where(fits & F.expr("root_a <> root_b and text_key_a < text_key_b"))
    return pairs.select(F.col("text_key_a").alias("a"), F.col("text_key_b").alias("b")).distinct()


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``members`` with the ``root`` of each class, without buckets of a single component."""
    now = members.join(joined, F.col("text_key") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "text_key").alias("root"))
    now = gathered(now)
    h = F.xxhash64("root")
    apart = gathered(now.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"), F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select("bucket", "__n"))
    total = apart.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return gathered(lookup(now, apart, "bucket", "__n", total, F.col("text_key")).where("__n is not null").drop("__n"))


def rare_shingles(classes: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """``bucket, text_key, shingles, most, n``: classes by the shingles of their prefixes, where a pair as similar as asked is possible.

    ``classes`` has ``text_key`` only.  Shingles are ordered by an estimate of their frequency, the rarest first.  Two sets of sizes x
    and y share at least ``similar / (1 + similar) * (x + y)`` shingles; if the first that they share has u and v shingles from it
    on, no more than the smaller of u and v.  So u allows a partner of ``most`` shingles.  Of a pair the smaller set allows one of its
    own size at least: a shingle that no class has early enough for that makes no pair, however many classes have it.
    """
    own = texts.join(classes, "text_key")

    def count(batches):
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0):
                seen += np.bincount((np.unique(shingles(t.as_py())) % SLOTS).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "c"])

    counts = map_arrow(own.select("text"), count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["c"].to_numpy()

    def prefixes(batches):
        for b in batches:
            for key, t in zip(b.column(0), b.column(1), strict=True):
                h = np.unique(shingles(t.as_py()))
                n = len(h)
                h = h[np.lexsort((h, often[(h % SLOTS).astype(np.int64)]))][: n - int(np.ceil(similar * n - 1e-9)) + 1]
                most = np.floor((n - np.arange(len(h))) * (1 + similar) / similar - n + 1e-9).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([key.as_py()] * len(h), pa.binary()), pa.array(np.full(len(h), n)), pa.array(most)], ["bucket", "text_key", "shingles", "most"])

    rows = gathered(map_arrow(own.select("text_key", "text"), prefixes, "bucket long, text_key binary, shingles long, most long"))
    able = F.min(F.when(F.col("most") >= F.col("shingles"), F.col("shingles"))).alias("least")
    heads = gathered(rows.groupBy("bucket").agg(able, F.count(F.lit(1)).alias("__n")).where("least is not null and __n > 1"))
    total = heads.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    some = lookup(rows, heads, "bucket", "__n", total, F.col("text_key")).where("most >= least")
    return _grouped(some.select("text_key", "shingles", "bucket", "most"))


def jaccard(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` with the exact Jaccard similarity of their shingle sets; ``texts`` has ``text_key, text``."""
    sides = gathered(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    sides = sides.join(texts.select(F.col("text_key").alias("a"), F.col("text").alias("__x")), "a")
    left = lookup(pairs, sides, "a", "n", pairs.count(), F.col("b"), F.octet_length("__x") <= HOT_BYTES).drop("n")
    both = left.join(texts.select(F.col("text_key").alias("b"), F.col("text").alias("__y")), "b").select("a", "b", "__x", "__y")

    def run(batches):
        kept, held = {}, 0  # shingle sets by class; a class has many pairs

        def whole(key, text):
            nonlocal kept, held
            if key not in kept:
                if held > KEPT_BYTES:
                    kept, held = {}, 0
                kept[key] = np.unique(shingles(text.as_py()))
                held += kept[key].nbytes
            return kept[key]

        for b in batches:
            out = []
            for i, j, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                p, q = whole(i, x), whole(j, y)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                out.append(shared / max(1, len(p) + len(q) - shared) if len(p) or len(q) else 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["a", "b", "jaccard"])

    return map_arrow(both, run, "a binary, b binary, jaccard double")


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``text_key, text`` of the classes in ``wanted`` (``row, text_key``); only rows that a filter flags are shuffled."""
    rows = docs.select(identity(id_col, sha_of(F.col(text_col))).alias("row"), F.col(text_col).alias("text"))
    bits = filter_bits(wanted.count())
    words = gathered(bitset(wanted.select(F.xxhash64("row").alias("h")), "h", bits))
    flagged = flag(rows, words, F.xxhash64("row"), bits, "__maybe").where("__maybe")
    return gathered(flagged.join(wanted, "row").dropDuplicates(["row"]).select("text_key", "text"))


def _told(marked: DataFrame, linked: DataFrame) -> DataFrame:
    """``a, b``: the classes of each row and of its ``keep_row``, where they differ."""
    keys = marked.select("row", "text_key").dropDuplicates(["row"])
    own = gathered(linked.where("row <> keep_row").select("row", "keep_row").distinct().join(keys, "row").select("keep_row", F.col("text_key").alias("a")))
    heads = gathered(own.groupBy("keep_row").agg(F.count(F.lit(1)).alias("members")).join(keys.select(F.col("row").alias("keep_row"), F.col("text_key").alias("b")), "keep_row"))
    return gathered(lookup(own, heads, "keep_row", "members", own.count(), F.col("a")).where("a <> b").select("a", "b").distinct())


def joined_classes(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, similar: float, told: DataFrame | None = None) -> DataFrame:
    """``node, root`` over the classes: components of all pairs that share a band, or are in ``told`` (``a, b``), and have a Jaccard similarity of at least ``similar``.

    Every link is verified exactly before it joins anything.
    """
    members = _banded(classes)
    met = members.select("text_key")
    if told is not None:
        met = met.unionByName(told.select(F.explode(F.array("a", "b")).alias("text_key")))
    wanted = gathered(classes.join(met.distinct(), "text_key").select("row", "text_key", *PARITIES))
    texts = _texts(docs, id_col, text_col, wanted.select("row", "text_key"))
    released(docs.sparkSession)
    sketches = wanted.select("text_key", *PARITIES)
    tried, links = [], []

    def joined_by(pairs: DataFrame) -> DataFrame:
        """Components once the pairs that have not been tried yet are verified too."""
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for before in tried:
            ordered = ordered.join(before, ["a", "b"], "left_anti")
        tried.append(gathered(ordered))
        links.append(gathered(jaccard(tried[-1], texts).where(F.col("jaccard") >= similar).select("a", "b")))
        released(docs.sparkSession)
        found = components(reduce(DataFrame.unionByName, links))
        released(docs.sparkSession)
        return found

    def compared(members: DataFrame) -> DataFrame:
        return all_pairs(members.join(sketches, "text_key"), similar)

    first = stars(members, similar)
    joined = joined_by(first if told is None else first.unionByName(told))
    left = _open(members.where("n > 2"), joined)
    if left.isEmpty():
        return joined
    pairs = compared(left.where(F.col("n") <= CROWDED))
    crowd = gathered(left.where(F.col("n") > CROWDED).select("text_key", "root").distinct())
    crowded = not crowd.isEmpty()
    if crowded:
        rare = rare_shingles(crowd.select("text_key"), texts, similar)
        few = gathered(rare.where(F.col("n") <= CROWDED).join(crowd, "text_key"))
        pairs = pairs.unionByName(compared(few)).unionByName(stars(rare.where(F.col("n") > CROWDED), similar))
    joined = joined_by(pairs)
    if crowded:
        left = _open(rare.where(F.col("n") > CROWDED), joined)
        if not left.isEmpty():
            joined = joined_by(compared(left))
    return joined


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, also: Callable | None = None) -> DataFrame:
    """``id, row, component_id, keep_row`` per row: the smallest id reachable over verified pairs, and the ``row`` of one document with it.

    Texts with equal shingle sets are one class long before pairs are made.  ``also`` is another operator's ``near_duplicates`` or ``candidates``:
    what it links (``row, keep_row``) is verified like the pairs of the bands.
    """
    marked = gathered(signatures(docs, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    classes = gathered(marked.groupBy("text_key").agg(first, F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands"), *[F.any_value(c).alias(c) for c in PARITIES]))
    told = None if also is None else _told(marked, also(docs, id_col, text_col))
    released(docs.sparkSession)
    joined = joined_classes(classes, docs, id_col, text_col, similar, told)
    rooted = gathered(classes.join(joined, classes.text_key == joined.node, "left").select("text_key", "n", "first", F.coalesce("root", "text_key").alias("root")))
    best = gathered(rooted.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("members")))
    total = rooted.count()
    by_key = gathered(lookup(rooted.select("text_key", "n", "root"), best, "root", "members", total, F.col("text_key")).select("text_key", "n", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row")))
    return lookup(marked.select("id", "row", "text_key"), by_key, "text_key", "n", marked.count(), F.col("row")).select("id", "row", "component_id", "keep_row")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, also: Callable | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the one with the smallest id."""
    return shielded(docs, [id_col, text_col], lambda docs, id_col, text_col: keep_one(docs, near_duplicates(docs, id_col, text_col, similar, also), id_col, text_col))


def hexed(signature_col: Column) -> Column:
    return F.lower(F.hex(signature_col))
