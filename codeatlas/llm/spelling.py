"""Spelling variants: words one edit apart, grouped below the frequent form that each is most likely meant for.

Two words one inserted, deleted or replaced character apart share the first half of the shorter one or its second half.
So they meet in a forward sorted dictionary, in a block of words with a shared beginning, or in a reversed one, in a
block with a shared end.  A block takes part for one length of the shorter word.  Blocks of more than ``CROWDED`` words are
subdivided: the unshared middle is halved again, so that a block is given by a beginning and an end, until a single character of the
shorter word is left open and the alphabet bounds the block.  The halves split pairs by where they first differ: each pair
of words is met in exactly one block.  Blocks are sorted, scanned in one sweep and verified; a task keeps one run of blocks.

A crowded block is recognised by its count, gathered with partial aggregation, and its words are dealt to its parts before any shuffle, so no
task gets a crowded block.  Crowded blocks are known to the tasks by a bit filter of bounded size; a block taken for crowded by mistake is subdivided,
too, with the same pairs.

Defined cases: a null text has no words, a null id is empty.  Only A-Z are lower-cased.  Words are letters of Latin-1.  Of near words
as frequent as each other the first by code point is the form.  Rows that repeat an id and a text count each.  Long texts are read whole; long words take part whatever their length.
Empty tables give an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitset, checkpointed, filter_bits, flag, map_arrow, stored

#: Code points of a word at least, occurrences at least, how much more frequent a form is.
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Words of a block that are compared with each other.
CROWDED = 64
#: Words, and bytes of words, that a task compares together; bytes of pairs.
SCANNED, SCANNED_BYTES, PAIR_BYTES = 20_000, 1 << 22, 1 << 24
#: One word in so many of a document loses a character.
MISSPELT = 31


def misspelt(run: str, base: int) -> str:
    """``run`` without a character if 31 divides its checksum, which goes on from that of the document's id."""
    h = zlib.crc32(run.encode(), base)
    if h % MISSPELT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``: the words of at least ``shortest`` letters, some with a character left out, that occur ``least`` times."""
    long_run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            for number, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base = zlib.crc32(f"{number}:".encode())
                for word, n in Counter(long_run.findall(text.as_py().encode().lower().decode())).items():
                    found[misspelt(word, base)] += n
            words = [w for w in found if len(w) >= shortest]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of ``word, n, m, i, j`` twice: with the first half of its open middle shared, and with the second."""
    middle = F.col("m") - F.col("i") - F.col("j")
    half = F.floor(middle / 2).cast("int")
    parts = F.array(F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j")), F.struct(F.col("i").alias("i"), (F.col("j") + middle - half).alias("j")))
    return rows.select("word", "n", "m", F.explode(parts).alias("x")).select("word", "n", "m", "x.i", "x.j", _block().alias("block"))


def _block() -> Column:
    head, tail = F.substring("word", F.lit(1), F.col("x.i")), F.substring("word", F.length("word") - F.col("x.j") + 1, F.col("x.j"))
    return F.concat_ws(",", "m", "x.i", "x.j", F.concat(head, tail))


def blocks(words: DataFrame, shortest: int = SHORTEST, crowded: int = CROWDED) -> DataFrame:
    """``block, word, n``: the words of each block, where more than one word meets.

    Block ``m,i,j,letters`` holds words of ``m`` and ``m + 1`` letters whose first ``i`` and last ``j`` are ``letters``.
    """
    # every word is the shorter one of some pairs and the longer one of others
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= shortest)
    rows = _halves(rows.withColumns({"i": F.lit(0), "j": F.lit(0)}))
    out = None
    while True:
        held = rows.groupBy(F.xxhash64("block").alias("h")).agg(F.count(F.lit(1)).alias("n"))
        many = checkpointed(held.where(F.col("n") > crowded).select("h"))
        k = many.count()
        if not k:
            done = rows
        else:
            bits = filter_bits(k)
            divided = flag(rows, checkpointed(bitset(many, "h", bits)), F.xxhash64("block"), bits, "many").withColumn("many", F.expr("many and m - i - j > 1"))
            divided, _ = stored(divided, "blocks")
            done, rows = divided.where("not many").drop("many"), _halves(divided.where("many"))
        out = done if out is None else out.unionByName(done)
        if not k:
            return out.select("block", "word", "n")


def _near(m: int, spans: list[tuple[int, int, int]], words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``words`` in blocks ``start, end, j``, shorter ones first: indices of words with near ones, how many, and the index of the best.

    In a block with a shared end a longer word counts if it differs before that end begins.
    """
    n = len(words)
    letters = np.frombuffer(b"".join(w.ljust(m + 1, b"\0") for w in words), np.uint8).reshape(n, m + 1)
    longer = np.fromiter((len(w) > m for w in words), bool, n)
    ends, bound = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for start, end, j in spans:
        ends[start:end] = end
        bound[start:end] = m - j if j else m + 1
    first = np.flatnonzero(~longer)
    partners = ends[first] - first - 1
    found = []
    step = max(1, PAIR_BYTES // (m + 1))
    before = np.concatenate([[0], np.cumsum(partners)])
    for low in range(0, int(before[-1]), step):
        k = np.arange(low, min(low + step, int(before[-1])))
        at = np.searchsorted(before, k, "right") - 1
        a = first[at]
        b = a + 1 + k - before[at]
        same_at = letters[a, :m] != letters[b, :m]
        differ = same_at.sum(1)
        lead = np.where(differ > 0, same_at.argmax(1), m)
        near = (differ == 1) & ~longer[b]
        c = np.flatnonzero(longer[b] & (lead < bound[a]))
        shifted = letters[a[c], :m] != letters[b[c], 1:]
        last = np.where(shifted.any(1), m - 1 - shifted[:, ::-1].argmax(1), -1)
        near[c] = last < lead[c]
        found.append(np.stack([a[near], b[near]]))
    if not found or not sum(x.shape[1] for x in found):
        return (np.zeros(0, np.int64),) * 3
    a, b = np.concatenate(found, 1)
    me, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=words.__getitem__)] = np.arange(n)
    order = np.lexsort((rank[other], -counts[other], me))
    me, other = me[order], other[order]
    start = np.flatnonzero(np.concatenate([[True], me[1:] != me[:-1]]))
    return me[start], np.diff(start, append=len(me)), other[start]


def near(words: DataFrame, shortest: int = SHORTEST, crowded: int = CROWDED) -> DataFrame:
    """``word, n_near, best, best_n``: how many of ``words`` (``word, n``, each word once) are one edit apart, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}  # by the shorter length: spans, words, counts
        size = 0

        def out() -> pa.RecordBatch:
            rows: tuple[list, ...] = ([], [], [], [])
            for m, (spans, found, counts) in held.items():
                who, many, best = _near(m, spans, found, np.array(counts, np.int64))
                rows[0].extend(found[i].decode("latin-1") for i in who)
                rows[1].extend(many.tolist())
                rows[2].extend(found[i].decode("latin-1") for i in best)
                rows[3].extend(counts[i] for i in best)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "best", "best_n"])

        for block, members in _scanned(batches):
            m, _, j, _ = block.split(",", 3)
            m, j = int(m), int(j)
            if len(members) < 2:
                continue
            members.sort(key=lambda x: len(x[0]))
            if len(members[0][0]) > m:
                continue
            spans, found, counts = held.setdefault(m, ([], [], []))
            spans.append((len(found), len(found) + len(members), j))
            found.extend(w for w, _ in members)
            counts.extend(n for _, n in members)
            size += len(members) * (m + 1)
            if size > SCANNED_BYTES or len(found) > SCANNED:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    together = blocks(words, shortest, crowded).repartition("block").sortWithinPartitions("block")
    found = map_arrow(together, run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", "x.best", (-F.col("x.less")).alias("best_n"))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """The runs of rows of one block."""
    now, members = None, []
    for b in batches:
        for block, word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if block != now:
                if members:
                    yield now, members
                now, members = block, []
            members.append((word.encode("latin-1"), n))
    if members:
        yield now, members


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: from ``word, form`` to the last form, each step taking twice as many links; a chain's counts grow tenfold a link, so it is short."""
    links, _ = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved, _ = stored(links.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, crowded: int = CROWDED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    A word's form is the most frequent of its near words if that is ``times`` as frequent as the word; the root is the last of the
    forms that follow each other, or the word itself.
    """
    words, _ = stored(counted(docs, id_col, text_col, shortest, least), "words")
    found = words.join(near(words, shortest, crowded), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    formed, _ = stored(found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    return formed.join(roots(formed.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
