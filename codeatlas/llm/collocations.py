"""Collocations by hierarchical pair naming: phrases that occur more often than their parts explain.

A word's name is a 64-bit hash of language and word.  Two adjacent frequent phrases of k-1 words that overlap in all but
one word make a phrase of k words; its key is the pair of their names, its name a hash of that pair.  Tasks replace names by
pair names level by level and count keys where the texts are; a bit filter over the frequent names of each level, of bounded size, spares most of
the others.  The counted keys are then joined globally to the level below, on either name: the join drops what a filter let
through, and the pair is the phrase's two parent pointers.  Over them run the counts of its beginnings and ends, which
every cut needs, and the test for longer phrases that contain it.  A phrase of two more words that nearly always
contains it implies one of one more word that does, so one level up is enough.

Defined cases: a null text is empty, a null language is ``und``.  Only A-Z are lower-cased.  Phrases don't cross punctuation, line ends or documents; overlapping
occurrences count each.  Long texts are counted whole, in segments of ``SEGMENT`` bytes that overlap by the words of a phrase less
one.  Repeated rows count each.  Equal scores go by count, then phrase.  Empty tables give an empty result; extra columns are
ignored, whatever their names.  Two phrases of one level that share a name, whose counts could not be told apart, raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitset, filter_bits, map_arrow, stored

#: Bytes of text that are looked at together.
SEGMENT = 4 << 20
#: Candidates that one task ranks.
RANKED_AT_ONCE = 50_000
#: What ends a piece, and what separates words.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(SPACES)] = 1
_CLASS[list(ENDS)] = 2
_GAP = re.compile(b"[" + re.escape(ENDS + SPACES) + b"]")
#: Odd multipliers of the pair hash.
_LEFT, _RIGHT, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ordered pair of names."""
    x = left * _LEFT + (right ^ (right >> np.uint64(31))) * _RIGHT
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _names(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a lower-cased text, and the number of the piece that each is in."""
    raw = np.frombuffer(text, np.uint8)
    kind = _CLASS[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.cumsum(kind == 2)[starts]


def segments(text: bytes, size: int, segment: int) -> Iterator[bytes]:
    """Parts of a text that hold each of its phrases of ``size`` words once; no word is cut."""
    at, end = 0, segment
    while len(text) > end and (gap := _GAP.search(text, end)):
        part = text[at : gap.start()]
        # the next part begins with the last words of this one, too few for a phrase
        back = len(part)
        for _ in range(size - 1):
            while back and _CLASS[part[back - 1]]:
                back -= 1
            while back and not _CLASS[part[back - 1]]:
                back -= 1
        if back:
            yield part
            at += back
        end = gap.start() + segment
    yield text[at:]


class Names:
    """A membership filter over the names of a level, of bounded size: it may know a name too many, never one too few."""

    def __init__(self, names: DataFrame, n: int):
        self.bits = filter_bits(n)
        found = bitset(names, "name", self.bits).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)

    def __contains__(self, name: int) -> bool:
        return bool(self.of(np.array([name], np.uint64))[0])

    def of(self, names: np.ndarray) -> np.ndarray:
        slot = names & np.uint64((1 << self.bits) - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _by_language(batches: Iterator[pa.RecordBatch], size: int, segment: int) -> Iterator[tuple[str, bytes]]:
    """Lower-cased texts of one language with line ends between, of about a segment each."""
    for b in batches:
        held: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held.setdefault(lang, []).append(text.as_py().encode())
        for lang, texts in held.items():
            together, n = [], 0
            for t in texts:
                if n + len(t) > segment and together:
                    yield lang, b"\n".join(together).lower()
                    together, n = [], 0
                if len(t) > segment:
                    yield from ((lang, s.lower()) for s in segments(t, size, segment))
                else:
                    together.append(t)
                    n += len(t)
            if together:
                yield lang, b"\n".join(together).lower()


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count_words(rows: DataFrame, segment: int) -> DataFrame:
    """``lang, word, n``; the row of a language with a null word has the number of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _by_language(batches, 1, segment):
            words, _ = words_of(text)
            if not len(words):
                continue
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            found = pa.concat_arrays([coded.dictionary.cast(pa.large_string()).cast(pa.string()), pa.nulls(1, pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), found, pa.array([*n, len(words)], pa.int64())], ["lang", "word", "n"])

    return map_arrow(rows, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _count_pairs(rows: DataFrame, filters: list[Names], segment: int) -> DataFrame:
    """``left, right, n`` of the phrases one word longer than the last of ``filters`` knows."""
    size = len(filters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _by_language(batches, size, segment):
            words, piece = words_of(text)
            if len(words) < size:
                continue
            coded = words.dictionary_encode()
            names = _names(coded.dictionary.to_pylist(), lang)
            code = coded.indices.to_numpy(zero_copy_only=False)
            known = filters[0].of(names)[code]
            names = names[code]
            at = np.flatnonzero(known[:-1] & known[1:] & (piece[:-1] == piece[1:]))  # where pairs begin
            left, right = names[at], names[at + 1]
            for f in filters[1:]:
                name = pair_name(left, right)
                ok = f.of(name)
                at, name = at[ok], name[ok]
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                at, left, right = at[both], name[both], name[both + 1]
            if not len(at):
                continue
            order = np.argsort(pair_name(left, right))
            left, right = left[order], right[order]
            first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
            n = np.diff(first, append=len(left))
            yield pa.RecordBatch.from_arrays([pa.array(left[first].view(np.int64)), pa.array(right[first].view(np.int64)), pa.array(n, pa.int64())], ["left", "right", "n"])

    return map_arrow(rows, run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def _named(df: DataFrame, key: list[str], name_of: Callable) -> DataFrame:
    """``df`` with ``name``, computed in the tasks as everywhere else."""
    schema = df.schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns)]
            named = name_of(*[columns[names.index(k)] for k in key])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(named.view(np.int64))], [*names, "name"])

    return map_arrow(df, run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema.fields)}, name long")


def _word_names(lang: pa.Array, word: pa.Array) -> np.ndarray:
    out = (xxhash.xxh64_intdigest(w.encode(), xxhash.xxh64_intdigest(x.encode())) for x, w in zip(lang.to_pylist(), word.to_pylist(), strict=True))
    return np.fromiter(out, np.uint64, len(lang))


def _pair_names(left: pa.Array, right: pa.Array) -> np.ndarray:
    return pair_name(left.to_numpy().view(np.uint64), right.to_numpy().view(np.uint64))


def _distinct(level: DataFrame, n: int) -> None:
    if level.select("name").distinct().count() != n:
        raise ValueError("Two phrases share a name; their counts can't be told apart.")


def levels(docs: DataFrame, most: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text", segment: int = SEGMENT) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` of all languages, and the phrases of 1 to ``most`` words that occur ``least`` times, a table a level.

    A level has ``name, lang, left, right, a, words, firsts, lasts``: the phrase's name and its parents', its count, its words, and the
    counts of its first and last 1, 2, ... words.
    """
    rows = _rows(docs, lang_col, text_col)
    kept = _count_words(rows, segment).where(F.col("word").isNull() | (F.col("n") >= least))
    kept, _ = stored(kept, "words")
    totals = kept.where("word is null").select("lang", "n")
    words = _named(kept.where("word is not null"), ["lang", "word"], _word_names)
    none = F.lit(None).cast("long")
    level = words.select("name", "lang", none.alias("left"), none.alias("right"), F.col("n").alias("a"), F.array("word").alias("words"), F.array("n").alias("firsts"), F.array("n").alias("lasts"))
    level, _ = stored(level, "phrases")
    out, filters = [level], []
    for _ in range(2, most + 1):
        n = level.count()
        _distinct(level, n)
        filters.append(Names(level, n))
        counted = _count_pairs(rows, filters, segment).where(F.col("n") >= least)
        below = lambda side: level.select(*[F.col(c).alias(f"{side}_{c}") for c in ("name", "lang", "words", "firsts", "lasts")])
        joined = counted.join(below("l"), F.col("left") == F.col("l_name")).join(below("r"), F.col("right") == F.col("r_name"))
        phrase = joined.select(
            "left", "right", F.col("l_lang").alias("lang"), F.col("n").alias("a"), F.concat("l_words", F.slice("r_words", -1, 1)).alias("words"),
            F.concat("l_firsts", F.array("n")).alias("firsts"), F.concat("r_lasts", F.array("n")).alias("lasts"),
        )
        level, _ = stored(_named(phrase, ["left", "right"], _pair_names).select("name", "lang", "left", "right", "a", "words", "firsts", "lasts"), "phrases")
        out.append(level)
    return totals, out


def _scored(level: DataFrame, size: int) -> DataFrame:
    """With the cut of the lowest score: ``score, l, r``."""
    def cut(k: int) -> Column:
        left, right = f"firsts[{k - 1}]", f"lasts[{size - k - 1}]"
        score = F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast({left} as decimal(19,0)) + cast({right} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r"))

    cuts = [cut(k) for k in range(1, size)]
    return level.withColumn("cut", cuts[0] if len(cuts) == 1 else F.least(*cuts))


def _within_longer(longer: DataFrame) -> DataFrame:
    """``name, most``: of the phrases one word longer, the largest count by the phrase that each begins or ends with."""
    both = longer.select(F.col("left").alias("name"), "a").unionByName(longer.select(F.col("right").alias("name"), "a"))
    return both.groupBy("name").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, first: int = 2000, most: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The ``first`` phrases of 2 to ``most`` words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase occurs ``least`` times at least.  Of its cuts into a first part and a rest with counts l and r the one of the lowest
    ``floor(2000000 a / (l + r))`` counts, of equal ones that with the shorter first part.  Phrases of which four fifths lie within one longer
    phrase are left out.
    """
    totals, found = levels(docs, most, least, lang_col, text_col, segment)
    parts = []
    for size, level in enumerate(found[1:], 2):
        if size < most:
            level = level.join(_within_longer(found[size]), "name", "left").where("most is null or 100 * most < 80 * a")
        parts.append(_scored(level, size).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    candidates, _ = stored(candidates, "candidates")
    spread = 1 + candidates.count() // RANKED_AT_ONCE
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within shares of a language, so that no task sorts more than a share and the best of all shares
    share = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(spread))).orderBy(*order)
    best = candidates.withColumn("of_share", F.row_number().over(share)).where(F.col("of_share") <= first) if spread > 1 else candidates
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
