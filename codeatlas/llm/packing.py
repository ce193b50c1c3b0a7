"""Bounded-space best-fit packing of tokenised documents into sequences of fixed length.

Each task tokenises its own rows and packs them where they are: no shuffle.  A fixed number of bins
is open; a bitset over free space finds the tightest bin that still fits a piece, and when all bins
are open and none fits, the fullest closes.  Pieces are taken in blocks of ``block`` rows, longest
first within a block, which leaves small pieces for the gaps; memory is bounded by the open bins and
one block.

A document longer than a sequence is cut into full pieces, its first piece being the shorter one.
Shorter documents are never cut.

Defined cases: a null text is empty; an empty text is one piece with the end token alone.  Long texts are
tokenised and cut whole.  Pieces of equal length keep their order; of bins with equal free space the one that got it
last is taken.  Rows that repeat an id are packed each on their own.  An empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Texts with other characters, or with a special token's string, go through the tokenizer file itself.
PLAIN = regex.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa0-\\u024f]|<\\|")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(json_path)


def encode(text: str, json_path: str | None = None, ranks_path: str | None = None) -> list[int]:
    """Ids as the tokenizer file gives them; plain texts take the same vocabulary's faster encoder."""
    fast, exact = _encoders(json_path or vocabulary("byte_bpe_50k.json"), ranks_path or vocabulary("byte_bpe_50k.tiktoken"))
    if PLAIN.search(text):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


class Bins:
    """Open bins by free space; ``put`` gives a bin's number and the place in it."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.used = size, most, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, space = self.used, self.size
            self.used += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.size - space


def pieces(n: int, size: int) -> Iterator[tuple[int, int, int]]:
    """``piece, start, length`` for a document of ``n`` ids."""
    first = n - (max(1, -(-n // size)) - 1) * size
    yield 0, 0, first
    for k, start in enumerate(range(first, n, size), 1):
        yield k, start, size


def pack_stream(rows: Iterable[tuple], size: int, most: int, block: int) -> Iterator[list[tuple]]:
    """From ``(doc_id, ids)`` to blocks of ``(doc_id, piece, start, ids, bin, offset)``."""
    bins, held = Bins(size, most), []

    def flush() -> list[tuple]:
        held.sort(key=lambda x: -len(x[3]))
        return [(*x, *bins.put(len(x[3]))) for x in held]

    for doc, ids in rows:
        for k, start, n in pieces(len(ids), size):
            held.append((doc, k, start, ids[start : start + n]))
        if len(held) >= block:
            yield flush()
            held.clear()
    if held:
        yield flush()


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2,
    open_bins: int = 4096, block: int = 4096, json_path: str | None = None, ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: id, ``piece, start, length, ids, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers.  Sequence numbers
    are unique over all tasks, not consecutive.
    """
    import numpy as np

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36

        def rows():
            for b in batches:
                for doc, text in zip(b.column(0), b.column(1), strict=True):
                    ids = encode(text.as_py() or "", json_path, ranks_path)
                    ids.append(end_id)
                    yield doc, np.array(ids, "<u4")

        for out in pack_stream(rows(), size, open_bins, block):
            doc, piece, start, ids, number, offset = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d.as_py() for d in doc], doc[0].type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                    pa.array([task + n for n in number], pa.int64()), pa.array(offset, pa.int64()),
                ],
                [id_col, "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, schema)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` (bytes in order of offset), ``documents`` (ids in order).

    A group is one sequence, so its size is bounded by the sequence length.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", id_col)))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x[id_col]).alias("documents"),
    )
