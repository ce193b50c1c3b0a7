"""A stored index for ranked search over one edition: it reads what a query can match and stops when the result is full.

``rows``    the edition, clustered by its order key; a row's number has its file in the upper bits and its place there in the lower ones, so rows are in
            order by number, and ``2**shift`` numbers are a block
``codes``   lower-cased codes with row numbers, ``labels`` normalised labels, both clustered by key: a prefix is a range, which
            Parquet statistics prune
``grams``   for each field and three adjacent characters a bit for each block that has them, 64 blocks a row, clustered by the characters
``longer``  the same for six adjacent characters, by a hash of as many values as a block has characters, twice over: few blocks have all of a phrase's,
            even where all have its trigrams
``blocks``  for each block its file, its rows, its first order key and how many rows lie before it

A text that contains the query has all its trigrams and longer grams, so blocks that lack one are not read; the others are tested exactly.  Tiers are
looked for in turn, and a tier's blocks in order, more at a time: what would come after a full result is not looked for.  A query brings at most
``limit`` row numbers and one bit a block to the driver.

Queries of fewer than three characters have no trigram: all blocks are candidates, in order.  The result is that of ``search.search``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_arrow
from ..functions.text import is_blank, norm_query, norm_text
from ..plans.schema import COLUMNS, ORD, STORED
from ..sources.files import Files
from .search import tier

#: Bits of a row number that count rows in a file.
PLACE_BITS = 33
#: Bytes of texts in a file and in a block.
FILE_BYTES, BLOCK_BYTES = 512 << 20, 4 << 20
#: Grams of a query that are looked up in either table; Parquet takes a longer list as a range.
GRAMS = 10
#: Characters of the longer grams.
LONGER = 6
#: Of the stored tables; one whose longer grams are hashed in another way must not be read.
FORMAT = 2
#: Blocks that are read first, and how many times as many come next; ranges of row numbers in a filter.
FIRST_BLOCKS, MORE_BLOCKS, RANGES = 16, 4, 64
FIELDS = ("label", "description")
_ROWS = T.StructType([*STORED.fields, T.StructField("row", T.LongType())])
_TABLES = {
    "codes": "level string, row long, code_norm string", "labels": "level string, row long, code_norm string, label_norm string", "grams": "field string, gram string, word long, mask long", "longer": "field string, gram long, word long, mask long",
    "blocks": "block long, file string, n long, before long, first_ord long, last_ord long",
}


def after(prefix: str) -> str | None:
    """The first string, by code points, after all that begin with ``prefix``; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i]) + 1
        if c <= 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD800 <= c <= 0xDFFF else c)
    return None


def in_prefix(c: Column, prefix: str) -> Column:
    """Whether a string begins with ``prefix``, as a range that a scan can prune."""
    end = after(prefix)
    return c >= F.lit(prefix) if end is None else (c >= F.lit(prefix)) & (c < F.lit(end))


def grams(text: str, size: int) -> list[str]:
    """Some of the distinct grams of a query, evenly spread: each is a condition of its own."""
    found = list(dict.fromkeys(text[i : i + size] for i in range(len(text) - size + 1)))
    return found[:: max(1, -(-len(found) // GRAMS))]


#: Trigrams that a task holds before it merges them; rows that it hands on at once; odd multipliers of a longer gram's characters.
HELD, ROWS = 1 << 20, 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers."""
    c = _points(text)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def _hashes(text: str) -> np.ndarray:
    """A hash of every longer gram of a text."""
    c = _points(text)
    n = max(0, len(c) - LONGER + 1)
    h = c[:n] * _ODD[0]
    for i in range(1, LONGER):
        h += c[i : n + i] * _ODD[i]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    return h ^ h >> np.uint64(29)


def slots_of(text: str, slots: int) -> np.ndarray:
    """The slots of the longer grams of a text; ``slots`` is a power of two."""
    return np.unique(_hashes(text) & np.uint64(slots - 1)).astype(np.int64)


def _written(codes: np.ndarray) -> list[str]:
    """Three characters each, from their numbers."""
    c = np.stack([codes >> np.uint64(42), codes >> np.uint64(21), codes], 1) & np.uint64((1 << 21) - 1)
    text = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _bits(texts: DataFrame, slots: int | None = None) -> DataFrame:
    """``field, gram, word, mask`` of ``block, field, text``: a bit a block.  The grams are three characters, or with ``slots`` the longer ones' slots."""

    def out(field: str, word: int, code: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        gram = pa.array(_written(code), pa.string()) if slots is None else pa.array(code.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([field] * len(code), pa.string()), gram, pa.array(np.full(len(code), word)), pa.array(mask.view(np.int64))], ["field", "gram", "word", "mask"])

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same as one pair of arrays, a code once."""
        code, mask = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(code):
            return [(code, mask)]
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return [(code[first], np.bitwise_or.reduceat(mask[order], first))]

    class Few:
        """Any codes of the blocks of a word; what comes in is merged when it is as much as what is held already."""

        def __init__(self) -> None:
            self.held, self.size, self.most = [], 0, HELD

        def add(self, text: str, bit: np.uint64) -> None:
            codes = _codes(text)
            self.held.append((codes, np.full(len(codes), bit)))
            self.size += len(codes)
            if self.size >= self.most:
                self.held = merged(self.held)
                self.size = len(self.held[0][0])
                self.most = max(HELD, 2 * self.size)

        def take(self) -> tuple[np.ndarray, np.ndarray]:
            return merged(self.held)[0]

    class Slots:
        """A mask for every slot."""

        def __init__(self) -> None:
            self.mask = np.zeros(slots, np.uint64)

        def add(self, text: str, bit: np.uint64) -> None:
            self.mask[(_hashes(text) & np.uint64(slots - 1)).astype(np.int64)] |= bit

        def take(self) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(self.mask)
            return at, self.mask[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows lie in the order of their blocks, so a word is handed on once, or twice where a task begins or ends within it
        now: dict[str, tuple[int, Few | Slots]] = {}
        def parts(field: str) -> Iterator[pa.RecordBatch]:
            word, held = now.pop(field)
            code, mask = held.take()
            for i in range(0, len(code), ROWS):
                yield out(field, word, code[i : i + ROWS], mask[i : i + ROWS])

        for b in batches:
            for block, field, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                word = block >> 6
                if field in now and now[field][0] != word:
                    yield from parts(field)
                if field not in now:
                    now[field] = word, Few() if slots is None else Slots()
                now[field][1].add(text.as_buffer().to_pybytes().decode("utf-8", "replace"), np.uint64(1) << np.uint64(block & 63))
        for field in list(now):
            yield from parts(field)

    kind = "string" if slots is None else "long"
    found = texts.select("block", "field", F.col("text").cast("binary").alias("text"))
    found = map_arrow(found, run, f"field string, gram {kind}, word long, mask long")
    return found.groupBy("field", "gram", "word").agg(F.bit_or("mask").alias("mask"))


def build(df: DataFrame, path: str, file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES, pages_only: bool = False) -> SearchIndex:
    """Stores the index of one edition (canonical columns and the order key) below ``path``, which must be free.

    With ``pages_only`` it has rows and blocks, which is all that pages read.
    """
    spark = df.sparkSession
    edition = df.select(*COLUMNS, ORD)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("code", *FIELDS)), F.lit(64))
    n, total = edition.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    files = max(1, -(-total // file_bytes))
    shift = max(0, int(block_bytes * max(1, n) // max(1, total)).bit_length() - 1)
    laid = edition.repartitionByRange(files, ORD).sortWithinPartitions(ORD) if files > 1 else edition.coalesce(1).sortWithinPartitions(ORD)
    laid.withColumn("row", F.monotonically_increasing_id()).write.option("parquet.block.size", block_bytes).parquet(f"{path}/rows")
    rows = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    block = F.shiftright("row", shift)

    slots = 1 << max(11, block_bytes.bit_length())
    if not pages_only:
        _searchable(rows, block, files, slots, path)

    _blocks(rows.select("row", ORD, block.alias("block"), F.col("_metadata.file_name").alias("file"))).write.parquet(f"{path}/blocks")
    Files(spark, path).create(f"{path}/index.json", json.dumps({"format": FORMAT, "shift": shift, "rows": n, "slots": slots, "pages_only": pages_only}))
    return SearchIndex(spark, path)


def _searchable(rows: DataFrame, block: Column, files: int, slots: int, path: str) -> None:
    """The tables by which codes, labels and texts are looked up."""
    narrow = rows.select("level", "row", F.lower("code").alias("code_norm"))
    _clustered(narrow, "code_norm", files, f"{path}/codes", "row")
    _clustered(rows.select("level", "row", F.lower("code").alias("code_norm"), norm_text(F.col("label")).alias("label_norm")), "label_norm", files, f"{path}/labels", "row")

    texts = rows.select(block.alias("block"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), norm_text(F.col(f)).alias("text")) for f in FIELDS])).alias("x"))
    texts = texts.select("block", "x.field", "x.text").where("text is not null")
    _clustered(_bits(texts), "gram", files, f"{path}/grams", "field", "word")
    _clustered(_bits(texts, slots), "gram", files, f"{path}/longer", "field", "word")


def _clustered(df: DataFrame, key: str, parts: int, path: str, *then: str) -> None:
    """By key; one that many rows have lies in several files."""
    laid = df.repartitionByRange(parts, key, *then) if parts > 1 else df.coalesce(1)
    laid.sortWithinPartitions(key, *then).write.parquet(path)


def _blocks(rows: DataFrame) -> DataFrame:
    """``block, file, n, before, first_ord, last_ord`` from ``row, ord, block, file``; blocks are numbered within a file, files among each other."""
    found = rows.groupBy("block", "file").agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias("first_ord"), F.max(ORD).alias("last_ord"))
    files = found.groupBy("file").agg(F.sum("n").alias("of_file"), F.min("block").alias("first_block"))
    earlier = F.sum("of_file").over(W.partitionBy(F.lit(0)).orderBy("first_block").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(earlier, F.lit(0)).alias("before_file"))
    inside = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    counted = found.withColumn("inside", F.coalesce(inside, F.lit(0))).join(files, "file")
    return counted.select("block", "file", "n", (F.col("before_file") + F.col("inside")).alias("before"), "first_ord", "last_ord")


class SearchIndex:
    """Search, exact lookup and pages over an edition's stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        stated = json.loads(Files(spark, path).read(f"{path}/index.json"))
        if stated.get("format") != FORMAT:
            raise ValueError(f"The index at '{path}' is of another format. Build it again.")
        self.shift, self.n, self.slots, self.pages_only = stated["shift"], stated["rows"], stated["slots"], stated.get("pages_only", False)
        self._names: dict[int, str] | None = None
        self._tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if self.pages_only and name != "blocks":
            raise ValueError(f"The index at '{self.path}' has pages only. Build it whole to search.")
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")
        return self._tables[name]

    def files(self, blocks: Sequence[int] | None = None) -> list[str]:
        """The files of ``rows``, of all blocks or of some; the driver keeps one name a file."""
        if self._names is None:
            number = F.shiftright("block", PLACE_BITS - self.shift)
            self._names = {r["number"]: r["file"] for r in self._table("blocks").select(number.alias("number"), "file").distinct().collect()}
        wanted = self._names if blocks is None else {b >> (PLACE_BITS - self.shift) for b in blocks}
        return [self._names[x] for x in sorted(wanted)]

    def rows(self, blocks: Sequence[int] | None = None) -> DataFrame:
        """The edition's rows with their numbers; of ``blocks``, only their files and ranges of numbers are read."""
        if blocks is None:
            return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")
        if not blocks:
            return self.spark.createDataFrame([], _ROWS)
        found = self.spark.read.schema(_ROWS).parquet(*[f"{self.path}/rows/{f}" for f in self.files(blocks)])
        return found.where(self._within("row", blocks, self.shift)).where(self._listed(blocks))

    def _listed(self, blocks: Sequence[int]) -> Column:
        """Exactly these blocks: ranges that were merged hold others, too."""
        return F.shiftright("row", self.shift).isin(*blocks) if len(blocks) <= 1000 else F.lit(True)

    @staticmethod
    def _within(name: str, blocks: Sequence[int], shift: int = 0) -> Column:
        """Few ranges of numbers that hold all of ``blocks``: the widest gaps are left out."""
        ordered = sorted(blocks)
        gaps = sorted(range(1, len(ordered)), key=lambda i: ordered[i - 1] - ordered[i])
        cuts = sorted(i for i in gaps[: RANGES - 1] if ordered[i] - ordered[i - 1] > 1)
        out = F.lit(False)
        for a, b in zip([0, *cuts], [*cuts, len(ordered)], strict=True):
            out = out | F.col(name).between(ordered[a] << shift, ((ordered[b - 1] + 1) << shift) - 1)
        return out

    def candidates(self, field: str, query: str) -> list[int]:
        """The blocks, in order, in which ``field`` may contain the normalised ``query``."""
        short, long = grams(query, 3), grams(query, LONGER)
        if not short:
            return sorted(r["block"] for r in self._table("blocks").select("block").collect())
        of_field = F.col("field") == field
        held = self._table("grams").where(of_field & F.col("gram").isin(*short)).select("word", "mask", "gram")
        if long:
            slots = sorted({x for g in long for x in slots_of(g, self.slots).tolist()})
            longer = self._table("longer").where(of_field & F.col("gram").isin(*slots)).select("word", "mask", F.col("gram").cast("string"))
            held, n = held.unionByName(longer), len(short) + len(slots)
        else:
            n = len(short)
        words = held.groupBy("word").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("n")).where((F.col("n") == n) & (F.col("mask") != 0)).collect()
        return sorted((r["word"] << 6) + i for r in words for i in range(64) if r["mask"] >> i & 1)

    # search

    def hits(self, query: str, level: str | None, limit: int) -> list[tuple[int, int]]:
        """``tier, row`` of at most ``limit`` matches, best first."""
        q, out = norm_query(query), []
        of_level = F.lit(True) if level is None else F.col("level") == level

        def take(found: DataFrame) -> bool:
            """The best of what a tier or two have; whether that fills the result."""
            out.extend((r["tier"], r["row"]) for r in found.select("tier", "row").orderBy("tier", "row").limit(limit - len(out)).collect())
            return len(out) >= limit

        code, label = F.col("code_norm"), F.col("label_norm")
        if not limit or take(self._table("codes").where(in_prefix(code, q) & of_level).withColumn("tier", F.when(code == F.lit(q), 1).otherwise(2))):
            return out
        labelled = self._table("labels").where(in_prefix(label, q) & of_level & ~code.startswith(q))
        if take(labelled.withColumn("tier", F.when(label == F.lit(q), 3).otherwise(4))):
            return out
        for number, field in ((5, "label"), (6, "description")):
            blocks, at, many = self.candidates(field, q), 0, FIRST_BLOCKS
            while at < len(blocks):
                if take(self.rows(blocks[at : at + many]).where(of_level).withColumn("tier", tier(query)).where(F.col("tier") == number)):
                    return out
                at, many = at + many, many * MORE_BLOCKS
        return out

    def _fetched(self, numbers: list[int]) -> DataFrame:
        return self.rows(sorted({r >> self.shift for r in numbers}))

    def search(self, query: str | None, level: str | None = None, limit: int = 100, ranked: bool = False) -> DataFrame:
        """As ``search.search`` over the edition."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        if is_blank(query):
            rows = self.page(0, limit) if level is None else self.rows().where(F.col("level") == level).orderBy("row").limit(limit)
            found = rows.withColumns({"tier": F.lit(None).cast("int"), "pos": F.row_number().over(W.partitionBy(F.lit(0)).orderBy("row")).cast("long")})
        else:
            hits = self.hits(query, level, limit)
            placed = self.spark.createDataFrame([(t, r, i) for i, (t, r) in enumerate(hits, 1)], "tier int, row long, pos long")
            found = self._fetched([r for _, r in hits]).join(F.broadcast(placed), "row")
        found = found.orderBy("pos")
        return found.select(*COLUMNS, "tier", "pos") if ranked else found.select(*COLUMNS)

    def entry(self, code: str) -> DataFrame:
        """As ``search.entry``: all rows with exactly this code."""
        same = self._table("codes").where(F.col("code_norm") == F.lower(F.lit(code))).select("row")
        blocks = sorted(r["block"] for r in same.select(F.shiftright("row", self.shift).alias("block")).distinct().collect())
        return self.rows(blocks).where(F.col("code") == F.lit(code)).select(*COLUMNS)

    # pages

    def page(self, number: int, size: int = 15) -> DataFrame:
        """The rows of page ``number``, from 0, with their numbers: the blocks in which the page lies are read and no others."""
        first = number * size
        lies = self._table("blocks").where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first))
        blocks = sorted((r["block"], r["before"]) for r in lies.select("block", "before").collect())
        if not blocks:
            return self.rows([])
        return self.rows([b for b, _ in blocks]).orderBy("row").offset(first - blocks[0][1]).limit(size)

    def next_page(self, ord: int | None, size: int = 15) -> DataFrame:
        """The ``size`` rows after the order key ``ord`` (None: the first), for keys that are unique: the key stands for the page."""
        lies = self._table("blocks") if ord is None else self._table("blocks").where(F.col("last_ord") > ord)
        out, held = [], 0
        for r in lies.orderBy("block").limit(size + 1).select("block", "n").collect():
            out.append(r["block"])
            # the first block may have one row only behind the key
            held += r["n"] if out[1:] else 1
            if held >= size:
                break
        rows = self.rows(out)
        return (rows if ord is None else rows.where(F.col(ORD) > ord)).orderBy("row").limit(size)
