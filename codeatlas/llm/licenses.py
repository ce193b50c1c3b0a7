"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of ``2 s`` words that starts at a multiple of ``s``; templates of up to ``s`` words are looked for in blocks of their own scale ``s``, so a
passage as long as the template lies whole in one of them.  A template is found in a block that has at least the share
``CONTAINED`` of its distinct words.

Words of templates are ordered by their frequency in the whole corpus, rarest first, and blocks are kept as
ordered sets of these.  Length filter: a block with fewer of them than any template of its scale needs is dropped where
it is read.  Prefix filter: a template of m words that needs o of them shares one of its m - o + 1 rarest with every block in
which it is found, and that one is among as many of the block's; these tokens are the join's key.  Positional filter:
after the first shared token, at places i and j, at most ``1 + min(m - i - 1, n - j - 1)`` can be shared, which must be o or more.  The pairs left
are verified on the whole sets.  Words that tell like licenses apart must be, or must not be, in the block.

Beside the join, ``PHRASES`` are found where their words stand consecutively.

Defined cases: a null or empty text has no words and no labels.  Only A-Z are lower-cased.  Words are runs of ASCII letters and digits and of anything
above ASCII.  Rows that repeat id and text get the same result each.  Long texts are scanned whole.  Tokens of equal frequency are
ordered by alphabet.  Empty tables give an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identity, map_arrow, sha_of, stored


@dataclass(frozen=True)
class Template:
    """``must`` and ``unless``: words without which, or with which, a block doesn't count."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


#: Share of a template's distinct words that a block must have.
CONTAINED = 0.8
#: The least scale, in words.
LEAST_SCALE = 16
#: Rows of templates' prefixes that may be broadcast.
BROADCAST_ROWS = 100_000
#: Phrases that label a text wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices by which texts are put under well-known licenses.
TEMPLATES = (
    Template("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3.", ("affero", "3")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache", "2")),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    Template("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License.", ("creative", "attribution"), ("noncommercial", "sharealike", "noderivatives")),
    Template("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "noncommercial"), ("sharealike", "noderivatives")),
    Template("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "sharealike"), ("noncommercial",)),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "2"), ("affero", "lesser")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3"), ("affero", "lesser")),
    Template(
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu", "2"), ("affero", "lesser", "3"),
    ),
    Template(
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu", "3"), ("affero", "lesser", "2"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
        ("fee",),
    ),
    Template("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3.", ("lesser", "3")),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        ("mozilla",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("unencumbered",),
    ),
)

#: Whether a byte, after lower-casing, is part of a word.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def split(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a text and where each begins."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = _INSIDE[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]), starts


def words_of(text: str) -> list[str]:
    return [w.decode() for w in split(text.encode())[0].to_pylist()]


def scale(template: Template) -> int:
    """The least power of two, ``LEAST_SCALE`` at least, that has as many words as the template."""
    n = LEAST_SCALE
    while n < len(words_of(template.text)):
        n *= 2
    return n


def needed(template: Template, contained: float = CONTAINED) -> int:
    """How many of its distinct words a block must have."""
    m = len(set(words_of(template.text)))
    return next(o for o in range(m + 1) if o >= contained * m - 1e-9)


def _tokens(templates: Sequence[Template], phrases: Sequence[str]) -> list[str]:
    """Every word that the join or a phrase asks for, sorted."""
    return sorted({w for t in templates for w in [*words_of(t.text), *t.must, *t.unless]} | {w for p in phrases for w in p.split()})


def _coded(texts: pa.Array, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of some texts its code (-1: not known), the number of its text, and its place there."""
    raw = [t.as_py().encode() for t in texts]
    words, starts = split(b"\n".join(raw))
    begins = np.zeros(len(raw), np.int64)
    np.cumsum([len(t) + 1 for t in raw[:-1]], out=begins[1:])
    doc = np.searchsorted(begins, starts, "right") - 1
    coded = words.dictionary_encode()
    codes = np.fromiter((known.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    first = np.searchsorted(doc, np.arange(len(raw)))
    return codes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64), doc, np.arange(len(doc)) - first[doc]


def frequencies(texts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of ``tokens`` occurs in all of ``texts`` (a column ``text``): one number a token comes to the driver."""
    known = {w.encode(): i for i, w in enumerate(tokens)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(tokens), np.int64)
        for b in batches:
            codes, _, _ = _coded(b.column(0), known)
            n += np.bincount(codes[codes >= 0], minlength=len(tokens))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["token", "n"])

    counted = map_arrow(texts, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = {r["token"]: r["n"] for r in counted.collect()}
    return {w: found.get(i, 0) for i, w in enumerate(tokens)}


def blocks(rows: DataFrame, order: list[str], scales: dict[int, tuple[int, list[str]]], phrases: dict[str, str]) -> DataFrame:
    """``id, row, n_words, n_base, first_word, last_word, base, blocks`` of ``id, row, text``.

    ``order`` has the tokens from the rarest on; ``scales`` says by scale the fewest tokens that any template needs, and the words of its templates.
    ``blocks`` has ``scale, start, tokens`` of the blocks that have as many, ``base`` the places in phrases as labels.
    """
    known = {w.encode(): i for i, w in enumerate(order)}
    place = {w: i for i, w in enumerate(order)}
    wanted = {s: (need, np.isin(np.arange(len(order)), [place[w] for w in words])) for s, (need, words) in scales.items()}
    sought = [([place[w] for w in p.split()], label) for p, label in phrases.items()]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            codes, doc, at = _coded(b.column(2), known)
            hits: list[np.ndarray] = []
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in sought:
                k = np.flatnonzero(codes == phrase[0])
                for i, code in enumerate(phrase[1:], 1):
                    k = k[k + i < len(codes)]
                    k = k[(codes[k + i] == code) & (doc[k + i] == doc[k])]
                hits.append(k)
                for d in np.unique(doc[k]):
                    base[d].add(label)
            hit = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            n_base = np.bincount(doc[hit], minlength=n)
            low, high = np.searchsorted(doc[hit], np.arange(n)), np.searchsorted(doc[hit], np.arange(n), "right") - 1
            none = n_base == 0
            ends = [pa.array(at[hit][np.where(none, 0, x)] if len(hit) else np.zeros(n, np.int64), pa.int64(), mask=none) for x in (low, high)]
            held: list[list[dict]] = [[] for _ in range(n)]
            for s, (need, words) in wanted.items():
                k = np.flatnonzero((codes >= 0) & words[codes])
                block = at[k] // s
                again = block > 0
                # a word is in the block that starts at or before it, and in the one before
                pairs = np.stack([np.concatenate([doc[k], doc[k][again]]), np.concatenate([block, block[again] - 1]), np.concatenate([codes[k], codes[k][again]])])
                # blocks with too few occurrences can't have enough tokens
                order_of = np.lexsort((pairs[2], pairs[1], pairs[0]))
                pairs = pairs[:, order_of]
                fresh = np.ones(pairs.shape[1], bool)
                fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
                pairs = pairs[:, fresh]
                start = np.ones(pairs.shape[1], bool)
                start[1:] = (pairs[:2, 1:] != pairs[:2, :-1]).any(0)
                begin = np.flatnonzero(start)
                size = np.diff(begin, append=pairs.shape[1])
                for i, z in zip(begin[size >= need].tolist(), size[size >= need].tolist(), strict=True):
                    held[pairs[0, i]].append({"scale": s, "start": int(pairs[1, i]) * s, "tokens": pairs[2, i : i + z].tolist()})
            out = [
                b.column(0), b.column(1), pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(n_base, pa.int64()), *ends,
                pa.array([sorted(x) for x in base], pa.list_(pa.string())), pa.array(held, pa.list_(pa.struct([("scale", pa.int32()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))]))),
            ]
            yield pa.RecordBatch.from_arrays(out, ["id", "row", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    found = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<scale:int,start:bigint,tokens:array<int>>>"
    return map_arrow(rows.select("id", "row", "text"), run, f"id {kind}, row string, {found}")


def prefixes(spark: SparkSession, templates: Sequence[Template], order: list[str], contained: float = CONTAINED) -> DataFrame:
    """``scale, token, i, template, label, need, all, must, unless``: the rarest tokens of each template, as many as the prefix filter asks for."""
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for number, t in enumerate(templates):
        tokens = sorted(place[w] for w in set(words_of(t.text)))
        need = needed(t, contained)
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((scale(t), token, i, number, t.label, need, tokens, [place[w] for w in t.must], [place[w] for w in t.unless]))
    out = spark.createDataFrame(rows, "scale int, token int, i int, template int, label string, need int, all array<int>, must array<int>, unless array<int>")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def matches(found: DataFrame, index: DataFrame, least: dict[int, int]) -> DataFrame:
    """``row, scale, start, template, label, contained``: every block in which a template is found, once a template."""
    one = found.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.scale", "b.start", "b.tokens")
    fewest = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[F.col("scale")]
    # the rarest tokens of a block, as many as the template that needs fewest asks for
    keyed = one.select("*", F.posexplode(F.slice("tokens", 1, F.size("tokens") - fewest + 1)).alias("j", "token"))
    met = keyed.join(index, ["scale", "token"])
    bound = 1 + F.least(F.size("all") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1)
    met = met.where(bound >= F.col("need")).withColumn("shared", F.array_intersect("tokens", "all"))
    first = F.col("shared")[0] == F.col("token")
    apart = (F.size(F.array_except("must", "tokens")) == 0) & ~F.arrays_overlap("unless", "tokens")
    whole = met.where(first & (F.size("shared") >= F.col("need")) & apart)
    return whole.select("row", "scale", "start", "template", "label", (F.size("shared") / F.size("all")).alias("contained"))


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: dict[str, str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base, labels, score`` of every row.

    ``base`` and ``labels`` are sorted lists, the second with the labels of templates as well; ``score`` is 1 where a phrase stands, else
    the largest share that a block has of a template found in it, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), identity(id_col, sha_of(F.col(text_col))).alias("row"), text.alias("text"))
    seen = frequencies(docs.select(text.alias("text")), _tokens(templates, list(phrases)))
    order = sorted(seen, key=lambda w: (seen[w], w))
    scales: dict[int, tuple[int, list[str]]] = {}
    for t in templates:
        need, words = scales.get(scale(t), (1 << 30, []))
        scales[scale(t)] = (min(need, needed(t, contained)), [*words, *words_of(t.text), *t.must, *t.unless])
    found, _ = stored(blocks(rows, order, scales, phrases), "licenses")
    index = prefixes(docs.sparkSession, templates, order, contained)
    by_row = matches(found, index, {s: need for s, (need, _) in scales.items()}).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("contained").alias("most"))
    none = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return found.join(by_row, "row", "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", "base", F.array_sort(F.array_union("base", F.coalesce("more", none))).alias("labels"), score.alias("score")
    )
