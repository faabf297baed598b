"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 13 consecutive words of the benchmark items; an item of fewer words is one
pattern. For each pattern length there is a table of shifts, indexed by the hash of a block of two words: how
far the end of a window may move on before it can end a pattern. Where the shift is zero, the block is the
last of some pattern; the patterns with that suffix are compared with the text, by word hashes and then by
their bytes. All texts of a slice move on side by side, as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import add_columns, binary, reliable, unused
from shelfwise.llm.words import ALPHANUMERIC, Words, join_hashes, read_words

#: Bytes of benchmark text that are broadcast at once (some 30 MB as patterns); a larger benchmark is searched in several passes.
BLOCK_BYTES = 4 << 20
_LANE = 256


class PatternSet:
    """Patterns of one length: places in the words of the items, with a shift table and suffix buckets."""

    def __init__(self, source: Words, length: int, first: np.ndarray, items: list[tuple[int, int]], names: list[str]):
        """Pattern p is ``length`` words of ``source`` from ``first[p]``; ``items`` are (pattern, number of a name)."""
        self.source, self.length, self.first, self.names = source, length, first, names
        items = np.array(sorted(items)).reshape(-1, 2)
        self.item, self.item_first = items[:, 1], np.searchsorted(items[:, 0], np.arange(len(first) + 1))
        self.block = min(2, length)
        places = length - self.block + 1
        blocks = [self._block(first + j + self.block - 1, source.hash) for j in range(places)]
        self.mask = np.uint64((1 << max(12, (4 * len(first) * places).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, places, np.uint8 if places < 256 else np.int64)
        for j, block in enumerate(blocks):
            np.minimum.at(self.shift, (block & self.mask).astype(np.int64), places - 1 - j)
        self.bucket = np.argsort(blocks[-1], kind="stable")
        self.suffixes, self.bucket_first = np.unique(blocks[-1][self.bucket], return_index=True)
        self.bucket_stop = np.append(self.bucket_first[1:], len(first))

    def _block(self, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at a word."""
        return join_hashes(hashes[at - 1], hashes[at]) if self.block == 2 else hashes[at]

    def items_of(self, pattern: int) -> list[str]:
        return [self.names[i] for i in self.item[self.item_first[pattern] : self.item_first[pattern + 1]].tolist()]

    def occurrences(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence within a text."""
        m, h = self.length, words.hash
        ends = words.first[:-1] + m - 1, words.first[1:]
        lanes = np.maximum(0, -(-(ends[1] - ends[0]) // _LANE))
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(ends[0], lanes) + number * _LANE
        stop = np.minimum(at + _LANE, np.repeat(ends[1], lanes))
        found = []
        while len(at):
            key = self._block(at, h)
            shift = self.shift[(key & self.mask).astype(np.int64)].astype(np.int64)
            zero = shift == 0
            if zero.any():
                found.append((at[zero], key[zero]))
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return
        at, key = (np.concatenate(x) for x in zip(*found))
        row = np.minimum(np.searchsorted(self.suffixes, key), len(self.suffixes) - 1)
        same = self.suffixes[row] == key
        at, row = at[same], row[same]
        many = self.bucket_stop[row] - self.bucket_first[row]
        first = np.repeat(at - m + 1, many)
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pattern = self.bucket[np.repeat(self.bucket_first[row], many) + inside]
        for j in range(m):
            same = h[first + j] == self.source.hash[self.first[pattern] + j]
            first, pattern = first[same], pattern[same]
        for s, p in zip(first.tolist(), pattern.tolist()):
            if words.phrase(s, s + m) == self.source.phrase(self.first[p], self.first[p] + m):
                yield s, p


def compile_patterns(items: list[tuple[str, str | None]], window: int) -> list[PatternSet]:
    """The patterns of (id, text) items, one set for each length that occurs; equal windows are one pattern."""
    words = read_words(binary(pa.array([t for _, t in items], pa.string())), ALPHANUMERIC, lower=True)
    known: dict[int, dict[bytes, int]] = {}
    places: dict[int, list[int]] = {}
    pairs: dict[int, set[tuple[int, int]]] = {}
    for i in range(len(items)):
        first, stop = int(words.first[i]), int(words.first[i + 1])
        length = min(window, stop - first)
        if not length:
            continue
        for s in range(first, stop - length + 1):
            pattern = known.setdefault(length, {}).setdefault(words.phrase(s, s + length), len(known[length]))
            own = places.setdefault(length, [])
            if pattern == len(own):
                own.append(s)
            pairs.setdefault(length, set()).add((pattern, i))
    names = [name for name, _ in items]
    return [PatternSet(words, length, np.array(own), list(pairs[length]), names) for length, own in places.items()]


def search(texts: pa.Array, patterns: list[PatternSet]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: its number of words, the merged runs of hit words, and the items that occur."""
    words = read_words(texts, ALPHANUMERIC, lower=True)
    n = len(texts)
    items: list[set[str]] = [set() for _ in range(n)]
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    change = np.zeros(len(words.hash) + 1, np.int64)
    for group in patterns:
        for first, p in group.occurrences(words):
            change[first] += 1
            change[first + group.length] -= 1
            items[int(np.searchsorted(words.first, first, side="right")) - 1].update(group.items_of(p))
    covered = np.cumsum(change) > 0
    for i in (i for i in range(n) if items[i]):
        hit = np.concatenate([[False], covered[words.first[i] : words.first[i + 1]], [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        runs[i] = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return words.counts(), runs, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for name, words in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text)).toLocalIterator():
        block.append((name, words))
        size += len(words or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merged(runs: list) -> list:
    """Runs as few as possible that cover the same words."""
    out: list[list[int]] = []
    for first, stop in sorted(tuple(x) for x in runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return out


def find_benchmark_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` columns of every document, its number of words, runs of hit words and occurring items.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Returns the frame and the
    names of the new columns by role (``n_words``, ``runs``, ``items``), which avoid the names in ``keep``.

    Null or empty texts have no words and no hits; items without words match nothing; a null item id counts as
    the id "null"; repeated items are one item, repeated documents stay separate rows; an empty benchmark hits
    nothing. Patterns of at most ``block_bytes`` of benchmark text are broadcast at once. A larger benchmark is
    searched block by block against all rows; what each pass finds, by the hash of the text, is written to the
    checkpoint folder, merged, and joined back to the rows.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    names = {role: unused(kept, role) for role in ("n_words", "runs", "items")}
    run = T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())])
    kinds = (T.LongType(), T.ArrayType(run), T.ArrayType(T.StringType()))
    fields = [T.StructField(n, k) for n, k in zip(names.values(), kinds)]
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
    context = docs.sparkSession.sparkContext

    def finder(block):
        shared = context.broadcast(compile_patterns(block, window))

        def make(texts: pa.Array) -> list[pa.Array]:
            counts, runs, items = search(texts, shared.value)
            spans = [[{"first": a, "stop": b} for a, b in r] for r in runs]
            return [pa.array(counts, pa.int64()), pa.array(spans, arrow), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

        return make

    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks, [])
    following = next(blocks, None)
    if following is None:
        return add_columns(docs, text, keep, fields, finder(block)), names

    # beyond one broadcast: a pass per block over all texts, of which only those with a hit are kept
    blocks = chain([block, following], blocks)
    source = docs.select(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("content"), F.col(f"`{text}`").alias("text"))
    hits = None
    for block in blocks:
        part = add_columns(source, "text", ["content"], [T.StructField(r, k) for r, k in zip(names, kinds)], finder(block))
        part = reliable(part.filter(F.size("items") > 0).dropDuplicates(["content"]))
        hits = part if hits is None else hits.union(part)
    merge = F.udf(lambda runs: _merged(runs), T.ArrayType(run))
    hits = hits.groupBy("content").agg(
        merge(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    own = unused(kept, "content")
    content = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias(own)
    counted = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(f"{own}_text"), content)
    counted = add_columns(counted, f"{own}_text", [*keep, own], [fields[0]], lambda texts: [pa.array(count_words(texts), pa.int64())])
    found = counted.join(reliable(hits).withColumnsRenamed({"content": own, "runs": f"{own}_runs", "items": f"{own}_items"}), own, "left")
    empty = lambda kind: F.lit([]).cast(kind)
    return found.select(
        *(F.col(f"`{c}`") for c in keep), names["n_words"],
        F.coalesce(f"{own}_runs", empty(T.ArrayType(run))).alias(names["runs"]),
        F.coalesce(f"{own}_items", empty(T.ArrayType(T.StringType()))).alias(names["items"]),
    ), names


def count_words(texts: pa.Array) -> np.ndarray:
    return read_words(texts, ALPHANUMERIC, lower=True).counts()


def hit_words(runs: Column | str) -> Column:
    """The number of words in merged runs."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["first"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    found, names = find_benchmark_passages(docs, benchmark, docs.columns, text, **options)
    bad = contaminated(hit_words(f"`{names['runs']}`"), F.col(names["n_words"]))
    return found.filter(~bad).select(*(F.col(f"`{c}`") for c in docs.columns))
