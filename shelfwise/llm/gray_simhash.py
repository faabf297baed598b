"""SimHash near-duplicates through a hierarchical index in Gray order.

Of 64 bits in five blocks, a pair that differs in at most three bits agrees on two whole blocks. So ten masks of
two blocks are the upper nodes: fingerprints that share the masked bits of a node form a group, all others are
pruned. A group is sorted by Gray rank, which puts similar codes side by side; runs of them are lower nodes that
hold the bits all members share. A search adds up the differences on the bits each node adds, and leaves out a
node with all that is below it once they exceed the limit. A group too large for that gets further masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import add_columns, reliable, unused
from shelfwise.llm.components import components

U64 = np.uint64
#: Largest group that is indexed in one piece.
MOST_IN_GROUP = 4096
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order under nodes that hold shared bits: ``levels`` from the top down."""

    def __init__(self, codes: np.ndarray, leaf: int = 16, fan_out: int = 8):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        lows, highs, sizes = self.codes, self.codes, []
        shared = []
        step = leaf
        while len(lows) > 1:
            at = np.arange(0, len(lows), step)
            sizes.append(step)
            lows, highs = np.bitwise_and.reduceat(lows, at), np.bitwise_or.reduceat(highs, at)
            shared.append((lows, ~(lows ^ highs)))
            step = fan_out
        self.levels = []
        above = np.zeros(1, U64)
        for (pattern, mask), size in zip(reversed(shared), reversed([*sizes[1:], 0])):
            # bits that a node shares and the node above does not
            own = mask & ~(np.repeat(above, size)[: len(mask)] if size else above)
            self.levels.append((pattern, own))
            above = mask
        self.fan = list(reversed(sizes))
        self.leaf_mask = above

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of codes with at most ``limit`` differing bits, in parts."""
        n = len(self.codes)
        for first in range(0, n, 256):
            query = np.arange(first, min(n, first + 256))
            node = np.zeros(len(query), np.int64)
            spent = np.zeros(len(query), np.int64)
            for depth, (pattern, own) in enumerate(self.levels):
                if depth:
                    query, node, spent = self._below(query, node, spent, self.fan[depth - 1], len(pattern))
                spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & own[node])
                query, node, spent = (x[spent <= limit] for x in (query, node, spent))
            if self.levels:
                query, place, spent = self._below(query, node, spent, self.fan[-1], n)
                rest = ~self.leaf_mask[place // self.fan[-1]]
                spent = spent + np.bitwise_count((self.codes[query] ^ self.codes[place]) & rest)
                near = (spent <= limit) & (query < place)
                yield query[near], place[near]

    @staticmethod
    def _below(query, node, spent, fan, n):
        child = (node[:, None] * fan + np.arange(fan)).ravel()
        there = child < n
        return np.repeat(query, fan)[there], child[there], np.repeat(spent, fan)[there]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first member of each of n places' component."""
    label = np.arange(n)
    for left, right in pairs:
        while len(left):
            a, b = label[left], label[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, label[label]):
                label = label[label]
    return label


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(free: int, blocks: int, together: int) -> list[int]:
    """The bits of ``free`` in so many blocks of about equal size; masks of each so many blocks together."""
    places = [i for i in range(64) if free >> i & 1]
    parts = [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(places), blocks) if len(part)]
    return [sum(chosen) for chosen in combinations(parts, together)]


def _group_links(limit: int, most: int):
    """Rows sorted by mask, key and code -> links (mask 0, key the linked code) and rows of groups that are too large."""

    def deeper(mask: int, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        free = ~mask & (1 << 64) - 1
        if free.bit_count() <= limit:  # all are as near as that: one star around the smallest
            yield 0, np.full(len(codes), codes[0]), codes
            return
        for more in block_masks(free, limit + 1, 1):
            yield mask | more, codes & U64(mask | more), codes

    def links(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(codes)
        root = _roots(len(codes), index.pairs(limit))
        linked = root != np.arange(len(codes))
        return index.codes[root[linked]], index.codes[linked]

    def out(mask: int, key: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(codes), _signed(mask)), pa.int64()), pa.array(key.view(np.int64)), pa.array(codes.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["mask", "key", "code"])

    def finish(mask: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(parts)
        if len(codes) > 1:
            a, b = links(codes)
            if len(a):
                yield out(0, a, b)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, size, large = None, [], 0, False
        for batch in batches:
            mask, key, code = (np.asarray(batch.column(i)).view(U64) for i in range(3))
            if not len(code):
                continue
            first = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            stop = np.append(first[1:], len(code))
            # groups of one code in the middle of a batch link nothing
            for a, b in zip(first.tolist(), stop.tolist()):
                if b - a == 1 and 0 < a and b < len(code):
                    continue
                mine = (int(mask[a]), int(key[a]))
                if mine != group:
                    if group and not large:
                        yield from finish(group[0], parts)
                    group, parts, size, large = mine, [], 0, False
                parts.append(code[a:b])
                size += b - a
                if large or size > most:
                    for m, k, c in deeper(group[0], np.concatenate(parts)):
                        yield out(m, k, c)
                    parts, large = ([] if m else [parts[0][:1]]), True
        if group and not large:
            yield from finish(group[0], parts)

    return step


def near_links(codes: DataFrame, limit: int = 3, most: int = MOST_IN_GROUP) -> DataFrame:
    """Links (a, b) between distinct ``code`` values (long) that differ in at most ``limit`` bits.

    Not all pairs: of each group, a spanning star of every component, so that components of the links are those
    of all pairs. A group beyond ``most`` codes is never held: it is dealt out again under longer masks, for
    which a pair within the limit still agrees on one at least, until groups are small or codes equal.
    """
    masks = [_signed(m) for m in block_masks((1 << 64) - 1, limit + 2, 2)]
    upper = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for m in masks)))
    waiting = codes.select("code").distinct().select(upper.alias("upper"), "code").select("upper.mask", "upper.key", "code")
    links = None
    while True:
        dealt = waiting.repartition("mask", "key").sortWithinPartitions("mask", "key", "code")
        found = reliable(dealt.mapInArrow(_group_links(limit, most), "mask long, key long, code long"))
        part = found.filter("mask = 0").select(F.col("key").alias("a"), F.col("code").alias("b"))
        links = part if links is None else links.union(part)
        waiting = found.filter("mask <> 0").distinct()
        if waiting.isEmpty():
            return links


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> tuple[DataFrame, str]:
    """``keep`` columns and the SimHash (64 bits as a long) of each whole text; the name of the new column."""
    name = unused(docs.select(*(F.col(f"`{c}`") for c in keep)), "fingerprint")

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], U64).view(np.int64))]

    return add_columns(docs, text, keep, [T.StructField(name, T.LongType())], make), name


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: doc_id, content (hash of the text), fingerprint and root (longs), component_id.

    Documents whose fingerprints differ in at most ``limit`` bits are linked; root is the smallest fingerprint
    (as a signed long) of a component, component_id its smallest doc_id.

    Null and empty texts have fingerprint 0, which links like any other. A null doc_id never names a component
    that has another; a component of null ids alone has component_id null. Repeated rows stay rows and share a
    fingerprint. Copies meet in one row per fingerprint before anything is compared.
    """
    source = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("content"), F.col(f"`{text}`").alias("text")
    )
    rows = reliable(fingerprints(source, ["doc_id", "content"], "text", shingle)[0])
    codes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("lowest"))
    classes = components(near_links(codes.select(F.col("fingerprint").alias("code")), limit))
    members = codes.join(classes, F.col("fingerprint") == F.col("node")).select("fingerprint", "root", "lowest")
    named = members.groupBy("root").agg(F.min("lowest").alias("smallest"))
    members = members.select("fingerprint", "root").join(named, "root")
    whole = codes.join(members, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"),
        F.when(F.col("root").isNull(), F.col("lowest")).otherwise(F.col("smallest")).alias("component_id"),
    )
    # written, so that the join below shuffles both sides anew and can split a fingerprint of very many documents
    whole = reliable(whole)
    return rows.join(whole, "fingerprint").select("doc_id", "content", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, of which one of each component stays: that of the smallest doc_id, nulls last.

    Where rows share that id, the one with the smallest hash of its text stays, and of equal rows one.
    """
    groups = near_duplicates(docs, doc_id, text, **options)
    identity = lambda name, content: F.concat_ws(":", F.coalesce(name.cast("string"), F.lit("null")), content.cast("string"))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("best"))
    key = unused(docs, "identity")
    best = best.select(identity(F.col("best.doc_id"), F.col("best.content")).alias(key))
    rows = docs.withColumn(key, identity(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`"))))
    return rows.dropDuplicates([key]).join(best, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
