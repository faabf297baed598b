"""Best-fit packing of token sequences: local best fit, then a tree that merges underfull bins.

Each input partition tokenizes its documents, cuts the long ones into pieces and packs its pieces by best fit
(longest first). Nearly full bins are done. The underfull ones go up a tree: the bins of ``fan_in`` groups meet
in one, where they are items of another best fit, until one group is left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import binary, reliable, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, cell long"

#: Code points up to here, but for white space beyond ASCII, are letters, digits and marks of every Unicode version alike.
_COMMON = re.compile("[\x00-\x7f\xa1-ɏ]*")
_LONG_RUN = 2000
#: A cell is a place in the tree, above, and a number among those that share it, in the lower bits.
_SPLIT_BITS = 32


class Tokenizer:
    """Byte-level BPE ids as the ``tokenizers`` library gives them.

    Texts of common Latin characters go through ``tiktoken`` with the same vocabulary and splitting pattern,
    which gives the same ids in a quarter of the time. All others, very long runs without a space and texts that
    hold the special token's string go through ``tokenizers`` itself. ``ranks_path`` None: always the latter.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.path, self.fast = path, None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        """Loaded when the first text needs it."""
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def encode(self, text: str) -> list[int]:
        if self.fast and "<|" not in text and _COMMON.fullmatch(text) and len(max(text.split(" "), key=len)) < _LONG_RUN:
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def public_tokenizer() -> Tokenizer:
    """The byte-level BPE vocabulary of 50,257 ids, from the installed public files."""
    import public_tokenizers as public

    return Tokenizer(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of the items in descending size: each item's bin and offset, and each bin's fill.

    Ties go by the items' order. Bit r of ``open_rests`` says that some bin has r places left, so the tightest
    bin is found without a search.
    """
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rests = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = open_rests >> size
        if fitting:
            rest = size + (fitting & -fitting).bit_length() - 1
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                open_rests &= ~(1 << rest)
        else:
            b, rest = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        by_rest[rest - size].append(b)
        open_rests |= 1 << (rest - size)
    return bins, offsets, fills


def _pack_partition(make_tokenizer: Callable[[], Tokenizer], capacity: int, end_id: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        ids_of, pieces, starts, lengths, sums = [], [], [], [], []
        for batch in batches:
            tokenizer = tokenizer or make_tokenizer()
            texts = binary(batch.column(1))
            names = batch.column(0).to_pylist()
            for first, stop in slices(texts):
                for name, text in zip(names[first:stop], texts.slice(first, stop - first).to_pylist()):
                    ids = np.array([*tokenizer.encode(text.decode("utf-8", "replace")), end_id], "<u4")
                    at = 0
                    while at < len(ids):
                        length = (len(ids) - at) % capacity or capacity
                        ids_of.append(name)
                        pieces.append(-(-at // capacity))
                        starts.append(at)
                        lengths.append(length)
                        sums.append(zlib.crc32(ids[at : at + length]))
                        at += length
        if not ids_of:
            return
        cell = TaskContext.get().partitionId() << _SPLIT_BITS
        bins, offsets, fills = best_fit(lengths, capacity)
        bins = np.array(bins)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids_of, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(sums, pa.int64()), pa.array((cell >> _SPLIT_BITS << 32) + bins), pa.array(offsets, pa.int64()), pa.array(np.array(fills)[bins]),
                pa.array(np.full(len(bins), cell)),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "cell"],
        )

    return step


def _merge_cell(capacity: int):
    def step(pdf):
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(pdf["fill"].tolist(), capacity)
        names = pdf["bin"].to_numpy()
        bins = np.array(bins)
        leader = np.zeros(len(fills), np.int64)
        leader[bins[::-1]] = names[::-1]  # a merged bin has the name of its first member
        return pdf.assign(root=leader[bins], shift=offsets, fill=np.array(fills)[bins])[["bin", "root", "shift", "fill", "cell"]]

    return step


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = 2048,
    end_id: int = 0,
    tokenizer: Callable[[], Tokenizer] = public_tokenizer,
    full: float = 0.98,
    fan_in: int = 32,
    cell_bins: int = 1 << 16,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its ids and ``end_id``. Only one longer than ``capacity`` is cut; its first piece takes what
    is over, the others are full. Columns: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), sequence_id, offset (its place, without gaps from 0).

    Bins with ``full`` of the capacity are done at once, the others go on to the next round, every one of them. A place of
    the tree with more than ``cell_bins`` bins is split into cells of about that many, dealt by a hash that changes from round to
    round, so that each holds bins of all fills; at the root the rounds go on until one cell is enough or a round saves
    less than a bin in a hundred (as where all bins are over half full). Tokenized pieces are written to the
    checkpoint folder (about 70 bytes each, no texts), so that later rounds and lost executors neither tokenize nor pack again.

    Null and empty texts are one piece, the end id alone. A null doc_id stays null. Repeated rows are packed as
    often as they occur. No rows: no sequences. Ties are broken by the order of the rows in their partition.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = reliable(source.mapInArrow(_pack_partition(tokenizer, capacity, end_id), PIECES))
    least = int(full * capacity)
    waiting = (
        pieces.filter(F.col("fill") < least).groupBy("bin").agg(F.first("fill").alias("fill"), F.first("cell").alias("cell"))
    )
    places, moves, turn = max(1, pieces.rdd.getNumPartitions()), None, 0
    while True:
        places, turn = -(-places // fan_in), turn + 1
        grouped = waiting.withColumn("place", F.floor(F.shiftright("cell", _SPLIT_BITS) / fan_in))
        # a row per place of the tree: at most one for each ``fan_in`` partitions
        splits = grouped.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / cell_bins).alias("splits"))
        number = F.pmod(F.xxhash64("bin", F.lit(turn)), F.col("splits"))
        dealt = grouped.join(F.broadcast(splits), "place").withColumn("cell", F.shiftleft("place", _SPLIT_BITS) + number).select("bin", "fill", "cell")
        merged = reliable(dealt.groupBy("cell").applyInPandas(_merge_cell(capacity), "bin long, root long, shift long, fill long, cell long"))
        step = merged.select("bin", "root", "shift")
        if moves is None:
            moves = step
        else:
            step = step.select(F.col("bin").alias("root"), F.col("root").alias("top"), F.col("shift").alias("more"))
            moves = moves.join(step, "root", "left").select(
                "bin", F.coalesce("top", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
        if places == 1:
            before, after, cells = merged.agg(F.count(F.lit(1)), F.count_if(F.col("bin") == F.col("root")), F.countDistinct("cell")).first()
            if cells <= 1 or 100 * after > 99 * before:
                break
        waiting = merged.filter((F.col("bin") == F.col("root")) & (F.col("fill") < least)).select("bin", "fill", "cell")
    return pieces.join(moves, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )

