"""LM scoring by cross-entropy difference.

Two bigram models, of a trusted target and of the whole corpus as background, share one vocabulary: every word and
every pair of neighbours of the corpus. They are matched: the same order, smoothing and vocabulary, and the
background's counts scaled to the target's mass. A document's score is its loss per word under the target's model less
that under the background's: the lower, the more it is like the target. What the document itself has added to a model's
counts is taken out before it is scored, else a model would know what it has seen.

Counts are kept for every word and pair, by keys that lengthen with the corpus, and no table of them is collected or
broadcast. A block of texts asks for the counts of its distinct grams, dealt out by ranges of keys; each range adds up
what all blocks have asked and answers every one; the answers meet the block's texts, which are scored there. Blocks go by the
hash of their texts, so that it does not matter when and where they are cut. A gram that all texts hold is one entry a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import binary, slices
from shelfwise.llm.ngram_ratio import trusted_rows
from shelfwise.llm.words import NOT_BLANK, join_hashes, mix, read_words

U64 = np.uint64
#: Words are equal if so many bits of their hashes are.
WORD_BITS = 48
#: Keys have so many bits more than the number of words in the corpus, whatever its size: one gram in 16,384 shares its key.
SPARE_BITS = 14
#: Bytes of text of a block, and of the texts whose grams a range of keys holds.
BLOCK_BYTES, RANGE_BYTES = 1 << 21, 1 << 24
#: The nominal number of words that the mass of unseen ones is spread over, and the prior's weight in words.
UNSEEN, PRIOR = 1 << 18, 2.0
_TARGET = 0  # in place of a block: counts of the target, which want no answer


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the codes of all words."""
    words = read_words(texts, NOT_BLANK, lower=True)
    return words.counts(), words.hash >> U64(64 - WORD_BITS)


def _before(n: np.ndarray, size: int) -> np.ndarray:
    """For each word whether it is the first of its text."""
    opens = np.zeros(size, bool)
    opens[(np.cumsum(n) - n)[n > 0]] = True
    return opens


def gram_keys(codes: np.ndarray, opens: np.ndarray, bits: int) -> np.ndarray:
    """The keys of all words, then those of all pairs of a word with the one before (nothing before a text's first)."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[opens] = 0
    return np.concatenate([mix(codes), join_hashes(before, codes)]) >> U64(64 - bits)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, all lowest bytes first: what they have in common compresses."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    numbers = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    numbers[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return numbers.view("<u8").ravel()


def _steps(ordered: np.ndarray) -> bytes:
    return packed(np.diff(ordered, prepend=U64(0)))


def _stepped(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=U64)


_ASKED = "kind int, address long, block long, part int, keys binary, counts binary"
_ANSWERED = "kind int, block long, part int, counts binary, ids array<long>, sizes binary, words binary, places binary"
_GRAMS, _TEXTS = 0, 1
_ASK_TYPES = {"kind": pa.int32(), "address": pa.int64(), "block": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
_ANSWER_TYPES = {
    "kind": pa.int32(), "block": pa.int64(), "part": pa.int32(), "counts": pa.binary(), "ids": pa.list_(pa.int64()), "sizes": pa.binary(),
    "words": pa.binary(), "places": pa.binary(),
}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(name, ids, texts) of the blocks of rows (text, id)."""
    for batch in batches:
        texts = binary(batch.column(0))
        for first, stop in slices(texts, BLOCK_BYTES):
            part = texts.slice(first, stop - first)
            name = hashlib.blake2b(digest_size=8)
            for value in part:
                name.update(len(value.as_py()).to_bytes(8, "little") + value.as_py())
            yield int.from_bytes(name.digest(), "little", signed=True) | 1, batch.column(1).slice(first, stop - first), part


def _asks(parts: int, bits: int, target: bool):
    """Texts -> for each block and range of keys its grams and their counts."""
    bounds = np.array([(p << bits) // parts for p in range(parts + 1)], U64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            n, codes = word_codes(texts)
            grams, count = np.unique(gram_keys(codes, _before(n, len(codes)), bits), return_counts=True)
            edges = np.searchsorted(grams, bounds).tolist()
            rows = [
                (_GRAMS, p, _TARGET if target else block, p, _steps(grams[a:b]), packed(count[a:b]))
                for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b
            ]
            yield _batch(rows, _ASK_TYPES)

    return step


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> the block's distinct words, and its texts as places among them."""
    for block, ids, texts in _blocks(batches):
        n, codes = word_codes(texts)
        words, place = np.unique(codes, return_inverse=True)
        yield _batch([(_TEXTS, block, -1, None, ids.to_pylist(), packed(n), _steps(words), packed(place))], _ANSWER_TYPES)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one, as they are large."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch)))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks sorted by range -> to each block of a range the counts of its grams in the corpus and in the target."""
    part, asked = None, []
    for batch in batches:
        for row in _rows(batch.select(["block", "part", "keys", "counts"])):
            if row["part"] != part and asked:
                yield from _summed(part, asked)
                asked = []
            part = row["part"]
            asked.append((row["block"], _stepped(row["keys"]), unpacked(row["counts"]).astype(np.int64)))
    if asked:
        yield from _summed(part, asked)


def _summed(part: int, asked: list) -> Iterator[pa.RecordBatch]:
    grams, place = np.unique(np.concatenate([keys for _, keys, _ in asked]), return_inverse=True)
    totals = np.zeros((2, len(grams)), np.int64)
    at = 0
    for block, keys, counts in asked:  # a gram is in an ask once
        totals[int(block == _TARGET), place[at : at + len(keys)]] += counts
        at += len(keys)
    at = 0
    for block, keys, _ in asked:
        if block != _TARGET:
            yield _batch([(_GRAMS, block, part, packed(totals[:, place[at : at + len(keys)]].ravel()), None, None, None, None)], _ANSWER_TYPES)
        at += len(keys)


def own_counts(whose: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place, how often its id occurs in its text."""
    _, group, counts = np.unique(whose * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True, return_counts=True)
    return counts[group]


def losses(counts: tuple[np.ndarray, ...], own: tuple[np.ndarray, ...], length: np.ndarray, total: float, scale: float) -> np.ndarray:
    """Nats of each word given the one before, from the counts of word, word before and pair, without ``own`` counts and ``length`` words.

    Pairs are smoothed by a Dirichlet prior on the word's probability, words by adding one. ``scale`` is what an
    occurrence adds to a model's counts, of which ``total`` are words.
    """
    word, before, pair = (np.maximum(scale * (c - n), 0.0) for c, n in zip(counts, own))
    share = (word + 1) / (np.maximum(total - scale * length, 0.0) + UNSEEN)
    return -np.log((pair + PRIOR * share) / (before + PRIOR))


def _behind(values: np.ndarray, opens: np.ndarray, at_first: float) -> np.ndarray:
    """The value of the word before; that of a text's first word is given."""
    out = np.empty(len(values), np.float64)
    out[1:] = values[:-1]
    out[opens] = at_first
    return out


def _scores(bits: int, words: tuple[int, int], texts: tuple[int, int]):
    """Answers, then the texts of each block -> id, words and mean losses of each text; ``words`` and ``texts`` of corpus and target."""
    scale = words[1] / max(1, words[0])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}
        for batch in batches:
            out = []
            for row in _rows(batch):
                if row["block"] != block:
                    block, held = row["block"], {}
                if row["kind"] == _GRAMS:
                    held[row["part"]] = unpacked(row["counts"]).astype(np.float64).reshape(2, -1)
                    continue
                n = unpacked(row["sizes"]).astype(np.int64)[: len(row["ids"])]
                codes = _stepped(row["words"])[unpacked(row["places"]).astype(np.int64)]
                opens = _before(n, len(codes))
                grams, places = np.unique(gram_keys(codes, opens, bits), return_inverse=True)
                counts = np.concatenate([np.zeros((2, 0)), *(held[p] for p in sorted(held))], axis=1)
                if counts.shape[1] != len(grams):
                    raise RuntimeError("a block of texts lacks the counts of some of its grams")
                word, pair = places.reshape(2, -1)
                whose = np.repeat(np.arange(len(n)), n)
                own_word, own_pair, length = own_counts(whose, word), own_counts(whose, pair), n[whose]
                own = (own_word, _behind(own_word, opens, 1), own_pair)
                raw, target = ((c[word], _behind(c[word], opens, number), c[pair]) for c, number in zip(counts, texts))
                none = (np.zeros(len(whose)),) * 3
                means = []
                for found, seen, size, total, weight in (
                    (target, own, length, words[1], 1.0), (target, none, none[0], words[1], 1.0), (raw, own, length, scale * words[0], scale),
                ):
                    each = np.bincount(whose, losses(found, seen, size, total, weight), len(n))
                    means.append((each / np.maximum(n, 1)).tolist())
                out += list(zip(row["ids"], n.tolist(), *means))
            yield _batch(out, _SCORE_TYPES)

    return step


_SCORED = "id long, n_tokens long, without_own double, as_it_is double, background_loss double"
_SCORE_TYPES = {
    "id": pa.int64(), "n_tokens": pa.int64(), "without_own": pa.float64(), "as_it_is": pa.float64(), "background_loss": pa.float64(),
}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.empty(0, np.int64)]
        texts = binary(batch.column(0))
        for first, stop in slices(texts):
            n.append(read_words(texts.slice(first, stop - first), NOT_BLANK).counts())
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(np.concatenate(n), pa.int64()), pc.binary_length(texts).cast(pa.int64())], names=["id", "words", "bytes"]
        )


def score(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id (long), n_tokens, target_loss, background_loss (nats a word), score (their difference).

    The background counts every word and pair of every document; the target those of all documents whose ``id`` is in
    ``trusted`` (unique ids), however many. A document of the target is scored as if it had not been there, and each one
    as if it were not in the background. Words are runs without white space, A-Z lower-cased. A text without words,
    null included, has losses and score 0. Without any trusted document both models are flat and all scores 0. Null ids and
    repeated rows are scored like any; a null id is never trusted. An empty table gives an empty one.

    Texts are read three times: for the number of words when this is called, for the grams, and to be scored. Shuffled
    are some 4 bytes for each distinct gram of a block, its counts, about 4 bytes for each word, and the texts of the
    target. A text is never split, so a very long one is a block of its own.
    """
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("id"))
    ids = trusted.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("trusted")).hint("shuffle_hash")
    sizes = rows.mapInArrow(_count_words, "id long, words long, bytes long").join(ids, "id", "left")
    mine = lambda column: F.sum(F.when(F.col("trusted"), column))
    filled = F.signum("words").cast("long")
    totals = sizes.agg(F.sum("words"), mine(F.col("words")), F.sum(filled), mine(filled), F.sum("bytes")).first()
    *numbers, size = (int(x or 0) for x in totals)

    parts, bits = max(1, -(-size // RANGE_BYTES)), min(62, numbers[0].bit_length() + SPARE_BITS)
    asked = rows.mapInArrow(_asks(parts, bits, False), _ASKED)
    wanted = trusted_rows(rows, trusted, "text", "id").select("text", "id").mapInArrow(_asks(parts, bits, True), _ASKED)
    dealt = asked.unionByName(wanted).repartition("address").sortWithinPartitions("part")
    answered = dealt.mapInArrow(_answers, _ANSWERED).unionByName(rows.mapInArrow(_texts, _ANSWERED))
    met = answered.repartition("block").sortWithinPartitions("block", "kind", "part")
    scored = met.mapInArrow(_scores(bits, tuple(numbers[:2]), tuple(numbers[2:])), _SCORED)
    # both losses under the target's model are there before it is known whether the target has seen the text: only numbers are joined
    joined = scored.join(ids, "id", "left")
    loss = F.when(F.col("trusted"), F.col("without_own")).otherwise(F.col("as_it_is"))
    return joined.select(F.col("id").alias("doc_id"), "n_tokens", loss.alias("target_loss"), "background_loss", (loss - F.col("background_loss")).alias("score"))
