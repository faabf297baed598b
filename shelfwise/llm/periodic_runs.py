"""Periodic runs of words, by a dictionary of basic factors.

A factor is the words i to i + 2^k of a text; its name at level k is made of the names of its two halves, so that
equal factors have equal names. Only factors that occur again in their text are named: a longer factor that occurs
again has two such halves, so nothing is lost and most of a natural text drops out at once.

Where a factor's next occurrence lies p words on, p is proposed as a period. Within one run these proposals are an
arithmetic progression: a factor of 2^k >= p words in a run with smallest period p occurs next exactly p words on,
as two periods within such a factor would have a common divisor as period. So a run of at least 3p words is
met at the level of the smallest 2^k >= p, and it is the longest stretch of places that propose p there.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import add_columns, unused

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``binary`` texts, one after the other, and the number of the first word of each text (and of the end)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()))  # splits at runs of just these six characters
    words, ends = parts.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))])
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at the edges make empty parts
    return words.filter(pa.array(filled)), np.concatenate([[0], np.cumsum(filled)])[ends]


def _first_level(least_words: int, least_periods: int) -> int:
    """The level at which all periods up to its factors' length are looked for."""
    level = 0
    while all((2 << level) + p <= max(least_words, least_periods * p) for p in range(1, (2 << level) + 1)):
        level += 1
    return level


def find_runs(
    words: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period.

    ``words`` are numbers of words, text i has those from ``first[i]`` to ``first[i + 1]``; starts are places in
    ``words``. ``least_periods`` is 3 at least, so that a factor of fewer than 2p words and its next occurrence fit in a run.
    """
    if least_periods < 3:
        raise ValueError("a run has three periods at least")
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    base = _first_level(least_words, least_periods)
    # names of the factors that occur again in their text, -1 for all others; at first those are words of a text
    at, name = _repeated(np.arange(n), text * (int(words.max()) + 1) + words if n else words)
    starts, lengths, periods = [], [], []
    level = 0
    while len(at):
        size = 1 << level
        if level >= base:
            by_name = np.lexsort((at, name))
            here, following = by_name[:-1], by_name[1:]
            distance = np.zeros(len(at), np.int64)
            same = name[here] == name[following]
            distance[here[same]] = at[following[same]] - at[here[same]]
            proposes = (distance > (size >> 1 if level > base else 0)) & (distance <= size)
            p, d = at[proposes], distance[proposes]
            breaks = np.flatnonzero((np.diff(p) != 1) | (np.diff(d) != 0)) + 1
            heads = np.concatenate([[0], breaks]) if len(p) else breaks
            tails = np.concatenate([breaks, [len(p)]])[: len(heads)] - 1
            length = p[tails] - p[heads] + size + d[heads]
            long = length >= np.maximum(least_words, least_periods * d[heads])
            starts.append(p[heads][long]), lengths.append(length[long]), periods.append(d[heads][long])
        dense = np.full(n + size, -1, np.int64)
        dense[at] = name
        other = dense[at + size]
        both = other >= 0
        both[both] = text[at[both]] == text[at[both] + size]
        at, name = _repeated(at[both], name[both] * (int(name.max()) + 1) + other[both])
        level += 1
    if not starts:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x).astype(np.int64) for x in (starts, lengths, periods))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _repeated(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose key occurs more than once, with small numbers for the keys."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[name] > 1
    return at[again], name[again]


def runs_and_rest(texts: pa.Array, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[pa.Array]:
    """For each text its number of words, its runs, and its words without the repeated ones, joined by a space."""
    words, first = split_words(texts)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = find_runs(numbers, first, least_words, least_periods)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    bounds = np.searchsorted(start, first)
    own = np.searchsorted(first, start, side="right") - 1
    columns = (start - first[own] if len(start) else start, length, period)
    runs = pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_ARROW_RUNS.value_type))
    )
    left = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[first], pa.int64()), words.filter(pa.array(kept)))
    rest = pc.binary_join(left, pa.scalar(" ", words.type)).cast(pa.string())
    return [pa.array(np.diff(first), pa.int64()), runs, rest]


def collapse_runs(
    docs: DataFrame, keep: Iterable[str], text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` columns of every document, its number of words, its periodic runs and its text without the repeats.

    Words are what blanks (space and characters 9 to 13) separate. A run is a stretch of ``least_words`` words or more
    with smallest period p, ``least_periods`` times p or more, that no neighbouring word extends; runs may overlap. The
    collapsed text keeps a word unless it is in some run after that run's first p words. Returns the frame and the
    names of the new columns by role (``n_words``, ``runs``, ``collapsed``), which avoid the names in ``keep``.

    A null, empty or blank text has no words, no runs and the empty collapsed text; repeated documents stay separate
    rows with equal results; an empty table gives an empty one. Words are compared as they are, not by a hash. One
    text is handled whole by one task, in memory of some 100 bytes a word.
    """
    keep = list(keep)
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    names = {role: unused(kept, role) for role in ("n_words", "runs", "collapsed")}
    fields = [T.StructField(n, k) for n, k in zip(names.values(), (T.LongType(), T.ArrayType(RUN, False), T.StringType()))]
    return add_columns(docs, text, keep, fields, lambda texts: runs_and_rest(texts, least_words, least_periods)), names


def strongest(runs: Column) -> Column:
    """The run of most periods (length / period, compared exactly), the first one of equals; null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(better(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run, in their order."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def repeat_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periodic words planted in a tenth of the texts, as the checksum of the decimal id says.

    With h the CRC-32 of the id and g = h div 10: where h mod 10 is 0 and the text has n > 0 words, words from
    a = g mod n on are replaced by a repetition of the p = 1 + (n - a) div (3 + g mod 8) words from a on, and
    single spaces separate the words. All other texts, and those of a null id, stay as they are.
    """
    own = {role: unused(docs, role) for role in ("h", "words", "n", "a", "p")}
    h, words, n, a, p = (f"`{c}`" for c in own.values())
    whole = f"CAST(`{text}` AS STRING)"
    found = docs.withColumn(own["h"], F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")))
    found = found.withColumn(own["words"], F.expr(rf"CASE WHEN {h} % 10 = 0 THEN regexp_extract_all({whole}, r'[^\x20\x09-\x0D]+', 0) END"))
    found = found.withColumn(own["n"], F.size(own["words"]))
    found = found.withColumn(own["a"], F.expr(f"CAST(try_mod({h} div 10, {n}) AS INT)"))
    found = found.withColumn(own["p"], F.expr(f"CAST(1 + ({n} - {a}) div (3 + ({h} div 10) % 8) AS INT)"))
    rest = f"flatten(array_repeat(slice({words}, {a} + 1, {p}), CAST(({n} - {a}) div {p} + 1 AS INT)))"
    planted = f"array_join(concat(slice({words}, 1, {a}), slice({rest}, 1, {n} - {a})), ' ')"
    new = F.expr(f"CASE WHEN {h} % 10 = 0 AND {n} > 0 THEN {planted} ELSE {whole} END")
    return found.withColumn(text, new).select(*(F.col(f"`{c}`") for c in docs.columns))
