"""Global ranks without putting a table into one task: NTILE over all rows, and dense numbers.

``ntile(n) over (order by x)`` without PARTITION BY sends every row to a single partition. Here the n - 1 rows at
which buckets begin are looked for instead: a histogram of the values, refined only where such a row falls,
gives their values, and only rows that have just these values are ordered by id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import case
from .session import ensure_checkpoint_dir, shuffle_partitions

# The range bounds come from about 100 sampled keys per range, held by the driver.
MOST_RANGES = 8192
#: Steps of a histogram: no task sends more rows than these for each range that is looked into.
SLOTS = 4096
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the lower 33 bits

# The order of values that are no plain numbers; NULL comes last.
_MINUS_INFINITY, _FINITE, _INFINITY, _NAN, _NULL = range(5)


@dataclass
class _Range:
    """Values of a class from ``low`` to ``high``, ``before`` rows ahead of them, and the ranks looked for among them."""

    kind: int
    low: float
    high: float
    before: int
    ranks: list[int] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        return (_kind(key) == self.kind) & _plain(key).between(self.low, self.high)

    def slot(self, key: Column, slots: int) -> Column:
        # halves: the width of the range may be more than a double holds
        width = self.high / 2 - self.low / 2
        part = (_plain(key) / 2 - self.low / 2) / F.lit(width) if width else F.lit(0.0)
        return F.least(F.floor(part * float(slots)), F.lit(slots - 1)).cast("int")


def _kind(key: Column) -> Column:
    infinity = float("inf")
    return case(
        (key.isNull(), _NULL), (F.isnan(key), _NAN), (key == infinity, _INFINITY), (key == -infinity, _MINUS_INFINITY), default=_FINITE
    )


def _plain(key: Column) -> Column:
    return F.when(_kind(key) == _FINITE, key).otherwise(0.0)


def global_ntiles(
    df: DataFrame, id_col: str, orderings: Mapping[str, Column], buckets: int, most_ranges: int = MOST_RANGES, slots: int = SLOTS
) -> DataFrame:
    """``id_col`` and, per ordering, its bigint bucket ``<name>`` and its key ``<name>_key``.

    The buckets are those of ``ntile(buckets)``. ``orderings`` maps a name to the numeric key to
    sort ascending by (negate for descending), NULL last; equal keys are ordered by ``id_col``, which
    must be unique. The keys come back as doubles, so ``df`` is read once and need not be joined again.

    1. ids and keys are written once, by a reliable checkpoint: a row per id, whatever the number of orderings;
    2. a histogram of each key, refined until each range with a wanted rank is a single value. Tasks send
       ``slots`` counts a range at most, and only these pass a window;
    3. where a bucket begins amid rows of equal keys, the id it begins with is looked up among their ids alone
       (``id_at``, a range shuffle in which equal keys are spread over tasks);
    4. the bucket follows from comparing a row with these at most ``buckets - 1`` beginnings: no join.

    Steps 1 to 3 are jobs that run when this is called.
    """
    ensure_checkpoint_dir(df.sparkSession)
    names = list(orderings)
    keyed = df.select(F.col(id_col), *[orderings[name].cast("double").alias(name + "_key") for name in names]).checkpoint(eager=True)
    starts = _starts(keyed, names, buckets, slots)
    wanted = {(name, kind, value, ahead) for name in names for _, kind, value, ahead in starts[name] if ahead}
    first_ids = _ids_at(keyed, id_col, wanted, most_ranges) if wanted else {}

    def bucket(name: str) -> Column:
        key = F.col(name + "_key")
        reached = [F.lit(1).cast("bigint")]
        for number, kind, value, ahead in starts[name]:
            beyond = (_kind(key) > kind) | ((_kind(key) == kind) & (_plain(key) > value))
            if ahead:
                at_least = F.coalesce(F.col(id_col) >= F.lit(first_ids[name, kind, value, ahead]), F.lit(False))
                beyond = beyond | ((_kind(key) == kind) & (_plain(key) == value) & at_least)
            else:
                beyond = beyond | ((_kind(key) == kind) & (_plain(key) == value))
            reached.append(F.when(beyond, number).otherwise(1).cast("bigint"))
        return F.greatest(*reached) if len(reached) > 1 else reached[0]

    return keyed.select(id_col, *[c for name in names for c in (bucket(name).alias(name), F.col(name + "_key"))])


def first_ranks(total: int, buckets: int) -> dict[int, int]:
    """The 0-based rank at which each bucket but the first begins, if it has rows: the first buckets get the rows left over."""
    small, larger = divmod(total, buckets)
    begins = {b: (b - 1) * small + min(b - 1, larger) for b in range(2, buckets + 1)}
    return {b: rank for b, rank in begins.items() if rank < total}


def _starts(keyed: DataFrame, names: Sequence[str], buckets: int, slots: int) -> dict[str, list[tuple[int, int, float, int]]]:
    """For each ordering and bucket but the first: (bucket, kind and value of its first key, rows of that key in earlier buckets)."""
    stacked = lambda exprs: F.explode(F.array(*exprs))
    classes = keyed.select(
        stacked([F.struct(F.lit(i).alias("o"), _kind(F.col(n + "_key")).alias("kind"), _plain(F.col(n + "_key")).alias("key")) for i, n in enumerate(names)]).alias("x")
    ).groupBy("x.o", "x.kind").agg(F.min("x.key").alias("low"), F.max("x.key").alias("high"), F.count(F.lit(1)).alias("n"))
    rows = _held(classes, ["o", "kind", "low", "high", "n"])
    total = sum(r["n"] for r in rows if r["o"] == 0)
    begins = first_ranks(total, buckets)
    open_: dict[int, list[_Range]] = {i: [] for i in range(len(names))}
    found: dict[str, dict[int, tuple[int, float, int]]] = {name: {} for name in names}

    def sort_in(o: int, ranges: list[_Range], ranks: list[int]) -> None:
        """Ranks in a range of one value are found; the other ranges are looked into."""
        for range_ in ranges:
            for rank in range_.ranks if range_.low == range_.high else ():
                found[names[o]][rank] = (range_.kind, range_.low, rank - range_.before)
        open_[o] += [r for r in ranges if r.ranks and r.low < r.high]

    for o in range(len(names)):
        before, ranges = 0, []
        for r in sorted((r for r in rows if r["o"] == o), key=lambda r: r["kind"]):
            ranges.append(_Range(r["kind"], r["low"], r["high"], before, [k for k in set(begins.values()) if before <= k < before + r["n"]]))
            before += r["n"]
        sort_in(o, ranges, [])
    while any(open_.values()):
        looked, open_ = open_, {i: [] for i in range(len(names))}
        for (o, j), ranges in _refine(keyed, names, looked, slots).items():
            sort_in(o, ranges, looked[o][j].ranks)
    return {name: [(b, *found[name][rank]) for b, rank in begins.items()] for name in names}


def _refine(keyed: DataFrame, names: Sequence[str], looked: dict[int, list[_Range]], slots: int) -> dict[tuple[int, int], list[_Range]]:
    """The slots of the ranges looked into that hold a wanted rank."""
    parts = []
    for o, ranges in looked.items():
        key = F.col(names[o] + "_key")
        for j, r in enumerate(ranges):
            part = F.struct(F.lit(o).alias("o"), F.lit(j).alias("j"), r.slot(key, slots).alias("slot"), _plain(key).alias("key"))
            parts.append(F.when(r.holds(key), part))
    each = keyed.select(F.explode(F.array(*parts)).alias("x")).filter("x IS NOT NULL")
    counted = each.groupBy("x.o", "x.j", "x.slot").agg(F.min("x.key").alias("low"), F.max("x.key").alias("high"), F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("o", "j").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("n").over(running))
    wanted = F.lit(False)
    for o, ranges in looked.items():
        for j, r in enumerate(ranges):
            inside = [(F.col("upto") - F.col("n") <= k - r.before) & (F.col("upto") > k - r.before) for k in r.ranks]
            for condition in inside:
                wanted = wanted | ((F.col("o") == o) & (F.col("j") == j) & condition)
    result: dict[tuple[int, int], list[_Range]] = {}
    for row in _held(upto.filter(wanted), ["o", "j", "low", "high", "n", "upto"]):
        outer = looked[row["o"]][row["j"]]
        before = outer.before + row["upto"] - row["n"]
        ranks = [k for k in outer.ranks if before <= k < before + row["n"]]
        result.setdefault((row["o"], row["j"]), []).append(_Range(outer.kind, row["low"], row["high"], before, ranks))
    return result


def _held(few: DataFrame, columns: Sequence[str]) -> list:
    """A bounded number of rows, as one."""
    return few.agg(F.collect_list(F.struct(*columns))).first()[0]


def _ids_at(keyed: DataFrame, id_col: str, wanted: set[tuple[str, int, float, int]], most_ranges: int) -> dict[tuple, object]:
    """For each (ordering, kind, value, n): the id that comes after n others among those of that value."""
    order = sorted(wanted)
    groups = sorted({w[:3] for w in order})
    parts = [F.when((_kind(F.col(n + "_key")) == kind) & (_plain(F.col(n + "_key")) == value), F.lit(g)) for g, (n, kind, value) in enumerate(groups)]
    tied = keyed.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("group")).filter("group IS NOT NULL")
    ranked = ranked_rows(tied, ["group"], ["id"], most_ranges)
    at = F.lit(False)
    for name, kind, value, ahead in order:
        at = at | ((F.col("group") == groups.index((name, kind, value))) & (F.col("rank") == ahead))
    ids = {(*groups[r["group"]], r["rank"]): r["id"] for r in _held(ranked.filter(at), ["group", "rank", "id"])}
    return {w: ids[w] for w in order}


def ranked_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str], most_ranges: int = MOST_RANGES) -> DataFrame:
    """``df`` and the 0-based ``rank`` of each row in its group (none: in all rows), in order of the columns ``order``.

    One range shuffle on groups and order, sorted inside partitions; equal rows may be ranked either way. The position in
    a partition is fixed by a reliable checkpoint, which runs when this is called: the range bounds come from a sample, so
    a recomputed layout could differ. Rows before each partition are a running sum over counts per partition, at
    most ``most_ranges`` plus one per group, hence the broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = [F.asc(c) for c in (*groups, *order)]
    # Adaptive execution merges small ranges unless their number is given, so it is given only at the cap.
    capped = [most_ranges] if shuffle_partitions(df.sparkSession) > most_ranges else []
    placed = (
        df.repartitionByRange(*capped, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
        .select(*df.columns, F.shiftright("place", _ROW_BITS).alias("part"), F.col("place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("row"))
        .checkpoint(eager=True)
    )
    per_part = placed.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first_row"))
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *[F.col(c).alias(f"of_{c}") for c in (*groups, "part")],
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first_row")).alias("offset"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*groups, "part")]
    return placed.join(F.broadcast(offsets), same).select(*df.columns, (F.col("offset") + F.col("row")).alias("rank"))


def dense_numbers(ids: DataFrame, id_col: str, order: Sequence[str], most_ranges: int = MOST_RANGES) -> DataFrame:
    """``id_col`` and its ``number``, 0, 1, 2, ... in order of the columns ``order``, for frames with a row per id."""
    return ranked_rows(ids.select(*dict.fromkeys((id_col, *order))), [], order, most_ranges).select(id_col, F.col("rank").alias("number"))
