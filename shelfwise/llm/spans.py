"""Places of pattern matches in texts, by SQL functions alone.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern what lies between them; a match ends
where the lengths of all gaps and matches up to it add up to. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of span: leftmost non-overlapping matches of a Java pattern for which ``holds``, if given.

    A match for which it does not hold is dropped, and the search goes on behind it.
    """

    kind: str
    pattern: str
    holds: Callable[[Column], Column] | None = None
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


def _gaps_and_matches(body: Column, pattern: str, rank: int) -> Column:
    """Each match with the length of the gap before it; the last gap has no match."""
    matches = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return F.zip_with(
        F.split(body, pattern, -1), matches, lambda gap, m: F.struct(F.lit(rank).alias("rank"), F.length(gap).alias("gap"), m.alias("match"))
    )


def match_rows(
    texts: DataFrame, key: str, text: str, rules: list[Rule], wanted: Callable[[Rule], Column] | None = None, carry: Iterable[str] = ()
) -> DataFrame:
    """One row per span: key, ``carry``, kind, rank (of the kind in ``rules``), start, stop (end exclusive), match.

    ``key`` names a row. ``wanted`` tells for which rows a rule is to be tried. Texts without a match, and null
    texts, give no row. Rows of a key stay in the partition they are in if that is by ``key``.
    """
    body = F.col(f"`{text}`")
    nothing = F.expr("cast(array() as array<struct<rank:int,gap:int,match:string>>)")
    found = []
    for rank, rule in enumerate(rules):
        hit = body.rlike(rule.pattern)
        if wanted:
            hit = wanted(rule) & hit
        found.append(F.coalesce(F.when(hit, _gaps_and_matches(body, rule.pattern, rank)), nothing))
    rows = texts.select(key, *carry, F.posexplode(F.concat(*found)).alias("nth", "found")).select(key, *carry, "nth", "found.*").filter("match is not null")
    in_order = Window.partitionBy(key, "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(in_order))
    holds, kinds = F.lit(True), F.lit(None).cast("string")
    for rank, rule in enumerate(rules):
        kinds = F.when(F.col("rank") == rank, F.lit(rule.kind)).otherwise(kinds)
        if rule.holds:
            holds = F.when(F.col("rank") == rank, rule.holds(F.col("match"))).otherwise(holds)
    return rows.filter(holds).select(key, *carry, kinds.alias("kind"), "rank", (F.col("stop") - F.length("match")).alias("start"), "stop", "match")


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with ``found``: its spans by start, then rank of the kind.

    A span's ``done`` is where the spans before it end: what lies before that is covered already.
    """
    before = Window.partitionBy(key).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("done", F.coalesce(F.max("stop").over(before), F.lit(0).cast("long")))
    span = F.struct("start", "rank", "stop", "done", "kind")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(span)).alias("found"))


EMPTY = "cast(array() as array<struct<start:bigint,rank:int,stop:bigint,done:bigint,kind:string>>)"


def joined(found: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of some kinds only, if given."""
    if kinds is not None:
        found = F.filter(found, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, found: Column, marker: Callable[[Column], Column]) -> Column:
    """The text with each run of overlapping spans replaced by the marker of its first span."""
    pieces = F.transform(
        found,
        lambda s: F.when(
            s["start"] >= s["done"],
            F.concat(F.substring(text, s["done"].cast("int") + 1, (s["start"] - s["done"]).cast("int")), marker(s)),
        ).otherwise(F.lit("")),
    )
    end = F.array_max(F.transform(found, lambda s: s["stop"])).cast("int")
    rest = F.substring(text, end + 1, F.length(text))
    return F.when(F.size(found) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
