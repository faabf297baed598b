"""Secret scans over an incremental ledger of blobs, by DataFrame functions alone.

Every historical version of a text is a blob, named by the SHA-256 of its bytes. The ledger says which versions of
which rules have seen which blob, and what they found. A scan tries only the pairs of blob and rule that the
ledger lacks, once per blob, and joins the findings back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import reliable, unused
from shelfwise.llm.spans import EMPTY, Rule, gathered, match_rows, replaced

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The kinds every scan reports. A run of hexadecimal digits, or an access key, that is too short holds no longer one.
BASE_RULES = [
    Rule("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]
#: Further public formats of credentials.
RULES = BASE_RULES + [
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
]


LEDGER = "blob string, rules array<string>, found array<struct<start:bigint,rank:int,stop:bigint,done:bigint,kind:string>>"


def blob_id(content: Column) -> Column:
    """The content address; a null content is the empty one."""
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256)


@dataclass
class Scan:
    """``findings``: blob and ``found`` spans, of blobs with any. ``entries``: what to append to the ledger."""

    findings: DataFrame
    entries: DataFrame


def scan_blobs(versions: DataFrame, content: str, rules: list[Rule] = RULES, ledger: DataFrame | None = None) -> Scan:
    """Scan the distinct contents of ``versions`` that the ledger does not cover.

    ``found`` is an array of (start, rank, stop, done, kind), in code points, end exclusive, by start and rank of
    the rule. ``entries`` has blob, rules (names with version that were tried now) and found; written to a table
    and passed as ``ledger`` next time, it saves that work. Findings of older versions of a rule are left out.

    Null contents count as empty and hold nothing. Equal contents are one blob, however many paths have it: copies
    meet before the shuffle. An empty table gives empty frames. Only the content column is read.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    text = F.coalesce(F.col(f"`{content}`").cast("string"), F.lit(""))
    blobs = versions.select(text.alias("content")).withColumn("blob", blob_id(F.col("content"))).dropDuplicates(["blob"])
    if ledger is None:
        new = gathered(match_rows(blobs, "blob", "content", rules), "blob")
        return Scan(new, _entries(blobs.select("blob", names.alias("rules")), new))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
    unseen = blobs.filter(F.size(F.array_except(names, "seen")) > 0)
    rows = match_rows(unseen, "blob", "content", rules, lambda rule: ~F.array_contains("seen", rule.name))
    entries = _entries(unseen.select("blob", F.array_except(names, "seen").alias("rules")), gathered(rows, "blob"))
    old = _today(ledger, rules)
    spans = old.union(rows.select("blob", "kind", "rank", "start", "stop"))
    return Scan(gathered(spans.distinct(), "blob"), entries)


def _today(ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, rank, start, stop): what the ledger has from rules of today's versions, in today's order."""
    today = lambda value: F.create_map(*(F.lit(x) for r in rules for x in (r.kind, value(r))))[F.col("kind")]
    ranks = {r.kind: i for i, r in enumerate(rules)}
    spans = ledger.select("blob", "rules", F.explode("found").alias("span")).select("blob", "rules", "span.*")
    spans = spans.filter(F.array_contains("rules", today(lambda r: r.name))).withColumn("rank", today(lambda r: ranks[r.kind]))
    return spans.select("blob", "kind", "rank", "start", "stop")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger kept in a folder; None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(versions: DataFrame, content: str, folder: str, rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it there, and return the ledger's findings: blob and ``found``.

    The entries are appended by one job, all or none of them; scanning a pair twice, as two runs at a time may,
    adds an equal entry and changes no finding. The findings are of all blobs that the ledger knows.
    """
    spark = versions.sparkSession
    scan = scan_blobs(versions, content, rules, read_ledger(spark, folder))
    scan.entries.write.mode("append").parquet(folder)
    return gathered(_today(read_ledger(spark, folder), rules).distinct(), "blob")


def _entries(tried: DataFrame, found: DataFrame) -> DataFrame:
    return tried.join(found, "blob", "left").withColumn("found", F.coalesce("found", F.expr(EMPTY)))


def scan_paths(versions: DataFrame, content: str, keep: list[str], folder: str | None = None, **options) -> DataFrame:
    """``keep`` columns of every path and ``found``, its blob's spans (empty if none); repeated paths stay rows.

    With ``folder`` the ledger there is used and updated: see ``update_ledger``. The new column avoids the names in
    ``keep``; it is the last one.
    """
    known = update_ledger(versions, content, folder, **options) if folder else scan_blobs(versions, content, **options).findings
    # written, so that the join below shuffles both sides anew and can split a blob of very many paths
    findings = reliable(known)
    kept = versions.select(*(F.col(f"`{c}`") for c in keep))
    blob, found = unused(kept, "blob"), unused(kept, "found")
    paths = versions.select(*(F.col(f"`{c}`") for c in keep), blob_id(F.col(f"`{content}`")).alias(blob))
    findings = findings.select(F.col("blob").alias(blob), F.col("found").alias(found))
    joined = paths.join(findings, blob, "left")
    return joined.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(found), F.expr(EMPTY)).alias(found))


def redact(docs: DataFrame, text: str = "text", marker: str = "[SECRET]", length: str | None = None, **options) -> DataFrame:
    """The documents, all columns, with the marker in place of each secret; ``length`` names a column that follows the text."""
    scanned = scan_paths(docs, text, docs.columns, **options)
    found = F.col(scanned.columns[-1])
    body = F.col(f"`{text}`")
    clean = replaced(body, found, lambda _: F.lit(marker))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.when(F.size(found) > 0, clean).otherwise(body).alias(c))
        elif c == length:
            columns.append(F.when(F.size(found) > 0, F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return scanned.select(*columns)
