"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    compact_windows,
    conversation_repair,
    disclosure,
    entropy_difference,
    gray_simhash,
    license_templates,
    ngram_ratio,
    pairwise_quality,
    periodic_runs,
    residual_packing,
    secret_ledger,
    spans,
    vector_graph,
    wu_manber,
)
from shelfwise.llm.common import checkpoint_folder, read_table


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, digest of their spans, and all spans.

    The ledger in the shared checkpoint folder outlives the query: texts it knows are not scanned again.
    """
    ledger = f"{checkpoint_folder(spark)}/secret-ledger"
    scanned = secret_ledger.scan_paths(read_table(spark, folder, "documents"), "text", ["doc_id"], ledger)
    base = [r.kind for r in secret_ledger.BASE_RULES]
    counts = (spans.count_kind(F.col("found"), kind).alias(f"n_{kind}") for kind in base)
    digest = F.sha2(spans.joined(F.col("found"), base), 256).alias("base_sha256")
    return scanned.select("doc_id", *counts, digest, spans.joined(F.col("found")).alias("spans"))


def op2_residual_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; a row per piece."""
    return residual_packing.pack(read_table(spark, folder, "documents"))


def op3_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the log-likelihood ratio's verdict for every document."""
    judged = ngram_ratio.quality_rules(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def op4_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    """The losses of every document under the target's and the background's model."""
    docs = read_table(spark, folder, "documents")
    trusted = ngram_ratio.trusted_ids(read_table(spark, folder, "labels"), "doc_id", "quality")
    return entropy_difference.score(docs, trusted)


def op5_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learnt outside the held-out quarter."""
    docs = read_table(spark, folder, "documents")
    model = pairwise_quality.learn(docs, read_table(spark, folder, "labels"))
    scored, score = pairwise_quality.score_documents(docs, model, ["doc_id"])
    accepted = F.when(F.col(score) >= pairwise_quality.ACCEPT, 1).otherwise(0)
    return scored.select("doc_id", pairwise_quality.held_out(F.col("doc_id")).alias("held_out"), score, accepted.alias("predicted"))


def op6_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of every document: counts of the kinds, digest of their spans, and all spans with disclosing terms."""
    found = disclosure.find_personal_data(read_table(spark, folder, "documents"), ["doc_id"])
    counts = (spans.count_kind(F.col("found"), kind).alias(f"n_{kind}") for kind in disclosure.KINDS)
    digest = F.sha2(spans.joined(F.col("found"), disclosure.KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, spans.joined(F.col("found")).alias("spans"))


def op7_gray_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint and the component of every document."""
    groups = gray_simhash.near_duplicates(read_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words or more that other documents hold too."""
    return compact_windows.repeated_passages(read_table(spark, folder, "documents"))


def op9_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs, benchmark = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    found, name = wu_manber.find_benchmark_passages(docs, benchmark, ["doc_id"])
    n_hit = wu_manber.hit_words(name["runs"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items").select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        wu_manber.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op10_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and accepted templates in every document."""
    found, name = license_templates.scan_licenses(read_table(spark, folder, "documents"), ["doc_id"])
    phrases, templates = F.col(name["phrases"]), F.col(name["templates"])
    starts = F.transform(phrases, lambda m: m["first"])
    return found.select(
        "doc_id", "n_words", F.size(phrases).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), license_templates.labels_of(phrases).alias("base_labels"),
        license_templates.labels_of(phrases, templates).alias("labels"),
        license_templates.covered_share(F.col("n_words"), phrases, templates).alias("score"),
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which have words repeated on purpose."""
    docs = periodic_runs.repeat_words(read_table(spark, folder, "documents"))
    found, name = periodic_runs.collapse_runs(docs, ["doc_id"])
    runs, best = F.col(name["runs"]), F.col("best")
    found = found.withColumn("best", periodic_runs.strongest(runs))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(runs), 256).alias("runs_sha256"), F.sha2(name["collapsed"], 256).alias("collapsed_sha256"),
    )


def op12_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 rows found nearest to every hundredth vector."""
    vectors = read_table(spark, folder, "embeddings")
    return vector_graph.search_index(vector_graph.build_index(vectors), vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every conversation, damaged on purpose, its cheapest edits and the digest of what they leave."""
    conversations = read_table(spark, folder, "conversations")
    turns, report = conversation_repair.repair(conversation_repair.damage(conversations))
    digests = conversation_repair.digests(turns).withColumnRenamed("conversation", "same")
    report = report.join(digests, F.col("conversation").eqNullSafe(F.col("same")), "left")
    every = conversations.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("conversation")), "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    digest = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_residual_packing, op3_ngram_ratio, op4_entropy_difference, op5_pairwise_quality, op6_disclosure,
        op7_gray_simhash, op8_compact_windows, op9_wu_manber, op10_license_templates, op11_periodic_runs, op12_vector_graph,
        op13_conversation_repair,
    )
}

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _spans_sql(source: str, key: str, text: str, rules: list[tuple[str, str, str]]) -> str:
    """Spans of (kind, RE2 pattern, condition on match): gaps and matches by position, summed up."""
    parts = []
    for rank, (kind, pattern, holds) in enumerate(rules):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT {key}, '{kind}' AS kind, {rank} AS rank, stop - length(match) AS start, stop, match FROM (SELECT *, "
            f"SUM(length(gap) + length(match)) OVER (PARTITION BY {key} ORDER BY nth) AS stop FROM (SELECT {key}, unnest(m) AS match, "
            f"unnest(gaps[1:len(m)]) AS gap, generate_subscripts(m, 1) AS nth FROM (SELECT {key}, regexp_extract_all({text}, '{quoted}') AS m, "
            f"string_split_regex({text}, '{quoted}') AS gaps FROM {source}))) WHERE {holds}"
        )
    return " UNION ALL ".join(parts)


_SPAN = "kind || ':' || start || ':' || stop"


def _report_sql(key: str, base: list[str], frame: str) -> str:
    """Counts of the base kinds, digest of their spans, and all spans, per document."""
    kinds = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"COUNT(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""SELECT doc_id, {counts}, sha256(COALESCE(STRING_AGG({_SPAN}, ',' ORDER BY start, rank) FILTER (kind IN ({kinds})), '')) AS base_sha256,
  COALESCE(STRING_AGG({_SPAN}, ',' ORDER BY start, rank), '') AS spans
FROM {frame} GROUP BY {key}, doc_id"""


def _secret_sql() -> str:
    rules = []
    for rule in secret_ledger.RULES:
        pattern = rule.pattern.replace("}+", "}")
        quoted = pattern.replace("'", "''")
        rules.append((rule.kind, pattern, f"length(regexp_extract(match, '{quoted}', 2)) >= 6" if rule.kind == "assign" else "true"))
    return f"""WITH docs AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, COALESCE(text, '') AS text FROM documents),
spans AS ({_spans_sql("docs", "row", "text", rules)})
{_report_sql("row", [r.kind for r in secret_ledger.BASE_RULES], "docs LEFT JOIN spans USING (row)")}"""


def _disclosure_sql(context: int = 80, generalise_at: str = "0.5e0", remove_at: str = "0.9e0", doubt: str = "0.75e0", least_holders: int = 4) -> str:
    """Identifiers by plain patterns; terms beside them and elsewhere by counting over the texts and their copies."""
    digits = "regexp_replace(match, '[^0-9]', '', 'g')"
    figure = f"CAST({digits}[i] AS INT)"
    luhn = (
        f"list_sum([CASE WHEN (len({digits}) - i) % 2 = 0 THEN {figure} WHEN {figure} > 4 THEN 2 * {figure} - 9 ELSE 2 * {figure} END "
        f"FOR i IN generate_series(1, len({digits}))])"
    )
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "len([x FOR x IN string_split(match, '.') IF len(ltrim(x, '0')) > 3 OR CAST('0' || ltrim(x, '0') AS HUGEINT) > 255]) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({digits}) BETWEEN 12 AND 19 THEN {luhn} % 10 = 0 ELSE false END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 9 AND 15"),
    ]
    n, term = len(rules), r"\p{L}+"
    words = [("word", f"{rules[0][1]}|{term}", "strpos(match, '@') = 0")]
    return f"""WITH docs AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, COALESCE(text, '') AS text FROM documents),
texts AS (SELECT ROW_NUMBER() OVER () AS c, text, COUNT(*) AS copies FROM docs GROUP BY text),
base AS ({_spans_sql("texts", "c", "text", rules)}),
named AS (SELECT base.*, kind || ':' || CASE WHEN kind = 'email' THEN lower(match) ELSE {digits} END AS entity, text, copies
  FROM base JOIN texts USING (c)),
sides AS (SELECT ROW_NUMBER() OVER () AS s, * FROM (
  SELECT DISTINCT c, entity, copies, length(text) AS size, GREATEST(start - {context}, 0) AS lo,
    substring(text, CAST(GREATEST(start - {context}, 0) + 1 AS BIGINT), CAST(LEAST(start, {context}) AS BIGINT)) AS side FROM named
  UNION SELECT DISTINCT c, entity, copies, length(text), stop, substring(text, CAST(stop + 1 AS BIGINT), {context}) FROM named)),
words AS ({_spans_sql("sides", "s", "side", [("term", term, "true")])}),
terms AS (SELECT c, entity, copies, lo + start AS start, lo + stop AS stop, lower(match) AS term FROM words JOIN sides USING (s)
  WHERE NOT (start = 0 AND lo > 0) AND NOT (stop = length(side) AND lo + length(side) < size)),
holding AS (SELECT DISTINCT c, entity, copies FROM named),
entities AS (SELECT entity, SUM(copies) AS with_entity FROM holding GROUP BY entity),
often AS (SELECT c, entity, copies FROM holding JOIN entities USING (entity) WHERE with_entity >= {least_holders}),
held AS (SELECT c, text FROM texts WHERE c IN (SELECT c FROM often)),
whole AS ({_spans_sql("held", "c", "text", words)}),
elsewhere AS (SELECT c, start, stop, lower(match) AS term FROM whole),
seen AS (SELECT c, entity, copies, term, MAX(weight) AS weight FROM (SELECT c, entity, copies, term, 5 AS weight FROM terms
  UNION ALL SELECT c, entity, copies, term, 1 FROM often JOIN elsewhere USING (c)) GROUP BY ALL),
pairs AS (SELECT entity, term, SUM(copies) AS together, SUM(copies * weight) / 5e0 AS met FROM seen GROUP BY entity, term),
with_terms AS (SELECT term, SUM(copies) AS with_term FROM
  (SELECT DISTINCT c, copies, lower(unnest(regexp_extract_all(text, '{term}'))) AS term FROM texts) GROUP BY term),
shares AS (SELECT entity, term, log2(together * (SELECT COUNT(*) FROM docs) / (with_entity * with_term))
    / NULLIF(-log2(with_entity / (SELECT COUNT(*) FROM docs)), 0) * met / (met + {doubt}) AS share
  FROM pairs JOIN entities USING (entity) JOIN with_terms USING (term)),
found AS (SELECT c, start, stop, MAX(share) AS share FROM (SELECT c, start, stop, share FROM terms JOIN shares USING (entity, term)
  UNION ALL SELECT c, start, stop, share FROM elsewhere JOIN often USING (c) JOIN shares USING (entity, term))
  WHERE share >= {generalise_at} GROUP BY c, start, stop),
spans AS (SELECT c, kind, rank, start, stop FROM base UNION ALL
  SELECT c, CASE WHEN share >= {remove_at} THEN 'term_removed' ELSE 'term' END, CASE WHEN share >= {remove_at} THEN {n + 1} ELSE {n} END, start, stop FROM found)
{_report_sql("row", [k for k, _, _ in rules], "docs JOIN texts USING (text) LEFT JOIN spans USING (c)")}"""


def _benchmark_sql() -> str:
    """Windows of items joined with all runs of as many words of the documents."""
    words = rf"regexp_extract_all(translate(COALESCE(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, LEAST(13, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM runs JOIN windows USING (n, g)),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, COUNT(*) AS n_items, STRING_AGG(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(names, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


#: What SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": _secret_sql(), "op6_disclosure": _disclosure_sql(), "op9_wu_manber": _benchmark_sql()}
