"""Quality rules, by DataFrame functions alone: counts of a text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets. The buckets' counts over a trusted target and over
the whole raw corpus are two multinomials; a document's ratio is the mean, over its n-grams, of the logarithm of
the target's probability over the corpus's. A document is kept if the ratio reaches a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import reliable

#: White space: what separates words.
BLANK = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _neighbours(a: Column, b: Column) -> Column:
    """Hashes of neighbours: element i of ``a`` with element i + 1 of ``b``."""
    n = F.greatest(F.size(b) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(2), n), lambda x, y: F.xxhash64(x, y))


def with_hashes(docs: DataFrame, text: str, words: str, pairs: str) -> DataFrame:
    """Columns ``words`` and ``pairs``: 64-bit hashes of the words, and of each two neighbours."""
    split = F.array_remove(F.split(_body(text), BLANK), "")
    docs = docs.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    return docs.withColumn(pairs, _neighbours(F.col(words), F.col(words)))


def _repeated(triples: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""
    # equal windows are neighbours once (hash, place) are sorted
    places = F.sort_array(
        F.zip_with(triples, F.sequence(F.lit(0), F.size(triples) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    same = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    again = F.flatten(
        F.transform(
            F.array(places),
            lambda s: F.filter(F.transform(s, lambda x, k: F.when(same(s, k, k - 1) | same(s, k, k + 1), x["i"])), lambda i: i.isNotNull()),
        )
    )
    words = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(F.array_distinct(triples)) < F.size(triples), words).otherwise(F.lit(0))


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), words and pairs (hashes).

    Words are runs without white space (space and U+0009 to U+000D); lengths are code points; a line counts as a
    duplicate if it has a word and equals an earlier one. Equality of 3-word windows within a text is that of 64-bit
    hashes. Null texts have no words. Columns of ``keep`` that have one of these names are an error of the caller.
    """
    body = F.col("text_")
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), _body(text).alias("text_"))
    rows = with_hashes(rows, "text_", "words", "pairs")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # neighbouring pairs overlap in a word: together they are three words
    rows = rows.withColumn("triples", _neighbours(F.col("pairs"), F.col("pairs"))).withColumn("lines", lines)
    return rows.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(body, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("triples")).cast("long").alias("n_repeat_words"),
        "words", "pairs",
    )


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _buckets(words: str, pairs: str, n_buckets: int) -> Column:
    return F.transform(F.concat(words, pairs), lambda h: F.pmod(h, F.lit(n_buckets)).cast("int"))


def trusted_ids(labels: DataFrame, doc_id: str, label: str, most: int | None = None) -> DataFrame:
    """Ids of documents labelled 1 and never 0: all, or ``most`` of them, those first by a hash."""
    good = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("label")).dropna()
    good = good.groupBy("id").agg(F.min("label").alias("label")).filter("label = 1").select("id")
    return good if most is None else good.orderBy(F.xxhash64("id"), "id").limit(most)


def trusted_rows(docs: DataFrame, trusted: DataFrame, text: str, doc_id: str, n_bits: int = 1 << 23) -> DataFrame:
    """(id, text) of the documents whose id is in ``trusted`` (unique ids in a column ``id``), null ids never.

    A bitmap of ``n_bits`` hashed ids, a constant of the plan at every size, drops nearly all other rows before the
    texts are shuffled; the exact join decides. Its strategy is fixed, so that small and large inputs take the same plan.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    ids = trusted.select(F.col("id").cast(rows.schema["id"].dataType).alias("id"))
    spot = F.pmod(F.xxhash64("id"), F.lit(n_bits)).alias("spot")
    bit = "shiftleft(1L, CAST(spot % 64 AS INT))"
    words = ids.select(spot).groupBy(F.expr("spot div 64").alias("word")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    every = docs.sparkSession.range(n_bits // 64).withColumnRenamed("id", "place").join(words, F.col("place") == F.col("word"), "left")
    in_order = F.sort_array(F.collect_list(F.struct("place", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bitmap = every.agg(F.transform(in_order, lambda x: x["bits"]).alias("bitmap")).scalar()
    possible = rows.select("id", "text", spot).withColumn("bitmap", bitmap).filter(F.expr(f"get(bitmap, CAST(spot div 64 AS INT)) & {bit} <> 0"))
    return possible.select("id", "text").join(ids.hint("shuffle_hash"), "id", "left_semi")


def bucket_weights(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    n_buckets: int = 1 << 16, most_trusted: int | None = None, smoothing: float = 1.0,
) -> DataFrame:
    """(bucket, weight): the log-likelihood ratio of target and corpus for each bucket that occurs; 0 without a target.

    The corpus counts cover every n-gram of every document, in a scan without a join; the target's are those of all
    ``trusted_ids``, the only texts that are shuffled. Counts are summed per task before the shuffle: never more than
    ``n_buckets`` rows from a task. They are counted once, when this is called, and written to the checkpoint folder.
    """
    trusted = trusted_ids(labels, doc_id, label, most_trusted)

    def count(rows: DataFrame, name: str) -> DataFrame:
        grams = with_hashes(rows, "text", "words", "pairs").select(F.explode(_buckets("words", "pairs", n_buckets)).alias("bucket"))
        return grams.groupBy("bucket").agg(F.count("*").alias(name))

    raw = count(docs.select(F.col(f"`{text}`").alias("text")), "raw")
    target = count(trusted_rows(docs, trusted, text, doc_id), "target")
    counts = reliable(raw.join(target, "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target")))
    raw_all, target_all = counts.agg(F.sum("raw"), F.sum("target")).first()
    if not target_all:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    share = lambda n, total: (F.col(n) + smoothing) / (total + smoothing * n_buckets)
    return counts.select("bucket", F.log(share("target", target_all) / share("raw", raw_all)).alias("weight"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = -0.1, n_buckets: int = 1 << 16, **options
) -> DataFrame:
    """One row per document: doc_id, the counts of ``text_counts``, base_failed, ratio and kept.

    ``ratio`` is the mean weight of the document's words and pairs, 0 for a text without words. A document is kept if
    it passes the base rules and its ratio is at least ``threshold``: the same for every document, at every size.
    Without labels the target is flat and says nothing: the ratio is 0 and the base rules decide.

    Null and empty texts have zero counts and fail. Null doc_ids are never trusted but are judged. Repeated rows are
    judged each, and counted each in the corpus. The weights are ``n_buckets`` numbers and go to every task.
    """
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = text_counts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), ["doc_id"], "text")
    weights = bucket_weights(docs, labels, text, doc_id, n_buckets=n_buckets, **options)
    # all buckets in order as one array, a scalar of the plan: no document is exploded or joined
    every = docs.sparkSession.range(n_buckets).join(weights, F.col("id") == F.col("bucket"), "left")
    by_bucket = F.sort_array(F.collect_list(F.struct("id", F.coalesce("weight", F.lit(0.0)).alias("weight"))))
    table = every.agg(F.transform(by_bucket, lambda x: x["weight"]).alias("weights"))
    rows = counted.select(*counts, _buckets("words", "pairs", n_buckets).alias("grams"))
    total = F.aggregate("grams", F.lit(0.0), lambda a, bucket: a + F.get(F.col("weights"), bucket))
    # each column is used once here, so that the optimizer puts the scalar into the sum
    summed = rows.withColumn("weights", table.scalar()).select(*counts, total.alias("total"))
    n_grams = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    scored = summed.select(*counts, F.when(n_grams > 0, F.col("total") / n_grams).otherwise(F.lit(0.0)).alias("ratio"))
    scored = scored.withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
