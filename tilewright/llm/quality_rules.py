"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Only DataFrame functions.  Two multinomials over hashed word unigrams and bigrams are counted: one over
all documents, one over the trusted target, all labelled good documents.  A document's score is the mean of
log p_target - log p_corpus over its n-grams; documents whose score is below the threshold go.  Nothing is
drawn at random, so the verdict on a document is always the same.

Texts that are null or empty have no words, fail the base rules and score 0.  Without target documents all
scores are 0 and the base rules alone decide.  Rows are independent: repeated rows repeat, extra columns
are ignored, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.sources.scratch import BROADCAST_ROWS, stage

#: Buckets of the two multinomials.
BUCKETS = 1 << 16
#: Documents that score less go.
THRESHOLD = -0.15
#: Pseudo-count of a bucket in the target, in units of the corpus's share of the bucket.
PRIOR = 2.0 * BUCKETS
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 0.3
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _windows(h: Column, size: int) -> Column:
    """A hash for each run of ``size`` words; null-free, empty if there are too few words."""
    n = F.size(h)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _recurring(windows: Column) -> Column:
    """The (hash, place) of a text's windows in order of the hash; empty if no window recurs."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed).otherwise(F.array().cast("array<struct<w:bigint,i:int>>"))


def _places(by_hash: Column) -> Column:
    """The places of windows that the text has twice or more, in order."""
    same = lambda k, x: F.coalesce(F.get(by_hash, k)["w"] == x["w"], F.lit(False))
    marked = F.transform(by_hash, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _covered(places: Column, size: int) -> Column:
    """Words that lie in the windows at these places."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-size).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def _buckets(h: Column) -> Column:
    """The buckets of a text's unigrams and bigrams."""
    into = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(h, into), F.transform(_windows(h, 2), into))


def _hashed(docs: DataFrame, *columns: str) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.coalesce("text", F.lit("")).alias("text"))
    words = text.select("doc_id", *columns, words_of(F.col("text")).alias("words"))
    return words.select("doc_id", *columns, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def ratios(docs: DataFrame, labels: DataFrame) -> Column:
    """log p_target - log p_corpus of every bucket in millionths, as an array literal of BUCKETS numbers."""
    target = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("target_id")).filter("target_id is not null").distinct()
    target = stage(target, "target")
    target = F.broadcast(target) if target.count() <= BROADCAST_ROWS else target
    seen = _hashed(docs.select("doc_id", "text").join(target, F.col("doc_id").cast("long") == F.col("target_id"), "left"), "target_id")
    counts = (
        seen.select(F.col("target_id").isNotNull().cast("bigint").alias("t"), F.explode(_buckets(F.col("h"))).alias("b"))
        .groupBy("b").agg(F.count("*").alias("c"), F.sum("t").alias("t"))
    )
    # BUCKETS rows from here on
    each = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("t", F.lit(0)).alias("t"))
    total = each.agg(F.sum("c").alias("all_c"), F.sum("t").alias("all_t"), F.sort_array(F.collect_list(F.struct("b", "c", "t"))).alias("seen"))
    share = lambda x: (x["c"] + 1.0) / (F.col("all_c") + F.lit(float(BUCKETS)))
    log_ratio = lambda x: F.log((x["t"] + PRIOR * share(x)) / (F.col("all_t") + PRIOR)) - F.log(share(x))
    text = total.select(F.concat_ws(",", F.transform("seen", lambda x: F.round(1e6 * log_ratio(x)).cast("int").cast("string")))).first()[0]
    return F.split(F.lit(text), ",").cast("array<int>")  # folded to an array when the plan is made


def _scored(docs: DataFrame, ratio: Column, threshold: float) -> DataFrame:
    """The rules' columns, behind ``row``, the whole row that they are about."""
    text = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    shaped = text.select(
        "row", words_of(F.col("text")).alias("words"), F.length(F.regexp_replace("text", SPACES, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), lines.alias("lines"),
    )
    hashed = shaped.select(
        "row", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    scored = hashed.select(
        "row", F.size("h").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        _windows(F.col("h"), WINDOW).alias("windows"),
        F.aggregate(_buckets(F.col("h")), F.lit(0).cast("bigint"), lambda a, i: a + F.get(ratio, i)).alias("sum"),
    )
    scored = scored.select(*[c for c in scored.columns if c != "windows"], _recurring(F.col("windows")).alias("by_hash"))
    scored = scored.select(*[c for c in scored.columns if c != "by_hash"], _places(F.col("by_hash")).alias("places"))
    scored = scored.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("places"), WINDOW).alias("n_repeat_words"),
        F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.col("sum") / (1e6 * (2 * F.col("n_words") - 1))).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score."""
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios(docs, labels), threshold)
    return scored.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    scored = _scored(docs, ratios(docs, labels), threshold)
    # the verdict goes through a generator: a condition on what a generator makes can't be pushed below it, where
    # every expression in it would be written out again wherever it is used, inside lambdas even
    judged = scored.select(F.explode(F.array(F.struct("row", "kept"))).alias("judged"))
    return judged.filter("judged.kept").select("judged.row.*")
