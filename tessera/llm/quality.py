"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials over the buckets are counted, one on
trusted documents (labelled good and not toxic), one on all documents. A document's score is the sum of log ratios of
its n-grams divided by their number, and every document with a score under a threshold is rejected.

The threshold comes from labels alone. Half of the trusted documents (by hash of the id) are held out of the target
multinomial, so they score as clean documents without a label do. With q the ``TAIL`` quantile of their scores and m the
median, the threshold is q - (m - q) / 2: below the tail by half of what the tail is below the middle. Where trusted text is thin,
held-out scores spread more, and the threshold falls with them. What n held-out documents say is weighed against a prior
of ``PRIOR``, under which hardly any document falls, that counts as ``PRIOR_WEIGHT`` documents: with few of them little is
rejected, and more labels move the threshold steadily.

Scale. DataFrame functions only. Counts cover all documents and all trusted ones; the aggregate is partial first and has at
most one row for each bucket and task. Trusted documents are met by a join on their ids behind a Bloom filter of fixed size,
so texts that it rejects are not shuffled; the held-out half is scored once more. Quantiles of its scores come from counts
of cells of ``CELL``, at most ``CELLS`` rows, so no task holds all scores. Scoring reads the ratios as one array of fixed length.
Each document is judged within its row.

Nulls and empty texts have no words and fail the base rules. Without trusted documents or any words the ratios are 0,
and only the base rules reject. An id with several labels is trusted if one of them is good and not toxic and none is
another. Repeated rows are judged alike, rows without an id as unlabelled. Extra columns are kept by ``quality_filter``,
whatever their names, and ignored by ``quality_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, marked, prefilter, stage, table
from .native import BLANK, buckets_of, filled, hashes_of, let, parts_of, summed, windows_of, words_of

SYMBOLS = "#*$%&|<>"
#: Added to the number of n-grams: scores of very short texts, which say little, move towards 0.
SHRINK = 20
#: Quantile of held-out trusted scores that the threshold starts from.
TAIL = 0.005
#: Held-out scores are counted in cells of this width, at most so many each side of 0; a cell stands for its middle.
CELL, CELLS = 1e-4, 1 << 18
#: Threshold without any held-out document, and how many of them it counts for.
PRIOR, PRIOR_WEIGHT = -6.0, 20


def repeated_words(windows: Column, k: int) -> Column:
    """Number of words covered by windows (of k words) that occur twice or more."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(k))).alias("n")), lambda acc: acc["n"])

    def sorted_pairs(w: Column) -> Column:
        return F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(sorted_pairs(w), covered))).cast("long")


def fives_of(hashes: Column, pairs: Column) -> Column:
    """Hash of every 5 consecutive words, from those of words and of word pairs."""
    all_places = F.transform(pairs, lambda p, i: F.xxhash64(p, F.get(pairs, i + 2), F.get(hashes, i + 4)))
    return F.slice(all_places, F.lit(1), F.greatest(F.size(hashes) - 4, F.lit(0)))


def statistics(text: Column, parts: Column, hashes: Column, pairs: Column) -> dict[str, Column]:
    """``parts``: between blanks (``parts_of``); ``hashes`` and ``pairs`` of its words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{BLANK}]")))
    return {
        "n_words": F.size(hashes).cast("long"),
        "word_chars": (F.length(text) - F.size(parts) + 1).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(fives_of(hashes, pairs), 5),
    }


def _trusted(labels: DataFrame) -> DataFrame:
    """doc_id, held (kept out of the target multinomial) of all trusted documents."""
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0))
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(good.alias("good")).where("good = 1").select("doc_id")
    return ids.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(2)) == 1)


def _quantiles(scores: DataFrame, *shares: float) -> DataFrame:
    """One row: ``n`` and, for each share, ``q0``, ``q1``, ...: the score at that share of all scores, interpolated between
    the middles of the cells of its two neighbours."""
    cell = F.greatest(F.least(F.floor(F.col("score") / CELL), F.lit(CELLS - 1)), F.lit(-CELLS))
    cells = scores.where("score is not null").groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("cell"))  # at most 2 * CELLS rows
    x = cells.select(((F.col("cell") + 0.5) * CELL).alias("value"), upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("n"))
    at = [(F.col("n") - 1) * F.lit(q) for q in shares]
    value = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    ends = [value(F.floor(p)) + (value(F.ceil(p)) - value(F.floor(p))) * F.max(p - F.floor(p)) for p in at]
    return x.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[e.alias(f"q{i}") for i, e in enumerate(ends)])


def _score(hashes: Column, values: Column, buckets: int, pairs: Column | None = None) -> Column:
    return summed(hashes, values, buckets, pairs) / (2 * F.size(hashes) + SHRINK)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """One row: ``ratios`` (log(target / raw) by bucket, add-one smoothed) and ``threshold``."""
    good = stage(_trusted(labels), "trusted")
    known = docs.select("doc_id", "text")
    split = marked(known, "doc_id", good, "_maybe")
    some = split.where("_maybe").select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("text", "held")
    grams = split.where("not _maybe").select("text", F.lit(None).cast("boolean").alias("held")).union(some)
    grams = grams.select((~F.coalesce("held", F.lit(True))).cast("int").alias("target"), F.explode(let(hashes_of(words_of(F.col("text"))), lambda h: buckets_of(h, buckets))).alias("bucket"))
    counts = stage(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target")), "grams")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    n_raw, n_target = total.select("all_raw").scalar(), total.select("all_target").scalar()
    part = lambda count, n: F.ln((F.coalesce(count, F.lit(0)) + 1) / (n + buckets))
    value = F.when(n_target > 0, part(F.col("target"), n_target) - part(F.col("raw"), n_raw)).otherwise(0.0)
    ratios = stage(filled(counts, buckets, value, "ratios"), "ratios")
    out = good.where("held").select("doc_id")
    held = prefilter(known, "doc_id", out).join(out.hint("merge"), "doc_id").select("text", ratios.scalar().alias("ratios"))
    held = held.select(let(hashes_of(words_of(F.col("text"))), lambda h: F.when(F.size(h) >= 10, _score(h, F.col("ratios"), buckets))).alias("score"))
    n, middle, low = F.col("n"), F.col("q0"), F.col("q1")
    limit = (n * F.coalesce(1.5 * low - 0.5 * middle, F.lit(0.0)) + PRIOR_WEIGHT * PRIOR) / (n + PRIOR_WEIGHT)
    limit = stage(_quantiles(held, 0.5, TAIL).select(limit.alias("threshold")), "threshold")
    return ratios.withColumn("threshold", limit.scalar())


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = 1 << 16) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept. ``threshold`` in
    place of the one that labels give."""
    fitted = log_ratios(docs, labels, buckets)

    def measured(parts: Column, hashes: Column, pairs: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in statistics(F.col("text"), parts, hashes, pairs).items()], _score(hashes, F.col("ratios"), buckets, pairs).alias("score"))

    x = let(parts_of(F.col("text")), lambda p: let(hashes_of(F.array_remove(p, "")), lambda h: let(windows_of(h, 2), lambda w: measured(p, h, w))))
    out = docs.select("doc_id", "text", fitted.select("ratios").scalar().alias("ratios")).select("doc_id", x.alias("x")).select("doc_id", "x.*")
    limit = fitted.select("threshold").scalar() if threshold is None else F.lit(threshold)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= limit))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = 1 << 16) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    fitted = log_ratios(docs, labels, buckets)
    ratios, limit = free_name(docs, "ratios"), free_name(docs, "limit")

    def passes(hashes: Column, pairs: Column) -> Column:
        n = F.size(hashes)
        return (n >= 10) & (_score(hashes, F.col(ratios), buckets, pairs) >= F.col(limit)) & (100 * repeated_words(fives_of(hashes, pairs), 5) <= 20 * n)

    kept = let(hashes_of(words_of(F.col("text"))), lambda h: let(windows_of(h, 2), lambda w: passes(h, w)))
    own = fitted.select("threshold").scalar() if threshold is None else F.lit(threshold)
    return docs.withColumn(ratios, fitted.select("ratios").scalar()).withColumn(limit, own).where(kept).select(docs.columns)


def op8_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
