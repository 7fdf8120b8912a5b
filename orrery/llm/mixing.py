"""Operator 10: mixing sources to target weights, on DataFrame operations only.

Every document gets a key that a hash of its id fixes (of its text, if it has no id). The keys cut each
source into ranges (the first hexadecimal digits of the key); sizes are summed
per range before anything is ordered, the sums of the ranges are added up in
key order, and inside each range a window adds up single documents. So a
source with a third of all rows is spread over `16 ** range_digits` ranges.
Each source is cut where the running sum meets its budget: the document on
the edge gives just the words that are missing. A budget beyond the source's
size takes whole epochs first.

Cases: null text counts 0 words and takes 0; a null source is one source,
placed last; repeated (doc_id, text) rows are separate rows and ordered by
size and row content, so ties are harmless (equal rows share out the same
words whichever comes first); an empty table gives an empty table; extra
columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, only

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds 3/2 of all words; a source gives 2 times its words at most.
TOTAL_NUM, TOTAL_DEN, MOST_EPOCHS = 3, 2, 2


def word_count(text: Column) -> Column:
    """Words in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources saturate in the order of cap / weight, so resharing the excess
    until no target is above its cap is one ordered pass: source k is capped
    when its cap is at most its weighted share of what the earlier ones left.
    One row per source is ordered here, never one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rk", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rk") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most_epochs)
    ratio = F.col("cap") / F.col("weight")
    upto = Window.orderBy(ratio, "rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.orderBy(ratio, "rk").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(ratio, "rk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole) * TOTAL_NUM)
        .withColumn("cap_before", (F.sum("cap").over(upto) - F.col("cap")) * TOTAL_DEN)
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("capped", F.col("cap") * TOTAL_DEN * F.col("weight_left") <= (F.col("total") - F.col("cap_before")) * F.col("weight"))
    )
    left = F.min(F.when(~F.col("capped"), F.struct((F.lit(-1) * F.col("weight_left")).alias("w"), F.col("total"), F.col("cap_before")))).over(whole)
    share = (F.col("left.total") - F.col("left.cap_before")) * F.col("weight") / (F.lit(-TOTAL_DEN) * F.col("left.w"))
    return filled.withColumn("left", left).select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, range_digits: int = 3) -> DataFrame:
    """(doc_id, source, text, ...) -> doc_id, size, source, source_size, target, taken."""
    keyed = only(docs, "doc_id", "source", "text").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.xxhash64("text").cast("string"))).cast("binary")).alias("key")
    )
    keyed = keyed.withColumn("rng", F.substring("key", 1, range_digits))
    ranges = keyed.groupBy("source", "rng").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("rng").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most_epochs)
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    offsets = (
        ranges.withColumn("offset", F.sum("range_size").over(before) - F.col("range_size"))
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").alias("o_source"), F.col("rng").alias("o_rng"), "offset", "source_size", "target")
    )
    inside = Window.partitionBy("source", "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("rng") == F.col("o_rng"))
    )
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    start = F.col("offset") + F.col("upto") - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), budget - epochs * F.col("source_size") - start))
    return placed.select(
        "doc_id", "size", "source", "source_size", F.col("target"), (epochs * F.col("size") + part).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of documents: one row per epoch that a document is in, columns unchanged.

    The document on a source's edge is in once more if at least half of it is
    taken; a document without words is never in. Documents are told apart by
    doc_id, so equal rows are the same document and are taken alike.
    """
    plan = mix(docs, **options)
    per_doc = plan.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = per_doc.select(
        F.col("doc_id").alias("m_id"),
        F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int").alias("times"),
    ).filter("times > 0")
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["m_id"]))
    return joined.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 2 * source_size AS cap FROM r),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT * 3 AS total,
  2 * (sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS UNBOUNDED PRECEDING) - cap)::BIGINT AS cap_before,
  (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left FROM w),
g AS (SELECT *, cap * 2 * weight_left <= (total - cap_before) * weight AS capped FROM f),
h AS (SELECT min(CASE WHEN NOT capped THEN {'w': -weight_left, 'total': total, 'cap_before': cap_before} END) AS l FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE ((l.total - l.cap_before) * weight)::DOUBLE / (-2 * l.w)::DOUBLE END AS target FROM g, h),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + least(size, greatest(0, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM p
"""


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, mixed."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
