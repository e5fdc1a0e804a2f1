"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / quality`` (``u`` from a hash of its id, so reruns agree). A source
takes its whole epochs first; the rest of its token budget is filled in key order within the source. Only sums cross
the network: keys fall into ``1 - exp(-key)`` bins, bins are summed per source (pre-aggregated in each task), and exact
order is needed only inside the one bin per source where the budget ends. What is left of a source is a single
``(bin, key, id, hash)`` cut, so the selection is a comparison in the scan: neither a hot source nor any text is moved.

Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; repeated
rows share a key and stand or fall together; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import WORD, fresh, stash, text_or_empty

#: Rows that a bin holds on average. The number of bins follows the number of rows.
BIN_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters and white space, 0.05 at least: junk is drawn later."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.lit(0.05) + F.lit(0.95) * (F.lit(1.0) - odd / F.greatest(F.length(text), F.lit(1)))


def uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from 48 bits of an MD5 of the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source, total`` -> also ``target``: shares of ``share`` times all sizes by weight, at most ``cap`` times a source's size.

    The reshared excess has a closed form: sources ordered by ``cap * total / weight`` fill up one after the other, and
    the water level is right at the first source that it does not fill. One row per source.
    """
    at = Window.orderBy(F.col("source").isNull(), F.col("source"))
    up = Window.orderBy("full_at", F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(cap) * F.col("total")).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = t.withColumn("left", F.lit(share) * F.sum("total").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = F.when(F.col("left") / F.col("open") <= F.col("full_at"), F.struct(F.row_number().over(up).alias("nth"), (F.col("left") / F.col("open")).alias("level")))
    t = t.withColumn("found", found).withColumn("level", F.min("found").over(everything)["level"])
    return t.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with ``size, source_size, target, epochs, picked, taken`` added (the names are reserved).

    ``epochs`` whole rounds, one more if ``picked``; ``taken = size * (epochs + picked)``. A source's last document is
    picked if that brings the sum closer to the target, so the error is at most half a document (or tie group).
    """
    n = docs.count()
    bins = max(16, n // BIN_ROWS)
    s_bin, s_key, s_tie, s_text = fresh(docs, "bin", "key", "tie", "text")
    keyed = docs.withColumn(s_text, text_or_empty())
    keyed = keyed.withColumn("size", word_count(F.col(s_text)))
    keyed = keyed.withColumn(s_key, -F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col(s_text)))
    keyed = keyed.withColumn(s_bin, F.floor((F.lit(1.0) - F.exp(-F.col(s_key))) * bins).cast("long"))
    keyed = keyed.withColumn(s_tie, F.xxhash64(s_text)).drop(s_text)

    light = stash(keyed.select("doc_id", "source", "size", F.col(s_key).alias("key"), F.col(s_bin).alias("bin"), F.col(s_tie).alias("tie")), "mix-keys")
    by_bin = stash(light.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    plan = source_targets(by_bin.groupBy("source").agg(F.sum("words").alias("total")), weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("total")).select("source", "total", "target", "epochs", "rest")
    plan = stash(plan, "mix-targets")

    # The bin of each source in which the rest of its budget ends.
    run = Window.partitionBy("source").orderBy("bin")
    sums = by_bin.withColumn("until", F.sum("words").over(run)).withColumn("before", F.col("until") - F.col("words"))
    p, b = plan.alias("p"), sums.alias("b")
    same = F.col("p.source").eqNullSafe(F.col("b.source"))
    ends = b.join(p, same).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("until")) & (F.col("rest") > 0))
    ends = stash(ends.select("b.source", "bin", "before", "rest"), "mix-ends")
    e, k = ends.alias("e"), light.alias("k")
    inside = k.join(e, F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k.bin") == F.col("e.bin")))
    units = inside.groupBy("k.source", "k.bin", "key", "doc_id", "tie", "before", "rest").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_first(), "tie")
    units = units.withColumn("until", F.col("before") + F.sum("words").over(order))
    near = (F.col("until") <= F.col("rest")) | (F.col("until") - F.col("rest") <= F.col("rest") - (F.col("until") - F.col("words")))
    cut = units.where(near).groupBy("source").agg(F.max(F.struct("bin", "key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie")).alias("cut"))
    p, c = plan.alias("p"), cut.alias("c")
    e = ends.alias("e")
    full = p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").join(c, F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    s_src, s_end, s_cut, s_total, s_target, s_epochs = fresh(keyed, "source", "end", "cut", "total", "target", "epochs")
    plan = stash(full.select(F.col("p.source").alias(s_src), F.col("p.total").alias(s_total), F.col("p.target").alias(s_target), F.col("p.epochs").alias(s_epochs), F.col("e.bin").alias(s_end), F.col("cut").alias(s_cut)), "mix-plan")

    # One row per source: the planner broadcasts it if its files are under the session's threshold, or else joins by shuffle.
    out = keyed.join(plan, F.col("source").eqNullSafe(F.col(s_src)), "left")
    own = F.struct(F.col(s_bin).alias("bin"), F.col(s_key).alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col(s_tie).alias("tie"))
    picked = F.coalesce(F.col(s_bin) < F.col(s_end), F.lit(False)) | F.coalesce(own <= F.col(s_cut), F.lit(False))
    out = out.withColumn("picked", picked & (F.col("size") > 0))
    out = out.withColumn("source_size", F.col(s_total)).withColumn("target", F.col(s_target)).withColumn("epochs", F.col(s_epochs))
    out = out.withColumn("taken", F.col("size") * (F.col("epochs") + F.col("picked").cast("long")))
    return out.select(*docs.columns, "size", "source_size", "target", "epochs", "picked", "taken")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
      / (CAST(0.05 AS DOUBLE) + CAST(0.95 AS DOUBLE) * (CAST(1 AS DOUBLE)
         - CAST(length(regexp_replace(t, '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS DOUBLE) / greatest(length(t), 1))) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total FROM k GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), c AS (
  SELECT *, 2.0::DOUBLE * total AS cap, 2.0::DOUBLE * total / weight AS full_at FROM w
), l AS (
  SELECT *,
    1.5::DOUBLE * sum(total) OVER () - coalesce(sum(cap) OVER up, 0) AS left_over,
    sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS open_weight,
    row_number() OVER (ORDER BY full_at, source NULLS LAST) AS nth
  FROM c WINDOW up AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, total, least(cap, weight * (SELECT arg_min(left_over / open_weight, nth) FROM l WHERE left_over / open_weight <= full_at)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS until
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, total AS source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND (until <= rest OR (until - size < rest AND until - rest <= rest - (until - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
