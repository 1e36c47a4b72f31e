"""Mixing sources to target weights by capped water-filling.

Sources, by code point and null last, weigh 1, 2, 3, repeating, and share all words. A source's target stops at
``max_epochs`` times its size; what is above is shared again by weight, until none is above: with sources in order of
size per weight, the first k stop at their cap and the rest share the remainder by weight. A document is then taken
floor(target / size of source) times whole, and once more while the seeded order of its source's documents has not
filled the fraction that is left: the last repetition is a fraction of the source, made of whole documents.

Plan: texts are read once, for (doc_id, source, size, place), which is cut; the rest works on that table. Sources are
sums of partial aggregates. The seeded order is never sorted as a whole: documents fall into slots of it, ``slots`` or one for
every ``SLOT_ROWS`` documents, whose sums are again partial aggregates; only the one slot of each source in which the
fraction ends is ordered row by row. The tables of sources and of their slots (sources times slots at most) are joined back
by plain equi-joins, which adaptive execution splits for a hot source. The number of slots does not change the result.

Edge cases: null text: size 0. Null source: a source of its own, last. A source without words: target 0, nothing taken. Empty texts: no copy
but the whole ones of their source. Repeated rows: each is a document; equal ones are taken in a fixed but unspecified order of equal places. Null
doc_id: ordered as the empty id. Empty table: no rows. Sizes count words ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import cut

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
SLOTS = 4096
#: Documents of one slot, on average, at most.
SLOT_ROWS = 1 << 16


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size); one task orders the sources, a row for each."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(F.lit(0.0)))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("weight") == 0, F.col("cap") / F.nullif("weight", F.lit(0.0)), "rank")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "left_words": F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # the level at which the water stands once every smaller cap is full; it is above the cap for exactly the full ones
    open_ = F.when(F.col("left_words") * F.col("weight") < F.col("cap") * F.col("left_weight"), F.struct("left_words", "left_weight"))
    filled = filled.withColumn("level", F.first(open_, ignorenulls=True).over(everything))
    share = F.col("level.left_words") * F.col("weight") / F.col("level.left_weight")
    full = F.col("level").isNull() | (F.col("left_words") * F.col("weight") >= F.col("cap") * F.col("left_weight"))
    return filled.select("source", "source_size", F.when(F.col("weight") == 0, F.lit(0.0)).when(full, F.col("cap")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS, seed: str = SEED, slots: int = SLOTS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies; ``keep`` names columns of ``docs`` to carry along."""
    place = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        place.alias("place"), *[F.col(c).alias(f"kept_{c}") for c in keep],
    ))
    slots = max(slots, -(-rows.count() // SLOT_ROWS))
    rows = rows.withColumn("slot", (F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * slots / (1 << 32)).cast("int"))
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = water_fill(sources, weights, max_epochs).withColumn("whole", F.floor(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))))
    targets = targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots_ = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    plan = slots_.join(targets, slots_["source"].eqNullSafe(targets["source"])).select(
        slots_["source"].alias("s"), F.col("slot").alias("k"), "source_size", "target", "whole", "rest", "before",
        # 1: all documents of the slot are taken once more; 0: none is; null: the fraction ends in it
        F.when(F.col("rest") <= 0, 0).when(F.col("before") + F.col("words") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).alias("more"),
    )
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["slot"] == plan["k"])).drop("s", "k")
    clear = joined.where("more is not null")
    order = Window.partitionBy("source", "slot").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where("more is null").withColumn("more_at", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("more", F.when(F.col("more_at") + F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)).drop("more_at")
    copies = (F.coalesce("whole", F.lit(0)) + F.col("more")).cast("int")
    return clear.unionByName(edge).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"),
        *[F.col(f"kept_{c}").alias(c) for c in keep],
    )


def oracle(documents: str = "documents", seed: str = SEED) -> str:
    """DuckDB SQL for the same rows."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}') AS place
  FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM s),
w AS (SELECT *, CASE WHEN source_size > 0 THEN ((rank - 1) % 3 + 1)::DOUBLE ELSE 0.0::DOUBLE END AS weight, (source_size * 3)::DOUBLE AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY weight = 0, cap / nullif(weight, 0), rank) AS k FROM w),
f AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM o) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         (SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM o),
l AS (SELECT left_words AS lw, left_weight AS lt FROM f WHERE left_words * weight < cap * left_weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight = 0 THEN 0.0::DOUBLE
         WHEN (SELECT count(*) FROM l) = 0 OR left_words * weight >= cap * left_weight THEN cap
         ELSE (SELECT lw FROM l) * weight / (SELECT lt FROM l) END AS target FROM f),
u AS (SELECT *, floor(target / nullif(source_size, 0)) AS whole FROM t),
x AS (SELECT d.doc_id, d.size, u.source_size, u.target, coalesce(u.whole, 0) AS whole, u.target - coalesce(u.whole, 0) * u.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
y AS (SELECT *, CAST(whole AS INTEGER) + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies FROM y
"""
