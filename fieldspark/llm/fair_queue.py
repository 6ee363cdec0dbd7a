"""Mixing sources to target weights by weighted fair queueing.

Method. Documents of a source stand in a shuffled order (by a keyed hash of the id). Each gets a virtual
finish time: the source's words up to and including it, divided by the source's target. A
source whose target exceeds its words is gone through again (up to ``max_repeats`` times in all), so one document has
an entry for each pass. All entries are range-sorted by finish time over the whole table and cut off where their
words exceed the total budget. As every source advances by its target in one unit of virtual
time, the cut leaves each within about a document of its target.

Scale. Running sums never put a source or the whole table into one task: a source is cut into ``spread``
blocks by the same hash, sums of blocks are added up over the small table of blocks, and
rows only within their block. The global order is a range partition with the same two levels: sums
of virtual-time slices (added up in ranges), then rows within the slice.

Everything is DataFrame functions.

Edge cases. A null or empty text has no words; such documents are taken 0 times. Null sources are one
source, the last. Rows that repeat an id stand next to each other, in order of their words, and are counted each. A null id
hashes as a missing value. An empty table gives an empty table. Extra columns are kept by
``mix`` and ignored by ``shares``; clashing names are no problem, as working columns get unused ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..numbering import running_sum
from .shared import unused, written

#: What separates words, [\x20\x09-\x0D]; a word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, filled up to max_repeats times a source.

    Weights repeat along the sources in order of code points, null last. Sources in order of max_repeats * size /
    weight reach their limit one after the other; the level beyond which none does sets the rest.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w)
    total = W.partitionBy()
    by_limit = W.orderBy(F.col("source_size") * max_repeats / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    all_size, all_w = F.sum("source_size").over(total), F.sum("w").over(total)
    left = all_size - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = F.col("w") * level >= F.col("source_size") * max_repeats
    ranked = ranked.select("source", "source_size", "w", level.alias("level"), full.alias("full"))
    # The first source in that order that stays below its limit sets the level of all after it; theirs would be lower.
    rest = F.max(F.when(~F.col("full"), F.col("level"))).over(total)
    target = F.when(F.col("full"), (F.col("source_size") * max_repeats).cast("double")).otherwise(F.col("w") * rest)
    return ranked.select("source", "source_size", target.alias("target"))


def shares(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of docs; taken counts repeats."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = 4 * parts
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place.alias("place"))
    # Leading hexadecimal digits keep the order of the hash, so blocks follow each other as their rows do.
    block = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * spread / F.lit(1 << 32)).cast("int")
    own = written(own.withColumn("block", block), "sizes")

    blocks = own.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goal = targets(sizes, weights, max_repeats)
    blocks = blocks.join(goal, blocks["source"].eqNullSafe(goal["source"])).select(blocks["source"], "block", "before", "source_size", "target")

    in_block = W.partitionBy("source", "block").orderBy("place", "size")
    run = own.withColumn("run", F.sum("size").over(in_block.rowsBetween(W.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(in_block))
    full = run.join(blocks, run["source"].eqNullSafe(blocks["source"]) & (run["block"] == blocks["block"]))
    full = full.select("id", run["source"], "place", run["block"], "nth", "size", "source_size", "target", (F.col("before") + F.col("run")).alias("run"))
    passes = F.least(F.lit(max_repeats), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    entries = full.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    finish = (F.col("run") + F.col("pass") * F.col("source_size")) / F.col("target")
    entries = entries.withColumn("finish", finish)

    # The global order: slices of virtual time, then rows of a slice. Time runs to max_repeats * size / target at most.
    slice_ = F.floor(F.col("finish") * spread).cast("long")
    entries = written(entries.withColumn("slice", slice_), "entries")
    slices = entries.groupBy("slice").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    slices = running_sum(slices, ["slice"], "words", "before")  # sources far below their target make many slices
    budget = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    slices = slices.crossJoin(F.broadcast(budget)).select("slice", "before", "budget")  # one row of budget
    order = W.partitionBy("slice").orderBy("finish", F.col("source").isNull(), F.encode("source", "utf-8"), "place", "nth", "pass")
    cut = entries.withColumn("sum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.join(slices, "slice")
    within = (F.col("before") + F.col("sum")) <= F.col("budget")
    taken = cut.groupBy("id", "place", "source", "block", "nth", "size", "source_size", "target").agg(F.sum(F.when(within, F.col("size")).otherwise(0)).alias("taken"))
    columns = ["id", "size", "source_size", "target", "taken"]
    empty = full.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns)
    return taken.select(*columns).union(empty).withColumnRenamed("id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as the mix takes them: each row as many times as it is taken, with all its columns; rows without words go."""
    key, times = unused(docs, "mix_id"), unused(docs, "mix_times")
    taken = shares(docs, id_col, text_col, source_col, **how).where("taken > 0")
    # Rows that repeat an id have the same count of passes up to one; the id's greatest stands for all.
    taken = taken.groupBy(F.col(id_col).alias(key)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(times))
    rows = docs.join(taken, docs[id_col].eqNullSafe(taken[key])).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[docs[c] for c in docs.columns])


#: The same rows as shares() with its defaults, over a table documents.
SHARES_SQL = r"""
WITH own AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sizes
), levels AS (
  SELECT *, (sum(source_size) OVER ()
             - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted
), goal AS (
  SELECT source, source_size,
         CASE WHEN w * level >= source_size * 3 THEN (source_size * 3)::DOUBLE
              ELSE w * max(CASE WHEN w * level < source_size * 3 THEN level END) OVER () END AS target
  FROM levels
), run AS (
  SELECT own.*, goal.source_size, goal.target,
         sum(size) OVER (PARTITION BY own.source ORDER BY place, size ROWS UNBOUNDED PRECEDING)::BIGINT AS run,
         row_number() OVER () AS nr
  FROM own JOIN goal ON own.source IS NOT DISTINCT FROM goal.source
), entries AS (
  SELECT *, (run + pass * source_size) / target AS finish
  FROM run, (SELECT unnest([0, 1, 2]) AS pass)
  WHERE size > 0 AND pass < least(3, ceil(target / source_size))
), cut AS (
  SELECT nr, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, place, run, pass ROWS UNBOUNDED PRECEDING) AS total FROM entries
), taken AS (
  SELECT nr, sum(size) FILTER (WHERE total <= (SELECT sum(source_size) FROM sizes)) AS taken FROM cut GROUP BY nr
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM run LEFT JOIN taken USING (nr)
"""
