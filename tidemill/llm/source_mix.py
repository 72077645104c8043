"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each document has a hash of its id and text.  Words are summed by source and leading hash bits; the bucket in which the running
sum passes the source's budget is found and only its documents are summed again by their next bits, level after level, until
one hash value is left.  A document below its source's threshold is taken once more than the others, and so are as many of the copies
that share the threshold's hash as the budget has room for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

NAME = "op6_source_mix"
#: A hash has BITS bits, of which each level looks at STEP more.
BITS, STEP = 52, 13
WEIGHTS = (5, 2, 1)
#: Sources up to this many are joined by broadcast (some 100 bytes each); more by a shuffle.
FEW_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of all words by weight, none above most times its size.

    Sources stand in code point order, null last, and weigh in turn.  What a capped source can't take is shared again by
    weight among the rest until none is above its cap; as caps bind in order of size/weight, a running sum finds the level.
    One row a source, sorted in one task, as each source's weight follows from its place among all: the bound is some ten
    million sources (100 bytes each, spilled to disk), which is one host name for each of ten million hosts.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    heavy = F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    s = s.withColumn("_left", left).withColumn("_heavy", heavy)
    s = s.withColumn("_free", F.col("_cap") * F.col("_heavy") > F.col("_left") * F.col("_w"))
    first = Window.orderBy(
        F.when(F.col("_free"), F.col("_cap") / F.col("_w")).asc_nulls_last(),
        F.col("source").isNull(),
        F.col("source"),
    ).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_l", F.first(F.when(F.col("_free"), F.col("_left"))).over(first)).withColumn(
        "_h",
        F.first(F.when(F.col("_free"), F.col("_heavy"))).over(first),
    )
    return s.select("source", "source_size", F.when(F.col("_free"), F.col("_w") * F.col("_l") / F.col("_h")).otherwise(F.col("_cap")).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame, near) -> DataFrame:
    """(source, at, m, more): a row of a source is taken once more if its hash is below at, and so are more of the m rows at it.

    rows: source, size, h.  plan: source, rest - the words still to take from each source.
    """
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("done"))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = near(rows, state.select("source", "prefix")).filter(F.shiftright("h", shift + STEP) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        hist = hist.join(state.select(F.col("source").alias("_s"), "rest", "done").hint("merge"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        cum = F.col("done") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        over = hist.withColumn("cum", cum).filter(F.col("cum") > F.col("rest"))
        state = over.groupBy("source").agg(
            F.min_by(F.struct("rest", F.col("bucket").alias("prefix"), (F.col("cum") - F.col("n")).alias("done"), "n", "m"), "bucket").alias("x")
        ).select("source", "x.*")
    more = F.round((F.col("rest") - F.col("done")) * F.col("m") / F.col("n")).cast("long")
    return state.select("source", F.col("prefix").alias("at"), "m", more.alias("more"))


def numbered_ties(rows: DataFrame) -> DataFrame:
    """rows (with source) numbered from 1 within their source, however many there are: tasks count, and each goes on from those before."""
    rows = checkpointed(rows.withColumn("__tm_task", F.spark_partition_id()))
    counts = rows.groupBy("source", "__tm_task").agg(F.count("*").alias("__tm_c"))
    before = Window.partitionBy("source").orderBy("__tm_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("_s"), F.col("__tm_task").alias("_t"), F.coalesce(F.sum("__tm_c").over(before), F.lit(0)).alias("__tm_before"))
    own = F.row_number().over(Window.partitionBy("source", "__tm_task").orderBy("__tm_task"))
    df = rows.withColumn("__tm_own", own).join(starts.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("__tm_task") == F.col("_t")))
    return df.withColumn("__tm_number", F.col("__tm_before") + F.col("__tm_own")).drop("_s", "_t", "__tm_task", "__tm_own", "__tm_before")


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with __tm_copies; they have source, __tm_h and the plan's __tm_base, __tm_at, __tm_m and __tm_more."""
    c = F.col
    tied = (c("__tm_h") == c("__tm_at")) & (c("__tm_m") > 1) & (c("__tm_more") > 0) & (c("__tm_more") < c("__tm_m"))
    plain = rows.filter(~F.coalesce(tied, F.lit(False)))
    once = (c("__tm_h") < c("__tm_at")) | (c("__tm_h") == c("__tm_at")) & (c("__tm_more") > 0)
    ties = numbered_ties(rows.filter(tied))
    some = c("__tm_number") <= c("__tm_more")
    counted = lambda df, x: df.withColumn("__tm_copies", c("__tm_base") + F.coalesce(x, F.lit(False)).cast("long"))
    return counted(plain, once).unionByName(counted(ties, some).drop("__tm_number"))


def measures() -> dict:
    """size and hash of a document, as columns."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    h = F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")
    return {"size": F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"), "h": h}


def _joiner(few: bool):
    def near(left, right, key="source"):
        """left with the columns of right, which has one row for each source."""
        right = right.withColumnRenamed("source", "_s").hint("broadcast" if few else "merge")
        return left.join(right, F.col(f"`{key}`").eqNullSafe(F.col("_s")), "left").drop("_s")

    return near


def fit(rows: DataFrame, weights: tuple, share: float, most: int) -> tuple[DataFrame, bool]:
    """((source, source_size, target, base, at, m, more), whether sources are few).  rows: source, size, h."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = checkpointed(plan.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")))
    few = plan.count() <= FEW_SOURCES
    near = _joiner(few)
    limits = near(plan, thresholds(rows, plan, near)).select("source", "source_size", "target", "base", F.coalesce("at", F.lit(-1)).alias("at"), "m", "more")
    return checkpointed(limits), few


def decided(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (source, __tm_h, ..) with the plan's columns, named __tm_*, and __tm_copies."""
    plan = plan.select("source", *[F.col(c).alias(f"__tm_{c}") for c in plan.columns[1:]])
    return with_copies(_joiner(few)(rows, plan))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs.

    size: runs of characters other than ASCII white space; null text has 0.  Every document is taken floor(target /
    source_size) times, and those whose hash of id and text lies below the source's threshold once more, so the words taken
    come within half a document of the target.  Rows of one id and text share a hash; where the threshold falls on them, as many are
    taken as fit, no matter which.  Null ids and texts hash as empty strings.  Null sources are one source.  A source without
    words has target 0 and takes its documents no times.  An empty table gives none.  Columns other than doc_id, text and
    source are not read.
    """
    m = measures()
    rows = checkpointed(docs.select("doc_id", "source", m["size"].alias("size"), m["h"].alias("h")))
    out = decided(rows.withColumnRenamed("h", "__tm_h"), *fit(rows, weights, share, most))
    copies = F.col("__tm_copies")
    plan = [F.col(f"__tm_{c}").alias(c) for c in ("source_size", "target")]
    return out.select("doc_id", "size", *plan, (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """The documents that the mix takes at least once, with their columns and size, source_size, target, taken and copies.

    As mix(); the decisions are taken to the texts by source, not by a join on documents.  Columns of docs named like one of
    the added ones give way to it.
    """
    m = measures()
    rows = checkpointed(docs.select("source", m["size"].alias("size"), m["h"].alias("h")))
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    out = decided(docs.withColumn("__tm_size", m["size"]).withColumn("__tm_h", m["h"]), *fit(rows, weights, share, most))
    taken = (F.col("__tm_copies") * F.col("__tm_size")).alias("taken")
    return out.filter("__tm_copies > 0").select(
        *[f"`{c}`" for c in own],
        F.col("__tm_size").alias("size"),
        F.col("__tm_source_size").alias("source_size"),
        F.col("__tm_target").alias("target"),
        taken,
        F.col("__tm_copies").alias("copies"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL of mix() over a relation."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS h FROM {docs}),
s AS (SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
rounds AS (SELECT 0 AS k, source, n, w, false AS capped, 0::DOUBLE AS t FROM s
  UNION ALL
  SELECT k + 1, source, n, w, capped OR t2 > 2 * n, least(t2, 2 * n)
  FROM (SELECT *, CASE WHEN capped THEN 2 * n ELSE w * (1.5 * sum(n) OVER () - sum(CASE WHEN capped THEN 2 * n ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS t2
        FROM rounds) WHERE k < (SELECT count(*) + 1 FROM s)),
t AS (SELECT source, n, t AS target, CASE WHEN n > 0 THEN floor(t / n) ELSE 0 END AS base FROM rounds WHERE k = (SELECT count(*) + 1 FROM s)),
c AS (SELECT d.*, t.n, t.target, t.base, t.target - t.base * t.n AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(size) OVER (PARTITION BY d.source, h) AS own, count(*) OVER (PARTITION BY d.source, h) AS m, row_number() OVER (PARTITION BY d.source, h) AS number FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, target, ((base + CASE WHEN cum <= rest THEN 1 WHEN cum - own <= rest THEN (number <= round((rest - cum + own) * m / own))::INT ELSE 0 END) * size)::BIGINT AS taken FROM c
"""


SQL = sql()
