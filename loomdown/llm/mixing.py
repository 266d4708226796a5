"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mix and a schedule: at training time t in [0, 1] its rate is
target * (1 + slope * (1 - 2 t)). The integral of the rate up to t is its cumulative demand; a document that begins at
demand u of its source stands where that integral reaches u, and the documents are range-sorted by that position.
A source whose target exceeds its size is read again, in the same order, up to `max_repeats` times.

Targets: sources by code point, null last, weigh `weights`, repeating; they share the sum of all sizes; a target stops at
max_repeats times its source's size and the excess is shared again by weight until none is above.

Running sums are taken in two steps, over (source, bucket of the order key) and then within a bucket, so that a source
that holds a third of all rows is spread over `buckets` groups. The order key is the md5 of the id and the text's md5, so reruns agree and
rows of one id, or of none, are spread too. Only the columns to keep go through the shuffles. The windows over all sources
see one row a source.

Defined cases: a null text has size 0, and a document of size 0 is never taken. A null source is a source of its own.
Repeated rows are separate documents that follow one another. A null doc_id is like an empty one. An empty table gives no rows. Very long
texts count whole. Extra columns, also of our names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS, SLOPES = (5, 2, 1), (0.5, 0.0, -0.5)


def choose(values, rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_repeats: int = 3) -> DataFrame:
    """(skey, source_size, target, slope) of (skey, source_size); one row for each source."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy("skey")) - 1)
    ranked = ranked.select("skey", "source_size", choose(weights, F.col("rank")).alias("w"), choose(slopes, F.col("rank")).alias("slope"), (max_repeats * F.col("source_size")).alias("cap"))
    every = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("w"), "skey").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = ranked.withColumn("level", left / weight)
    # Filled up in the order of cap / weight, the level only falls once a source stays below its cap.
    level = level.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    return level.select("skey", "source_size", "slope", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def position_of(demand: Column, slope: Column) -> Column:
    """The time t at which the share t + slope * (t - t * t) of a source's demand is reached."""
    b = slope + 1
    return (demand * 2) / (b + F.sqrt(F.greatest(F.lit(0.0), b * b - slope * 4 * demand)))


def plan_mix(docs: DataFrame, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, slopes=SLOPES, max_repeats=3, buckets=4096, keep: list[str] | None = None) -> DataFrame:
    """Every row as the struct `row` with size, source_size, target, slope, begin (its place in its source) and times (how often it is taken).

    keep: the columns of `row`, all if not given.
    """
    r = F.col("row")
    df = docs.select(F.struct("*").alias("row")).select(
        (r if keep is None else F.struct(*(r[k].alias(k) for k in keep))).alias("row"),
        F.coalesce(F.regexp_count(r[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(r[source].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), r[source].cast("string"))).alias("skey"),
        F.md5(F.concat(F.coalesce(r[doc_id].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(r[text], F.lit("")).cast("binary"))).cast("binary")).alias("order_key"),
    )
    df = df.withColumn("bucket", F.pmod(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") / F.lit(2**32 // buckets), F.lit(float(buckets))).cast("int"))
    sums = written(df.groupBy("skey", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    targets = source_targets(sums.groupBy("skey").agg(F.sum("n").alias("source_size")), weights, slopes, max_repeats)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    group = W.partitionBy("skey", "bucket").orderBy("order_key", "size").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum("size").over(group), F.lit(0)))
    df = df.join(offsets.join(targets, "skey"), ["skey", "bucket"])
    begin = F.col("offset") + F.col("within")
    taken = sum(F.when(begin + k * F.col("source_size") < F.col("target"), 1).otherwise(0) for k in range(max_repeats))
    return df.select("row", "order_key", "size", "source_size", "target", "slope", begin.alias("begin"), F.when(F.col("size") > 0, taken).otherwise(0).alias("times"))


def demand_of() -> Column:
    """The share of its source's demand at the middle of the document's `turn`."""
    begin = F.col("begin") + F.col("turn") * F.col("source_size")
    return (begin + F.col("size") / 2) / F.greatest(F.col("target"), (begin + F.col("size")).cast("double"))


def occurrences(plan: DataFrame) -> DataFrame:
    """A row for each time that a document is taken, with its position in (0, 1)."""
    each = plan.where("times > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return each.withColumn("position", position_of(demand_of(), F.col("slope")))


def training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mixed documents, with their own columns, range-sorted by position: one row for each time a document is taken."""
    mixed = occurrences(plan_mix(docs, **options)).select("row", "position", "order_key", "turn")
    keys = ("position", "order_key", "turn")
    mixed = mixed.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
    return mixed.select("row.*")


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = plan_mix(docs, keep=["doc_id"]).withColumn("turn", F.lit(0))
    out = plan.select(
        F.col("row")["doc_id"].alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("times")).cast("long").alias("taken"),
        F.when(F.col("times") > 0, position_of(demand_of(), F.col("slope"))).alias("first_position"),
        "order_key",
    )
    out = written(out, "mix-plan")  # a range sort reads its input twice
    return out.repartitionByRange("first_position", "order_key").sortWithinPartitions("first_position", "order_key").drop("order_key")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
r AS (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS i FROM s),
c AS (SELECT skey, source_size, [5, 2, 1][(i % 3 + 1)::INT] AS w, [0.5, 0.0, -0.5][(i % 3 + 1)::INT]::DOUBLE AS slope,
             3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
             / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM c WINDOW b AS (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT max(level) FILTER (WHERE level <= cap / w) AS level FROM l),
t AS (SELECT skey, source_size, slope, least(cap::DOUBLE, coalesce(m.level * w, cap::DOUBLE)) AS target FROM c, m),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY k, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM d),
q AS (SELECT *, CASE WHEN size > 0 THEN (b < target)::INT + (b + source_size < target)::INT + (b + 2 * source_size < target)::INT
             ELSE 0 END AS times, (b + size / 2) / greatest(target, (b + size)::DOUBLE) AS u FROM p JOIN t USING (skey))
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken,
       CASE WHEN times > 0 THEN (u * 2) / ((slope + 1) + sqrt(greatest(0.0, (slope + 1) * (slope + 1) - slope * 4 * u))) END AS first_position
FROM q
"""
