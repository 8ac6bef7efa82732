"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: its rate of words is ``target * (1 + slope * (2t - 1))``,
so the integral up to t is ``target * (t + slope * (t^2 - t))`` and reaches the source's target at t = 1. Time is each source's own
share of its schedule, not a share of the mix's tokens. A document's place
in its source's word sequence is a cumulative demand; inverting the integral gives its training position. The documents
are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row a source from ``sizes`` (source, source_size): adds rank, weight and target.

    Targets are weight shares of all words; a source stops at ``cap`` times its size and the excess is shared
    anew by weight until none is above. Sorted by cap / weight, the stopped sources are a prefix, so running sums
    give the level in one pass. The windows see one row a source.
    """
    w_of = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    caps = ranked.withColumn("weight", w_of.cast("long")).withColumn("most", F.col("source_size") * cap).withColumn("all_size", F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    levels = (
        caps.withColumn("pos", F.row_number().over(by_ratio))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.col("stopped")) / F.col("open_weight"))
        .withColumn("open", F.col("most") / F.col("weight") > F.col("level"))
    )
    first = F.min(F.when(F.col("open"), F.col("pos"))).over(everything)
    return (
        levels.withColumn("first_open", first)
        .withColumn("final", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("pos") >= F.col("first_open"), F.col("final") * F.col("weight")).otherwise(F.col("most").cast("double")))
        .select("source", "source_size", "rank", "weight", "target")
    )


def slope_of(rank: Column) -> Column:
    """The default schedules: sources lean by turns to the start, the middle pace and the end of training."""
    return F.element_at(F.array(F.lit(-0.6), F.lit(0.0), F.lit(0.6)), (rank % 3 + 1).cast("int"))


def position_of(demand: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's cumulative demand is reached: the root of slope t^2 + (1 - slope) t = u."""
    u = demand / target
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
    return F.when(target > 0, 2 * u / ((1 - slope) + root))


def takes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, slope=slope_of, size: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken (words), and positions (training time of each copy).

    In a source, documents stand in the order of md5(doc_id). The mix takes every document as often as the target
    holds the whole source, and the rest from the start of that order; the last document is taken in part, so a
    source's taken words are its target rounded. Order and result depend only on ids and texts, so reruns agree.

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Repeated rows each count. Rows of equal
    doc_id are ordered by size; a frequent or null doc_id is dealt over tasks, see ``uncrowded``. An empty table gives an empty result. All columns are kept, but for those of the result's own
    names, which are replaced. The result is in no order; ``by_position`` sorts it.
    """
    made = ("size", "source_size", "target", "taken", "positions")
    kept = [c for c in docs.columns if c.lower() not in made]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    src = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    digits = hex_digits(docs)
    # all columns of a row in one, so that none of their names can clash with what follows
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("id"), "source", src.alias("src"), (words() if size is None else size).alias("size"), key.alias("key"))
    dealt = sized.withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    dealt = uncrowded(dealt)
    buckets = dealt.groupBy("src", "source", "bucket").agg(F.sum("size").alias("total"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("total").alias("source_size")), weights, cap)
    plan = targets.withColumn("src", src).withColumn("slope", slope(F.col("rank"))).drop("source", "weight", "rank")
    summed = common.running_total(dealt, "src", "bucket", ["key", "id", "size"], "size", "before", buckets.select("src", "bucket", "total"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("rounds") * F.col("source_size") - F.col("before"))).cast("long")
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0), (F.col("rounds") - F.when(F.col("rest") > 0, 0).otherwise(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    middle = lambda i: i * F.col("source_size") + F.col("before") + F.when(i < F.col("rounds"), F.col("size")).otherwise(F.col("rest")) / 2
    placed = (
        summed.join(plan, "src")
        .withColumn("budget", budget)
        .withColumn("rounds", rounds)
        .withColumn("rest", rest)
        .withColumn("taken", F.col("rounds") * F.col("size") + F.col("rest"))
        .withColumn("positions", F.transform(copies, lambda i: F.least(F.lit(1.0), position_of(middle(i), F.greatest(F.col("target"), F.lit(1e-9)), F.col("slope")))))
    )
    return placed.select("row.*", *made)


#: Rows of a bucket that are sorted in one task; buckets of more, which a frequent doc_id makes, are cut.
CROWD = 1 << 14
#: Rows of a list that is broadcast to be joined; a longer one is joined as Spark sees fit.
LISTED = 10_000


def listed(df: DataFrame) -> DataFrame | None:
    """``df`` to be joined: None if it is empty, broadcast if it is short."""
    rows = df.limit(LISTED + 1).collect()
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= LISTED else df


def uncrowded(dealt: DataFrame) -> DataFrame:
    """``dealt`` (src, bucket, key, size, ...) with buckets in the same order that hold about ``CROWD`` rows each, whatever ids are null or frequent.

    A crowded bucket is cut by key and size, and rows of a source that share both, whose order does not matter, are dealt over several buckets.
    """
    at = ["src", "bucket"]
    big = listed(dealt.groupBy(*at).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*at))
    whole = F.struct("bucket", F.lit("").alias("key"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("part"))
    if big is None:
        return dealt.withColumn("bucket", whole)
    crowded = dealt.join(big, at, "left_semi")
    crowds = listed(crowded.groupBy(*at, "key", "size").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*at, "key", "size", F.ceil(F.col("n") / CROWD).alias("parts")))
    parted = crowded.join(crowds, [*at, "key", "size"], "left") if crowds is not None else crowded.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")
    finer = F.struct("bucket", "key", F.col("size").cast("long").alias("size"), part.alias("part"))
    # a row's part is drawn once: sums of buckets and rows have to agree
    kept = common.written(parted.withColumn("bucket", finer).select(*dealt.columns), "crowded")
    return dealt.join(big, at, "left_anti").withColumn("bucket", whole).select(*dealt.columns).unionByName(kept)


def hex_digits(docs: DataFrame) -> int:
    """Hexadecimal digits of a hash that deal the rows of a source into buckets of a bounded size: 3 for 16 million rows, one more for each 16 times."""
    rows, digits = docs.count(), 3
    while digits < 6 and rows > 4096 << (4 * digits):
        digits += 1
    return digits


def by_position(taken: DataFrame) -> DataFrame:
    """Range-sorts documents by training position, with ``position``, that of their first copy; those of which nothing is taken come first."""
    first = F.try_element_at("positions", F.lit(1))
    out = taken.withColumn("position", first)
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sized = takes(docs.select("doc_id", "source", words().alias("__words")), size=F.col("__words"))
    return by_position(sized).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
c AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS most, sum(source_size) OVER () AS all_size FROM s),
l AS (
  SELECT *, row_number() OVER o AS pos,
         CAST(all_size - coalesce(sum(most) OVER (ORDER BY most / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(w) OVER (ORDER BY most / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM c WINDOW o AS (ORDER BY most / w, rnk)),
f AS (SELECT *, min(CASE WHEN most / w > lev THEN pos END) OVER () AS first_open FROM l),
t AS (
  SELECT *, CASE WHEN pos >= first_open THEN max(CASE WHEN pos = first_open THEN lev END) OVER () * w ELSE CAST(most AS DOUBLE) END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM p),
r AS (SELECT *, greatest(0, least(size, budget - rounds * source_size - bef)) AS rest FROM q),
u AS (
  SELECT *, rounds * size + rest AS taken, CASE rnk % 3 WHEN 0 THEN -0.6::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS k,
         CAST(bef + CAST(CASE WHEN rounds > 0 THEN size ELSE rest END AS DOUBLE) / 2 AS DOUBLE) / greatest(target, 1e-9::DOUBLE) AS x
  FROM r)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN least(1.0::DOUBLE, 2 * x / ((1 - k) + sqrt((1 - k) * (1 - k) + 4 * k * x))) END AS position
FROM u
"""
