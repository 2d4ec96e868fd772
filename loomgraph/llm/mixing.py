"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate. Among all rates that meet each source's token target, entropy balancing takes
those closest to one in token-weighted relative entropy; they are exponential tilts ``exp(lambda)`` of the constraint's
multipliers. The convex dual, sum(size * exp(lambda)) - target * lambda for each source, is solved by Newton steps over
the table of sources: gradient and curvature of a step are sums over documents, and as a document enters them by its
size only, one distributed aggregate is gathered once. With one constraint for each source the dual falls apart by
source, and its solution is the logarithm of target over size; the steps are those of the general method. Targets stop at three times a source's size, so no rate
exceeds three.

Rates are rounded into whole copies by systematic rounding along the sizes: within a source and a size tier, ordered
by size, the i-th document gets ``floor((i+1) r + 1/2) - floor(i r + 1/2)`` copies. What the large documents miss is
carried to the next smaller tier, so the last error is of the order of the smallest documents. Ranks come from a range
partitioning, never from one task for each source; a source with a third of all rows is dealt over many tasks.

Defined results of the odd cases
* null, empty or wordless text: size 0, taken 0. null source: a source of its own, last in order.
* repeated rows and equal doc_ids: each row is counted, ties in size are ordered by hashes. For ``mixed``, rows that
  agree in doc_id and text share the copies of the first of them.
* a source of size 0: target 0. All sizes 0: all targets 0. Empty table: an empty result.
* very long texts: whole, in the first tier. Extra columns: kept by ``mixed``, not read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import SPACE, cut, fresh, read, width
from loomgraph.llm.sharding import number_rows

WEIGHTS = (1, 2, 3)
CAP = 3
#: Lower ends of the size tiers, large documents first.
TIERS = (4096, 512, 64, 8, 0)
NEWTON_STEPS = 60


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight and target of the table (source, source_size).

    Only scalars reach the driver: the level at which uncapped sources are filled is raised until no more cap.
    """
    numbered, _ = number_rows(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "sources")
    table = cut(numbered.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("row") % len(weights)).cast("int"))).select("source", "source_size", "weight"), "weights")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0]
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        got = table.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, cap * F.col("source_size"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open")).head()
        if got.n == capped or not got.open:
            break
        capped, level = (got.n if level else -1), (total - got.full) / got.open
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), (cap * F.col("source_size")).cast("double")))


def tilt(sources: DataFrame) -> DataFrame:
    """``sources`` (source_size, target) with ``rate`` = exp(lambda), lambda by Newton steps on the dual."""
    now = sources.withColumn("lam", F.lit(0e0))
    for _ in range(NEWTON_STEPS):
        moved = F.col("source_size") * F.exp("lam")
        gap = F.abs(moved - F.col("target")) / F.greatest(F.col("target"), F.lit(1e0))
        open_ = (F.col("source_size") > 0) & (F.col("target") > 0)
        if (now.agg(F.max(F.when(open_, gap))).head()[0] or 0.0) < 1e-12:
            break
        # gradient moved - target, curvature moved; a step is held to one unit so that a steep start cannot overshoot
        step = F.greatest(F.lit(-1e0), F.least(F.lit(1e0), (F.col("target") - moved) / moved))
        now = cut(now.withColumn("lam", F.when(open_, F.col("lam") + step).otherwise(F.lit(0e0))), "newton")
    return now.withColumn("rate", F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp("lam")).otherwise(F.lit(0e0))).drop("lam")


def _ranked(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size, __tie) with ``tier`` and ``i``, the rank by size within source and tier."""
    tier = F.lit(len(TIERS) - 1)
    for k in reversed(range(len(TIERS) - 1)):
        tier = F.when(F.col("size") >= TIERS[k], F.lit(k)).otherwise(tier)
    order = ["source", "tier", "size", "__tie", "doc_id"]
    spark = sized.sparkSession
    dealt = cut(sized.withColumn("tier", tier).repartitionByRange(width(spark), *order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("source", "tier", "__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "tier").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("source").alias("__s"), F.col("tier").alias("__t"), F.col("__part").alias("__p"), before.alias("__before"))
    within = Window.partitionBy("source", "tier", "__part").orderBy("size", "__tie", "doc_id")
    rows = dealt.withColumn("__at", F.row_number().over(within) - 1)
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("tier") == F.col("__t")) & (F.col("__part") == F.col("__p"))
    return rows.join(offsets, on).withColumn("i", F.col("__before") + F.col("__at")).drop("__s", "__t", "__p", "__before", "__at", "__part")


def _copies(i: Column, rate: Column) -> Column:
    return (F.floor((i + 1) * rate + 0.5) - F.floor(i * rate + 0.5)).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken and the text's hash ``tie`` of every row."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("__tie"))
    ranked = cut(_ranked(sized), "sizes")
    sources = cut(tilt(targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size")))), "rates")
    tiers = ranked.groupBy("source", "tier").agg(F.sum("size").alias("tier_size"))
    state = sources.select(F.col("source").alias("__s"), "rate", F.lit(0e0).alias("carry"))
    rates = None
    for k in range(len(TIERS)):
        sizes = tiers.filter(F.col("tier") == k).select(F.col("source").alias("__s2"), "tier_size")
        here = state.join(sizes, F.col("__s").eqNullSafe(F.col("__s2")), "left").drop("__s2")
        wanted = F.col("rate") * F.coalesce("tier_size", F.lit(0)) + F.col("carry")
        here = here.withColumn("wanted", wanted).withColumn("tier_rate", F.when(F.col("tier_size") > 0, F.least(F.lit(float(CAP)), F.greatest(F.lit(0e0), F.col("wanted") / F.col("tier_size")))).otherwise(F.lit(0e0)))
        here = cut(here, f"tier{k}")
        part = here.select("__s", F.lit(k).alias("__t"), "tier_rate")
        rates = part if rates is None else rates.unionByName(part)
        if k + 1 < len(TIERS):
            rounded = ranked.filter(F.col("tier") == k).join(here.select("__s", "tier_rate"), F.col("source").eqNullSafe(F.col("__s")))
            got = rounded.groupBy(F.col("__s").alias("__s2")).agg(F.sum(F.col("size") * _copies(F.col("i"), F.col("tier_rate"))).alias("got"))
            state = here.join(got, F.col("__s").eqNullSafe(F.col("__s2")), "left").select("__s", "rate", (F.col("wanted") - F.coalesce("got", F.lit(0))).alias("carry"))
    facts = sources.select(F.col("source").alias("__f"), "source_size", "target", "rate")
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("tier") == F.col("__t"))
    out = ranked.join(rates, on).join(facts, F.col("source").eqNullSafe(F.col("__f")))
    copies = _copies(F.col("i"), F.col("tier_rate"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken"), F.col("__tie").alias("tie"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the plan copies it, with their own columns, whatever their names."""
    own, tie, copies, copy = fresh(docs, "copied_id", "copied_tie", "copies", "copy")
    planned = plan(docs.select("doc_id", "source", "text"))
    many = planned.groupBy(F.col("doc_id").alias(own), F.col("tie").alias(tie)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    many = docs.join(many, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(tie)))
    return many.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(copy)).drop(copy)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
