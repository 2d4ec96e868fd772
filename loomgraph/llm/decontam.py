"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units behind numbers turn into typed
placeholders, everything else is lower-cased, punctuation goes. Windows of WINDOW template tokens are hashed and joined
with the benchmark's. A question whose numbers or names were replaced has the same template, so it matches; whether it
is the same question is then decided by its slots: along one alignment (difference of positions) every value of the
item has to stand for one value of the document. Windows of an alignment whose slots contradict don't count, unless
they hold no slot.

The corpus is read twice. The first pass hashes every window and gives the candidate pairs (document, item): a
common run of WINDOW tokens or more holds one. The second looks at the slots too, of candidates only. Only
hashes and positions are shuffled, as long as the candidates fit the size that is checked before they are broadcast;
beyond it, texts are joined by shuffle. Spark expressions only.

Windows with fewer than LEAST_WORDS words are told apart by their values: they match windows with the same template and
the same values, count whatever the rest of their alignment holds, and never make it contradict.

A pair is a leak if half of the item's windows are found, or half of those with words enough (n_windows and n_found are
of the larger share), or EVIDENCE tokens in windows that are found.

Defined results of the odd cases
* null or empty text (document or item): no tokens, no leak. Items of fewer than SHORTEST tokens are no evidence and
  are never reported; items shorter than a window are one window of their own length.
* repeated rows and equal doc_ids or item_ids: one pair each. null doc_id or item_id: reported as null; all documents
  (items) without an id are one.
* very long texts: whole. Empty tables: an empty result. Extra columns: not read by ``leaks``, kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, fresh, read

WINDOW = 6
SHORTEST = 4
COVERAGE, EVIDENCE = 0.5, 13
#: Tokens of a window that have to be words for its template alone to match.
LEAST_WORDS = 3
#: Rows that are broadcast at most; beyond, joins shuffle.
BROADCAST_ROWS = 200_000

UNITS = (
    "km|cm|mm|m|mi|miles?|meters?|metres?|kilomet(?:er|re)s?|feet|foot|ft|inch(?:es)?|yards?|kg|g|mg|grams?|kilograms?|pounds?|lbs?|ounces?|oz|tons?|"
    "l|ml|lit(?:er|re)s?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|hz|khz|mhz|ghz|w|kw|kwh|v|volts?|watts?|"
    "joules?|degrees?|celsius|fahrenheit|percent|dollars?|cents?|euros?|usd|eur|people|times|kb|mb|gb|tb"
)
_NAME = r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_UNIT = rf"(⟦n[^⟧]*⟧)\s*({UNITS}|[%$€£°])(?![\p{{L}}\p{{N}}])"
_TOKEN = r"⟦[^⟧]*⟧|[\p{L}\p{N}]+"


def _marked(text: Column, values: bool) -> Column:
    """``text`` with placeholders ⟦n⟧, ⟦name⟧, ⟦u⟧, or with their values behind a colon."""
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit("⟦"), F.lit(" "))
    named = F.lower(F.regexp_replace(raw, _NAME, " ⟦name:$1⟧ " if values else " ⟦name⟧ "))
    counted = F.regexp_replace(named, _NUMBER, " ⟦n:$0⟧ " if values else " ⟦n⟧ ")
    return F.when(F.contains(counted, F.lit("⟦n")), F.regexp_replace(counted, _UNIT, "$1 ⟦u:$2⟧ " if values else "$1 ⟦u⟧ ")).otherwise(counted)


def _valued(text: Column) -> Column:
    return F.regexp_extract_all(_marked(text, True), F.lit(_TOKEN), F.lit(0))


def _window(tokens: Column, start: Column, size) -> Column:
    return F.slice(tokens, start + 1, size)


def _words(tokens: Column, at: Column, size) -> Column:
    return F.size(F.filter(_window(tokens, at, size), lambda x: ~x.startswith("⟦")))


def _hash(tokens: Column, values: Column, at: Column, size) -> Column:
    """Hash of a window's template; of its values too if the template has few words."""
    return F.when(_words(tokens, at, size) >= LEAST_WORDS, F.xxhash64(_window(tokens, at, size))).otherwise(F.xxhash64(_window(values, at, size)))


def _starts(n: Column, size, step: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _each(starts: Column, size: int, body) -> Column:
    return F.transform(starts, lambda i: body(i, size))


def _plain(token: Column) -> Column:
    """⟦n:3.5⟧ -> ⟦n⟧."""
    return F.when(token.startswith("⟦"), F.regexp_replace(token, ":[^⟧]*", "")).otherwise(token)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size, n_windows, n_told, at, told, hash and slots (values, null for words) of every window of every item.

    ``told``: the window has words enough to match by its template; n_told of the item's windows do.
    """
    # an item's first word is a name or not by what stands before it in a document: both readings are looked up
    leads = benchmark.select("item_id", "text", F.explode(F.array(F.lit(""), F.lit("so "))).alias("lead"))
    read_as = leads.select("item_id", _valued(F.concat("lead", F.coalesce("text", F.lit("")))).alias("v"), F.when(F.col("lead") == "", 0).otherwise(1).alias("skip"))
    values = read_as.select("item_id", F.slice("v", F.col("skip") + 1, F.greatest(F.lit(0), F.size("v") - F.col("skip"))).alias("v"))
    values = values.distinct().withColumn("t", F.transform("v", _plain)).filter(F.size("t") >= SHORTEST)
    size = F.least(F.lit(WINDOW), F.size("t"))
    sized = values.select("item_id", size.alias("size"), "v", "t")
    starts = _starts(F.size("t"), F.col("size"), 1)
    n_told = F.size(F.filter(starts, lambda i: _words(F.col("t"), i, F.col("size")) >= LEAST_WORDS))
    each = sized.select("item_id", "size", F.size(starts).alias("n_windows"), n_told.alias("n_told"), "v", "t", F.explode(starts).alias("at"))
    told = _words(F.col("t"), F.col("at"), F.col("size")) >= LEAST_WORDS
    return each.select("item_id", "size", "n_windows", "n_told", "at", told.alias("told"), _hash(F.col("t"), F.col("v"), F.col("at"), F.col("size")).alias("hash"), _slots(F.col("v"), F.col("at"), F.col("size")).alias("slots"))


def _slots(values: Column, at: Column, size: Column) -> Column:
    return F.transform(_window(values, at, size), lambda x: F.when(x.startswith("⟦"), x))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (materialised) with a broadcast hint if it is small; joins choose another way beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage, n_slots, n_changed and kind of every leak."""
    items = cut(item_windows(benchmark), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # from SHORTEST to WINDOW
    keys = _small(cut(items.select("hash", "item_id").distinct(), "item-keys"))
    tokens = docs.select("doc_id", _valued(F.col("text")).alias("v")).withColumn("t", F.transform("v", _plain))
    n = F.size("t")
    hashed = [_each(_starts(n, F.lit(s), 1), s, lambda i, size: _hash(F.col("t"), F.col("v"), i, size)) for s in sizes]
    if not hashed:
        hashed = [F.array().cast("array<bigint>")]
    first = tokens.select("doc_id", F.explode(F.concat(*hashed)).alias("hash")).join(keys, "hash").select("doc_id", "item_id").distinct()
    pairs = cut(first, "pairs")
    named = pairs.select(F.col("doc_id").alias("__id"), "item_id")
    ids = _small(cut(named.select("__id").distinct(), "pair-ids"))
    read_again = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("doc_id", _valued(F.col("text")).alias("v"))
    read_again = read_again.withColumn("t", F.transform("v", _plain))
    at = F.concat(*[_each(_starts(F.size("t"), F.lit(s), 1), s, lambda i, size: F.struct(i.alias("at"), F.lit(size).alias("size"))) for s in sizes]) if sizes else F.array().cast("array<struct<at:int,size:int>>")
    each = read_again.select("doc_id", "v", "t", F.explode(at).alias("w"))
    windows = each.select("doc_id", F.col("w.at").alias("doc_at"), F.col("w.size").alias("size"), _hash(F.col("t"), F.col("v"), F.col("w.at"), F.col("w.size")).alias("hash"), _slots(F.col("v"), F.col("w.at"), F.col("w.size")).alias("doc_slots"))
    met = windows.join(_small(items), ["hash", "size"]).withColumn("line", F.col("doc_at") - F.col("at"))
    zipped = F.arrays_zip(F.col("slots").alias("i"), F.col("doc_slots").alias("d"))
    met = cut(met.select("doc_id", "item_id", "line", "at", "size", "n_windows", "n_told", "told", F.array_distinct(F.filter(zipped, lambda x: x["i"].isNotNull())).alias("slots")), "met")
    lines = met.filter("told").select("doc_id", "item_id", "line", F.explode("slots").alias("s")).distinct()
    lines = lines.groupBy("doc_id", "item_id", "line", "s.i").agg(F.count("*").alias("n"), F.count_if(F.col("s.i") != F.col("s.d")).alias("other"))
    lines = lines.groupBy(F.col("doc_id").alias("__id"), F.col("item_id").alias("__item"), F.col("line").alias("__line")).agg(F.count("*").alias("n_slots"), F.count_if(F.col("other") > 0).alias("n_changed"), (F.max("n") > 1).alias("contradicts"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("line") == F.col("__line"))
    good = met.join(lines, on, "left").filter(~F.coalesce("contradicts", F.lit(False)) | (F.size("slots") == 0) | ~F.col("told"))
    out = good.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("all_windows"), F.max("n_told").alias("n_told"), F.countDistinct("at").alias("all_found"), F.countDistinct(F.when(F.col("told"), F.col("at"))).alias("told_found"), F.max("size").alias("size"), F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"), F.max(F.coalesce("n_changed", F.lit(0))).alias("n_changed"))
    by_told = F.col("told_found") * F.col("all_windows") >= F.col("all_found") * F.col("n_told")
    by_told = by_told & (F.col("n_told") > 0)
    out = out.withColumn("n_windows", F.when(by_told, F.col("n_told")).otherwise(F.col("all_windows"))).withColumn("n_found", F.when(by_told, F.col("told_found")).otherwise(F.col("all_found")))
    coverage = F.col("n_found") / F.col("n_windows")
    out = out.withColumn("coverage", F.round(coverage, 6)).filter((coverage >= COVERAGE) | (F.col("all_found") + F.col("size") - 1 >= EVIDENCE))
    return out.select("doc_id", "item_id", "n_windows", "n_found", "coverage", "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no leak, with all their columns, whatever their names."""
    (bad_id,) = fresh(docs, "bad_id")
    bad = _small(cut(leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(bad_id)).distinct(), "leaks"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
