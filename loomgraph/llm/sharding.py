"""Sharding: a Feistel permutation with cycle walking over global row numbers.

A row's place follows from its number alone: ``position = permute(row number)``, ``shard = position % shards``,
``slot = position / shards``. The shuffle is reproducible from the key, shard sizes differ by one row at most (law
``rows``), and ``unpermute`` finds the row that sits at a place without any table.

The permutation is an alternating-modulus Feistel network on Z_a x Z_b with a = ceil(sqrt(n)), b = ceil(n / a): the
domain exceeds n by fewer than a values, so a walk that leaves [0, n) is rare (below one in sqrt(n)) and short.

Defined results of the odd cases
* null text: as an empty one (16 bytes, crc 0). null doc_id: numbered first.
* repeated rows and equal doc_ids: each row gets its own number; ties are ordered by the text's hashes, and rows that
  are equal throughout can change places without changing the result.
* empty table: an empty result. Very long texts: only their length and checksum travel. Extra columns: not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.common import cut, read, width

ROUNDS = 6
WALKS = 40
#: Multiplier and round keys of the round function; below 2^31, so that products of 31-bit halves fit a long.
MULTIPLIER = 1_540_483_477
KEY = 20_250


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(key: int = KEY) -> list[int]:
    out, x = [], key
    for _ in range(ROUNDS):
        x = (x * 1_103_515_245 + 12_345) % 2**31
        out.append(x)
    return out


def _f(x, k: int):
    """The round function on a half: multiply, add, fold the high bits down. Columns or ints."""
    y = x * MULTIPLIER + k
    if isinstance(y, Column):
        return F.shiftright(y, 11)
    return y >> 11


def _once(x, n: int, key: int):
    a, b = domain(n)
    left = x % a
    right = F.call_function("div", x, F.lit(a)) if isinstance(x, Column) else x // a
    for i, k in enumerate(round_keys(key)):
        if i % 2 == 0:
            left = (left + _f(right, k)) % a
        else:
            right = (right + _f(left, k)) % b
    return right * a + left


def permute_int(x: int, n: int, key: int = KEY) -> int:
    """The same permutation on the driver, for looking up single rows."""
    y = _once(x, n, key)
    while y >= n:
        y = _once(y, n, key)
    return y


def unpermute_int(y: int, n: int, key: int = KEY) -> int:
    """The row number that sits at position ``y``."""
    a, b = domain(n)
    while True:
        left, right = y % a, y // a
        for i, k in reversed(list(enumerate(round_keys(key)))):
            if i % 2 == 0:
                left = (left - _f(right, k)) % a
            else:
                right = (right - _f(left, k)) % b
        y = right * a + left
        if y < n:
            return y


def permute(x: Column, n: int, key: int = KEY) -> Column:
    """Cycle walking as a fold: a value inside [0, n) stands still. One still outside after all walks is an error."""
    first = _once(x, n, key)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda y, _: F.when(y < n, y).otherwise(_once(y, n, key)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, order: list[str], label: str = "rows") -> tuple[DataFrame, int]:
    """``rows`` with their global number in ``order`` (from 0, gapless) as ``row``, and how many there are.

    Rows are dealt out by range and written once; only one count for each range meets, never the rows. The table of
    offsets has one row for each range, at most as many as the session has shuffle partitions.
    """
    spark = rows.sparkSession
    dealt = cut(rows.repartitionByRange(width(spark), *order).withColumn("__part", F.spark_partition_id()), label)
    counts = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "__part int, __start long") if starts else spark.createDataFrame([], "__part int, __start long")
    within = Window.partitionBy("__part").orderBy(*order)
    out = dealt.join(F.broadcast(offsets), "__part").withColumn("row", F.col("__start") + F.row_number().over(within) - 1)
    return out.drop("__part", "__start"), total


def shard(docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard and slot of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__tie"))
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "__tie"], "shard")
    placed = numbered.withColumn("position", permute(F.col("row"), max(1, n), key))
    return placed.select("doc_id", "size", "text_crc32", "row", "position", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "position")
