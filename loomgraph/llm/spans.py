"""Places of regex matches as Spark expressions: positions follow from the lengths of what lies between matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of an array that are folded one by one; blocks of them are folded again.
BLOCK = 64


def scanned(values: Column, zero: Column, kind: str, add, join) -> Column:
    """For each element the fold of all elements before it: ``add`` takes a state and an element, ``join`` two states.

    An appended array is copied, so one fold over n elements costs their square. Blocks are folded by themselves and
    behind the fold of the blocks before them, which costs a 64th of it, or 64 for each element.
    """

    def before(items: Column, start: Column, step) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(items, state, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def walk(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
        return bind(before(totals, zero, join), lambda heads: F.flatten(F.transform(blocks, lambda b, k: before(b, F.get(heads, k), add))))

    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    return bind(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda k: F.slice(values, k * BLOCK + 1, BLOCK)), walk)


def matches(text: Column, pattern: Column, size=F.length) -> Column:
    """array<struct<start, end, text>> of the leftmost non-overlapping matches, ascending.

    ``size`` measures a string (code points by default). The pieces between matches and the matches alternate, so the
    sums of their sizes yield every start.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, pattern)

    def place(m: Column, p: Column) -> Column:
        plus = lambda a, x: a + x
        starts = scanned(F.transform(m, lambda x, i: size(F.get(p, i)) + size(x)), F.lit(0), "int", plus, plus)
        return F.transform(starts, lambda s, i: F.struct((s + size(F.get(p, i))).alias("start"), (s + size(F.get(p, i)) + size(F.get(m, i))).alias("end"), F.get(m, i).alias("text")))

    return bind(found, lambda m: F.when(F.size(m) > 0, bind(pieces, lambda p: place(m, p))).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")))
