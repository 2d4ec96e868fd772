"""The experiment protocol: which methods, weights and seeds a dataset is run with, and the reports of all its runs.

    python -m loomgraph.protocol --path DIR --dataset NAME --seeds 0,1,2,3,4 --out OUT

Runs that have a row already are skipped, so a protocol that was stopped goes on where it was. ``--report`` writes the
report of all rows in OUT alone.
"""

from __future__ import annotations

import argparse
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Step(NamedTuple):
    """Methods that are run alike; ``lam`` is the weight of the semantic term where they have one."""

    step: str
    methods: tuple[str, ...]
    lam: float | None
    tag: str
    shuffled: bool = False
    first_seed_only: bool = False


STEPS = (
    Step("baselines", ("louvain", "near"), None, "audit"),
    Step("baselines", ("centroid", "descr"), 0.5, "audit"),
    Step("agreement", ("cagree",), 0.5, "cagree"),
    Step("controls", ("cexp",), 0.5, "cexp"),
    Step("controls", ("dexp",), 0.5, "dexp"),
    Step("shuffled", ("louvain",), None, "shuffle2", True, True),
    Step("shuffled", ("centroid", "cagree"), 0.5, "shuffle2", True, True),
)


def jobs(seeds: DataFrame) -> DataFrame:
    """dataset, step, method, lam, tag, shuffled and seed of every run, for ``seeds`` (dataset, seed)."""
    rows = [(s.step, m, s.lam, s.tag, s.shuffled, s.first_seed_only) for s in STEPS for m in s.methods]
    steps = seeds.sparkSession.createDataFrame(rows, "step string, method string, lam double, tag string, shuffled boolean, one boolean")
    first = seeds.groupBy(F.col("dataset").alias("__dataset")).agg(F.min("seed").alias("__first"))
    each = seeds.join(first, F.col("dataset") == F.col("__dataset")).join(F.broadcast(steps), ~F.col("one") | (F.col("seed") == F.col("__first")))
    return each.select("dataset", "step", "method", "lam", "tag", "shuffled", "seed")


def main(argv: list[str] | None = None) -> None:
    from loomgraph import reports, run, sources

    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--format", default="parquet"), p.add_argument("--path"), p.add_argument("--dataset", default="graph")
    p.add_argument("--seeds", default="0,1,2,3,4"), p.add_argument("--k", type=int), p.add_argument("--out", required=True)
    p.add_argument("--report", action="store_true", help="no runs, the report of all rows only"), p.add_argument("--style", default="markdown")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if not a.report:
        first = str(min(map(int, a.seeds.split(","))))
        for s in STEPS:
            words = ["--format", a.format, "--path", a.path, "--dataset", a.dataset, "--methods", ",".join(s.methods), "--seeds", first if s.first_seed_only else a.seeds, "--out", a.out, "--tag", s.tag]
            words += [] if s.lam is None else ["--lams", str(s.lam)]
            words += [] if a.k is None else ["--k", str(a.k)]
            run.main(words + ["--shuffle"] * s.shuffled)
    rows = sources.cached_json(spark, f"{a.out}/runs", run.ROWS)
    text = reports.result_report(rows, a.style)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{a.out}/report-{a.style}")


if __name__ == "__main__":
    main()
