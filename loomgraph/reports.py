"""Reports of run rows: tables of settings by datasets, aggregated in Spark and rendered from what is left.

A setting is a method with its tag. Rows of shuffled runs have a table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.sources import report

METRICS = ("nmi", "ari", "acc", "purity", "q")
#: Metrics that are compared seed by seed, and the method they are compared with.
PAIRED, BASE = ("nmi", "acc", "purity"), "centroid"
_TITLE = {"markdown": "## {}\n", "html": "<h2>{}</h2>", "latex": "% {}"}


def _setting():
    return F.concat_ws(" ", "method", "tag").alias("setting")


def _number(x, digits: int = 3):
    return F.format_string(f"%.{digits}f", x)


def _by_dataset(cells: DataFrame) -> DataFrame:
    """One row for each setting of ``cells`` (setting, dataset, cell), a column for each dataset."""
    return cells.groupBy("setting").pivot("dataset").agg(F.first("cell")).na.fill("--").orderBy("setting")


def seeds(runs: DataFrame) -> DataFrame:
    return _by_dataset(runs.groupBy(_setting(), "dataset").agg(F.countDistinct("seed").cast("string").alias("cell")))


def means(runs: DataFrame, metric: str) -> DataFrame:
    """Mean and standard deviation over seeds; the best of a dataset has two stars, the second one."""
    stats = runs.groupBy(_setting(), "dataset").agg(F.avg(metric).alias("m"), F.stddev_pop(metric).alias("s")).filter("m IS NOT NULL")
    place = F.rank().over(Window.partitionBy("dataset").orderBy(F.desc("m")))
    mark = F.when(place == 1, "**").when(place == 2, "*").otherwise("")
    return _by_dataset(stats.withColumn("cell", F.concat(_number(F.col("m")), F.lit(" ± "), _number(F.col("s")), mark)))


def paired(runs: DataFrame, metric: str) -> DataFrame:
    """Mean difference to BASE over the seeds of both, with the number of seeds that win."""
    base = runs.filter((F.col("method") == BASE)).groupBy("dataset", "seed").agg(F.avg(metric).alias("b"))
    gaps = runs.filter(F.col("method") != BASE).join(base, ["dataset", "seed"]).withColumn("d", F.col(metric) - F.col("b")).filter("d IS NOT NULL")
    cell = F.concat(F.format_string("%+.3f", F.avg("d")), F.lit(" ("), F.count_if(F.col("d") > 0), F.lit("/"), F.count("*"), F.lit(")"))
    return _by_dataset(gaps.groupBy(_setting(), "dataset").agg(cell.alias("cell")))


def runtime(runs: DataFrame) -> DataFrame:
    return _by_dataset(runs.groupBy(_setting(), "dataset").agg(_number(F.avg("time"), 0).alias("cell")))


def result_report(runs: DataFrame, style: str = "markdown") -> str:
    """All tables of ``runs`` (dataset, method, seed, tag, shuffled, metrics, time), as Markdown, HTML or LaTeX rows."""
    plain, shuffled = runs.filter("NOT shuffled"), runs.filter("shuffled")
    tables = [("Seeds", seeds(plain))] + [(m, means(plain, m)) for m in METRICS]
    tables += [(f"{m}: difference to {BASE}, seeds that win", paired(plain, m)) for m in PAIRED] + [("Seconds", runtime(plain))]
    tables += [(f"Shuffled vectors: {m}", means(shuffled, m)) for m in ("nmi",)]
    return "\n\n".join(_TITLE[style].format(name) + "\n" + report(table, style) for name, table in tables)
