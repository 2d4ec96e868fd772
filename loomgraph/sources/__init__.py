"""Readers and writers: graph files, partitions, run rows, caches and reports."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def reader(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, path: str) -> dict[str, DataFrame]:
    """The tables of a dataset in the format ``name``."""
    if name not in READERS:
        raise KeyError(f"unknown format {name}; known: {', '.join(sorted(READERS))}")
    return READERS[name](spark, path)


@reader("parquet")
def read_parquet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (node, text, label) and raw_edges (a, b), with class names in a CSV with a header."""
    return {"nodes": spark.read.parquet(f"{path}/nodes"), "raw_edges": spark.read.parquet(f"{path}/edges"), "classes": spark.read.csv(f"{path}/categories.csv", header=True)}


@reader("gzip-csv")
def read_gzip_csv(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """edge.csv.gz, node-label.csv.gz, nodeidx2paperid.csv.gz (node, paper) and titleabs.tsv; rows with fewer than three
    fields or a key that isn't a number are dropped, missing texts are empty."""
    edges = spark.read.csv(f"{path}/edge.csv.gz", schema="a long, b long")
    # the line is the node: a gzip file can't be split, so its one partition numbers the lines from 0
    labels = spark.read.csv(f"{path}/node-label.csv.gz", schema="label long").select(F.monotonically_increasing_id().alias("node"), "label")
    ids = spark.read.csv(f"{path}/nodeidx2paperid.csv.gz", header=True, schema="node long, paper long")
    lines = spark.read.text(f"{path}/titleabs.tsv").select(F.split("value", "\t", 3).alias("f")).filter(F.size("f") >= 3)
    titles = lines.select(F.expr("try_cast(f[0] AS bigint)").alias("paper"), F.concat_ws(" ", F.get("f", F.lit(1)), F.get("f", F.lit(2))).alias("text")).filter("paper is not null").dropDuplicates(["paper"])
    nodes = ids.join(titles, "paper", "left").join(labels, "node", "left").select("node", F.coalesce("text", F.lit("")).alias("text"), "label")
    return {"nodes": nodes, "raw_edges": edges, "labels": labels}


@reader("neighbour-csv")
def read_neighbour_csv(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A CSV with node_id, neighbour (literal list), label, category, text: nodes without an edge go, ids become dense."""
    from loomgraph.plans.engine import plan

    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.expr("try_cast(node_id AS bigint)").alias("node"), F.col("neighbour").alias("neighbours"), "category", F.expr("try_cast(label AS bigint)").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    import loomgraph.operators.text  # noqa: F401

    ids = plan(spark, "listed_ids", neighbour_lists=rows)
    return {
        "nodes": rows.join(ids, "node").select(F.col("id").alias("node"), "text", "label"),
        "raw_edges": plan(spark, "listed_graph", neighbour_lists=rows).select(F.col("src").alias("a"), F.col("dst").alias("b")),
        "classes": plan(spark, "listed_names", neighbour_lists=rows),
    }


def write_partition(comms: DataFrame, path: str, dataset: str, method: str, tag: str, seed: int) -> None:
    comms.withColumns({"dataset": F.lit(dataset), "method": F.lit(method), "tag": F.lit(tag), "seed": F.lit(seed)}).write.mode("append").partitionBy("dataset", "method", "tag", "seed").parquet(path)


def append_runs(rows: DataFrame, path: str) -> None:
    """Run rows as JSON lines."""
    rows.write.mode("append").json(path)


def open_jobs(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that have no row in ``done`` yet."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def write_errors(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_move_log(log: DataFrame, path: str, dataset: str, seed: int) -> None:
    log.withColumns({"dataset": F.lit(dataset), "seed": F.lit(seed)}).write.mode("append").partitionBy("dataset", "seed").parquet(path)


def cached(path: str, compute: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The table at ``path``, computed and written on first use; what a write that died has left is written anew."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(table: DataFrame, style: str = "markdown", most: int = 100) -> str:
    """A small result table as Markdown, HTML or LaTeX rows."""
    rows = table.limit(most).collect()
    cells = [[f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    if style == "markdown":
        return "\n".join(["| " + " | ".join(x) + " |" for x in [table.columns, ["---"] * len(table.columns), *cells]])
    if style == "html":
        line = lambda tag, x: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in x) + "</tr>"
        return "<table>" + line("th", table.columns) + "".join(line("td", c) for c in cells) + "</table>"
    if style == "latex":
        return "\n".join(" & ".join(c.replace("_", r"\_").replace("%", r"\%") for c in x) + r" \\" for x in cells)
    raise ValueError(style)


def cached_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines at ``path``, or no rows if nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
