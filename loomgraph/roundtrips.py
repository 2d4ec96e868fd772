"""Queries over sinks and sources: what was written is read back, and has to be the relation that went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import protocol, sources
from loomgraph.operators import analysis, describe, encode, metrics, objectives, text, vectors  # noqa: F401  (define their relations)
from loomgraph.plans.engine import duckdb_sql, plan
from loomgraph.storage import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loomgraph-files-{uuid.uuid4().hex}"


def parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a graph in the Parquet format, through the dispatcher."""
    path = _folder(spark)
    plan(spark, "texts", sf_dir).select("node", "text", F.col("y").alias("label")).write.parquet(f"{path}/nodes")
    plan(spark, "vedges", sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")).write.parquet(f"{path}/edges")
    plan(spark, "texts", sf_dir).select(F.col("y").alias("name")).distinct().write.option("header", True).csv(f"{path}/categories.csv")
    got = sources.load(spark, "parquet", path)
    ends = got["raw_edges"].select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    named = got["nodes"].join(got["classes"], F.col("label") == F.col("name"))
    return named.join(ends, "node", "left").select("node", "label", F.md5("text").alias("text"), F.coalesce("n", F.lit(0)).alias("n_edges"))


def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from the cache: computed and written at first, read only from then on."""
    path = _folder(spark)
    sources.cached(path, lambda: plan(spark, "emb", sf_dir), spark)
    return plan(spark, "emb_out", emb=sources.cached(path, lambda: plan(spark, "emb", sf_dir).limit(0), spark))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing encoder's vectors with all their positions."""
    return plan(spark, "emb_out", emb=encode.encoded(plan(spark, "texts", sf_dir)))


def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    for method in ("louvain", "centroid"):
        sources.write_partition(plan(spark, "vcomms", sf_dir), path, "graph", method, "main", 0)
    return spark.read.parquet(path).select("node", "comm", "dataset", "method", "tag", "seed")


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without a row in the file of runs."""
    path = _folder(spark)
    sources.append_runs(plan(spark, "done_runs", sf_dir), path)
    jobs = plan(spark, "runs", sf_dir).select("dataset", "method", "seed").distinct()
    return sources.open_jobs(jobs, sources.cached_json(spark, path, "dataset string, method string, seed long"), ["dataset", "method", "seed"])


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misplaced nodes as the CSV of errors holds them."""
    path, rows = _folder(spark), plan(spark, "signals_out", sf_dir).filter("correct = 0")
    sources.write_errors(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


def move_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, log = _folder(spark), plan(spark, "move_log", sf_dir)
    sources.write_move_log(log, path, "graph", 0)
    return spark.read.parquet(path).select(*log.columns, "dataset", "seed")


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of answers as JSON, as bullets and as neither, one of each three events."""
    raw = plan(spark, "raw_answers", sf_dir)
    return raw.select("item", F.posexplode(describe.parsed(F.col("raw")))).select("item", F.col("pos").cast("long").alias("pos"), F.col("col").alias("candidate"))


def protocol_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiments of every dataset with the seeds that its runs have."""
    return protocol.jobs(plan(spark, "runs", sf_dir).select("dataset", "seed").distinct())


QUERIES = {
    "o001_parquet_source": parquet_source,
    "o007_dense_vectors": dense_vectors,
    "o008_cached_vectors": cached_vectors,
    "o009_partition_files": partition_files,
    "o010_run_rows": run_rows,
    "o011_error_rows": error_rows,
    "o012_move_log_rows": move_log_rows,
    "o016_protocol_jobs": protocol_jobs,
    "o073_parsed_answers": parsed_answers,
}

_JOBS = ", ".join(f"('{j.step}', '{m}', {'NULL' if j.lam is None else j.lam}, '{j.tag}', {j.shuffled}, {j.first_seed_only})" for j in protocol.STEPS for m in j.methods)

SQL = {
    "o001_parquet_source": "SELECT d.doc_id AS node, d.lang AS label, md5(coalesce(d.text, '')) AS text, coalesce(e.n, 0) AS n_edges FROM documents d LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT v.vec_id AS node FROM embeddings v, (SELECT count(*) AS n FROM embeddings) c, (VALUES (1), (7), (-1), (-7)) AS o(d) WHERE v.vec_id + o.d >= 0 AND v.vec_id + o.d < c.n) GROUP BY node) e ON d.doc_id = e.node WHERE d.lang IS NOT NULL",
    "o007_dense_vectors": duckdb_sql("dense_encoding"),
    "o008_cached_vectors": "SELECT vec_id AS node, unnest(range(len(embedding))) AS pos, round(unnest(CAST(embedding AS DOUBLE[])), 9) + 0e0 AS val FROM embeddings",
    "o009_partition_files": "SELECT vec_id AS node, CAST(label AS BIGINT) AS comm, 'graph' AS dataset, m.method, 'main' AS tag, 0 AS seed FROM embeddings CROSS JOIN (VALUES ('louvain'), ('centroid')) AS m(method)",
    "o010_run_rows": duckdb_sql("open_runs"),
    "o011_error_rows": f"SELECT * FROM ({duckdb_sql('signals_out')}) WHERE correct = 0",
    "o012_move_log_rows": f"SELECT *, 'graph' AS dataset, 0 AS seed FROM ({duckdb_sql('move_log')})",
    "o016_protocol_jobs": f"WITH r AS ({duckdb_sql('runs')}), s AS (SELECT DISTINCT dataset, seed FROM r), f AS (SELECT dataset, min(seed) AS seed FROM s GROUP BY dataset) SELECT s.dataset, j.step, j.method, CAST(j.lam AS DOUBLE) AS lam, j.tag, j.shuffled, s.seed FROM s JOIN f ON s.dataset = f.dataset CROSS JOIN (VALUES {_JOBS}) AS j(step, method, lam, tag, shuffled, one) WHERE NOT j.one OR s.seed = f.seed",
    "o073_parsed_answers": "SELECT event_id AS item, p.pos, CASE event_id % 3 WHEN 0 THEN concat(event_type, ' ', CAST(p.pos AS VARCHAR)) WHEN 1 THEN concat('three words ', event_type) ELSE concat('just ', event_type) END AS candidate FROM events JOIN (VALUES (0), (1)) AS p(pos) ON p.pos = 0 OR event_id % 3 = 0",
}
