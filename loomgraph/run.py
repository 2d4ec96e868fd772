"""Experiments from the command line: load a graph, run methods over seeds, append run rows and partitions.

    python -m loomgraph.run --format parquet --path DIR --methods louvain,near,centroid,wmean --lams 0.25,0.5 --k 7 --seeds 0,1 --out DIR

``DIR`` holds nodes (node, text, label, x) and edges (a, b); texts without vectors are encoded by hashing. Runs that have a row already are skipped. ``--shuffle``
permutes the vectors across nodes, as a control.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import sources
from loomgraph.operators import encode, metrics, moves  # noqa: F401
from loomgraph.plans.engine import plan
from loomgraph.storage import cut

#: Methods with a weight of the semantic term; the others have none.
WEIGHTED = tuple(moves.PROTOTYPES)
METHODS = ("louvain", "near", "three_factor", *WEIGHTED)
KEYS = "dataset string, method string, lam double, seed int, tag string, shuffled boolean"
#: Columns of the run rows.
ROWS = KEYS + ", nmi double, ari double, purity double, acc double, q double, k long, time double"


def run_one(tables: dict[str, DataFrame], method: str, k: int, seed: int, shuffle: bool = False, **given) -> tuple[DataFrame, dict]:
    """The partition and its run row; ``given``: parameters of the method, such as lam, gamma or tau."""
    nodes = tables["nodes"]
    spark = nodes.sparkSession
    emb = nodes.select("node", F.transform("x", lambda v: v.cast("double")).alias("x"))
    if shuffle:
        emb = plan(spark, "shuffled_emb", emb=emb)
    edges = plan(spark, "edges", raw_edges=tables["raw_edges"], nodes=nodes.select("node"))
    began = time.time()
    comms = moves.pipeline(emb, edges, nodes.select("node"), k, method, seed, **given)
    labelled = comms.join(nodes.select("node", "label"), "node").select("node", F.col("comm").alias("pred"), F.col("label").alias("y"))
    row = plan(spark, "metric_bundle", labelled=labelled).head().asDict()
    row |= {"acc": moves.accuracy(labelled).head()["acc"], "q": moves.modularity(edges, comms)}
    return comms, row | {"time": time.time() - began}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--format", default="parquet"), p.add_argument("--path", required=True), p.add_argument("--dataset", default="graph")
    p.add_argument("--methods", default="louvain"), p.add_argument("--seeds", default="0"), p.add_argument("--k", type=int)
    p.add_argument("--lams", default="0.5", help="weights of the semantic term, each run by the methods that have one")
    p.add_argument("--gamma", type=float, default=0.5), p.add_argument("--tau", type=float, default=3.0), p.add_argument("--fraction", type=float, default=0.5)
    p.add_argument("--wc", type=float, default=0.25), p.add_argument("--wd", type=float, default=0.25), p.add_argument("--sigma-scale", type=float, default=1.0), p.add_argument("--no-gate", action="store_true")
    p.add_argument("--out", required=True), p.add_argument("--tag", default="main"), p.add_argument("--shuffle", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    tables = sources.load(spark, a.format, a.path)
    if "x" not in tables["nodes"].columns:
        tables["nodes"] = cut(tables["nodes"].join(encode.encoded(tables["nodes"]), "node"), "encoded")
    k = a.k or tables["nodes"].select("label").distinct().count()
    for method, seed in ((m, int(x)) for m in a.methods.split(",") for x in a.seeds.split(",")):
        for lam in map(float, a.lams.split(",")) if method in WEIGHTED else (None,):
            given = {"lam": lam, "gate": not a.no_gate, "gamma": a.gamma, "tau": a.tau, "tau_margin": a.tau, "fraction": a.fraction} if method in WEIGHTED else {}
            given |= {"wc": a.wc, "wd": a.wd, "gate": not a.no_gate} if method == "three_factor" else {"sigma_scale": a.sigma_scale} if method == "near" else {}
            job = spark.createDataFrame([(a.dataset, method, lam, seed, a.tag, a.shuffle)], KEYS).withColumn("lam", F.coalesce("lam", F.lit(-1e0)))
            done = sources.cached_json(spark, f"{a.out}/runs", ROWS).withColumn("lam", F.coalesce("lam", F.lit(-1e0)))
            if sources.open_jobs(job, done, ["dataset", "method", "lam", "seed", "tag", "shuffled"]).isEmpty():
                continue
            comms, row = run_one(tables, method, k, seed, a.shuffle, **given)
            tag = a.tag if lam is None else f"{a.tag}-l{lam:g}"
            sources.write_partition(comms, f"{a.out}/partitions", a.dataset, method, tag, seed)
            sources.append_runs(spark.createDataFrame([(a.dataset, method, lam, seed, a.tag, a.shuffle, row["nmi"], row["ari"], row["purity"], row["acc"], row["q"], row["k"], row["time"])], ROWS), f"{a.out}/runs")


if __name__ == "__main__":
    main()
