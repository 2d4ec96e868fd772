"""Relation plans against DuckDB on the smallest fixture, and properties of the operators."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.operators import moves
from loomgraph.operators.components import components
from loomgraph.plans.engine import TABLES, plan

SF = "/root/testdata/sf0.001"


def ring(spark, n=60, parts=2):
    """Two rings joined by one edge: a planted partition."""
    half = n // parts
    edges = [(i, (i + d) % half + i // half * half if i % half + d >= half else i + d) for i in range(n) for d in (1, 2, 3)]
    edges = sorted({(min(a, b), max(a, b)) for a, b in edges if a != b}) + [(0, half)]
    return spark.createDataFrame(edges, "src long, dst long"), spark.range(n).select(F.col("id").alias("node"))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(repr(tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else x for x in r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
@pytest.mark.parametrize("name", ["o004_neighbour_lists", "o007_hash_encoder", "o017_clean_edges", "o020_community_stats", "o022_modularity", "o024_move_gain", "o026_merge_gain", "o035_top3", "o042_reliability_gate", "o045_prototype_wmean", "o050_extra_candidate", "o054_sn_move_gain", "o058_semantic_merge_gain", "o071_prompts", "o080_nmi", "o082_accuracy", "o093_correction_rules", "o098_paired_delta", "o112_majority_vote", "o030_components", "o030_component_count", "o030_fragmented", "o001_parquet_source", "o007_dense_vectors", "o008_cached_vectors", "o009_partition_files", "o010_run_rows", "o011_error_rows", "o012_move_log_rows", "o016_protocol_jobs", "o073_parsed_answers"])
def test_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) and rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_every_relation_has_an_oracle():
    oracles = catalog.oracle_sql()
    assert set(catalog.PLANS) <= set(oracles) and len(catalog.queries()) > 110


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")
def test_golden_modularity_of_brands(spark):
    brands = plan(spark, "classes", SF).select("node", F.col("label").alias("comm"))
    row = plan(spark, "modularity", SF, comms=brands).head()
    assert (int(row["m"]), row["n_comm"]) == (8899, 25) and abs(row["q"] + 0.0030038) < 1e-7


def test_gains_are_differences_of_the_value(spark):
    edges, nodes = ring(spark)
    comms = nodes.select("node", F.expr("node % 5").alias("comm"))
    given = {"edges": edges, "comms": comms, "nodes": nodes}
    before = moves.modularity(edges, comms)
    move = plan(spark, "move_gain", **given).orderBy("v", "b").head()
    after = moves.modularity(edges, comms.select("node", F.when(F.col("node") == move["v"], move["b"]).otherwise(F.col("comm")).alias("comm")))
    assert abs(after - before - move["dq"]) < 1e-8
    merge = plan(spark, "merge_gain", **given).orderBy("a", "b").head()
    after = moves.modularity(edges, comms.select("node", F.when(F.col("comm") == merge["b"], merge["a"]).otherwise(F.col("comm")).alias("comm")))
    assert abs(after - before - merge["dq"]) < 1e-8


def test_planted_partition_is_recovered(spark):
    edges, nodes = ring(spark)
    found = {r["node"]: r["comm"] for r in moves.louvain_k(edges, nodes, 2).collect()}
    assert len(set(found.values())) == 2 and len({found[i] for i in range(30)}) == 1 and found[0] != found[59]


def test_merge_reaches_k_even_without_edges(spark):
    edges, nodes = ring(spark)
    comms = nodes.unionByName(spark.createDataFrame([(100,), (101,)], "node long")).select("node", F.col("node").alias("comm"))
    assert moves.merge_to_k(edges, comms, 3).select("comm").distinct().count() == 3


def test_bulk_rounds_never_lower_modularity(spark):
    edges, nodes = ring(spark)
    start = nodes.select("node", F.expr("node % 7").alias("comm"))
    assert moves.modularity(edges, moves.local_move_bulk(edges, start, 4)) >= moves.modularity(edges, start)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (102, 100), (None, 5)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102)) and len(got) == 44
    assert components(e.filter("src > 1000")).count() == 0


def test_assignment_against_permutations():
    from itertools import permutations

    r = np.random.default_rng(3)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        g = r.integers(0, 20, (n, m))
        best = max(sum(g[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else max(sum(g[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        assert sum(g[a, b] for a, b in moves.assignment(g)) == best


def vector_ring(spark):
    edges, nodes = ring(spark)
    return edges, nodes.select("node", F.when(F.col("node") < 30, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).alias("x"))


@pytest.mark.parametrize("method", list(moves.OBJECTIVES))
def test_objectives_repair_a_spoiled_partition(spark, method):
    edges, emb = vector_ring(spark)
    planted = emb.select("node", F.expr("CASE WHEN node < 30 THEN 0L ELSE 1L END").alias("comm"))
    spoiled = planted.select("node", F.when(F.col("node").isin(3, 40, 51), 1 - F.col("comm")).otherwise(F.col("comm")).alias("comm"))
    from loomgraph.functions import unit

    given = emb.select("node", unit(F.col("x")).alias("x"))
    got = moves.objective_moves(given, edges, spoiled, method, 6)
    assert got.exceptAll(planted).count() == 0


def test_command_line(spark, tmp_path):
    from loomgraph import run

    edges, emb = vector_ring(spark)
    emb.select("node", F.lit("t").alias("text"), F.expr("CAST(node >= 30 AS INT)").alias("label"), "x").write.parquet(f"{tmp_path}/in/nodes")
    edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).write.parquet(f"{tmp_path}/in/edges")
    (tmp_path / "in" / "categories.csv").write_text("label,name\n0,a\n1,b\n")
    for _ in range(2):
        run.main(["--path", f"{tmp_path}/in", "--methods", "louvain", "--out", f"{tmp_path}/out"])
    rows = spark.read.json(f"{tmp_path}/out/runs").collect()
    assert len(rows) == 1 and rows[0]["nmi"] == 1 and rows[0]["acc"] == 1 and rows[0]["k"] == 2
    assert spark.read.parquet(f"{tmp_path}/out/partitions").count() == 60
