"""Sources, sinks, caches, descriptions, functions and the streaming refresh."""

import gzip

import pandas as pd
from pyspark.sql import functions as F

from loomgraph import functions, sources
from loomgraph.operators import describe
from loomgraph.streaming import refresh_descriptions


def test_gzip_csv(spark, tmp_path):
    for name, text in {"edge.csv.gz": "0,1\n1,2\n", "node-label.csv.gz": "3\n4\n5\n", "nodeidx2paperid.csv.gz": "node,paper\n0,10\n1,11\n2,12\n"}.items():
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    (tmp_path / "titleabs.tsv").write_text("10\tA title\tan abstract\n11\tonly two\nx\ty\tz\n")
    got = sources.load(spark, "gzip-csv", str(tmp_path))
    assert [tuple(r) for r in got["nodes"].orderBy("node").collect()] == [(0, "A title an abstract", 3), (1, "", 4), (2, "", 5)]
    assert got["raw_edges"].count() == 2 and sorted(tuple(r) for r in got["labels"].collect()) == [(0, 3), (1, 4), (2, 5)]


def test_neighbour_csv(spark, tmp_path):
    pd.DataFrame({"node_id": [5, 7, 9, 11], "neighbour": ["[7, 5]", "[5]", "[99]", "[5, 7]"], "label": [0, 0, 1, 1], "category": ["a", "z", "b", "c"], "text": ["x", None, "y", "w"]}).to_csv(tmp_path / "g.csv", index=False)
    got = sources.load(spark, "neighbour-csv", str(tmp_path / "g.csv"))
    assert sorted(tuple(r) for r in got["raw_edges"].collect()) == [(0, 1), (0, 2), (1, 2)]
    assert sorted(tuple(r) for r in got["nodes"].collect()) == [(0, "x", 0), (1, "", 0), (2, "w", 1)]
    assert sorted(tuple(r) for r in got["classes"].collect()) == [(0, "a"), (1, "b")]


def test_sinks_and_resume(spark, tmp_path):
    comms = spark.createDataFrame([(1, 0), (2, 1)], "node long, comm long")
    sources.write_partition(comms, f"{tmp_path}/p", "ring", "louvain", "main", 3)
    assert spark.read.parquet(f"{tmp_path}/p").filter("seed = 3").count() == 2
    runs = spark.createDataFrame([("ring", 0, 0.5)], "dataset string, seed int, q double")
    sources.append_runs(runs, f"{tmp_path}/r"), sources.append_runs(runs, f"{tmp_path}/r")
    done = spark.read.json(f"{tmp_path}/r")
    jobs = spark.createDataFrame([("ring", 0), ("ring", 1)], "dataset string, seed int")
    assert done.count() == 2 and [r["seed"] for r in sources.open_jobs(jobs, done, ["dataset", "seed"]).collect()] == [1]
    sources.write_errors(comms, f"{tmp_path}/e"), sources.write_move_log(comms, f"{tmp_path}/m", "ring", 1)
    assert spark.read.csv(f"{tmp_path}/e", header=True).columns == ["node", "comm"] and spark.read.parquet(f"{tmp_path}/m").count() == 2
    assert "| node | comm |" in sources.report(comms) and "<td>1</td>" in sources.report(comms, "html") and r"1 & 0 \\" in sources.report(comms, "latex")
    calls = []
    for _ in range(2):
        assert sources.cached(f"{tmp_path}/c", lambda: calls.append(1) or comms, spark).count() == 2
    assert len(calls) == 1


def test_parsing_of_answers(spark):
    raw = spark.createDataFrame([('x {"candidates": ["a b", "c"]} y',), ("- one two three\n- four five\n2) six seven eight",), ("short text",), ("{broken",)], "raw string")
    got = [r["c"] for r in raw.select(describe.parsed(F.col("raw")).alias("c")).collect()]
    assert got == [["a b", "c"], ["one two three", "six seven eight"], ["short text"], ["{broken"]]


def test_only_misses_are_generated(spark):
    prompts = spark.createDataFrame([(1, "graphs graphs databases"), (2, "systems theory")], "comm long, prompt string")
    answers, new = describe.generated(prompts, None, describe.TopWords())
    assert answers.count() == 2 and new.count() == 2
    more = prompts.unionByName(spark.createDataFrame([(3, "another prompt")], "comm long, prompt string"))
    answers, fresh = describe.generated(more, new, describe.TopWords())
    assert answers.count() == 3 and fresh.count() == 1


def test_judge_takes_the_first_valid_answer(spark):
    rows = spark.createDataFrame([(1, 1, None, "end_turn"), (1, 2, 2, "end_turn"), (2, 1, 9, "end_turn"), (3, 1, 1, "max_tokens"), (3, 4, 1, "end_turn")], "item long, attempt int, answer int, stop_reason string")
    assert {r["item"]: r["answer"] for r in describe.judged(rows, 5).collect()} == {1: 2, 2: None, 3: None}


def test_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], 5, 10)], "x array<double>, k int, n int").select(functions.unit(F.col("x")).alias("u"), functions.dot(F.col("x"), F.col("x")).alias("d"), functions.wilson(F.col("k"), F.col("n")).alias("w")).head()
    assert row["u"] == [0.6, 0.8] and row["d"] == 25 and abs(row["w"]["centre"] - 0.5) < 1e-9


def test_streaming_refresh(spark, tmp_path):
    old = spark.createDataFrame([(i, i % 2) for i in range(40)], "node long, comm long")
    spark.createDataFrame([(i, 1) for i in range(0, 20, 2)], "node long, comm long").write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("node long, comm long").parquet(f"{tmp_path}/in")
    refresh_descriptions(stream, lambda: old, lambda df: seen.append(sorted(r["comm"] for r in df.collect())), f"{tmp_path}/cp").awaitTermination(120)
    assert seen == [[0, 1]]
