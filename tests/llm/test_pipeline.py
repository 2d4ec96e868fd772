"""The pipeline: every stage keeps the columns, acts on its input and survives an empty table."""

import corpus_pipeline as pipeline
from loomgraph.llm import registry

SENTENCES = "The {a} of the {b} was over and in the end it is on for all who are with us from that {a}. It is the {b} by the {c} that was in the {a} and on."


def test_stages(spark, tmp_path):
    clean = [(i, SENTENCES.format(a=f"day{i}", b=f"road{i * 7}", c=f"river{i * 3}") + f" Only {i} of the words in it are the same as in that of number {i + 1}.", "en", f"s{i % 3}", 1) for i in range(40)]
    item = "what is the sum of all the even numbers between ten and one hundred in the list that was given to us"
    rows = [*clean, (100, clean[3][1], "en", "s0", 1), (101, clean[5][1] + " " + item + ". And so it goes on by the road.", "en", "s1", 1), (102, "JUNK!! " * 40, "en", "s2", 1), (103, None, None, None, None), (104, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mix_sources", "token_ids"]
    now, seen = docs, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "token_ids":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = sorted(r.doc_id for r in now.select("doc_id").collect())
    assert seen["quality_rules"] == [*range(40), 100, 101]
    assert seen["near_duplicates"] == [*range(40), 101] and seen["decontamination"] == [*range(40)]
    assert set(seen["mix_sources"]) <= set(range(40)) and seen["token_ids"] == seen["mix_sources"]
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen["token_ids"])


def test_empty_input(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0, name


def test_registry():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(registry.oracle_sql()) <= set(names)
