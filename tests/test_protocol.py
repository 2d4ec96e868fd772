"""Fragments, encoders, the protocol of runs and their reports."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from loomgraph import protocol, reports, run, sources
from loomgraph.operators import encode
from loomgraph.operators.components import all_components, fragments


def brute_components(nodes, edges):
    root = {v: v for v in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_fragments_against_brute_force(spark):
    r = np.random.default_rng(3)
    nodes, comm = list(range(40)), {v: int(r.integers(0, 3)) for v in range(40)}
    edges = sorted({(int(a), int(b)) for a, b in r.integers(0, 40, (30, 2)) if a != b})
    table, comms = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(list(comm.items()), "node long, comm long")
    whole = brute_components(nodes, edges)
    assert {r.node: r.component for r in all_components(table, comms).collect()} == whole
    inside = brute_components(nodes, [(a, b) for a, b in edges if comm[a] == comm[b]])
    sizes = {}
    for v in nodes:
        sizes[comm[v], inside[v]] = sizes.get((comm[v], inside[v]), 0) + 1
    largest = {c: min((-n, at) for (d, at), n in sizes.items() if d == c)[1] for c in set(comm.values())}
    got = {r.node: (r.component, r.fragmented) for r in fragments(table, comms).collect()}
    assert got == {v: (inside[v], inside[v] != largest[comm[v]]) for v in nodes}


def test_fragments_without_edges(spark):
    comms = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, comm long")
    none = spark.createDataFrame([], "src long, dst long")
    assert {r.node: r.fragmented for r in fragments(none, comms).collect()} == {1: False, 2: True, 3: False}
    assert fragments(none, comms.limit(0)).count() == 0


def test_encoders(spark):
    nodes = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, "beta " * 5000 + "alpha")], "node long, text string")
    got = {r.node: np.array(r.x) for r in encode.encoded(nodes).collect()}
    assert set(got) == {1, 2, 3} and all(len(x) == encode.BUCKETS for x in got.values())
    assert not got[2].any() and abs(np.linalg.norm(got[1]) - 1) < 1e-8
    # whole texts: the last word counts
    shorter = spark.createDataFrame([(3, "beta " * 5000)], "node long, text string")
    assert not np.allclose(encode.encoded(shorter).head().x, got[3], atol=1e-12)

    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    got = {r.node: r.x for r in encode.encoded(nodes, lengths, batch=2).collect()}
    assert np.allclose(got[2], [0, 1]) and np.allclose(got[1], np.array([15, 1]) / np.hypot(15, 1))


def test_protocol_from_files_to_report(spark, tmp_path):
    # two groups of nodes with words of their own, in the format of compressed CSVs, without vectors
    n, half = 24, 12
    edges = [(i, (i + d) % half + i // half * half) for i in range(n) for d in (1, 2)] + [(0, half)]
    titles = "".join(f"{i + 100}\t{'graph node edge' if i < half else 'protein cell gene'}\tpaper\n" for i in range(n))
    for name, text in {"edge.csv.gz": "".join(f"{a},{b}\n" for a, b in edges), "node-label.csv.gz": "".join(f"{int(i >= half)}\n" for i in range(n)), "nodeidx2paperid.csv.gz": "node,paper\n" + "".join(f"{i},{i + 100}\n" for i in range(n))}.items():
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    (tmp_path / "titleabs.tsv").write_text(titles)
    nodes = sources.load(spark, "gzip-csv", str(tmp_path))["nodes"]
    assert {r.node: r.label for r in nodes.collect()} == {i: int(i >= half) for i in range(n)}
    steps = protocol.STEPS
    protocol.STEPS = tuple(s for s in steps if s.step in ("baselines", "shuffled"))[:1] + (steps[-1]._replace(methods=("centroid",)),)
    try:
        for _ in range(2):
            protocol.main(["--format", "gzip-csv", "--path", str(tmp_path), "--dataset", "two", "--seeds", "0", "--out", f"{tmp_path}/out"])
    finally:
        protocol.STEPS = steps
    rows = sources.cached_json(spark, f"{tmp_path}/out/runs", run.ROWS).collect()
    assert sorted((r.method, r.shuffled) for r in rows) == [("centroid", True), ("louvain", False), ("near", False)]
    assert all(r.nmi == 1 for r in rows if not r.shuffled)
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/out/report-markdown").collect())
    assert "## nmi" in text and "| louvain audit | 1.000 ± 0.000** |" in text and "| centroid shuffle2 |" in text


def test_reports(spark):
    rows = [("d1", m, 0.5, s, "main", False, x + s / 100, 0.1, 0.2, x, 0.3, 2, 60.4) for m, x in (("centroid", 0.5), ("cagree", 0.6), ("louvain", 0.4)) for s in (0, 1)]
    runs = spark.createDataFrame(rows + [("d2", "centroid", 0.5, 0, "main", False, None, 0.1, 0.2, 0.3, 0.3, 2, 1.0)], run.ROWS)
    text = reports.result_report(runs)
    assert "| cagree main | 0.605 ± 0.005** |" in text and "| centroid main | 0.505 ± 0.005* |" in text
    assert "| cagree main | +0.100 (2/2) |" in text and "| louvain main | -0.100 (0/2) |" in text and "| cagree main | 60 | -- |" in text
    assert r"0.605 ± 0.005** \\" in reports.result_report(runs, "latex") and "<td>+0.100 (2/2)</td>" in reports.result_report(runs, "html")
    assert "## Seeds" in reports.result_report(runs.limit(0))


def test_jobs_of_the_protocol(spark):
    jobs = protocol.jobs(spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "dataset string, seed int")).collect()
    plain = sum(len(s.methods) for s in protocol.STEPS if not s.first_seed_only)
    once = sum(len(s.methods) for s in protocol.STEPS if s.first_seed_only)
    assert len(jobs) == 3 * plain + 2 * once and {r.seed for r in jobs if r.shuffled} == {1, 5}
    assert all((r.lam is None) == (r.method in ("louvain", "near")) for r in jobs)
    assert {m for s in protocol.STEPS for m in s.methods} <= set(run.METHODS)
