"""Kernels against values computed from scratch, and the pipelines: exactly K, the distributed ways, parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import loomgraph.catalog  # noqa: F401
from loomgraph.operators import kernels, moves
from loomgraph.plans.engine import plan

SF = "/root/testdata/sf0.001"


def planted(seed=0, groups=4, size=15, p=0.5, q=0.04):
    r = np.random.default_rng(seed)
    n = groups * size
    ends = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < (p if a // size == b // size else q)]
    x = r.normal(size=(n, 8)) * 0.4 + np.eye(8)[np.arange(n) // size % 8] * 2
    return n, np.array(ends), x / np.linalg.norm(x, axis=1, keepdims=True)


def graph(seed=0, comm=None, **kind):
    n, e, x = planted(seed, **kind)
    c = np.arange(n) * 7 % 6 if comm is None else comm
    return kernels.Graph(np.arange(n), c, e[:, 0], e[:, 1], np.ones(len(e))), x


def terms(g, x, factor=0.3):
    s = (1 + x @ np.stack([x[g.c == c].sum(0) for c in range(len(g.ids))]).T / 5) / 2
    return kernels.Margins(g, s, factor)


def value(g, x, kind, s=None):
    if kind == "plain":
        return g.modularity()
    if kind == "near":
        out = 0.0
        for c in range(len(g.ids)):
            m = g.c == c
            if m.any():
                spread = ((x[m] - x[m].mean(0)) ** 2).sum(1).mean()
                out += (g.mc[c] / g.m - (g.dc[c] / (2 * g.m)) ** 2) / (1 + spread / 0.49)
        return out
    own = s[np.arange(len(s)), g.c]
    rest = s.copy()
    rest[np.arange(len(s)), g.c] = -np.inf
    return 0.7 * g.modularity() + 0.3 * (own - rest.max(1)).sum()


def objective(g, x, kind):
    return {"plain": lambda: kernels.Plain(g), "near": lambda: kernels.Near(g, x, 0.7), "semantic": lambda: kernels.Semantic(g, 0.7, [terms(g, x)])}[kind]()


@pytest.mark.parametrize("kind", ["plain", "near", "semantic"])
def test_gains_are_changes_of_the_value(kind):
    g, x = graph()
    o, r = objective(g, x, kind), np.random.default_rng(1)
    s = lambda: o.terms[0].s if kind == "semantic" else None
    for v in r.permutation(len(x))[:25].tolist():
        a = int(g.c[v])
        to, k = g.around(v)
        ka, k, to = float(k[to == a].sum()), k[to != a], to[to != a]
        before, gain = value(g, x, kind, s()), o.gains(v, a, to, k, ka)
        b = int(np.argmax(gain))
        o.moved(v, a, int(to[b]))
        g.move(v, a, int(to[b]), ka, float(k[b]))
        assert abs(value(g, x, kind, s()) - before - gain[b]) < 1e-9
    while g.alive > 2:
        a, b, e = g.between()
        before, (gain, keep) = value(g, x, kind, s()), o.pairs(a, b, e)
        i = int(np.argmax(gain))
        o.merged(int(a[i]), int(b[i]), keep[i])
        g.merge(int(a[i]), int(b[i]), float(e[i]))
        assert g.alive == 2 and kind == "semantic" or abs(value(g, x, kind, s()) - before - gain[i]) < 1e-9


def test_louvain_finds_planted_groups():
    n, e, _ = planted(3)
    got = kernels.louvain(np.arange(n), e[:, 0], e[:, 1], np.ones(len(e)), 0, 20)
    assert [len(set(got[i * 15 : i * 15 + 15].tolist())) for i in range(4)] == [1] * 4 and len(set(got.tolist())) == 4


@pytest.fixture(scope="module")
def tables(spark):
    n, e, x = planted(5)
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    return spark.createDataFrame(e.tolist(), "src long, dst long"), spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node long, x array<double>"), nodes


def groups(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["comm"], set()).add(r["node"] // 15)
    return by


@pytest.mark.parametrize("method", ["louvain", "near", "three_factor", "centroid", "descr", "wmean", "cagree", "dexp"])
def test_pipelines_reach_k(spark, tables, method):
    edges, emb, nodes = tables
    for k in (4, 3):
        got = moves.pipeline(emb, edges, nodes, k, method)
        by = groups(got)
        assert got.count() == 60 and len(by) == k and (k == 3 or all(len(x) == 1 for x in by.values()))


def test_distributed_ways_come_near_the_kernels(spark, tables, monkeypatch):
    edges, emb, nodes = tables
    exact = moves.modularity(edges, moves.louvain(edges, nodes))
    monkeypatch.setattr(moves, "KERNEL_EDGES", 40)
    bulk = moves.louvain(edges, nodes)
    assert moves.modularity(edges, bulk) > exact - 0.02
    assert len(groups(moves.louvain_k(edges, nodes, 3))) == 3
    monkeypatch.setattr(moves, "KERNEL_CELLS", 10)
    log = []
    found = list(moves.semantic_clustering(emb, edges, bulk, 3, phases=2, log=log))[-1]
    assert len(groups(found)) == 3 and len({x["scale"] for x in log}) == 1 and len(log) <= 2


def test_bulk_moves_keep_k(spark, tables):
    edges, _, nodes = tables
    start = nodes.select("node", (F.col("node") % 6).alias("comm"))
    assert moves.local_move_bulk(edges, start, k=6).select("comm").distinct().count() == 6


def test_a_closed_gate_leaves_modularity(spark, tables):
    edges, emb, nodes = tables
    start, log = moves.louvain(edges, nodes), []
    noise = emb.select("node", F.array(*[(F.pmod(F.xxhash64("node", F.lit(i)), F.lit(997)) - 498).cast("double") for i in range(6)]).alias("x"))
    list(moves.semantic_clustering(noise, edges, start, 4, phases=1, proto="descr", log=log))
    assert log[0]["lam_eff"] == 0.0


def test_parameters_reach_the_relations(spark):
    q, sem, scale = (plan(spark, x, SF).head()[0] for x in ("semantic_value", "q_sem", "sem_scale"))
    only = {lam: plan(spark, "semantic_value", SF, lam=lam).head()[0] for lam in (0.0, 1.0)}
    assert abs(q - (only[0.0] + only[1.0]) / 2) < 1e-8 and abs(only[1.0] - sem * scale) < 1e-8
    modes = {m: plan(spark, "agree_gain", SF, mode=m).count() for m in ("agree", "cent", "desc")}
    assert modes["agree"] <= min(modes["cent"], modes["desc"])
