"""Iterative operators: local moves, Louvain, merging to K, optimal matching, evidence and pipelines.

Graphs within the checked bounds go through the sequential kernels (``kernels``) in one task; beyond them, bulk rounds
and contraction are loops of distributed plans, each round materialised in the shared folder. What else is sequential
(matching K classes, choosing ten of forty documents) runs over a table that is bounded by K or by the pool.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import kernels, objectives, text  # noqa: F401
from loomgraph.plans.engine import plan
from loomgraph.storage import cut

EPS, PASSES, PHASES = 1e-12, 20, 6
#: Bounds of the sequential kernels: edges, cells of a table of nodes by prototypes, and numbers in the prototypes.
KERNEL_EDGES, KERNEL_CELLS, KERNEL_PROTOTYPES = 5_000_000, 50_000_000, 10_000_000


def modularity(edges: DataFrame, comms: DataFrame) -> float:
    nodes = comms.select("node")
    return plan(comms.sparkSession, "modularity_from_edges", edges=edges, comms=comms, nodes=nodes).head()["q"]


def _in_one_task(edges: DataFrame, comms: DataFrame, emb: DataFrame | None, work: Callable) -> DataFrame:
    """(node, comm) from ``work(nodes, comm, src, dst, w, x)`` over arrays sorted by node, in one task."""

    wide = emb is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.kind == 0].sort_values("a")
        ends = pdf[pdf.kind == 1].sort_values(["a", "b"])
        x = np.array(nodes.x.tolist(), float) if wide else None
        out = work(nodes.a.to_numpy(np.int64), nodes.b.to_numpy(np.int64), ends.a.to_numpy(np.int64), ends.b.to_numpy(np.int64), ends.w.to_numpy(float), x)
        return pd.DataFrame({"node": nodes.a.to_numpy(np.int64), "comm": out})

    none = F.lit(None).cast("array<double>")
    nodes = comms.select("node", "comm", none.alias("x")) if emb is None else comms.join(emb, "node").select("node", "comm", F.transform("x", lambda v: v.cast("double")).alias("x"))
    weight = F.col("w").cast("double") if "w" in edges.columns else F.lit(1e0)
    rows = nodes.select(F.lit(0).alias("kind"), F.col("node").alias("a"), F.col("comm").alias("b"), F.lit(0e0).alias("w"), "x").unionByName(edges.select(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), weight.alias("w"), none.alias("x")))
    return rows.groupBy(F.lit(1).alias("g")).applyInPandas(run, "node long, comm long")


def local_move_exact(edges: DataFrame, comms: DataFrame, k: int = 1, seed: int = 0, passes: int = PASSES) -> DataFrame:
    """Sequential local moves in a seeded random order, best positive gain, never below ``k`` communities.

    More than KERNEL_EDGES edges are refused; ``local_move_bulk`` is the operator for those.
    """
    if edges.count() > KERNEL_EDGES:
        raise ValueError("too many edges for the sequential kernel; use local_move_bulk")

    def work(nodes, comm, src, dst, w, x):
        g = kernels.Graph(nodes, comm, src, dst, w)
        kernels.local_moves(g, kernels.Plain(g), k, passes, seed)
        return g.ids[g.c]

    return _in_one_task(edges, comms, None, work)


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.col("w").cast("double").alias("w") if "w" in edges.columns else F.lit(1e0).alias("w"))


def _bulk_state(edges: DataFrame, comms: DataFrame) -> tuple[DataFrame, float, int]:
    """(comm, dc) of every community, the modularity and the number of communities."""
    ends = edges.select(F.col("src").alias("node"), "w").unionByName(edges.select(F.col("dst").alias("node"), "w"))
    degree = ends.groupBy("node").agg(F.sum("w").alias("d"))
    dc = comms.join(degree, "node", "left").groupBy("comm").agg(F.sum(F.coalesce("d", F.lit(0e0))).alias("dc"))
    side = lambda c: comms.select(F.col("node").alias(c), F.col("comm").alias(f"c_{c}"))
    inner = edges.join(side("src"), "src").join(side("dst"), "dst").agg(F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0e0)).alias("inner"), F.sum("w").alias("m")).head()
    if not inner.m:
        return dc, 0.0, comms.select("comm").distinct().count()
    row = dc.agg(F.sum((F.col("dc") / (2 * inner.m)) ** 2).alias("expected"), F.count("*").alias("n")).head()
    return dc, inner.inner / inner.m - row.expected, row.n


def local_move_bulk(edges: DataFrame, comms: DataFrame, rounds: int = PASSES, k: int = 1) -> DataFrame:
    """Synchronous rounds of best moves over a graph of any size; ``edges`` (src, dst and, if there is one, w).

    Half of the movers (by hash and round) move at a time. A round that doesn't raise modularity is undone, and two of
    them in a row end the loop. Where fewer than ``k`` communities would be left, none is emptied.
    """
    comms, edges = cut(comms.select("node", "comm"), "comms"), cut(_weighted(edges), "edges")
    m = edges.agg(F.sum("w")).head()[0] or 0.0
    both = edges.filter("src <> dst")
    both = both.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionByName(both.select(F.col("dst").alias("v"), F.col("src").alias("u"), "w"))
    loops = edges.filter("src = dst").select(F.col("src").alias("v"), (2 * F.col("w")).alias("w"))
    degree = cut(both.select("v", "w").unionByName(loops).groupBy("v").agg(F.sum("w").alias("d")), "degree")
    dc, now, n = _bulk_state(edges, comms)
    failed = 0
    for r in range(rounds if m else 0):
        own = comms.select(F.col("node").alias("v"), F.col("comm").alias("a"))
        near = cut(both.join(comms.select(F.col("node").alias("u"), F.col("comm").alias("b")), "u").groupBy("v", "b").agg(F.sum("w").alias("k")), "near")
        at_home = near.join(own, "v").filter("a = b").select("v", F.col("k").alias("ka"))
        options = near.join(own, "v").filter("a <> b").join(at_home, "v", "left").join(degree, "v")
        options = options.join(dc.select(F.col("comm").alias("a"), F.col("dc").alias("da")), "a").join(dc.select(F.col("comm").alias("b"), F.col("dc").alias("db")), "b")
        gain = (F.col("k") - F.coalesce("ka", F.lit(0e0))) / m + F.col("d") * (F.col("da") - F.col("d") - F.col("db")) / (2 * m * m)
        best = options.withColumn("gain", gain).filter(F.col("gain") > EPS).groupBy("v").agg(F.max_by("b", F.struct(F.round("gain", 12), -F.col("b"))).alias("to"))
        best = best.filter(F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2)) == 0)
        new = comms.join(best.withColumnRenamed("v", "node"), "node", "left").select("node", "comm", F.coalesce("to", "comm").alias("to"))
        moved = cut(new.select("node", F.col("to").alias("comm")), "comms")
        dc_new, then, left = _bulk_state(edges, moved)
        if left < k:
            stays = new.groupBy("comm").agg(F.max((F.col("to") == F.col("comm")).cast("int")).alias("some"))
            moved = cut(new.join(stays, "comm").select("node", F.when(F.col("some") == 1, F.col("to")).otherwise(F.col("comm")).alias("comm")), "comms")
            dc_new, then, left = _bulk_state(edges, moved)
        if then <= now + EPS:
            failed += 1
            if failed == 2:
                break
            continue
        comms, dc, now, failed = moved, dc_new, then, 0
    return comms


def louvain(edges: DataFrame, nodes: DataFrame, levels: int = 10, seed: int = 0) -> DataFrame:
    """Multi-level Louvain: local moves from singletons, then again over the graph of communities while it helps.

    Beyond KERNEL_EDGES edges a level is bulk rounds, and its communities are contracted to a weighted graph, until that
    fits the kernel or shrinks no more. A community has the id of its least node (of its least community, if contracted).
    """
    now, labels = cut(_weighted(edges), "edges"), cut(nodes.select("node", F.col("node").alias("comm")), "labels")
    size = now.count()
    for _ in range(levels):
        if size <= KERNEL_EDGES:
            break
        comms = cut(local_move_bulk(now, labels.select(F.col("comm").alias("node")).distinct().select("node", F.col("node").alias("comm"))), "level")
        side = lambda c: comms.select(F.col("node").alias(c), F.col("comm").alias(f"c_{c}"))  # noqa: B023, E731
        low, high = F.least("c_src", "c_dst"), F.greatest("c_src", "c_dst")
        now = cut(now.join(side("src"), "src").join(side("dst"), "dst").groupBy(low.alias("src"), high.alias("dst")).agg(F.sum("w").alias("w")), "contracted")
        labels = cut(labels.join(comms.select(F.col("node").alias("comm"), F.col("comm").alias("new")), "comm").select("node", F.col("new").alias("comm")), "labels")
        before, size = size, now.count()
        if size >= before:
            return labels
    if size > KERNEL_EDGES:
        return labels
    small = labels.select(F.col("comm").alias("node")).distinct().select("node", F.col("node").alias("comm"))
    comms = _in_one_task(now, small, None, lambda nodes, comm, src, dst, w, x: kernels.louvain(nodes, src, dst, w, seed, PASSES))
    return labels.join(comms.select(F.col("node").alias("comm"), F.col("comm").alias("new")), "comm").select("node", F.col("new").alias("comm"))


def merge_to_k(edges: DataFrame, comms: DataFrame, k: int) -> DataFrame:
    """Greedy merges under modularity of the adjacent pair with the best gain, or of the two lightest communities, until
    ``k`` are left.

    The graph of communities is contracted and merged in one task (nodes and edges stay distributed); it is refused if
    it has more than KERNEL_EDGES pairs. A merged community keeps the lower id.
    """
    side = lambda c: comms.select(F.col("node").alias(c), F.col("comm").alias(f"c_{c}"))
    pairs = _weighted(edges).join(side("src"), "src").join(side("dst"), "dst").groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("w").alias("w"))
    pairs = cut(pairs, "pairs")
    if pairs.count() > KERNEL_EDGES:
        raise ValueError("too many pairs of communities to merge in one task; run louvain first")
    sizes = comms.groupBy("comm").agg(F.count("*").alias("size"))

    def work(nodes, size, src, dst, w, x):
        g = kernels.Graph(nodes, nodes, src, dst, w)
        g.size = size.copy()
        kernels.merge_to(g, kernels.Plain(g), k)
        return g.ids[g.c]

    table = _in_one_task(pairs, sizes.select(F.col("comm").alias("node"), F.col("size").alias("comm")), None, work)
    return comms.join(table.select(F.col("node").alias("comm"), F.col("comm").alias("to")), "comm").select("node", F.col("to").alias("comm"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the largest sum (shortest augmenting paths, cubic)."""
    n, m = gain.shape
    flip = n > m
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def matching(labelled: DataFrame) -> DataFrame:
    """pred, y, n of the optimal one-to-one matching of predicted communities to classes (node, pred, y)."""
    spark = labelled.sparkSession
    table = plan(spark, "contingency", labelled=labelled).toPandas().pivot_table(index="pred", columns="y", values="n", fill_value=0)
    pairs = assignment(table.to_numpy()) if table.size else []
    plain = lambda v: v.item() if hasattr(v, "item") else v
    rows = [(plain(table.index[i]), plain(table.columns[j]), int(table.iat[i, j])) for i, j in pairs]
    return spark.createDataFrame(rows, f"pred {labelled.schema['pred'].dataType.simpleString()}, y {labelled.schema['y'].dataType.simpleString()}, n long")


def accuracy(labelled: DataFrame) -> DataFrame:
    """Share of nodes whose community is matched to their class."""
    total = labelled.agg(F.count("*").alias("total"))
    return matching(labelled).agg(F.sum("n").alias("hit")).crossJoin(total).select(F.round(F.col("hit") / F.col("total"), 9).alias("acc"))


def evidence(ordered: DataFrame, emb: DataFrame, texts: DataFrame, r: int = 10, apart: float = 0.8) -> DataFrame:
    """At most ``r`` members of each community in order of ``place``, each less similar than ``apart`` to those before it.

    ``ordered`` (comm, node, place) holds a bounded pool for each community; blank texts are skipped.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        x = np.array(pdf.x.tolist(), float).reshape(len(pdf), -1)
        chosen: list[int] = []
        for i in range(len(pdf)):
            if len(chosen) < r and all(x[i] @ x[j] < apart for j in chosen):
                chosen.append(i)
        if not chosen:
            chosen = list(range(min(r, len(pdf))))
        out = pdf.iloc[chosen][["comm", "node"]].copy()
        out["place"] = np.arange(1, len(out) + 1)
        return out

    shown = texts.filter(F.trim("text") != "").select("node")
    pool = ordered.join(shown, "node", "left_semi").join(emb, "node")
    return pool.groupBy("comm").applyInPandas(choose, "comm long, node long, place long")


def louvain_k(edges: DataFrame, nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Louvain, merged to exactly ``k`` (if it has more), then local moves that keep ``k``."""
    merged = cut(merge_to_k(edges, louvain(edges, nodes, seed=seed), k), "merged")
    return local_move_exact(edges, merged, k, seed) if edges.count() <= KERNEL_EDGES else local_move_bulk(edges, merged, k=k)


#: Method name -> (relation of move gains, relation of the objective's value).
OBJECTIVES = {
    "near": ("sn_move_gain", "sn_value"),
    "semantic": ("semantic_move_gain", "semantic_value"),
    "three_factor": ("three_factor_move_gain", "three_factor_value"),
    "agree": ("agree_gain", "semantic_value"),
}


def _over(emb: DataFrame, edges: DataFrame, comms: DataFrame) -> dict[str, DataFrame]:
    return {"emb": emb, "vedges": edges, "vcomms": comms, "vcount": comms.agg(F.count("*").alias("n"))}


def objective_moves(emb: DataFrame, edges: DataFrame, comms: DataFrame, method: str, rounds: int = PASSES, **given) -> DataFrame:
    """Distributed rounds of best positive moves under an objective; half of the movers go at a time.

    ``given``: relations and parameters of the objective, such as ``centroid_unit`` (the prototypes) or ``lam``. A round
    that doesn't raise the objective is undone, two of them in a row end the loop. No community is emptied.
    """
    spark, (gain, value) = comms.sparkSession, OBJECTIVES[method]
    comms = cut(comms.select("node", "comm"), "objective")
    now, failed = plan(spark, value, **_over(emb, edges, comms), **given).head()[0], 0
    for r in range(rounds):
        moves = plan(spark, gain, **_over(emb, edges, comms), **given).filter(F.col("gain") > EPS)
        best = moves.groupBy("v").agg(F.max_by("b", F.struct(F.round("gain", 12), -F.col("b"))).alias("b")).filter(F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2)) == 0)
        new = comms.join(best.withColumnRenamed("v", "node"), "node", "left").select("node", "comm", F.coalesce("b", "comm").alias("to"))
        stays = new.groupBy("comm").agg(F.count_if(F.col("to") == F.col("comm")).alias("left"))
        new = cut(new.join(stays, "comm").select("node", F.when(F.col("left") > 0, F.col("to")).otherwise(F.col("comm")).alias("comm")), "objective")
        then = plan(spark, value, **_over(emb, edges, new), **given).head()[0]
        if then is None or then <= now + 1e-9:
            failed += 1
            if failed == 2:
                break
            continue
        comms, now, failed = new, then, 0
    return comms


def _bulk_merges(emb: DataFrame, edges: DataFrame, comms: DataFrame, k: int, protos: DataFrame, **given) -> DataFrame:
    """Merges under the semantic objective, one distributed step each: the best pair, and the better of its prototypes."""
    spark, n = comms.sparkSession, comms.select("comm").distinct().count()
    while n > k:
        best = plan(spark, "semantic_survivor", **_over(emb, edges, comms), centroid_unit=protos, **given).head()
        if best is None:  # no two communities are adjacent
            return merge_to_k(edges, comms, k)
        a, b, p = best["a"], best["b"], best["p"]
        protos = cut(protos.filter(~F.col("comm").isin(a, b) | (F.col("comm") == p)).select(F.when(F.col("comm") == p, F.lit(a)).otherwise(F.col("comm")).cast("long").alias("comm"), "x"), "protos")
        comms = cut(comms.select("node", F.when(F.col("comm") == b, F.lit(a)).otherwise(F.col("comm")).cast("long").alias("comm")), "merged")
        n -= 1
    return comms


def _matrix(protos: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of prototypes, collected: at most KERNEL_PROTOTYPES numbers."""
    rows = sorted(protos.select("comm", "x").collect(), key=lambda r: r["comm"])
    x = np.array([r["x"] for r in rows], float)
    return np.array([r["comm"] for r in rows], np.int64), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _fits(emb: DataFrame, edges: DataFrame, comms: DataFrame) -> bool:
    n, k, width = comms.count(), comms.select("comm").distinct().count(), emb.select(F.size("x").alias("d")).head()
    return edges.count() <= KERNEL_EDGES and n * k <= KERNEL_CELLS and k * (width["d"] if width else 0) <= KERNEL_PROTOTYPES and n * (width["d"] if width else 0) <= KERNEL_CELLS


def refined(emb: DataFrame, edges: DataFrame, comms: DataFrame, k: int, weight: float, terms: list[tuple[float, DataFrame]], advice: DataFrame | None = None, mode: str = "agree", passes: int = PASSES, seed: int = 0) -> DataFrame:
    """Local moves under ``weight`` times modularity and margins, then merges to ``k``, in the sequential kernel.

    ``terms``: (factor, prototypes (comm, x)); the factor holds weight, scale and 1 / n. ``advice``: descriptions whose
    nearest one a node may move to, by ``mode``, though no neighbour is there.
    """
    sets = [(f, *_matrix(p)) for f, p in terms]
    told = None if advice is None else _matrix(advice)

    def work(nodes, comm, src, dst, w, x):
        g = kernels.Graph(nodes, comm, src, dst, w)

        def similar(ids, protos):
            s = np.full((len(nodes), len(g.ids)), -np.inf)
            at = np.searchsorted(g.ids, ids)
            known = np.flatnonzero(np.isin(ids, g.ids))
            s[:, at[known]] = (1 + x @ protos[known].T) / 2
            return s

        margins = [kernels.Margins(g, similar(ids, protos), f) for f, ids, protos in sets]
        objective = kernels.Semantic(g, weight, margins, None if told is None else similar(*told).argmax(1), mode)
        kernels.local_moves(g, objective, k, passes, seed)
        kernels.merge_to(g, objective, k)
        return g.ids[g.c]

    return _in_one_task(edges, comms, emb, work)


#: Kind of prototypes -> relation. The last three are centroids with non-local candidates of a mode.
PROTOTYPES = {
    "centroid": "centroid_unit",
    "descr": "proto_fallback",
    "shift": "proto_shift_unit",
    "wmean": "proto_wmean_unit",
    "wmargin": "proto_wmargin_unit",
    "trim": "proto_trim_unit",
    "selfw": "proto_selfw_unit",
    "cagree": "centroid_unit",
    "cexp": "centroid_unit",
    "dexp": "centroid_unit",
}
MODES = {"cagree": "agree", "cexp": "cent", "dexp": "desc"}


def semantic_clustering(emb: DataFrame, edges: DataFrame, comms: DataFrame, k: int, lam: float = 0.5, proto: str = "centroid", phases: int = PHASES, gate: bool = True, describe: Callable | None = None, seed: int = 0, log: list | None = None, **given) -> Iterator[DataFrame]:
    """Phases of the semantic pipeline, each yielding its partition; ends when one repeats.

    A phase freezes the prototypes of the kind ``proto`` (``given``: gamma, tau, fraction), asks the reliability gate,
    moves nodes under the semantic objective and merges to ``k`` communities. A closed gate leaves plain modularity.
    The scale is that of the first phase. ``describe(comms)`` gives descriptions (comm, x) and the nodes that they were
    fitted on (comm, node), by default the mean of ten members. ``log`` collects a row for each phase.
    """
    spark, comms, scale = comms.sparkSession, cut(comms.select("node", "comm"), "phase"), None
    edges, emb, n = cut(edges, "edges"), cut(emb, "emb"), comms.count()
    for _ in range(phases):
        over = _over(emb, edges, comms) | given
        if proto != "centroid" and describe is not None:
            over["descr"], over["fit"] = describe(comms)
        protos = cut(plan(spark, PROTOTYPES[proto], **over), "protos")
        fit = comms.select("comm", "node").limit(0) if proto == "centroid" else plan(spark, "fit", **over) if "fit" not in over else over["fit"]
        asked = over | {"centroid_unit": protos, "fit": fit}
        if scale is None:
            scale = plan(spark, "sem_scale", **asked).head()[0]
        found = plan(spark, "gate", **asked).head()
        now = lam if found["reliable"] or not gate else 0.0
        if log is not None:
            log.append({"acc": found["acc"], "chance": found["chance"], "lam_eff": now, "scale": scale})
        advice = plan(spark, "big_descr", **over) if proto in MODES else None
        if _fits(emb, edges, comms):
            new = refined(emb, edges, comms, k, 1 - now, [(now * scale / n, protos)], advice, MODES.get(proto, "agree"), seed=seed)
        else:
            fixed = {"centroid_unit": protos, "sem_scale": spark.sql(f"SELECT {scale!r}D AS c"), "lam": now, "mode": MODES.get(proto, "agree")} | ({"descr": advice} if advice is not None else {})
            moved = objective_moves(emb, edges, comms, "agree" if advice is not None else "semantic", **fixed)
            new = _bulk_merges(emb, edges, moved, k, **({"protos" if x == "centroid_unit" else x: v for x, v in fixed.items() if x != "mode"}))
        new = cut(new.select("node", "comm"), "phase")
        changed = new.join(comms.withColumnRenamed("comm", "old"), "node").filter("comm <> old").head(1)
        comms = new
        yield comms
        if not changed:
            break


def three_factor_phases(emb: DataFrame, edges: DataFrame, comms: DataFrame, k: int, wc: float = 0.25, wd: float = 0.25, phases: int = PHASES, gate: bool = True, describe: Callable | None = None, seed: int = 0) -> Iterator[DataFrame]:
    """As ``semantic_clustering``, with centroids and descriptions as two sets of prototypes, each with its scale and gate."""
    spark, comms, scales = comms.sparkSession, cut(comms.select("node", "comm"), "phase"), None
    edges, emb, n = cut(edges, "edges"), cut(emb, "emb"), comms.count()
    for _ in range(phases):
        over = _over(emb, edges, comms)
        if describe is not None:
            over["descr"], over["fit"] = describe(comms)
        sets = [(cut(plan(spark, "centroid_unit", **over), "protos"), comms.select("comm", "node").limit(0)), (cut(plan(spark, "proto_fallback", **over), "protos"), over.get("fit", plan(spark, "fit", **over)))]
        asked = [over | {"centroid_unit": p, "fit": f} for p, f in sets]
        scales = scales or [plan(spark, "sem_scale", **a).head()[0] for a in asked]
        weights = [w if not gate or plan(spark, "gate", **a).head()["reliable"] else 0.0 for w, a in zip((wc, wd), asked, strict=True)]
        if _fits(emb, edges, comms):
            new = refined(emb, edges, comms, k, 1 - wc - wd, [(w * c / n, p) for w, c, (p, _) in zip(weights, scales, sets, strict=True)], seed=seed)
        else:
            moved = objective_moves(emb, edges, comms, "three_factor", wc=weights[0], wd=weights[1], centroid_unit=sets[0][0], descr=sets[1][0])
            new = _bulk_merges(emb, edges, moved, k, sets[0][0], lam=weights[0])
        new = cut(new.select("node", "comm"), "phase")
        changed = new.join(comms.withColumnRenamed("comm", "old"), "node").filter("comm <> old").head(1)
        comms = new
        yield comms
        if not changed:
            break


def near_clustering(emb: DataFrame, edges: DataFrame, nodes: DataFrame, k: int, seed: int = 0, sigma_scale: float = 1.0) -> DataFrame:
    """Louvain, moves under the spatially-near objective, merges to ``k`` under it, moves again."""
    spark, start = nodes.sparkSession, cut(louvain(edges, nodes, seed=seed), "start")
    sigma = plan(spark, "edge_sigma", **_over(emb, edges, start)).head()[0] * sigma_scale
    if not _fits(emb, edges, start):
        moved = objective_moves(emb, edges, start, "near", edge_sigma=spark.sql(f"SELECT {sigma!r}D AS sigma"))
        return objective_moves(emb, edges, _near_merges(emb, edges, moved, k, sigma), "near", edge_sigma=spark.sql(f"SELECT {sigma!r}D AS sigma"))

    def work(nodes, comm, src, dst, w, x):
        g = kernels.Graph(nodes, comm, src, dst, w)
        objective = kernels.Near(g, x, sigma)
        kernels.local_moves(g, objective, k, PASSES, seed)
        kernels.merge_to(g, objective, k)
        kernels.local_moves(g, objective, k, PASSES, seed)
        return g.ids[g.c]

    return _in_one_task(edges, start, emb, work)


def _near_merges(emb: DataFrame, edges: DataFrame, comms: DataFrame, k: int, sigma: float) -> DataFrame:
    """Merges under the spatially-near objective, one distributed step each."""
    spark, n = comms.sparkSession, comms.select("comm").distinct().count()
    while n > k:
        best = plan(spark, "sn_merge_gain", **_over(emb, edges, comms), edge_sigma=spark.sql(f"SELECT {sigma!r}D AS sigma")).orderBy(F.desc("gain"), "a", "b").head()
        if best is None:
            return merge_to_k(edges, comms, k)
        comms = cut(comms.select("node", F.when(F.col("comm") == best["b"], F.lit(best["a"])).otherwise(F.col("comm")).cast("long").alias("comm")), "merged")
        n -= 1
    return comms


def pipeline(emb: DataFrame, edges: DataFrame, nodes: DataFrame, k: int, method: str, seed: int = 0, **given) -> DataFrame:
    """The partition of a method: ``louvain``, ``near``, ``three_factor`` or a kind of prototypes (see PROTOTYPES)."""
    if method == "louvain":
        return louvain_k(edges, nodes, k, seed)
    if method == "near":
        return near_clustering(emb, edges, nodes, k, seed, **given)
    start = louvain(edges, nodes, seed=seed)
    phases = three_factor_phases(emb, edges, start, k, seed=seed, **given) if method == "three_factor" else semantic_clustering(emb, edges, start, k, proto=method, seed=seed, **given)
    return list(phases)[-1]
