"""Formulas against plain numpy over the small vector graph: written node by node, not from the relations' text."""

import numpy as np
import pandas as pd
import pytest

import loomgraph.catalog  # noqa: F401
from loomgraph.plans.engine import plan

SF = "/root/testdata/sf0.001"


class World:
    def __init__(self):
        t = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
        self.n, self.e, self.comm = len(t), np.array(t["embedding"].tolist(), float), t["label"].to_numpy(int)
        self.y, self.k = np.arange(self.n) // 5 % 7, int(t["label"].max()) + 1
        self.edges = {(v, v + s) for s in (1, 7) for v in range(self.n - s)}
        self.nbrs = [[] for _ in range(self.n)]
        for a, b in self.edges:
            self.nbrs[a].append(b), self.nbrs[b].append(a)
        self.m, self.deg = len(self.edges), np.array([len(x) for x in self.nbrs])
        members = [np.flatnonzero(self.comm == c) for c in range(self.k)]
        self.members = members
        self.fit = np.concatenate([x[:10] for x in members])
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        self.unit = unit
        self.cent = unit(np.stack([self.e[x].sum(0) for x in members]))
        self.descr = unit(np.stack([self.e[x[:10]].sum(0) for x in members]))
        self.sc, self.sd = (1 + self.e @ self.cent.T) / 2, (1 + self.e @ self.descr.T) / 2
        self.maj = np.array([np.bincount(self.y[x], minlength=7).argmax() for x in members])

    def margin(self, s, v, c):
        return s[v, c] - np.delete(s[v], c).max()

    def scale(self, s):
        return 2 / (s.max(1) - s.mean(1)).mean()

    def dq(self, v, a, b):
        near = lambda c: sum(self.comm[u] == c for u in self.nbrs[v])
        d = lambda c: self.deg[self.comm == c].sum()
        return (near(b) - near(a)) / self.m + self.deg[v] * (d(a) - self.deg[v] - d(b)) / (2 * self.m**2)

    def moves(self):
        return [(v, self.comm[v], b) for v in range(self.n) for b in sorted({self.comm[u] for u in self.nbrs[v]} - {self.comm[v]})]


@pytest.fixture(scope="module")
def w():
    return World()


def rows(spark, name, **given):
    return [r.asDict() for r in plan(spark, name, SF, **given).collect()]


def test_gate_compares_with_labels_permuted_among_the_scored(spark, w):
    scored = np.array([v for v in range(w.n) if len(w.members[w.comm[v]]) >= 20 and v not in set(w.fit.tolist())])
    top, lab = w.sc[scored].argmax(1), w.comm[scored]
    (got,) = rows(spark, "gate")
    r = np.random.default_rng(0)
    sampled = np.mean([np.mean(top == r.permutation(lab)) for _ in range(4000)])
    assert abs(got["acc"] - np.mean(top == lab)) < 1e-8 and abs(got["chance"] - sampled) < 2e-3
    assert got["reliable"] == (got["acc"] >= max(2 * got["chance"], got["chance"] + 0.05))


def test_prototypes_keep_centroids_of_undescribed_communities(spark, w):
    few = plan(spark, "descr", SF).filter("comm <> 3")
    z = w.descr

    def weighted(c, score):
        x = np.exp(score) / np.exp(score).sum()
        return x @ w.e[w.members[c]]

    others = [c for c in range(w.k) if c != 3]
    cases = {
        "proto_shift_unit": lambda c, e: w.cent[c] + 0.25 * z[c],
        "proto_wmean_unit": lambda c, e: weighted(c, 2 * e @ z[c]),
        "proto_wmargin_unit": lambda c, e: weighted(c, 5 * (e @ z[c] - np.max([e @ z[o] for o in others if o != c], axis=0))),
        "proto_trim_unit": lambda c, e: e[np.argsort(-(e @ z[c]), kind="stable")[: int(np.ceil(0.3 * len(e)))]].mean(0),
        "proto_selfw_unit": lambda c, e: weighted(c, 2 * e @ w.cent[c]),
    }
    for name, f in cases.items():
        got = {r["comm"]: np.array(r["x"]) for r in rows(spark, name, descr=few, gamma=0.25, tau=2.0, tau_margin=5.0, fraction=0.3)}
        assert set(got) == set(range(w.k)), name
        for c in range(w.k):
            x = w.cent[c] if c == 3 else f(c, w.e[w.members[c]])
            assert np.allclose(got[c], x / np.linalg.norm(x), atol=1e-9), (name, c)


@pytest.mark.parametrize("lam", [0.5, 0.25])
def test_semantic_merge_is_the_change_of_the_value(spark, w, lam):
    def q_sem(comm, s):
        return np.mean([s[v, comm[v]] - max(s[v, c] for c in range(w.k) if c != comm[v] and s[v, c] > -1) for v in range(w.n)])

    got = {(r["a"], r["b"]): r["gain"] for r in rows(spark, "semantic_merge_gain", lam=lam)}
    sides = {(r["a"], r["b"], r["p"]): r["ds"] for r in rows(spark, "merge_side")}
    now, dc, best = q_sem(w.comm, w.sc), np.bincount(w.comm, w.deg), {}
    for a, b in sorted(got)[::4]:
        e = sum({w.comm[x], w.comm[z]} == {a, b} for x, z in w.edges)
        ds = {}
        for p, dead in ((a, b), (b, a)):
            s = w.sc.copy()
            s[:, a] = s[:, p]
            s[:, b] = -2
            merged = np.where(w.comm == b, a, w.comm)
            ds[p] = (q_sem(merged, s) - now) * w.n
            assert abs(ds[p] - sides[(a, b, p)]) < 1e-8
        best[(a, b)] = max(ds.values())
        want = (1 - lam) * (e / w.m - 2 * dc[a] * dc[b] / (4 * w.m**2)) + lam * w.scale(w.sc) * best[(a, b)] / w.n
        assert abs(got[(a, b)] - want) < 1e-8
    (top,) = rows(spark, "semantic_best_merge", lam=lam)
    a, b = top["a"], top["b"]
    (kept,) = rows(spark, "semantic_survivor", lam=lam)
    assert kept["p"] == (a if sides[(a, b, a)] >= sides[(a, b, b)] - 1e-12 else b)


def node_signals(w, v):
    cur, near = w.comm[v], [w.comm[u] for u in w.nbrs[v]]
    cand = sorted({*near, cur})
    count = {c: near.count(c) for c in cand}
    most = max(count.values())
    tied = [c for c in cand if count[c] == most]
    cos = sorted((w.e[v] @ w.cent[c] for c in cand), reverse=True)
    pick = lambda s: min(cand, key=lambda c: (-round(s[v, c], 12), c))
    return {"cur": cur, "descr": pick(w.sd), "cent": pick(w.sc), "graph": cur if cur in tied else tied[0], "margin": cos[0] - cos[1] if len(cos) > 1 else 1.0, "n_cand": len(cand), "available": int(any(w.maj[c] == w.y[v] for c in cand))}


def test_node_signals_and_rules(spark, w):
    want = {v: node_signals(w, v) for v in range(w.n)}
    for r in rows(spark, "signals_out"):
        x = want[r["node"]]
        assert all(r[k] == x[k] for k in ("cur", "descr", "cent", "graph", "n_cand", "available")) and abs(r["margin"] - x["margin"]) < 1e-8, (r, x)
    q25 = np.quantile([x["margin"] for x in want.values()], 0.25)
    rules = {"R1": lambda x: x["descr"], "R2": lambda x: x["graph"], "R4": lambda x: x["descr"] if x["descr"] == x["graph"] else x["cur"], "R4low": lambda x: x["descr"] if x["descr"] == x["graph"] and x["margin"] <= q25 + 1e-12 else x["cur"]}
    top2 = np.sort(w.e @ w.cent.T, axis=1)[:, ::-1]
    everywhere = {"both_clear": lambda v: w.sd[v].argmax() if w.sd[v].argmax() == w.sc[v].argmax() and top2[v, 0] - top2[v, 1] > 0.05 else w.comm[v]}
    got = {r["rule"]: r for r in rows(spark, "rule_stats")} | {r["rule"]: r for r in rows(spark, "global_stats")}
    for rule, to in [(k, [f(want[v]) for v in range(w.n)]) for k, f in rules.items()] + [(k, [f(v) for v in range(w.n)]) for k, f in everywhere.items()]:
        moved = [v for v in range(w.n) if to[v] != w.comm[v]]
        before, after = [w.maj[w.comm[v]] == w.y[v] for v in moved], [w.maj[to[v]] == w.y[v] for v in moved]
        fixes, breaks = sum(a and not b for a, b in zip(after, before, strict=True)), sum(b and not a for a, b in zip(after, before, strict=True))
        r = got.get(rule, {"moved": 0, "fixes": 0, "breaks": 0, "net": 0})
        assert (r["moved"], r["fixes"], r["breaks"], r["net"]) == (len(moved), fixes, breaks, fixes - breaks), rule


def test_move_log_and_what_is_read_from_it(spark, w):
    lam, kd, kc, log = 0.5, w.scale(w.sd), w.scale(w.sc), []
    for v, a, b in w.moves():
        dd, dc = w.margin(w.sd, v, b) - w.margin(w.sd, v, a), w.margin(w.sc, v, b) - w.margin(w.sc, v, a)
        log.append((v, a, b, w.dq(v, a, b), dd, dc, w.margin(w.sd, v, a), int(w.y[v] == w.maj[b]) - int(w.y[v] == w.maj[a])))
    gains = [(1 - lam) * x[3] + lam * kd * x[4] / w.n for x in log]
    best = {}
    for x, g in zip(log, gains, strict=True):
        if g > 1e-12 and (x[0] not in best or g > best[x[0]][0] + 1e-13):
            best[x[0]] = (g, x[2])
    got = {(r["v"], r["a"], r["b"]): r for r in rows(spark, "move_log")}
    assert set(got) == {x[:3] for x in log}
    for x in log:
        r = got[x[:3]]
        assert np.allclose([r["dq"], r["dm_descr"], r["dm_cent"], r["md_a"]], x[3:7], atol=1e-8) and r["accepted"] == (best.get(x[0], (0, None))[1] == x[2])
    inf = [x for x in log if x[7]]
    both = [x for x in inf if abs(x[4]) > 1e-9 and abs(x[5]) > 1e-9]
    signs = {r["kind"]: r for r in rows(spark, "sign_agreement")}
    for kind, some in (("agree", [x for x in both if x[4] * x[5] > 0]), ("disagree", [x for x in both if x[4] * x[5] < 0])):
        r = signs[kind]
        k, n, z = sum(np.sign(x[4]) == x[7] for x in some), len(some), 1.96
        p, d = k / n, 1 + z * z / n
        half = z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
        assert (r["n"], r["descr_right"], r["cent_right"]) == (n, k, sum(np.sign(x[5]) == x[7] for x in some))
        assert abs(r["descr_lo"] - ((p + z * z / (2 * n)) / d - half)) < 1e-8 and abs(r["share"] - n / len(both)) < 1e-8
    cut = np.quantile([abs(x[5]) for x in inf], [0, 0.1, 0.25, 0.5, 0.75, 1])
    bins = {r["bin"]: r for r in rows(spark, "binned")}
    for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        some = [x for x in inf if lo - 1e-9 <= abs(x[5]) <= hi + 1e-9 and abs(x[4]) > 1e-9]
        assert (bins[str(i)]["n"], bins[str(i)]["descr_right"]) == (len(some), sum(np.sign(x[4]) == x[7] for x in some))
    own = {}
    for x in log:
        own.setdefault(x[1], []).append(x[6])
    mean = {c: np.mean(v) for c, v in own.items()}
    apart = [(np.fmin(mean[x[1]], mean.get(x[2], np.nan)), np.sign(x[4]) == x[7]) for x in both if x[4] * x[5] < 0]
    cut = np.quantile([a for a, _ in apart], [0, 0.25, 0.5, 0.75, 0.9, 1])
    lookup = {r["bin"]: r for r in rows(spark, "reliability_lookup")}
    for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        some = [k for a, k in apart if lo - 1e-9 <= a <= hi + 1e-9]
        assert (lookup[i]["n"], lookup[i]["descr_right"]) == (len(some), sum(some))
    (r,) = rows(spark, "attribution")
    taken = [x for x in log if best.get(x[0], (0, None))[1] == x[2] and x[7]]
    assert r["accepted"] == len(taken) and r["graph_opposed"] == sum(0.5 * x[3] <= 0 for x in taken)
    assert r["cent_rejects"] == sum(0.5 * x[3] + 0.5 * kc * x[5] / w.n <= 0 for x in taken)


def test_failure_indicators(spark, w):
    nd, nc = w.sd.argmax(1), w.sc.argmax(1)
    contrast = {c: w.sd[w.members[c], c].mean() - w.sd[:, c].mean() for c in range(w.k)}  # all nodes: fewer than 512
    q1 = np.quantile(list(contrast.values()), 0.25)
    shown = {}
    for r in rows(spark, "evidence_order"):
        if r["place"] <= 10:
            shown.setdefault(r["comm"], []).append(w.y[r["node"]])
    judge = {r["comm"]: r["answer"] for r in rows(spark, "judge_answers")}
    for r in rows(spark, "failures"):
        c, m = r["comm"], w.members[r["comm"]]
        acc_d, acc_c = (w.maj[nd[m]] == w.y[m]).mean(), (w.maj[nc[m]] == w.y[m]).mean()
        lost = m[nd[m] != c]
        dest = sorted({int(x) for x in nd[lost]}, key=lambda d: (-int((nd[lost] == d).sum()), d))[0]
        many = (nd[lost] == dest).sum() >= 0.5 * len(lost)
        want = {"size": len(m), "hetero": (w.y[m] == w.maj[c]).mean() < 0.5, "broad": contrast[c] <= q1 + 1e-12, "confusable": bool(w.descr[c] @ w.descr[dest] >= 0.6 and many), "repdocs": np.bincount(shown[c]).argmax() != w.maj[c], "fine": bool(w.maj[dest] == w.maj[c] and many), "encoder": bool(judge[c] == w.maj[c] and acc_d < acc_c - 0.15), "graphtext": (w.y[lost] != w.maj[c]).mean() >= 0.5, "failure": acc_c - acc_d >= 0.15}
        assert abs(r["acc_d"] - acc_d) < 1e-8 and abs(r["acc_c"] - acc_c) < 1e-8 and {k: r[k] for k in want} == want


def test_description_evaluation(spark, w):
    (r,) = rows(spark, "descr_eval_total")
    top, held = w.sd.argmax(1), np.setdiff1d(np.arange(w.n), w.fit)
    names = w.unit(np.stack([w.e[w.y == c].mean(0) for c in range(7)]))
    assert r["k_eval"] == w.k and abs(r["retrieval"] - np.mean(top == w.comm)) < 1e-8 and abs(r["heldout"] - np.mean(top[held] == w.comm[held])) < 1e-8
    assert abs(r["q_sem"] - np.mean([w.margin(w.sd, v, w.comm[v]) for v in range(w.n)])) < 1e-8
    assert abs(r["align"] - np.mean([w.descr[c] @ names[w.maj[c]] for c in range(w.k)])) < 1e-8


def test_majority_vote_needs_three_answers(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    by = {}
    for i, kind in zip(e["event_id"], e["event_type"], strict=True):
        by.setdefault(i // 4, {})[i % 4] = None if i % 17 == 0 else kind
    want = {}
    for item, answers in by.items():
        three = [answers.get(p) for p in range(3)]
        if all(three):
            top = min(set(three), key=lambda a: (-three.count(a), a))
            want.setdefault((f"d{item % 2}", f"m{item % 3}"), []).append(top == "click")
    got = {(r["dataset"], r["method"]): (r["n"], r["acc"]) for r in rows(spark, "majority_vote")}
    assert {k: (len(v), round(float(np.mean(v)), 9)) for k, v in want.items()} == got
