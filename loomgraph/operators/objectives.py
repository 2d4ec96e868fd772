"""Objectives: spatially-near modularity, semantic, agreement and three-factor; move gains, merge gains and values.

They run over the vector graph (``emb``, ``vedges``, ``vcomms``). Its modularity relations are those of ``graph`` under
the prefix ``v_``. The weights are the parameters
``lam``, ``wc`` and ``wd``.
"""

from __future__ import annotations

import re

from loomgraph.operators import graph, vectors  # noqa: F401
from loomgraph.plans.engine import RELATIONS, define

_CLONED = ("adj", "degree", "edge_count", "inner_edges", "cstat", "q_terms", "nbr_comm", "move_gain", "inter_edges", "merge_gain")
_FIXED = {"edges": "vedges", "comms": "vcomms", "nodes": "vcomms"}


def _clone(text: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: "{" + (_FIXED.get(m[1]) or ("v_" + m[1] if m[1] in _CLONED else m[1])) + "}", text)


define({f"v_{x}": _clone(RELATIONS[x]) for x in _CLONED})

_TERM = "(CASE WHEN {n} <= 0 THEN 0e0 ELSE ({mc} / e.m - ({dc} / (2e0 * e.m)) * ({dc} / (2e0 * e.m))) / (1e0 + greatest(0e0, {q2} / {n} - {s2} / ({n} * {n})) / (g.sigma * g.sigma)) END)"


def _term(n: str, mc: str, dc: str, q2: str, s2: str) -> str:
    out = _TERM
    for k, v in {"n": n, "mc": mc, "dc": dc, "q2": q2, "s2": s2}.items():
        out = out.replace("{" + k + "}", f"({v})")
    return out


_OLD = lambda x: _term(f"{x}.n", f"{x}.mc", f"{x}.dc", f"{x}.q2", f"{x}.s2")

def _merge(p: str, sim: str, top: str, own: str, competitors: str) -> dict[str, str]:
    """Merge relations over one set of prototypes; ``merge_side``: (a, b, p, ds), ds the gain if prototype p survives."""
    return {
        f"{p}drop_sum": "SELECT comm, sum(coalesce(s - next, 0e0)) AS gain FROM {" + competitors + "} WHERE rk = 1 GROUP BY comm",
        f"{p}drop_own": "SELECT own, comm, sum(coalesce(s - next, 0e0)) AS gain FROM {" + competitors + "} WHERE rk = 1 GROUP BY own, comm",
        f"{p}pair_members": "SELECT i.a, i.b, c.node FROM {v_inter_edges} i JOIN {vcomms} c ON c.comm = i.a UNION ALL SELECT i.a, i.b, c.node FROM {v_inter_edges} i JOIN {vcomms} c ON c.comm = i.b",
        f"{p}outside_two": f"SELECT m.a, m.b, m.node, max(t.s) AS s FROM {{{p}pair_members}} m JOIN {{{top}}} t ON t.node = m.node WHERE t.comm <> m.a AND t.comm <> m.b GROUP BY m.a, m.b, m.node",
        f"{p}inside_a": f"SELECT o.a, o.b, sum(s.s - o.s - m.margin) AS inside FROM {{{p}outside_two}} o JOIN {{{sim}}} s ON s.node = o.node AND s.comm = o.a JOIN {{{own}}} m ON m.node = o.node GROUP BY o.a, o.b",
        f"{p}inside_b": f"SELECT o.a, o.b, sum(s.s - o.s - m.margin) AS inside FROM {{{p}outside_two}} o JOIN {{{sim}}} s ON s.node = o.node AND s.comm = o.b JOIN {{{own}}} m ON m.node = o.node GROUP BY o.a, o.b",
        f"{p}merge_side": f"SELECT x.a, x.b, x.a AS p, x.inside + coalesce(d.gain, 0e0) - coalesce(o.gain, 0e0) AS ds FROM {{{p}inside_a}} x LEFT JOIN {{{p}drop_sum}} d ON d.comm = x.b LEFT JOIN {{{p}drop_own}} o ON o.own = x.a AND o.comm = x.b "
        f"UNION ALL SELECT x.a, x.b, x.b AS p, x.inside + coalesce(d.gain, 0e0) - coalesce(o.gain, 0e0) AS ds FROM {{{p}inside_b}} x LEFT JOIN {{{p}drop_sum}} d ON d.comm = x.a LEFT JOIN {{{p}drop_own}} o ON o.own = x.b AND o.comm = x.a",
    }


define(
    {
        "cvec": "SELECT q.comm, CAST(q.n AS DOUBLE) AS n, q.q2, $dot(s.x; s.x) AS s2, s.x, c.mc, c.dc FROM (SELECT c.comm, count(*) AS n, sum($dot(e.x; e.x)) AS q2 FROM {vcomms} c JOIN {emb} e ON c.node = e.node GROUP BY c.comm) q JOIN {centroid} s ON q.comm = s.comm JOIN {v_cstat} c ON q.comm = c.comm",
        "sn_value": f"SELECT $r(sum({_OLD('a')})) AS sn FROM {{cvec}} a CROSS JOIN {{v_edge_count}} e CROSS JOIN {{edge_sigma}} g",
        "sn_move_gain": "SELECT k.u AS v, o.comm AS a, k.comm AS b, "
        + _term("a.n - 1e0", "a.mc - coalesce(h.k, 0)", "a.dc - d.d", "a.q2 - $dot(x.x; x.x)", "a.s2 - 2e0 * $dot(a.x; x.x) + $dot(x.x; x.x)")
        + " + "
        + _term("b.n + 1e0", "b.mc + k.k", "b.dc + d.d", "b.q2 + $dot(x.x; x.x)", "b.s2 + 2e0 * $dot(b.x; x.x) + $dot(x.x; x.x)")
        + f" - {_OLD('a')} - {_OLD('b')} AS gain FROM {{v_nbr_comm}} k JOIN {{vcomms}} o ON k.u = o.node LEFT JOIN {{v_nbr_comm}} h ON h.u = k.u AND h.comm = o.comm JOIN {{v_degree}} d ON d.node = k.u JOIN {{cvec}} a ON a.comm = o.comm JOIN {{cvec}} b ON b.comm = k.comm JOIN {{emb}} x ON x.node = k.u CROSS JOIN {{v_edge_count}} e CROSS JOIN {{edge_sigma}} g WHERE k.comm <> o.comm",
        "sn_move_gain_out": "SELECT v, a, b, $r(gain) AS gain FROM {sn_move_gain}",
        "sn_merge_gain": "SELECT i.a, i.b, $r(" + _term("a.n + b.n", "a.mc + b.mc + i.e", "a.dc + b.dc", "a.q2 + b.q2", "a.s2 + b.s2 + 2e0 * $dot(a.x; b.x)") + f" - {_OLD('a')} - {_OLD('b')}) AS gain FROM {{v_inter_edges}} i JOIN {{cvec}} a ON i.a = a.comm JOIN {{cvec}} b ON i.b = b.comm CROSS JOIN {{v_edge_count}} e CROSS JOIN {{edge_sigma}} g",
        "semantic_move_gain": "SELECT g.v, g.a, g.b, (1e0 - @lam) * g.dq + @lam * c.c * (mb.margin - ma.margin) / n.n AS gain FROM {v_move_gain} g JOIN {margin} ma ON g.v = ma.node AND g.a = ma.comm JOIN {margin} mb ON g.v = mb.node AND g.b = mb.comm CROSS JOIN {sem_scale} c CROSS JOIN {vcount} n",
        "semantic_move_gain_out": "SELECT v, a, b, $r(gain) AS gain FROM {semantic_move_gain}",
        "semantic_value": "SELECT $r((1e0 - @lam) * q.q + @lam * c.c * s.q_sem) AS value FROM (SELECT sum(q) AS q FROM {v_q_terms}) q CROSS JOIN {sem_scale} c CROSS JOIN {q_sem} s",
        # the best competitor of a node's own community and what it leaves behind
        "competitors": "SELECT s.node, s.comm, s.s, lead(s.s) OVER (PARTITION BY s.node ORDER BY round(s.s, 12) DESC, s.comm) AS next, row_number() OVER (PARTITION BY s.node ORDER BY round(s.s, 12) DESC, s.comm) AS rk, c.comm AS own FROM {sim} s JOIN {vcomms} c ON s.node = c.node WHERE s.comm <> c.comm",
        "drop_gain": "SELECT comm, $r(gain) AS gain FROM {drop_sum}",
        # merge of a pair under either prototype: what its members gain, and what others do whose best competitor dies
        **_merge("", "sim", "top3", "own_margin", "competitors"),
        "semantic_merge_gain": "SELECT g.a, g.b, $r((1e0 - @lam) * g.dq + @lam * k.c * max(x.ds) / n.n) AS gain FROM {v_merge_gain} g JOIN {merge_side} x ON g.a = x.a AND g.b = x.b CROSS JOIN {sem_scale} k CROSS JOIN {vcount} n GROUP BY g.a, g.b, g.dq, k.c, n.n",
        # apply the best semantic merge: the column that survives takes the better prototype's similarities
        "semantic_best_merge": "SELECT a, b FROM {semantic_merge_gain} ORDER BY gain DESC, a, b LIMIT 1",
        "semantic_survivor": "SELECT m.a, m.b, x.p FROM {semantic_best_merge} m JOIN (SELECT a, b, p, row_number() OVER (PARTITION BY a, b ORDER BY round(ds, 12) DESC, p) AS rk FROM {merge_side}) x ON m.a = x.a AND m.b = x.b WHERE x.rk = 1",
        "semantic_merged": "SELECT c.node, CASE WHEN c.comm = v.b THEN v.a ELSE c.comm END AS comm, s.comm AS prototype FROM {vcomms} c CROSS JOIN {semantic_survivor} v JOIN {sim} s ON s.node = c.node AND s.comm = CASE WHEN c.comm = v.a OR c.comm = v.b THEN v.p ELSE c.comm END",
        # neighbour communities and the candidate of the mode: agreed on, nearest centroid or nearest description
        "agree_pairs": "SELECT u AS v, comm AS b FROM {v_nbr_comm} UNION SELECT node AS v, b FROM (SELECT node, CASE WHEN @mode = 'agree' THEN agree WHEN @mode = 'cent' THEN cent ELSE descr END AS b FROM {extra_candidate}) WHERE b IS NOT NULL",
        "agree_gain": "SELECT p.v, o.comm AS a, p.b, $r((1e0 - @lam) * ((coalesce(k.k, 0) - coalesce(h.k, 0)) / e.m + d.d * CAST(ca.dc - d.d - cb.dc AS DOUBLE) / (2e0 * e.m * e.m)) + @lam * c.c * (mb.margin - ma.margin) / n.n) AS gain FROM {agree_pairs} p JOIN {vcomms} o ON p.v = o.node LEFT JOIN {v_nbr_comm} k ON k.u = p.v AND k.comm = p.b LEFT JOIN {v_nbr_comm} h ON h.u = p.v AND h.comm = o.comm JOIN {v_degree} d ON d.node = p.v JOIN {v_cstat} ca ON ca.comm = o.comm JOIN {v_cstat} cb ON cb.comm = p.b JOIN {margin} ma ON ma.node = p.v AND ma.comm = o.comm JOIN {margin} mb ON mb.node = p.v AND mb.comm = p.b CROSS JOIN {v_edge_count} e CROSS JOIN {sem_scale} c CROSS JOIN {vcount} n WHERE p.b <> o.comm",
        "dtop": "SELECT node, rk, comm, s FROM (SELECT node, comm, s, row_number() OVER (PARTITION BY node ORDER BY round(s, 12) DESC, comm) AS rk FROM {sim_descr}) WHERE rk <= 3",
        "dmargin": "SELECT s.node, s.comm, s.s - CASE WHEN t1.comm = s.comm THEN t2.s ELSE t1.s END AS margin FROM {sim_descr} s JOIN {dtop} t1 ON s.node = t1.node AND t1.rk = 1 LEFT JOIN {dtop} t2 ON s.node = t2.node AND t2.rk = 2",
        "dscale": "SELECT 2e0 / greatest(avg(top - mean), 1e-6) AS c FROM (SELECT node, max(s) AS top, avg(s) AS mean FROM {sim_descr} GROUP BY node)",
        "three_factor_move_gain": "SELECT g.v, g.a, g.b, (1e0 - @wc - @wd) * g.dq + @wc * c.c * (mb.margin - ma.margin) / n.n + @wd * k.c * (db.margin - da.margin) / n.n AS gain FROM {v_move_gain} g JOIN {margin} ma ON g.v = ma.node AND g.a = ma.comm JOIN {margin} mb ON g.v = mb.node AND g.b = mb.comm JOIN {dmargin} da ON g.v = da.node AND g.a = da.comm JOIN {dmargin} db ON g.v = db.node AND g.b = db.comm CROSS JOIN {sem_scale} c CROSS JOIN {dscale} k CROSS JOIN {vcount} n",
        "three_factor_move_gain_out": "SELECT v, a, b, $r(gain) AS gain FROM {three_factor_move_gain}",
        # one round of the local move under the semantic objective
        "local_round": "SELECT c.node, coalesce(b.b, c.comm) AS comm FROM {vcomms} c LEFT JOIN (SELECT v, b FROM (SELECT v, b, gain, row_number() OVER (PARTITION BY v ORDER BY round(gain, 12) DESC, b) AS rk FROM {semantic_move_gain}) WHERE rk = 1 AND gain > 1e-12) b ON c.node = b.v",
        "own_dmargin": "SELECT m.node, m.comm, m.margin FROM {dmargin} m JOIN {vcomms} c ON m.node = c.node AND m.comm = c.comm",
        "dq_sem": "SELECT avg(margin) AS q_sem FROM {own_dmargin}",
        "three_factor_value": "SELECT $r((1e0 - @wc - @wd) * q.q + @wc * c.c * s.q_sem + @wd * k.c * d.q_sem) AS value FROM (SELECT sum(q) AS q FROM {v_q_terms}) q CROSS JOIN {sem_scale} c CROSS JOIN {q_sem} s CROSS JOIN {dscale} k CROSS JOIN {dq_sem} d",
        "dcompetitors": "SELECT s.node, s.comm, s.s, lead(s.s) OVER (PARTITION BY s.node ORDER BY round(s.s, 12) DESC, s.comm) AS next, row_number() OVER (PARTITION BY s.node ORDER BY round(s.s, 12) DESC, s.comm) AS rk, c.comm AS own FROM {sim_descr} s JOIN {vcomms} c ON s.node = c.node WHERE s.comm <> c.comm",
        **_merge("d", "sim_descr", "dtop", "own_dmargin", "dcompetitors"),
        "three_factor_merge_gain": "SELECT g.a, g.b, $r((1e0 - @wc - @wd) * g.dq + @wc * c.c * x.ds / n.n + @wd * k.c * y.ds / n.n) AS gain FROM {v_merge_gain} g JOIN (SELECT a, b, max(ds) AS ds FROM {merge_side} GROUP BY a, b) x ON g.a = x.a AND g.b = x.b JOIN (SELECT a, b, max(ds) AS ds FROM {dmerge_side} GROUP BY a, b) y ON g.a = y.a AND g.b = y.b CROSS JOIN {sem_scale} c CROSS JOIN {dscale} k CROSS JOIN {vcount} n",
        # the semantic objective under description prototypes: what the logged moves are judged by
        "descr_move_gain": "SELECT g.v, g.a, g.b, g.dq, da.margin AS md_a, db.margin AS md_b, (1e0 - @lam) * g.dq + @lam * k.c * (db.margin - da.margin) / n.n AS gain FROM {v_move_gain} g JOIN {dmargin} da ON g.v = da.node AND g.a = da.comm JOIN {dmargin} db ON g.v = db.node AND g.b = db.comm CROSS JOIN {dscale} k CROSS JOIN {vcount} n",
        "move_log": "SELECT CAST(0 AS BIGINT) AS phase, g.v, g.a, g.b, $r(g.dq) AS dq, $r(g.md_b - g.md_a) AS dm_descr, $r(mb.margin - ma.margin) AS dm_cent, $r(g.md_a) AS md_a, $r(ma.margin) AS mc_a, $r(g.md_b) AS md_b, $r(mb.margin) AS mc_b, @lam AS lam, $r(k.c) AS scale_descr, $r(c.c) AS scale_cent, y.y, ja.y AS maj_a, jb.y AS maj_b, sa.size AS size_a, sb.size AS size_b, CASE WHEN g.gain > 1e-12 AND row_number() OVER (PARTITION BY g.v ORDER BY round(g.gain, 12) DESC, g.b) = 1 THEN 1 ELSE 0 END AS accepted FROM {descr_move_gain} g JOIN {margin} ma ON g.v = ma.node AND g.a = ma.comm JOIN {margin} mb ON g.v = mb.node AND g.b = mb.comm JOIN {csize} sa ON sa.comm = g.a JOIN {csize} sb ON sb.comm = g.b JOIN {vclasses} y ON y.node = g.v JOIN {vmajority} ja ON ja.comm = g.a JOIN {vmajority} jb ON jb.comm = g.b CROSS JOIN {dscale} k CROSS JOIN {sem_scale} c",
    }
)
