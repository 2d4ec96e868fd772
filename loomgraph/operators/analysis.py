"""Error analysis, description evaluation, move logs and judge accounting.

Over the vector graph with classes (``vclasses``) against a partition (``vcomms``); ``judged`` holds judge records.
"""

from __future__ import annotations

from loomgraph.operators import metrics, objectives, text, vectors  # noqa: F401
from loomgraph.plans.engine import define

_RULES = {
    "R1": ("descr", "TRUE"),
    "R2": ("graph", "TRUE"),
    "R3": ("cent", "TRUE"),
    "R4": ("descr", "descr = graph"),
    "R5": ("descr", "descr = cent"),
    "R6": ("descr", "descr = graph AND descr = cent"),
    "R4low": ("descr", "descr = graph AND margin <= (SELECT q25 FROM {margin_quartile})"),
}
_rule = lambda rule, to, when, rel: f"SELECT '{rule}' AS rule, cur, y, {to} AS new FROM {{{rel}}} WHERE {to} <> cur AND {when}"
_GLOBAL = {"descr": ("descr", "TRUE"), "cent": ("cent", "TRUE"), "both": ("descr", "descr = cent"), "both_clear": ("descr", "descr = cent AND margin > 5e-2")}
_STATS = "SELECT p.rule, count(*) AS moved, CAST(sum(CASE WHEN o.y <> p.y AND n.y = p.y THEN 1 ELSE 0 END) AS BIGINT) AS fixes, CAST(sum(CASE WHEN o.y = p.y AND n.y <> p.y THEN 1 ELSE 0 END) AS BIGINT) AS breaks, CAST(sum(CASE WHEN n.y = p.y THEN 1 ELSE 0 END) - sum(CASE WHEN o.y = p.y THEN 1 ELSE 0 END) AS BIGINT) AS net FROM ({union}) p JOIN {vmajority} o ON p.cur = o.comm JOIN {vmajority} n ON p.new = n.comm GROUP BY p.rule"



def _wilson(k: str, n: str, sign: str) -> str:
    """One end of the Wilson interval of k out of n at z = 1.96; null for n = 0."""
    share, m = f"CAST({k} AS DOUBLE) / nullif({n}, 0)", f"nullif({n}, 0)"
    return f"$r(({share} + 3.8416e0 / (2e0 * {m}) {sign} 1.96e0 * sqrt({share} * (1e0 - {share}) / {m} + 3.8416e0 / (4e0 * CAST({m} AS DOUBLE) * {m}))) / (1e0 + 3.8416e0 / {m}))"


def _interval(k: str, n: str, name: str) -> str:
    return f"{_wilson(k, n, '-')} AS {name}_lo, {_wilson(k, n, '+')} AS {name}_hi"


#: Counts over the informative rows of a move log: how often each term's sign is that of the truth.
_RIGHT = "count(*) AS n, CAST(sum(CASE WHEN descr = truth THEN 1 ELSE 0 END) AS BIGINT) AS descr_right, CAST(sum(CASE WHEN cent = truth AND abs(dm_cent) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS cent_right"

define(
    {
        "vclasses": "SELECT vec_id AS node, CAST(floor(vec_id / 5) AS BIGINT) % 7 AS y FROM {embeddings}",
        "vmajority": "SELECT comm, y FROM (SELECT c.comm, k.y, row_number() OVER (PARTITION BY c.comm ORDER BY count(*) DESC, k.y) AS rk FROM {vcomms} c JOIN {vclasses} k ON c.node = k.node GROUP BY c.comm, k.y) WHERE rk = 1",
        "trapped": "SELECT count(*) AS wrong, CAST(sum(CASE WHEN coalesce(r.reach, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS trapped, $r(avg(coalesce(r.own, 0e0))) AS own_share FROM {vclasses} k JOIN {vcomms} c ON k.node = c.node JOIN {vmajority} m ON c.comm = m.comm LEFT JOIN (SELECT a.u, max(CASE WHEN m.y = k.y THEN 1 ELSE 0 END) AS reach, avg(CASE WHEN t.comm = s.comm THEN 1e0 ELSE 0e0 END) AS own FROM {v_adj} a JOIN {vcomms} s ON a.u = s.node JOIN {vcomms} t ON a.v = t.node JOIN {vmajority} m ON t.comm = m.comm JOIN {vclasses} k ON a.u = k.node GROUP BY a.u) r ON r.u = k.node WHERE m.y <> k.y",
        "moved_profile": "SELECT count(*) AS n, CAST(sum(CASE WHEN a.comm <> b.comm THEN 1 ELSE 0 END) AS BIGINT) AS moved, CAST(sum(CASE WHEN a.comm <> b.comm AND ma.y = k.y THEN 1 ELSE 0 END) AS BIGINT) AS right_before, CAST(sum(CASE WHEN a.comm <> b.comm AND mb.y = k.y THEN 1 ELSE 0 END) AS BIGINT) AS right_after, CAST(sum(CASE WHEN a.comm <> b.comm AND n.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS seeds FROM {vcomms} a JOIN {local_round} b ON a.node = b.node JOIN {vclasses} k ON a.node = k.node JOIN {vmajority} ma ON a.comm = ma.comm JOIN {vmajority} mb ON b.comm = mb.comm LEFT JOIN {v_nbr_comm} n ON n.u = a.node AND n.comm = b.comm",
        # candidates of a node: the communities of its neighbours and its own
        "candidates": "SELECT u AS node, comm FROM {v_nbr_comm} UNION SELECT node, comm FROM {vcomms}",
        "near_cent": "SELECT node, comm, s, next FROM (SELECT c.node, c.comm, s.s, lead(s.s) OVER (PARTITION BY c.node ORDER BY round(s.s, 12) DESC, c.comm) AS next, row_number() OVER (PARTITION BY c.node ORDER BY round(s.s, 12) DESC, c.comm) AS rk FROM {candidates} c JOIN {sim} s ON c.node = s.node AND c.comm = s.comm) WHERE rk = 1",
        "near_descr": "SELECT node, comm, s, next FROM (SELECT c.node, c.comm, s.s, lead(s.s) OVER (PARTITION BY c.node ORDER BY round(s.s, 12) DESC, c.comm) AS next, row_number() OVER (PARTITION BY c.node ORDER BY round(s.s, 12) DESC, c.comm) AS rk FROM {candidates} c JOIN {sim_descr} s ON c.node = s.node AND c.comm = s.comm) WHERE rk = 1",
        # most neighbours; among equals the node's own community if it is one of them, else the lowest
        "graph_vote": "SELECT node, comm FROM (SELECT d.node, d.comm, row_number() OVER (PARTITION BY d.node ORDER BY coalesce(k.k, 0) DESC, CASE WHEN d.comm = c.comm THEN 0 ELSE 1 END, d.comm) AS rk FROM {candidates} d JOIN {vcomms} c ON d.node = c.node LEFT JOIN {v_nbr_comm} k ON k.u = d.node AND k.comm = d.comm) WHERE rk = 1",
        # margin: the centroid's cosine margin among the candidates, 1 where there is one
        "signals": "SELECT c.node, c.comm AS cur, k.y, d.comm AS descr, n.comm AS cent, g.comm AS graph, coalesce(2e0 * (n.s - n.next), 1e0) AS margin, r.available, r.n_cand, t.d AS deg, coalesce(CAST(o.k AS DOUBLE), 0e0) / greatest(t.d, 1) AS frac_own FROM {vcomms} c JOIN {vclasses} k ON c.node = k.node JOIN {near_descr} d ON c.node = d.node JOIN {near_cent} n ON c.node = n.node JOIN {graph_vote} g ON c.node = g.node JOIN (SELECT c.node, count(*) AS n_cand, max(CASE WHEN m.y = k.y THEN 1 ELSE 0 END) AS available FROM {candidates} c JOIN {vmajority} m ON c.comm = m.comm JOIN {vclasses} k ON c.node = k.node GROUP BY c.node) r ON c.node = r.node JOIN {v_degree} t ON c.node = t.node LEFT JOIN {v_nbr_comm} o ON o.u = c.node AND o.comm = c.comm",
        "signals_out": "SELECT s.node, s.cur, s.y, s.descr, s.cent, s.graph, $r(s.margin) AS margin, s.available, s.n_cand, s.deg, $r(s.frac_own) AS frac_own, CASE WHEN m.y = s.y THEN 1 ELSE 0 END AS correct FROM {signals} s JOIN {vmajority} m ON s.cur = m.comm",
        "margin_quartile": "SELECT $quantile(margin; 0.25) AS q25 FROM {signals}",
        "judged_margins": "SELECT s.margin, CASE WHEN m.y = s.y THEN 1 ELSE 0 END AS correct FROM {signals} s JOIN {vmajority} m ON s.cur = m.comm",
        "margin_quantiles": "SELECT $r(max(q.q25)) AS q25, $r($quantile(CASE WHEN j.correct = 0 THEN j.margin END; 0.5)) AS wrong_median, $r($quantile(CASE WHEN j.correct = 1 THEN j.margin END; 0.5)) AS right_median, $r(avg(CASE WHEN j.correct = 1 THEN NULL WHEN j.margin <= q.q25 THEN 1e0 ELSE 0e0 END)) AS wrong_low FROM {judged_margins} j CROSS JOIN {margin_quartile} q",
        "rule_stats": _STATS.replace("{union}", " UNION ALL ".join(_rule(r, to, when, "signals") for r, (to, when) in _RULES.items())),
        # over all communities; the margin is the centroid's cosine margin
        "global_signals": "SELECT c.node, c.comm AS cur, k.y, d.comm AS descr, t.comm AS cent, 2e0 * (t.s - u.s) AS margin FROM {vcomms} c JOIN {vclasses} k ON c.node = k.node JOIN {dtop} d ON c.node = d.node AND d.rk = 1 JOIN {top3} t ON c.node = t.node AND t.rk = 1 JOIN {top3} u ON c.node = u.node AND u.rk = 2",
        "global_stats": _STATS.replace("{union}", " UNION ALL ".join(_rule(r, to, when, "global_signals") for r, (to, when) in _GLOBAL.items())),
        # communities of five members or more are described, and only those can be retrieved
        "eval_top": "SELECT node, rk, comm, s FROM (SELECT s.node, s.comm, s.s, row_number() OVER (PARTITION BY s.node ORDER BY round(s.s, 12) DESC, s.comm) AS rk FROM {sim_descr} s JOIN {big_descr} b ON s.comm = b.comm) WHERE rk <= 2",
        "eval_nodes": "SELECT c.node, c.comm, CASE WHEN t.comm = c.comm THEN 1e0 ELSE 0e0 END AS hit, CASE WHEN f.node IS NOT NULL THEN NULL WHEN t.comm = c.comm THEN 1e0 ELSE 0e0 END AS held, s.s - CASE WHEN t.comm = c.comm THEN u.s ELSE t.s END AS margin FROM {vcomms} c JOIN {big_descr} b ON c.comm = b.comm JOIN {sim_descr} s ON s.node = c.node AND s.comm = c.comm JOIN {eval_top} t ON c.node = t.node AND t.rk = 1 LEFT JOIN {eval_top} u ON c.node = u.node AND u.rk = 2 LEFT JOIN {fit} f ON c.node = f.node",
        # the vector of a class's name: by default that of its members
        "class_vectors": "SELECT y, $unit(x) AS x FROM {class_proto}",
        "descr_eval": "SELECT b.comm, z.size, m.y AS majority, j.answer, $r(n.retrieval) AS retrieval, $r(n.heldout) AS heldout, $r(n.q_sem) AS q_sem, $r($dot(b.x; k.x)) AS align FROM {big_descr} b JOIN {csize} z ON b.comm = z.comm JOIN {vmajority} m ON b.comm = m.comm JOIN {class_vectors} k ON m.y = k.y LEFT JOIN {judge_answers} j ON b.comm = j.comm JOIN (SELECT comm, avg(hit) AS retrieval, avg(held) AS heldout, avg(margin) AS q_sem FROM {eval_nodes} GROUP BY comm) n ON b.comm = n.comm",
        "descr_eval_total": "SELECT d.k_eval, d.judge_acc, d.judge_unresolved, d.align, $r(n.retrieval) AS retrieval, $r(n.heldout) AS heldout, $r(n.q_sem) AS q_sem FROM (SELECT count(*) AS k_eval, $r(avg(CASE WHEN answer IS NULL THEN NULL WHEN answer = majority THEN 1e0 ELSE 0e0 END)) AS judge_acc, count(*) - count(answer) AS judge_unresolved, $r(avg(align)) AS align FROM {descr_eval}) d CROSS JOIN (SELECT avg(hit) AS retrieval, avg(held) AS heldout, avg(margin) AS q_sem FROM {eval_nodes}) n",
        "coverage": "SELECT $r(avg(CASE WHEN z.size >= 5 THEN 1e0 ELSE 0e0 END)) AS coverage FROM {vcomms} c JOIN {csize} z ON c.comm = z.comm",
        # is a move towards a community of the node's class, and do the two semantic terms say so
        "log_signs": "SELECT l.phase, l.v, l.a, l.b, sign(l.dm_descr) AS descr, sign(l.dm_cent) AS cent, CASE WHEN l.y = l.maj_b THEN 1 ELSE 0 END - CASE WHEN l.y = l.maj_a THEN 1 ELSE 0 END AS truth, l.accepted, l.dm_descr, l.dm_cent, l.dq, l.md_a, l.lam, l.scale_descr, l.scale_cent FROM {move_log} l",
        "informative": "SELECT phase, v, a, b, descr, cent, truth, dm_descr, dm_cent, dq FROM {log_signs} WHERE truth <> 0 AND lam > 0",
        "both_signs": "SELECT phase, v, a, b, descr, cent, truth, dm_cent, dq, CASE WHEN descr = cent THEN 'agree' ELSE 'disagree' END AS kind FROM {informative} WHERE abs(dm_descr) > 1e-9 AND abs(dm_cent) > 1e-9",
        "sign_agreement": f"SELECT kind, n, $r(n / pooled) AS share, descr_right, {_interval('descr_right', 'n', 'descr')}, cent_right, {_interval('cent_right', 'n', 'cent')} FROM (SELECT kind, {_RIGHT} FROM {{both_signs}} GROUP BY kind) CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS pooled FROM {{both_signs}})",
        "log_bins": "SELECT 0 AS bin, round($quantile(round(abs(dm_cent), 9); 0), 9) AS lo, round($quantile(round(abs(dm_cent), 9); 0.1), 9) AS hi FROM {informative} UNION ALL SELECT 1 AS bin, round($quantile(round(abs(dm_cent), 9); 0.1), 9) AS lo, round($quantile(round(abs(dm_cent), 9); 0.25), 9) AS hi FROM {informative} UNION ALL SELECT 2 AS bin, round($quantile(round(abs(dm_cent), 9); 0.25), 9) AS lo, round($quantile(round(abs(dm_cent), 9); 0.5), 9) AS hi FROM {informative} UNION ALL SELECT 3 AS bin, round($quantile(round(abs(dm_cent), 9); 0.5), 9) AS lo, round($quantile(round(abs(dm_cent), 9); 0.75), 9) AS hi FROM {informative} UNION ALL SELECT 4 AS bin, round($quantile(round(abs(dm_cent), 9); 0.75), 9) AS lo, round($quantile(round(abs(dm_cent), 9); 1), 9) AS hi FROM {informative}",
        "binned": f"SELECT CAST(b.bin AS VARCHAR(2)) AS bin, {_RIGHT} FROM {{informative}} l JOIN {{log_bins}} b ON round(abs(l.dm_cent), 9) BETWEEN b.lo AND b.hi WHERE abs(l.dm_descr) > 1e-9 GROUP BY b.bin UNION ALL SELECT CASE WHEN dq < 0 THEN '-' ELSE '+' END AS bin, {_RIGHT} FROM {{both_signs}} GROUP BY CASE WHEN dq < 0 THEN '-' ELSE '+' END",
        "reliability": "SELECT phase, a AS comm, avg(md_a) AS r FROM {log_signs} GROUP BY phase, a",
        # mean own margin of the two communities in the phase; where one is missing, that of the other
        "lookup_rows": "SELECT s.v, s.a, s.b, s.descr, s.cent, s.truth, s.dm_cent, round(least(coalesce(ra.r, rb.r), coalesce(rb.r, ra.r)), 9) AS r FROM {both_signs} s LEFT JOIN {reliability} ra ON s.phase = ra.phase AND s.a = ra.comm LEFT JOIN {reliability} rb ON s.phase = rb.phase AND s.b = rb.comm WHERE s.kind = 'disagree'",
        "lookup_bins": "SELECT 0 AS bin, round($quantile(r; 0), 9) AS lo, round($quantile(r; 0.25), 9) AS hi FROM {lookup_rows} UNION ALL SELECT 1 AS bin, round($quantile(r; 0.25), 9) AS lo, round($quantile(r; 0.5), 9) AS hi FROM {lookup_rows} UNION ALL SELECT 2 AS bin, round($quantile(r; 0.5), 9) AS lo, round($quantile(r; 0.75), 9) AS hi FROM {lookup_rows} UNION ALL SELECT 3 AS bin, round($quantile(r; 0.75), 9) AS lo, round($quantile(r; 0.9), 9) AS hi FROM {lookup_rows} UNION ALL SELECT 4 AS bin, round($quantile(r; 0.9), 9) AS lo, round($quantile(r; 1), 9) AS hi FROM {lookup_rows} UNION ALL SELECT 10 AS bin, round($quantile(r; 0.5), 9) AS lo, 1e9 AS hi FROM {lookup_rows} UNION ALL SELECT 11 AS bin, round($quantile(r; 0.75), 9) AS lo, 1e9 AS hi FROM {lookup_rows} UNION ALL SELECT 12 AS bin, round($quantile(r; 0.9), 9) AS lo, 1e9 AS hi FROM {lookup_rows} UNION ALL SELECT 13 AS bin, round($quantile(r; 0.95), 9) AS lo, 1e9 AS hi FROM {lookup_rows}",
        "reliability_lookup": f"SELECT bin, n, descr_right, cent_right, {_interval('descr_right', 'n', 'descr')} FROM (SELECT b.bin, {_RIGHT} FROM {{lookup_rows}} l JOIN {{lookup_bins}} b ON l.r BETWEEN b.lo AND b.hi GROUP BY b.bin)",
        "accepted_moves": "SELECT l.truth, (1e0 - l.lam) * l.dq AS graph, l.lam * l.scale_cent * l.dm_cent / n.n AS cent, l.lam * l.scale_descr * l.dm_descr / n.n AS descr, l.accepted FROM {log_signs} l CROSS JOIN {vcount} n WHERE l.lam > 0",
        "attribution": "SELECT CAST(sum(CASE WHEN accepted = 1 AND truth <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN accepted = 1 AND truth = 1 THEN 1 ELSE 0 END) AS BIGINT) AS improving, CAST(sum(CASE WHEN accepted = 1 AND truth <> 0 AND graph <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS graph_opposed, CAST(sum(CASE WHEN accepted = 1 AND truth = 1 AND graph <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS graph_opposed_improving, CAST(sum(CASE WHEN accepted = 1 AND truth <> 0 AND graph + cent <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS cent_rejects, CAST(sum(CASE WHEN accepted = 1 AND truth = 1 AND graph + cent <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS cent_rejects_improving, $r(avg(abs(graph))) AS mean_graph, $r(avg(abs(descr))) AS mean_descr, $r(avg(abs(cent))) AS mean_cent FROM {accepted_moves}",
        # members of described communities: is the nearest prototype's majority class theirs, and where do lost ones go
        "member_hits": "SELECT c.node, c.comm, k.y, m.y AS majority, t.comm AS near_descr, CASE WHEN dm.y = k.y THEN 1e0 ELSE 0e0 END AS descr_ok, CASE WHEN cm.y = k.y THEN 1e0 ELSE 0e0 END AS cent_ok FROM {vcomms} c JOIN {descr} b ON c.comm = b.comm JOIN {csize} z ON c.comm = z.comm JOIN {vclasses} k ON c.node = k.node JOIN {vmajority} m ON c.comm = m.comm JOIN {dtop} t ON c.node = t.node AND t.rk = 1 JOIN {vmajority} dm ON t.comm = dm.comm JOIN {top3} u ON c.node = u.node AND u.rk = 1 JOIN {vmajority} cm ON u.comm = cm.comm WHERE z.size >= 20",
        "lost_to": "SELECT comm, dest, n, lost, alien FROM (SELECT comm, dest, n, sum(n) OVER (PARTITION BY comm) AS lost, sum(alien) OVER (PARTITION BY comm) AS alien, row_number() OVER (PARTITION BY comm ORDER BY n DESC, dest) AS rk FROM (SELECT comm, near_descr AS dest, count(*) AS n, sum(CASE WHEN y <> majority THEN 1e0 ELSE 0e0 END) AS alien FROM {member_hits} WHERE near_descr <> comm GROUP BY comm, near_descr)) WHERE rk = 1",
        "negatives": "SELECT node FROM {vcomms} ORDER BY md5(concat('neg:', CAST(node AS VARCHAR(20)))), node LIMIT 512",
        "contrast": "SELECT i.comm, i.s - o.s AS contrast FROM (SELECT s.comm, avg(s.s) AS s FROM {sim_descr} s JOIN {vcomms} c ON s.node = c.node AND s.comm = c.comm JOIN {csize} z ON c.comm = z.comm WHERE z.size >= 20 GROUP BY s.comm) i JOIN (SELECT s.comm, avg(s.s) AS s FROM {sim_descr} s JOIN {negatives} g ON s.node = g.node GROUP BY s.comm) o ON i.comm = o.comm",
        # classes of the representative documents (place up to ten) of each community
        "shown_classes": "SELECT comm, y FROM (SELECT e.comm, k.y, row_number() OVER (PARTITION BY e.comm ORDER BY count(*) DESC, k.y) AS rk FROM {evidence_order} e JOIN {vclasses} k ON e.node = k.node WHERE e.place <= 10 GROUP BY e.comm, k.y) WHERE rk = 1",
        "failures": "SELECT h.comm, h.size, $r(h.acc_d) AS acc_d, $r(h.acc_c) AS acc_c, $r(h.acc_c - h.acc_d) AS gap, h.acc_c - h.acc_d >= @gap AS failure, h.purity < 5e-1 AS hetero, round(t.contrast, 12) <= round(b.q1, 12) AS broad, coalesce(round($dot(p.x; q.x), 12) >= 6e-1 AND l.n >= 5e-1 * l.lost, FALSE) AS confusable, r.y <> h.majority AS repdocs, coalesce(dm.y = h.majority AND l.n >= 5e-1 * l.lost, FALSE) AS fine, coalesce(j.answer = h.majority AND h.acc_d < h.acc_c - @gap, FALSE) AS encoder, coalesce(l.alien / l.lost, 0e0) >= 5e-1 AS graphtext FROM (SELECT comm, count(*) AS size, max(majority) AS majority, avg(descr_ok) AS acc_d, avg(cent_ok) AS acc_c, avg(CASE WHEN y = majority THEN 1e0 ELSE 0e0 END) AS purity FROM {member_hits} GROUP BY comm) h JOIN {contrast} t ON h.comm = t.comm CROSS JOIN (SELECT $quantile(contrast; 0.25) AS q1 FROM {contrast}) b JOIN {shown_classes} r ON h.comm = r.comm JOIN {descr} p ON h.comm = p.comm LEFT JOIN {lost_to} l ON h.comm = l.comm LEFT JOIN {descr} q ON l.dest = q.comm LEFT JOIN {vmajority} dm ON l.dest = dm.comm LEFT JOIN {judge_answers} j ON h.comm = j.comm",
        # judge records: four passes of each item, the class 'click' is right
        "judged": "SELECT CAST(floor(event_id / 4) AS BIGINT) AS item, concat('p', CAST(1 + event_id % 4 AS VARCHAR(2))) AS pass, concat('d', CAST(CAST(floor(event_id / 4) AS BIGINT) % 2 AS VARCHAR(2))) AS dataset, concat('m', CAST(CAST(floor(event_id / 4) AS BIGINT) % 3 AS VARCHAR(2))) AS method, CAST(floor(event_id / 4) AS BIGINT) % 5 AS seed, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS answer, 'click' AS majority, CASE WHEN event_id % 17 = 0 THEN FALSE ELSE TRUE END AS valid, event_id % 34 = 0 AS empty, CASE WHEN event_id % 29 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason, 1 + event_id % 3 AS attempts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type = 'click' END AS correct FROM {events}",
        "judge_counts": "SELECT dataset, method, count(*) AS queries, CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN empty THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN stop_reason = 'max_tokens' THEN 1 ELSE 0 END) AS BIGINT) AS truncated, CAST(sum(CASE WHEN attempts > 1 THEN 1 ELSE 0 END) AS BIGINT) AS retried, CAST(sum(CASE WHEN answer IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM {judged} GROUP BY dataset, method",
        "judge_by_pass": f"SELECT t.dataset, t.method, t.pass, t.n, t.k, {_interval('t.k', 't.n', 'acc')}, $r(s.mean) AS mean, $r(s.std) AS std FROM (SELECT dataset, method, pass, count(correct) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS k FROM {{judged}} GROUP BY dataset, method, pass) t JOIN (SELECT dataset, method, pass, avg(acc) AS mean, stddev_pop(acc) AS std FROM (SELECT dataset, method, pass, seed, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS acc FROM {{judged}} WHERE correct IS NOT NULL GROUP BY dataset, method, pass, seed) GROUP BY dataset, method, pass) s ON t.dataset = s.dataset AND t.method = s.method AND t.pass = s.pass",
        "pass_agreement": "SELECT a.dataset, a.method, b.pass, count(*) AS n, CAST(sum(CASE WHEN a.answer = b.answer THEN 1 ELSE 0 END) AS BIGINT) AS same, $r(avg(CASE WHEN b.correct THEN 1e0 ELSE 0e0 END)) AS acc FROM {judged} a JOIN {judged} b ON a.item = b.item WHERE a.pass = 'p1' AND b.pass <> 'p1' AND a.answer IS NOT NULL AND b.answer IS NOT NULL GROUP BY a.dataset, a.method, b.pass",
        # the first three passes, of items that have a valid answer in each; equal votes go to the lowest name
        "three_answers": "SELECT item FROM {judged} WHERE pass IN ('p1', 'p2', 'p3') AND answer IS NOT NULL GROUP BY item HAVING count(*) = 3",
        "votes": "SELECT item, dataset, method, majority, answer, votes FROM (SELECT j.item, j.dataset, j.method, j.majority, j.answer, count(*) AS votes, row_number() OVER (PARTITION BY j.item ORDER BY count(*) DESC, j.answer) AS rk FROM {judged} j JOIN {three_answers} t ON j.item = t.item WHERE j.pass IN ('p1', 'p2', 'p3') GROUP BY j.item, j.dataset, j.method, j.majority, j.answer) WHERE rk = 1",
        "majority_vote": "SELECT dataset, method, count(*) AS n, $r(avg(CASE WHEN answer = majority THEN 1e0 ELSE 0e0 END)) AS acc FROM {votes} GROUP BY dataset, method",
        # pass p2 shuffles the class order; answers are mapped back through the permutation
        "judge_passes": "SELECT j.item, p.pass, c.y, CAST(row_number() OVER (PARTITION BY j.item, p.pass ORDER BY CASE WHEN p.pass = 'p2' THEN md5(concat(CAST(j.item AS VARCHAR(20)), ':', c.y)) ELSE c.y END) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT item FROM {judged}) j CROSS JOIN (SELECT DISTINCT pass FROM {judged}) p CROSS JOIN (SELECT DISTINCT event_type AS y FROM {events}) c",
    }
)
