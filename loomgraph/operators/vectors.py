"""Centroids, similarities, prototypes, margins and the reliability gate.

Base relations: ``emb`` (node, x), ``vcomms`` (node, comm), ``vedges`` (src, dst), ``descr`` (comm, x) with ``fit`` (comm,
node). Similarity is s = (1 + cos) / 2 against normalised prototypes. A dead community is an absent row.
"""

from __future__ import annotations

from loomgraph.plans.engine import define

_WEIGHTED = "SELECT comm, $arr(val; pos) AS x FROM (SELECT w.comm, l.pos, sum(w.w * l.val) AS val FROM {weights} w JOIN $long({{emb}}; node) l ON w.node = l.node GROUP BY w.comm, l.pos) GROUP BY comm"


def _weighted(weights: str) -> str:
    return _WEIGHTED.replace("{weights}", "{" + weights + "}").replace("{{emb}}", "{emb}")


def _sim(proto: str) -> str:
    return "SELECT e.node, p.comm, (1e0 + $dot(e.x; p.x)) / 2e0 AS s FROM {emb} e CROSS JOIN {" + proto + "} p"


def _unit(rel: str) -> str:
    return "SELECT comm, $unit(x) AS x FROM {" + rel + "}"


def _long(rel: str) -> str:
    return "SELECT comm, CAST(pos AS BIGINT) AS pos, $r(val) AS val FROM $long({" + rel + "}; comm)"


def _ranked(rel: str) -> str:
    """Global ranks of (node, g, h) by h: within the bucket g, behind the buckets before it; no task sees all rows."""
    before = "SELECT g, coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT g, count(*) AS n FROM {" + rel + "} GROUP BY g)"
    return "SELECT s.node, CAST(b.before AS BIGINT) + row_number() OVER (PARTITION BY s.g ORDER BY s.h, s.node) AS i FROM {" + rel + "} s JOIN (" + before + ") b ON s.g = b.g"


def _moved(rel: str) -> str:
    """Prototypes of described communities with five members or more; the unit centroid of the others."""
    return "SELECT c.comm, coalesce(p.x, c.x) AS x FROM {centroid_unit} c LEFT JOIN {" + rel + "} p ON c.comm = p.comm"


_SOFTMAX = "SELECT node, comm, e / sum(e) OVER (PARTITION BY comm) AS w FROM (SELECT node, comm, exp({tau} * c) AS e FROM {cos})"

define(
    {
        "emb": "SELECT vec_id AS node, $vec(embedding) AS x FROM {embeddings}",
        "vcomms": "SELECT vec_id AS node, CAST(label AS BIGINT) AS comm FROM {embeddings}",
        "vcount": "SELECT count(*) AS n FROM {embeddings}",
        "vedges": "SELECT vec_id AS src, vec_id + 1 AS dst FROM {embeddings} CROSS JOIN {vcount} WHERE vec_id + 1 < n UNION ALL SELECT vec_id AS src, vec_id + 7 AS dst FROM {embeddings} CROSS JOIN {vcount} WHERE vec_id + 7 < n",
        "fit": "SELECT comm, node FROM (SELECT comm, node, row_number() OVER (PARTITION BY comm ORDER BY node) AS rk FROM {vcomms}) WHERE rk <= 10",
        "fit_weights": "SELECT node, comm, 1e0 AS w FROM {fit}",
        "descr_sum": _weighted("fit_weights"),
        "descr": _unit("descr_sum"),
        "one_weights": "SELECT node, comm, 1e0 AS w FROM {vcomms}",
        "centroid": _weighted("one_weights"),
        "centroid_out": _long("centroid"),
        "centroid_unit": _unit("centroid"),
        "centroid_unit_out": _long("centroid_unit"),
        "sim": _sim("centroid_unit"),
        "sim_out": "SELECT node, comm, $r(s) AS s FROM {sim}",
        "top3": "SELECT node, rk, comm, s FROM (SELECT node, comm, s, row_number() OVER (PARTITION BY node ORDER BY round(s, 12) DESC, comm) AS rk FROM {sim}) WHERE rk <= 3",
        "top3_out": "SELECT node, CAST(rk AS BIGINT) AS rk, comm, $r(s) AS s FROM {top3}",
        "killed": "SELECT node, CAST(rk AS BIGINT) AS rk, comm, $r(s) AS s FROM (SELECT node, comm, s, row_number() OVER (PARTITION BY node ORDER BY round(s, 12) DESC, comm) AS rk FROM {sim} WHERE comm <> @killed) WHERE rk <= 3",
        "best_other": "SELECT node, comm, $r(s) AS s FROM (SELECT s.node, s.comm, s.s, row_number() OVER (PARTITION BY s.node ORDER BY round(s.s, 12) DESC, s.comm) AS rk FROM {sim} s JOIN {vcomms} c ON s.node = c.node WHERE s.comm <> c.comm AND s.comm <> @killed) WHERE rk = 1",
        "margin": "SELECT s.node, s.comm, s.s - CASE WHEN t1.comm = s.comm THEN t2.s ELSE t1.s END AS margin FROM {sim} s JOIN {top3} t1 ON s.node = t1.node AND t1.rk = 1 LEFT JOIN {top3} t2 ON s.node = t2.node AND t2.rk = 2",
        "margin_out": "SELECT node, comm, $r(margin) AS margin FROM {margin}",
        "own_margin": "SELECT m.node, m.comm, m.margin FROM {margin} m JOIN {vcomms} c ON m.node = c.node AND m.comm = c.comm",
        "q_sem": "SELECT avg(margin) AS q_sem FROM {own_margin}",
        "q_sem_out": "SELECT $r(q_sem) AS q_sem FROM {q_sem}",
        "sem_scale": "SELECT 2e0 / greatest(avg(top - mean), 1e-6) AS c FROM (SELECT node, max(s) AS top, avg(s) AS mean FROM {sim} GROUP BY node)",
        "sem_scale_out": "SELECT $r(c) AS c FROM {sem_scale}",
        "retrieval": "SELECT $r(avg(CASE WHEN t.comm = c.comm THEN 1e0 ELSE 0e0 END)) AS acc FROM {top3} t JOIN {vcomms} c ON t.node = c.node WHERE t.rk = 1",
        # permuted labels: nodes by id against nodes by a hash of seed and id
        "gate_nodes": "SELECT c.node, c.comm FROM {vcomms} c JOIN (SELECT comm FROM {vcomms} GROUP BY comm HAVING count(*) >= 20) b ON c.comm = b.comm LEFT JOIN {fit} f ON c.node = f.node WHERE f.node IS NULL",
        # chance: the expected share of hits if the labels of the scored nodes are permuted among them
        "gate_chance": "SELECT sum(CAST(t.c AS DOUBLE) * l.c) / max(CAST(n.n AS DOUBLE) * n.n) AS chance FROM (SELECT t.comm, count(*) AS c FROM {gate_nodes} g JOIN {top3} t ON g.node = t.node AND t.rk = 1 GROUP BY t.comm) t JOIN (SELECT comm, count(*) AS c FROM {gate_nodes} GROUP BY comm) l ON t.comm = l.comm CROSS JOIN (SELECT count(*) AS n FROM {gate_nodes}) n",
        "gate": "SELECT $r(a.acc) AS acc, $r(coalesce(c.chance, 0e0)) AS chance, coalesce(a.acc >= greatest(2e0 * coalesce(c.chance, 0e0), coalesce(c.chance, 0e0) + 5e-2), FALSE) AS reliable FROM (SELECT avg(CASE WHEN t.comm = g.comm THEN 1e0 ELSE 0e0 END) AS acc FROM {gate_nodes} g JOIN {top3} t ON g.node = t.node AND t.rk = 1) a CROSS JOIN {gate_chance} c",
        "csize": "SELECT comm, count(*) AS size FROM {vcomms} GROUP BY comm",
        "proto_fallback": "SELECT c.comm, CASE WHEN z.size >= 5 AND d.comm IS NOT NULL THEN d.x ELSE c.x END AS x FROM {centroid_unit} c JOIN {csize} z ON c.comm = z.comm LEFT JOIN {descr} d ON c.comm = d.comm",
        "proto_fallback_out": _long("proto_fallback"),
        "big_descr": "SELECT d.comm, d.x FROM {descr} d JOIN {csize} z ON d.comm = z.comm WHERE z.size >= 5",
        "proto_shift": "SELECT c.comm, CASE WHEN d.comm IS NULL THEN c.x ELSE $add(c.x; d.x; @gamma) END AS x FROM {centroid_unit} c LEFT JOIN {big_descr} d ON c.comm = d.comm",
        "proto_shift_unit": _unit("proto_shift"),
        "proto_shift_out": _long("proto_shift_unit"),
        "cos_descr": "SELECT c.node, c.comm, $dot(e.x; d.x) AS c FROM {vcomms} c JOIN {emb} e ON c.node = e.node JOIN {big_descr} d ON c.comm = d.comm",
        "wmean_weights": _SOFTMAX.replace("{tau}", "@tau").replace("{cos}", "{cos_descr}"),
        "proto_wmean_sum": _weighted("wmean_weights"),
        "proto_wmean": _moved("proto_wmean_sum"),
        "proto_wmean_unit": _unit("proto_wmean"),
        "proto_wmean_out": _long("proto_wmean_unit"),
        "cos_all": "SELECT e.node, d.comm, $dot(e.x; d.x) AS c FROM {emb} e CROSS JOIN {big_descr} d",
        "cos_margin": "SELECT o.node, o.comm, o.c - coalesce(max(a.c), 0e0) AS c FROM {cos_descr} o LEFT JOIN {cos_all} a ON o.node = a.node AND o.comm <> a.comm GROUP BY o.node, o.comm, o.c",
        "wmargin_weights": _SOFTMAX.replace("{tau}", "@tau_margin").replace("{cos}", "{cos_margin}"),
        "proto_wmargin_sum": _weighted("wmargin_weights"),
        "proto_wmargin": _moved("proto_wmargin_sum"),
        "proto_wmargin_unit": _unit("proto_wmargin"),
        "proto_wmargin_out": _long("proto_wmargin_unit"),
        "trim_weights": "SELECT node, comm, 1e0 AS w FROM (SELECT node, comm, row_number() OVER (PARTITION BY comm ORDER BY round(c, 12) DESC, node) AS rk, count(*) OVER (PARTITION BY comm) AS n FROM {cos_descr}) WHERE rk <= greatest(1, ceil(@fraction * n))",
        "proto_trim_sum": _weighted("trim_weights"),
        "proto_trim": _moved("proto_trim_sum"),
        "proto_trim_unit": _unit("proto_trim"),
        "proto_trim_out": _long("proto_trim_unit"),
        "cos_own": "SELECT c.node, c.comm, $dot(e.x; d.x) AS c FROM {vcomms} c JOIN {emb} e ON c.node = e.node JOIN {centroid_unit} d ON c.comm = d.comm JOIN {big_descr} z ON c.comm = z.comm",
        "selfw_weights": _SOFTMAX.replace("{tau}", "@tau").replace("{cos}", "{cos_own}"),
        "proto_selfw_sum": _weighted("selfw_weights"),
        "proto_selfw": _moved("proto_selfw_sum"),
        "proto_selfw_unit": _unit("proto_selfw"),
        "proto_selfw_out": _long("proto_selfw_unit"),
        "sim_descr": _sim("descr"),
        "advisor": "SELECT node, comm FROM (SELECT node, comm, row_number() OVER (PARTITION BY node ORDER BY round(s, 12) DESC, comm) AS rk FROM {sim_descr}) WHERE rk = 1",
        "extra_candidate": "SELECT c.node, CASE WHEN t.comm = a.comm AND t.comm <> c.comm THEN t.comm END AS agree, CASE WHEN t.comm <> c.comm THEN t.comm END AS cent, CASE WHEN a.comm <> c.comm THEN a.comm END AS descr FROM {vcomms} c JOIN {top3} t ON c.node = t.node AND t.rk = 1 JOIN {advisor} a ON c.node = a.node",
        "extra_candidate_out": "SELECT node, coalesce(agree, -1) AS agree, coalesce(cent, -1) AS cent, coalesce(descr, -1) AS descr FROM {extra_candidate}",
        "edge_sigma": "SELECT avg(sqrt(greatest(0e0, $dot(u.x; u.x) + $dot(v.x; v.x) - 2e0 * $dot(u.x; v.x)))) AS sigma FROM {vedges} e JOIN {emb} u ON e.src = u.node JOIN {emb} v ON e.dst = v.node",
        "edge_sigma_out": "SELECT $r(sigma) AS sigma FROM {edge_sigma}",
        # a permutation of the nodes: those in order of one hash against those in order of another, ranked by buckets
        "shuffle_to": "SELECT node, substr(md5(concat('to:', CAST(node AS VARCHAR(20)))), 1, 3) AS g, md5(concat('to:', CAST(node AS VARCHAR(20)))) AS h FROM {emb}",
        "shuffle_from": "SELECT node, substr(md5(concat('123:', CAST(node AS VARCHAR(20)))), 1, 3) AS g, md5(concat('123:', CAST(node AS VARCHAR(20)))) AS h FROM {emb}",
        "rank_to": _ranked("shuffle_to"),
        "rank_from": _ranked("shuffle_from"),
        "shuffled": "SELECT a.node, b.node AS source FROM {rank_to} a JOIN {rank_from} b ON a.i = b.i",
        "shuffled_emb": "SELECT s.node, e.x FROM {shuffled} s JOIN {emb} e ON s.source = e.node",
        "shuffled_texts": "SELECT s.node, s.source, coalesce(t.text, '') AS text FROM {shuffled} s LEFT JOIN {texts} t ON s.source = t.node",
        "shuffled_texts_out": "SELECT node, source, md5(text) AS text FROM {shuffled_texts}",
        "emb_out": "SELECT node, CAST(pos AS BIGINT) AS pos, $r(val) AS val FROM $long({emb}; node)",
        "shuffled_out": "SELECT node, CAST(pos AS BIGINT) AS pos, $r(val) AS val FROM $long({shuffled_emb}; node)",
    }
)
