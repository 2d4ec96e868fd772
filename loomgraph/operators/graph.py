"""Graph construction, bookkeeping, modularity and its gains.

Base relations: ``nodes`` (node), ``raw_edges`` (a, b), ``comms`` (node, comm), ``classes`` (node, label). By default they
are the co-purchase graph of the fixture tables; pass DataFrames of these columns to run over another graph.
"""

from __future__ import annotations

from loomgraph.plans.engine import define

define(
    {
        "nodes": "SELECT p_partkey AS node FROM {part}",
        "raw_edges": "SELECT l1.l_partkey AS a, l2.l_partkey AS b FROM {lineitem} l1 JOIN {lineitem} l2 ON l1.l_orderkey = l2.l_orderkey",
        "comms": "SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS comm FROM {part}",
        "brands": "SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS label FROM (SELECT DISTINCT p_brand FROM {part})",
        "classes": "SELECT p.p_partkey AS node, b.label FROM {part} p JOIN {brands} b ON p.p_brand = b.p_brand",
        # self-loops go, ends are ordered, repeated edges are one, ends have to be nodes
        "edges": "SELECT DISTINCT least(e.a, e.b) AS src, greatest(e.a, e.b) AS dst FROM {raw_edges} e JOIN {nodes} s ON e.a = s.node JOIN {nodes} t ON e.b = t.node WHERE e.a <> e.b",
        "edge_bounds": "SELECT count(*) AS outside FROM {raw_edges} e LEFT JOIN {nodes} s ON e.a = s.node LEFT JOIN {nodes} t ON e.b = t.node WHERE s.node IS NULL OR t.node IS NULL",
        "adj": "SELECT src AS u, dst AS v FROM {edges} UNION ALL SELECT dst AS u, src AS v FROM {edges}",
        "degree": "SELECT n.node, CAST(coalesce(a.c, 0) AS BIGINT) AS d FROM {nodes} n LEFT JOIN (SELECT u, count(*) AS c FROM {adj} GROUP BY u) a ON n.node = a.u",
        "edge_count": "SELECT CAST(count(*) AS DOUBLE) AS m FROM {edges}",
        "inner_edges": "SELECT s.comm, count(*) AS c FROM {edges} e JOIN {comms} s ON e.src = s.node JOIN {comms} t ON e.dst = t.node WHERE s.comm = t.comm GROUP BY s.comm",
        "cstat": "SELECT p.comm, p.size, p.dc, CAST(coalesce(i.c, 0) AS BIGINT) AS mc FROM (SELECT c.comm, count(*) AS size, CAST(sum(d.d) AS BIGINT) AS dc FROM {comms} c JOIN {degree} d ON c.node = d.node GROUP BY c.comm) p LEFT JOIN {inner_edges} i ON p.comm = i.comm",
        "alive": "SELECT comm FROM {cstat} WHERE size > 0",
        "n_comm": "SELECT count(DISTINCT comm) AS n_comm FROM {comms}",
        "q_terms": "SELECT c.comm, c.mc / e.m - (c.dc / (2e0 * e.m)) * (c.dc / (2e0 * e.m)) AS q FROM {cstat} c CROSS JOIN {edge_count} e",
        "q_terms_out": "SELECT comm, $r(q) AS q FROM {q_terms}",
        "modularity": "SELECT max(e.m) AS m, count(*) AS n_comm, $r(sum(t.q)) AS q FROM {q_terms} t CROSS JOIN {edge_count} e",
        "nbr_comm": "SELECT a.u, c.comm, count(*) AS k FROM {adj} a JOIN {comms} c ON a.v = c.node GROUP BY a.u, c.comm",
        # gain of moving v from its community a to a neighbour's b; dc of a includes v
        "move_gain": "SELECT k.u AS v, o.comm AS a, k.comm AS b, (k.k - coalesce(h.k, 0)) / e.m + d.d * (CAST(ca.dc - d.d - cb.dc AS DOUBLE)) / (2e0 * e.m * e.m) AS dq FROM {nbr_comm} k JOIN {comms} o ON k.u = o.node LEFT JOIN {nbr_comm} h ON h.u = k.u AND h.comm = o.comm JOIN {degree} d ON d.node = k.u JOIN {cstat} ca ON ca.comm = o.comm JOIN {cstat} cb ON cb.comm = k.comm CROSS JOIN {edge_count} e WHERE k.comm <> o.comm",
        "move_gain_out": "SELECT v, a, b, $r(dq) AS dq FROM {move_gain}",
        "best_move": "SELECT v, a, b, dq FROM (SELECT v, a, b, dq, row_number() OVER (PARTITION BY v ORDER BY round(dq, 12) DESC, b) AS rk FROM {move_gain}) WHERE rk = 1 AND dq > 1e-12",
        "best_move_out": "SELECT v, a, b, $r(dq) AS dq FROM {best_move}",
        "moved": "SELECT c.node, coalesce(b.b, c.comm) AS comm FROM {comms} c LEFT JOIN {best_move} b ON c.node = b.v",
        "inter_edges": "SELECT least(s.comm, t.comm) AS a, greatest(s.comm, t.comm) AS b, count(*) AS e FROM {edges} e JOIN {comms} s ON e.src = s.node JOIN {comms} t ON e.dst = t.node WHERE s.comm <> t.comm GROUP BY least(s.comm, t.comm), greatest(s.comm, t.comm)",
        "merge_gain": "SELECT i.a, i.b, i.e / m.m - 2e0 * ca.dc * cb.dc / (4e0 * m.m * m.m) AS dq FROM {inter_edges} i JOIN {cstat} ca ON i.a = ca.comm JOIN {cstat} cb ON i.b = cb.comm CROSS JOIN {edge_count} m",
        "merge_gain_out": "SELECT a, b, $r(dq) AS dq FROM {merge_gain}",
        "best_merge": "SELECT a, b FROM {merge_gain} ORDER BY round(dq, 12) DESC, a, b LIMIT 1",
        "merged": "SELECT c.node, CASE WHEN c.comm = m.b THEN m.a ELSE c.comm END AS comm FROM {comms} c CROSS JOIN {best_merge} m",
        "relabel": "SELECT c.node, r.new AS comm FROM {comms} c JOIN (SELECT comm, CAST(dense_rank() OVER (ORDER BY comm) - 1 AS BIGINT) AS new FROM (SELECT DISTINCT comm FROM {comms})) r ON c.comm = r.comm",
        "isolated": "SELECT a.u AS node FROM {adj} a JOIN {comms} s ON a.u = s.node JOIN {comms} t ON a.v = t.node GROUP BY a.u HAVING sum(CASE WHEN s.comm = t.comm THEN 1 ELSE 0 END) = 0",
        # the sparse graph: customers of one nation in a chain
        "chain_edges": "SELECT src, dst FROM (SELECT c_custkey AS src, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS dst FROM {customer}) WHERE dst IS NOT NULL",
        "modularity_from_edges": "SELECT $r(i.inside / m.m - d.expected) AS q FROM (SELECT CAST(sum(CASE WHEN s.comm = t.comm THEN 1 ELSE 0 END) AS DOUBLE) AS inside FROM {edges} e JOIN {comms} s ON e.src = s.node JOIN {comms} t ON e.dst = t.node) i CROSS JOIN {edge_count} m CROSS JOIN (SELECT sum((c.dc / (2e0 * e.m)) * (c.dc / (2e0 * e.m))) AS expected FROM {cstat} c CROSS JOIN {edge_count} e) d",
    }
)
