"""Partition metrics and run aggregates.

Base relations: ``labelled`` (node, pred, y); ``runs`` (dataset, method, seed, tag, lam, shuffled, score, time, calls).
"""

from __future__ import annotations

from loomgraph.plans.engine import define

define(
    {
        "labelled": "SELECT event_id AS node, user_id % 5 AS pred, event_type AS y FROM {events}",
        "contingency": "SELECT pred, y, count(*) AS n FROM {labelled} GROUP BY pred, y",
        "pred_totals": "SELECT pred, CAST(sum(n) AS DOUBLE) AS n FROM {contingency} GROUP BY pred",
        "y_totals": "SELECT y, CAST(sum(n) AS DOUBLE) AS n FROM {contingency} GROUP BY y",
        "total": "SELECT CAST(sum(n) AS DOUBLE) AS n FROM {contingency}",
        "entropy_pred": "SELECT -sum(p.n / t.n * ln(p.n / t.n)) AS h FROM {pred_totals} p CROSS JOIN {total} t",
        "entropy_y": "SELECT -sum(y.n / t.n * ln(y.n / t.n)) AS h FROM {y_totals} y CROSS JOIN {total} t",
        "mutual": "SELECT sum(c.n / t.n * ln(c.n * t.n / (p.n * y.n))) AS i FROM {contingency} c JOIN {pred_totals} p ON c.pred = p.pred JOIN {y_totals} y ON c.y = y.y CROSS JOIN {total} t",
        "nmi": "SELECT CASE WHEN a.h + b.h = 0 THEN 1e0 ELSE $r(2e0 * i.i / (a.h + b.h)) END AS nmi FROM {mutual} i CROSS JOIN {entropy_pred} a CROSS JOIN {entropy_y} b",
        "ari": "SELECT CASE WHEN m.top = m.mean THEN 1e0 ELSE $r((m.s - m.mean) / (m.top - m.mean)) END AS ari FROM (SELECT s.s, p.s * y.s / greatest(t.s, 1e0) AS mean, 0.5e0 * (p.s + y.s) AS top FROM (SELECT sum(n * (n - 1) / 2e0) AS s FROM {contingency}) s CROSS JOIN (SELECT sum(n * (n - 1) / 2e0) AS s FROM {pred_totals}) p CROSS JOIN (SELECT sum(n * (n - 1) / 2e0) AS s FROM {y_totals}) y CROSS JOIN (SELECT n * (n - 1) / 2e0 AS s FROM {total}) t) m",
        "purity": "SELECT $r(sum(m.n) / max(t.n)) AS purity FROM (SELECT pred, max(n) AS n FROM {contingency} GROUP BY pred) m CROSS JOIN {total} t",
        "metric_bundle": "SELECT n.nmi, a.ari, p.purity, k.k, CAST(t.n AS BIGINT) AS n FROM {nmi} n CROSS JOIN {ari} a CROSS JOIN {purity} p CROSS JOIN {total} t CROSS JOIN (SELECT count(*) AS k FROM {pred_totals}) k",
        "composition": "SELECT pred, CAST(rk AS BIGINT) AS rk, y, n FROM (SELECT pred, y, n, row_number() OVER (PARTITION BY pred ORDER BY n DESC, y) AS rk FROM {contingency}) WHERE rk <= 3",
        "majority": "SELECT pred, y, n FROM {composition} WHERE rk = 1",
        "runs": "SELECT event_type AS dataset, concat('m', CAST(user_id % 4 AS VARCHAR(2))) AS method, event_id % 5 AS seed, CASE WHEN event_id % 3 = 0 THEN 'audit' ELSE 'main' END AS tag, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 5e-1 ELSE 2.5e-1 END AS lam, event_id % 11 = 0 AS shuffled, value AS score, value / 1e1 AS time, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 9 END AS calls FROM {events}",
        "kept_runs": "SELECT dataset, method, seed, tag, score, time, calls FROM {runs} WHERE (lam IS NULL OR lam = 5e-1) AND NOT shuffled",
        "run_groups": "SELECT dataset, tag, method, count(*) AS n_runs FROM {kept_runs} GROUP BY dataset, tag, method",
        "seed_scores": "SELECT dataset, method, seed, avg(score) AS score FROM {kept_runs} GROUP BY dataset, method, seed",
        "mean_std": "SELECT dataset, method, $r(avg(score)) AS mean, $r(stddev_pop(score)) AS std, count(*) AS seeds FROM {seed_scores} GROUP BY dataset, method",
        "paired_delta": "SELECT a.dataset, a.method, $r(avg(a.score - b.score)) AS delta, CAST(sum(CASE WHEN a.score > b.score THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS seeds FROM {seed_scores} a JOIN {seed_scores} b ON a.dataset = b.dataset AND a.seed = b.seed AND b.method = 'm0' WHERE a.method <> 'm0' GROUP BY a.dataset, a.method",
        "marking": "SELECT dataset, method, mean, CAST(rank() OVER (PARTITION BY dataset ORDER BY mean DESC) AS BIGINT) AS place FROM {mean_std}",
        "best_marks": "SELECT dataset, method, mean, CASE place WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM {marking}",
        "runtime": "SELECT dataset, method, $r(avg(coalesce(time, 0e0))) AS time, $r(avg(coalesce(calls, 0))) AS calls FROM {kept_runs} GROUP BY dataset, method",
        # one row for each phase of a run: the weight that the reliability gate left to the semantic term
        "gate_blocks": "SELECT dataset, seed, CASE WHEN calls IS NULL OR score < 5e1 THEN 0e0 ELSE coalesce(lam, 5e-1) END AS lam_eff FROM {runs} WHERE shuffled",
        "gate_outcome": "SELECT dataset, CAST(sum(CASE WHEN open = 0 THEN 1 ELSE 0 END) AS BIGINT) AS all_closed, count(*) AS n FROM (SELECT dataset, seed, sum(CASE WHEN lam_eff > 0 THEN 1 ELSE 0 END) AS open FROM {gate_blocks} GROUP BY dataset, seed) GROUP BY dataset",
        "wilson": "SELECT pred, n, k, $r((k / n + 1.96e0 * 1.96e0 / (2e0 * n)) / (1e0 + 1.96e0 * 1.96e0 / n)) AS centre, $r(1.96e0 * sqrt(k / n * (1e0 - k / n) / n + 1.96e0 * 1.96e0 / (4e0 * n * n)) / (1e0 + 1.96e0 * 1.96e0 / n)) AS half FROM (SELECT pred, CAST(sum(n) AS DOUBLE) AS n, CAST(max(n) AS DOUBLE) AS k FROM {contingency} GROUP BY pred) WHERE n > 0",
        "thresholds": "SELECT $r($quantile(value; 0.25)) AS q25, $r($quantile(value; 0.5)) AS q50, $r($quantile(value; 0.75)) AS q75 FROM {events}",
        "confusions": "SELECT y, other, n FROM (SELECT l.y, m.y AS other, count(*) AS n FROM {labelled} l JOIN {majority} m ON l.pred = m.pred WHERE l.y <> m.y GROUP BY l.y, m.y) ORDER BY n DESC, y, other LIMIT 8",
    }
)
