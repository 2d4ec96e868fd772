"""Registry of the graph queries: the operator inventory by number, each a relation plan and its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import roundtrips
from loomgraph.operators import analysis, describe, graph, metrics, moves, objectives, text, vectors  # noqa: F401  (define their relations)
from loomgraph.operators.components import all_components, components, fragments
from loomgraph.plans.engine import duckdb_sql, plan

#: Query name -> relation.
PLANS = {
    "o003_titles": "joined_titles",
    "o004_neighbour_lists": "listed_graph",
    "o004_label_names": "listed_names",
    "o005_markers": "normalised_texts",
    "o006_category_labels": "category_labels",
    "o007_hash_encoder": "hash_encoding",
    "o009_partition_names": "pred_parts",
    "o010_open_runs": "open_runs",
    "o014_cache_hits": "cache_hits",
    "o014_cache_misses": "cache_misses",
    "o015_judge_cache": "judge_cache",
    "o017_clean_edges": "edges",
    "o017_edge_bounds": "edge_bounds",
    "o018_degree": "degree",
    "o019_edge_count": "edge_count",
    "o020_community_stats": "cstat",
    "o021_alive": "alive",
    "o021_n_comm": "n_comm",
    "o022_q_terms": "q_terms_out",
    "o022_modularity": "modularity",
    "o023_neighbour_communities": "nbr_comm",
    "o024_move_gain": "move_gain_out",
    "o025_apply_moves": "moved",
    "o026_merge_gain": "merge_gain_out",
    "o027_apply_merge": "merged",
    "o028_inter_edges": "inter_edges",
    "o029_relabel": "relabel",
    "o031_isolated_nodes": "isolated",
    "o032_centroids": "centroid_out",
    "o033_normalise": "centroid_unit_out",
    "o034_similarity": "sim_out",
    "o035_top3": "top3_out",
    "o036_kill_column": "killed",
    "o037_best_other": "best_other",
    "o038_margin": "margin_out",
    "o039_q_sem": "q_sem_out",
    "o040_scale": "sem_scale_out",
    "o041_retrieval": "retrieval",
    "o042_reliability_gate": "gate",
    "o043_prototype_fallback": "proto_fallback_out",
    "o044_prototype_shift": "proto_shift_out",
    "o045_prototype_wmean": "proto_wmean_out",
    "o046_prototype_wmargin": "proto_wmargin_out",
    "o047_prototype_trim": "proto_trim_out",
    "o048_prototype_selfw": "proto_selfw_out",
    "o049_advisor": "advisor",
    "o050_extra_candidate": "extra_candidate_out",
    "o051_edge_sigma": "edge_sigma_out",
    "o052_best_move": "best_move_out",
    "o053_sn_value": "sn_value",
    "o054_sn_move_gain": "sn_move_gain_out",
    "o055_sn_merge_gain": "sn_merge_gain",
    "o056_semantic_move_gain": "semantic_move_gain_out",
    "o056_semantic_value": "semantic_value",
    "o057_drop_gain": "drop_gain",
    "o058_semantic_merge_gain": "semantic_merge_gain",
    "o059_apply_semantic_merge": "semantic_merged",
    "o060_agreement_gain": "agree_gain",
    "o061_three_factor_gain": "three_factor_move_gain_out",
    "o063_local_round": "local_round",
    "o061_three_factor_value": "three_factor_value",
    "o061_three_factor_merge_gain": "three_factor_merge_gain",
    "o069_shuffled_control": "shuffled_out",
    "o069_shuffled_texts": "shuffled_texts_out",
    "o070_evidence_order": "evidence_order",
    "o071_prompts": "prompts",
    "o074_candidate_choice": "chosen",
    "o075_lazy_refresh": "refresh",
    "o076_fit_mask": "fit_mask",
    "o077_judge": "judge_answers",
    "o078_judge_passes": "judge_passes",
    "o079_contingency": "contingency",
    "o080_nmi": "nmi",
    "o081_ari": "ari",
    "o083_purity": "purity",
    "o084_modularity_from_edges": "modularity_from_edges",
    "o085_metric_bundle": "metric_bundle",
    "o086_composition": "composition",
    "o087_majority": "majority",
    "o088_description_evaluation": "descr_eval_total",
    "o088_descriptions": "descr_eval",
    "o088_coverage": "coverage",
    "o090_trapped_errors": "trapped",
    "o091_moved_profile": "moved_profile",
    "o092_node_signals": "signals_out",
    "o093_correction_rules": "rule_stats",
    "o094_global_reassignment": "global_stats",
    "o095_quantile_thresholds": "margin_quantiles",
    "o096_confusion_pairs": "confusions",
    "o097_mean_std": "mean_std",
    "o098_paired_delta": "paired_delta",
    "o099_best_marks": "best_marks",
    "o100_run_groups": "run_groups",
    "o101_gate_outcome": "gate_outcome",
    "o102_runtime": "runtime",
    "o103_wilson": "wilson",
    "o104_move_log": "move_log",
    "o105_sign_agreement": "sign_agreement",
    "o106_binned": "binned",
    "o107_reliability_lookup": "reliability_lookup",
    "o108_attribution": "attribution",
    "o109_failures": "failures",
    "o110_judge_counts": "judge_counts",
    "o111_judge_by_pass": "judge_by_pass",
    "o112_majority_vote": "majority_vote",
    "o112_votes": "votes",
    "o112_pass_agreement": "pass_agreement",
}


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(plan(spark, "chain_edges", sf_dir))


def _component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, comms = _vector_graph(spark, sf_dir)
    return all_components(edges, comms).agg(F.countDistinct("component").alias("n_components"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(*_vector_graph(spark, sf_dir))


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.accuracy(plan(spark, "labelled", sf_dir))


def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.matching(plan(spark, "labelled", sf_dir))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.evidence(plan(spark, "evidence_order", sf_dir), plan(spark, "emb", sf_dir), plan(spark, "texts", sf_dir))


def _vector_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return plan(spark, "vedges", sf_dir), plan(spark, "vcomms", sf_dir)


def _louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, comms = _vector_graph(spark, sf_dir)
    return moves.louvain(edges, comms)


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, comms = _vector_graph(spark, sf_dir)
    return moves.merge_to_k(edges, comms, 4)


def _louvain_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, comms = _vector_graph(spark, sf_dir)
    return moves.louvain_k(edges, comms, 10)


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, comms = _vector_graph(spark, sf_dir)
    return moves.local_move_bulk(edges, comms)


def _pipeline(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, comms = _vector_graph(spark, sf_dir)
        return moves.pipeline(plan(spark, "emb", sf_dir), edges, comms.select("node"), 10, method)

    return run


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = plan(spark, "shown", sf_dir).groupBy("comm").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("prompt"))
    answers, _ = describe.generated(prompts, None, describe.TopWords())
    return answers.select("comm", F.size("candidates").alias("n_candidates"), F.get("candidates", F.lit(0)).alias("first"))


#: Operators that iterate or hold state; name -> callable.
ITERATIVE = {
    "o030_components": _components,
    "o030_component_count": _component_count,
    "o030_fragmented": _fragments,
    "o062_louvain": _louvain,
    "o063_local_move_bulk": _bulk,
    "o064_merge_to_k": _merge,
    "o065_louvain_k": _louvain_k,
    "o066_near_pipeline": _pipeline("near"),
    "o067_semantic_pipeline": _pipeline("centroid"),
    "o068_three_factor_pipeline": _pipeline("three_factor"),
    "o070_evidence": _evidence,
    "o072_generation": _descriptions,
    "o082_accuracy": _accuracy,
    "o089_matching": _matching,
}

#: Oracles of those that SQL can express: chains are components of one nation, five classes have 120 matchings.
_MATCHED = "WITH c AS (SELECT user_id % 5 AS pred, event_type AS y, count(*) AS n FROM events GROUP BY 1, 2), y AS (SELECT DISTINCT event_type AS y FROM events), p AS (SELECT a.y a, b.y b, c.y c, d.y d, e.y e FROM y a, y b, y c, y d, y e WHERE len(list_distinct([a.y, b.y, c.y, d.y, e.y])) = 5), s AS (SELECT p.*, (SELECT sum(n) FROM c WHERE (pred = 0 AND y = p.a) OR (pred = 1 AND y = p.b) OR (pred = 2 AND y = p.c) OR (pred = 3 AND y = p.d) OR (pred = 4 AND y = p.e)) AS hit FROM p) "
_PLACED = "SELECT a, b, c, d, e FROM s ORDER BY hit DESC, a, b, c, d, e LIMIT 1"
_REACHED = f"WITH RECURSIVE e AS ({duckdb_sql('vedges')}), c AS ({duckdb_sql('vcomms')}), "
_INSIDE = _REACHED + "b AS (SELECT e.src AS u, e.dst AS v FROM e JOIN c s ON e.src = s.node JOIN c t ON e.dst = t.node WHERE s.comm = t.comm UNION SELECT e.dst, e.src FROM e JOIN c s ON e.src = s.node JOIN c t ON e.dst = t.node WHERE s.comm = t.comm), r AS (SELECT node, node AS at FROM c UNION SELECT r.node, b.v FROM r JOIN b ON r.at = b.u), p AS (SELECT c.node, c.comm, min(r.at) AS component FROM c JOIN r ON c.node = r.node GROUP BY c.node, c.comm), w AS (SELECT comm, component AS whole FROM (SELECT comm, component, row_number() OVER (PARTITION BY comm ORDER BY count(*) DESC, component) AS rk FROM p GROUP BY comm, component) WHERE rk = 1) "
ITERATIVE_SQL = {
    # edges to the next node join all of them
    "o030_component_count": _REACHED + "o AS (SELECT node FROM c WHERE node > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst = c.node)) SELECT 1 + (SELECT count(*) FROM o) AS n_components",
    "o030_fragmented": _INSIDE + "SELECT p.node, p.comm, p.component, p.component <> w.whole AS fragmented FROM p JOIN w ON p.comm = w.comm",
    "o089_matching": _MATCHED + f", w AS ({_PLACED}) SELECT c.pred, c.y, c.n FROM c CROSS JOIN w WHERE c.y = CASE c.pred WHEN 0 THEN w.a WHEN 1 THEN w.b WHEN 2 THEN w.c WHEN 3 THEN w.d ELSE w.e END",
    "o030_components": "SELECT c.c_custkey AS node, m.least AS component FROM customer c JOIN (SELECT c_nationkey, min(c_custkey) AS least, count(*) AS n FROM customer GROUP BY c_nationkey) m ON c.c_nationkey = m.c_nationkey WHERE m.n > 1",
    "o082_accuracy": _MATCHED + "SELECT round(CAST(max(hit) AS DOUBLE) / (SELECT count(*) FROM events), 9) AS acc FROM s",
}


def queries() -> dict:
    return ITERATIVE | roundtrips.QUERIES | {name: (lambda spark, sf_dir, r=r: plan(spark, r, sf_dir)) for name, r in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return ITERATIVE_SQL | roundtrips.SQL | {name: duckdb_sql(r) for name, r in PLANS.items()}
