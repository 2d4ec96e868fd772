"""Text side: normalisation, hashing encoder, evidence, prompts, candidate choice, refresh, judging, caches.

Base relations: ``texts`` (node, comm, y, text). Generated descriptions and judges are protocols (``describe``); what is
relational about them is here.
"""

from __future__ import annotations

from loomgraph.operators import objectives, vectors  # noqa: F401
from loomgraph.plans.engine import define

#: Two markers of raw texts; the first occurrence of each goes.
MARKERS = ("Title: ", "Abstract: ")


def _without_first(text: str, marker: str) -> str:
    at = f"instr({text}, '{marker}')"
    return f"(CASE WHEN {at} > 0 THEN concat(substr({text}, 1, {at} - 1), substr({text}, {at} + {len(marker)})) ELSE {text} END)"


define(
    {
        "texts": "SELECT doc_id AS node, source AS comm, lang AS y, coalesce(text, '') AS text FROM {documents}",
        "marked_texts": "SELECT node, concat('Title: ', text, ' Abstract: ', text, ' Title: x') AS text FROM {texts}",
        "normalised_texts": "SELECT node, " + _without_first(_without_first("text", MARKERS[0]), MARKERS[1]) + " AS text FROM {marked_texts}",
        "category_labels": "SELECT label, concat('cs.', upper(replace(label, 'arxiv cs ', ''))) AS name FROM (SELECT DISTINCT concat('arxiv cs ', substr(lower(event_type), 1, 2)) AS label FROM {events})",
        # hashing encoder: counts of word buckets, normalised
        "word_buckets": "SELECT node, pos, CAST(count(*) AS DOUBLE) AS c FROM (SELECT node, $bucket(word; 64) AS pos FROM $split({texts}; node; lower(text)) WHERE word <> '') GROUP BY node, pos",
        "hash_encoding": "SELECT w.node, w.pos, $r(w.c / n.norm) AS val FROM {word_buckets} w JOIN (SELECT node, sqrt(sum(c * c)) AS norm FROM {word_buckets} GROUP BY node) n ON w.node = n.node",
        # all positions of every node; one without words has zeros
        "dense_encoding": "SELECT t.node, p.pos, coalesce(h.val, 0e0) AS val FROM {texts} t CROSS JOIN (SELECT DISTINCT pos FROM {hash_encoding}) p LEFT JOIN {hash_encoding} h ON t.node = h.node AND p.pos = h.pos",
        # raw files as their lines would be read: a text table with bad rows, and neighbour lists
        "raw_titles": "SELECT CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR(20)) END AS pid, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS title, props AS abstract FROM {events}",
        "id_map": "SELECT doc_id AS idx, doc_id * 3 AS pid FROM {documents}",
        "joined_titles": "SELECT m.idx AS node, coalesce(t.title || ' ' || t.abstract, '') AS text FROM {id_map} m LEFT JOIN (SELECT $bigint(pid) AS pid, title, abstract FROM {raw_titles} WHERE $bigint(pid) IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL) t ON m.pid = t.pid",
        "neighbour_lists": "SELECT c_custkey AS node, concat('[', CAST(c_custkey + 1 AS VARCHAR(20)), ', ', CAST(c_custkey + 5 AS VARCHAR(20)), ', ', CAST(c_custkey AS VARCHAR(20)), ']') AS neighbours, c_mktsegment AS category, c_nationkey AS label FROM {customer}",
        "listed_edges": "SELECT DISTINCT least(e.node, e.item) AS src, greatest(e.node, e.item) AS dst FROM $intlist({neighbour_lists}; node; neighbours) e JOIN {neighbour_lists} t ON e.item = t.node WHERE e.node <> e.item",
        # dense ids in order of node, ranked by blocks of ids so that no task sees all
        "listed_nodes": "SELECT node, CAST(floor(node / 1000) AS BIGINT) AS g FROM (SELECT src AS node FROM {listed_edges} UNION SELECT dst AS node FROM {listed_edges})",
        "listed_before": "SELECT g, CAST(coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT g, count(*) AS n FROM {listed_nodes} GROUP BY g)",
        "listed_ids": "SELECT n.node, b.before + CAST(row_number() OVER (PARTITION BY n.g ORDER BY n.node) - 1 AS BIGINT) AS id FROM {listed_nodes} n JOIN {listed_before} b ON n.g = b.g",
        "listed_graph": "SELECT s.id AS src, t.id AS dst FROM {listed_edges} e JOIN {listed_ids} s ON e.src = s.node JOIN {listed_ids} t ON e.dst = t.node",
        "listed_names": "SELECT label, category AS name FROM (SELECT label, category, row_number() OVER (PARTITION BY label ORDER BY node) AS rk FROM {neighbour_lists}) WHERE rk = 1",
        # answers as a generator may give them: JSON between other text, a bullet beside one that is too short, plain text
        "raw_answers": "SELECT event_id AS item, CASE event_id % 3 WHEN 0 THEN concat('Here: ', chr(123), replace(concat('~candidates~: [~', event_type, ' 0~, ~', event_type, ' 1~]'), '~', chr(34)), chr(125), ' done') WHEN 1 THEN concat('- three words ', event_type, chr(10), '- ', event_type) ELSE concat('just ', event_type) END AS raw FROM {events}",
        "pred_files": "SELECT DISTINCT concat(event_type, '_semantic_l0.5_s', CAST(event_id % 5 AS VARCHAR(2)), '_audit.npy') AS file FROM {events}",
        "pred_parts": "SELECT file, regexp_extract(file, '^([a-z_]+?)_([a-z]+)_l([0-9.]+)_s([0-9]+)_([a-z]+)[.]npy', 1) AS dataset, regexp_extract(file, '_l([0-9.]+)_s', 1) AS lam, regexp_extract(file, '_s([0-9]+)_', 1) AS seed, regexp_extract(file, '_([a-z]+)[.]npy', 1) AS tag FROM {pred_files}",
        "done_runs": "SELECT dataset, method, seed FROM {runs} WHERE seed < 2 GROUP BY dataset, method, seed",
        "open_runs": "SELECT DISTINCT r.dataset, r.method, r.seed FROM {runs} r LEFT JOIN {done_runs} d ON r.dataset = d.dataset AND r.method = d.method AND r.seed = d.seed WHERE d.dataset IS NULL",
        "evidence_pool": "SELECT c.node, c.comm, coalesce(k.k, 0) AS inner, row_number() OVER (PARTITION BY c.comm ORDER BY coalesce(k.k, 0) DESC, c.node) AS rk FROM {vcomms} c LEFT JOIN {v_nbr_comm} k ON c.node = k.u AND c.comm = k.comm",
        "evidence_order": "SELECT p.comm, p.node, CAST(row_number() OVER (PARTITION BY p.comm ORDER BY round($dot(e.x; m.x), 12) DESC, p.node) AS BIGINT) AS place FROM {evidence_pool} p JOIN {emb} e ON p.node = e.node JOIN {centroid} m ON p.comm = m.comm WHERE p.rk <= 40",
        "shown": "SELECT node, comm, text, place FROM (SELECT node, comm, replace(substr(text, 1, 500), chr(10), ' ') AS text, row_number() OVER (PARTITION BY comm ORDER BY node) AS place FROM {texts} WHERE text <> '') WHERE place <= 10",
        # documents, community size and domain: all that the request consists of
        "prompt_texts": "SELECT s.comm, z.size, count(*) AS documents, concat('Domain: ', @domain, chr(10), CAST(count(*) AS VARCHAR(20)), ' of ', CAST(z.size AS VARCHAR(20)), ' documents', chr(10), chr(10), $joined(line; place; concat(chr(10), chr(10))), chr(10), chr(10), 'Give three noun phrases of at most 20 words each for the topic these documents share, as JSON with the key candidates.') AS prompt FROM (SELECT comm, place, concat('[', CAST(place AS VARCHAR(3)), '] ', text) AS line FROM {shown}) s JOIN (SELECT comm, count(*) AS size FROM {texts} GROUP BY comm) z ON s.comm = z.comm GROUP BY s.comm, z.size",
        "prompts": "SELECT comm, md5(prompt) AS prompt, documents, size FROM {prompt_texts}",
        "prompt_keys": "SELECT comm, sha1(concat('v1', 'offline', 'describe', prompt)) AS k FROM {prompt_texts}",
        # the cache holds what was asked before: here the prompts of half of the communities, and those of another size
        "prompt_cache": "SELECT DISTINCT sha1(concat('v1', 'offline', 'describe', CASE WHEN comm < 'src5' THEN prompt ELSE replace(prompt, concat(' of ', CAST(size AS VARCHAR(20))), ' of 1') END)) AS k FROM {prompt_texts}",
        "cache_hits": "SELECT p.comm, p.k FROM {prompt_keys} p JOIN {prompt_cache} c ON p.k = c.k",
        "cache_misses": "SELECT p.comm, p.k FROM {prompt_keys} p LEFT JOIN {prompt_cache} c ON p.k = c.k WHERE c.k IS NULL",
        "judge_cache": "SELECT item, pass, answer FROM (SELECT item, pass, answer, row_number() OVER (PARTITION BY item, pass ORDER BY attempts, coalesce(answer, '')) AS rk FROM {judged} WHERE valid AND attempts <= 3) WHERE rk = 1",
        # candidates of a community: its description and its centroid; at most 512 others are sampled by hash
        "choices": "SELECT comm, 0 AS idx, x FROM {descr} UNION ALL SELECT comm, 1 AS idx, x FROM {centroid_unit}",
        # for each community 512 nodes by hash of all, without its own members
        "sampled": "SELECT node, comm FROM (SELECT c.node, c.comm, row_number() OVER (PARTITION BY c.comm ORDER BY md5(CAST(c.node AS VARCHAR(20))), c.node) AS rk FROM {vcomms} c) WHERE rk <= 512",
        "others": "SELECT comm, node FROM (SELECT d.comm, c.node, row_number() OVER (PARTITION BY d.comm ORDER BY md5(concat(CAST(d.comm AS VARCHAR(20)), ':', CAST(c.node AS VARCHAR(20)))), c.node) AS rk FROM {descr} d JOIN {sampled} c ON d.comm <> c.comm) WHERE rk <= 512",
        "choice_scores": "SELECT z.comm, z.idx, $r(i.s - o.s) AS score FROM {choices} z JOIN (SELECT z.comm, z.idx, avg((1e0 + $dot(e.x; z.x)) / 2e0) AS s FROM {choices} z JOIN {vcomms} c ON z.comm = c.comm JOIN {emb} e ON c.node = e.node GROUP BY z.comm, z.idx) i ON z.comm = i.comm AND z.idx = i.idx JOIN (SELECT z.comm, z.idx, avg((1e0 + $dot(e.x; z.x)) / 2e0) AS s FROM {choices} z JOIN {others} c ON z.comm = c.comm JOIN {emb} e ON c.node = e.node GROUP BY z.comm, z.idx) o ON z.comm = o.comm AND z.idx = o.idx",
        "chosen": "SELECT comm, idx, score FROM (SELECT comm, idx, score, row_number() OVER (PARTITION BY comm ORDER BY score DESC, idx) AS rk FROM {choice_scores}) WHERE rk = 1",
        # a description stays while Jaccard(old members, new members) >= 0.9
        "refresh": "SELECT comm, shared, total, shared < 9e-1 * total AS regenerate FROM (SELECT coalesce(a.comm, b.comm) AS comm, sum(CASE WHEN a.comm IS NOT NULL AND b.comm IS NOT NULL THEN 1e0 ELSE 0e0 END) AS shared, CAST(count(*) AS DOUBLE) AS total FROM {vcomms} a FULL OUTER JOIN {local_round} b ON a.node = b.node AND a.comm = b.comm GROUP BY coalesce(a.comm, b.comm))",
        "fit_mask": "SELECT c.node, CASE WHEN f.node IS NULL THEN FALSE ELSE TRUE END AS fitted FROM {vcomms} c LEFT JOIN {fit} f ON c.node = f.node",
        # the offline judge answers with the class whose prototype is nearest to the description
        "class_long": "SELECT k.y, l.pos, avg(l.val) AS val FROM {vclasses} k JOIN $long({emb}; node) l ON k.node = l.node GROUP BY k.y, l.pos",
        "class_proto": "SELECT y, $arr(val; pos) AS x FROM {class_long} GROUP BY y",
        "judge_answers": "SELECT comm, CASE WHEN y BETWEEN 0 AND 6 THEN y END AS answer FROM (SELECT d.comm, p.y, row_number() OVER (PARTITION BY d.comm ORDER BY round($dot(d.x; p.x), 12) DESC, p.y) AS rk FROM {descr} d CROSS JOIN {class_proto} p) WHERE rk = 1",
    }
)
