"""Sharding, token output, mixing, near-duplicates, suffixes and language model against brute force; odd cases."""

import collections
import hashlib
import math
import random
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import lm, mixing, neardup, sharding, suffixes, tokens

ODD = [(None, None), (None, "no id"), (900, ""), (901, " \t\n"), (902, "x"), (903, "X"), (904, "rep rep rep rep"), (904, "rep rep rep rep"), (905, "w" * 30_000), (906, "日本 a²b <|endoftext|> \x1c é"), (907, "tie tie"), (908, "tie tie")]


def corpus(seed=1, n=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 120))]
        if out and r.random() < 0.4:
            words = (r.choice(out)[1] or "x").split()
            for _ in range(r.randrange(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i, " ".join(words)))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for i in range(3, n, 17):
        out[i] = (i, out[i][1] + "\n" + passage)
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus() + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, f"s{(r[0] or 0) % 7 % 4}", 1) for r in rows], "doc_id long, text string, source string, row int").withColumn("source", F.when(F.col("doc_id") != 900, F.col("source")))


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 40, 1000, 4097):
        at = [sharding.permute_int(i, n) for i in range(n)]
        assert sorted(at) == list(range(n)) and all(sharding.unpermute_int(p, n) == i for i, p in enumerate(at))
    assert sharding.unpermute_int(sharding.permute_int(123_456_789_012, 10**12), 10**12) == 123_456_789_012


def test_shards(docs, rows):
    got = sharding.shard(docs, 8).collect()
    n = len(rows)
    assert len(got) == n and sorted(r.row for r in got) == list(range(n)) and all(r.position == sharding.permute_int(r.row, n) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.shard, r.slot)
    assert sorted(got, key=key) == sorted(sharding.shard(docs.repartition(3), 8).collect(), key=key)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_tokens_round_trip(spark, docs, rows):
    path = tokens.write_tokens(docs)
    got = tokens.read_tokens(spark, path, with_ids=True).collect()
    library = tokens.encoder(tokens.vocabulary_path()).tokenizer
    want = collections.Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids) + (tokens.END_ID,)) for d, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    assert tokens.read_document(spark, path, 5) == list(next(r.ids for r in got if r.doc_id == 5))
    with pytest.raises(KeyError):
        tokens.read_document(spark, path, 12345)
    assert tokens.read_tokens(spark, tokens.write_tokens(docs.limit(0))).count() == 0


def fill(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(cap * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def test_mixing(docs):
    got = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = fill({s: sizes[s] for s in {r.source for r in docs.collect()}})
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(64, 0.03 * want[s]) for s in want), (taken, want)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.plan(docs.repartition(5)).collect())
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns and mixing.plan(docs.limit(0)).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    table = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 5), (None, 100)], "source string, source_size long")
    want = fill({"a": 1000, "b": 10, "c": 5, None: 100})
    assert {r.source: round(r.target, 6) for r in mixing.targets(table).collect()} == {k: round(v, 6) for k, v in want.items()}
    assert all(abs(r.rate * r.source_size - r.target) < 1e-6 for r in mixing.tilt(mixing.targets(table)).collect())


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if 0 < len(words) < k else set(zip(*(words[j:] for j in range(k)), strict=False))


def brute_components(rows, k):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, shingle_set(t, k))
    ids, root = list(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, rows, k):
    want, sizes = brute_components(rows, k)
    got = neardup.near_duplicates(docs, k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], r.doc_id == want[r.doc_id])
    kept = [r.doc_id for r in neardup.one_of_each(docs, k).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(d for d in want if want[d] == d) and kept.count(None) == 2
    assert neardup.near_duplicates(docs.limit(0), k).count() == 0


def test_texts_of_one_doc_id_are_one_document(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near + " end"), (1, "some other text of the same id"), (5, near + " tail"), (7, "some other text of the same id")]
    of = lambda rows: {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 2).collect()}
    got = of(rows)
    assert got == of(rows[::-1]) and got[(1, 60)] == got[(1, 6)] == 1 and sorted((got[(5, 60)], got[(7, 6)])) in ([1, 5], [1, 7])


def test_stages_keep_columns_of_any_name(spark):
    from loomgraph.llm import decontam, quality

    names = ["__m", "__w", "__l", "__h", "__kept", "__fails", "__fence", "__id", "__row", "row", "kept_id", "bad_id", "__copies", "copies", "copy", "copied_id", "__tie", "tie", "size", "v", "t", "component_id", "kept"]
    text = "The run of the town was over and in the end it is on for all who are with us from that day. And so it goes by the river."
    d = spark.createDataFrame([(1, text, "s", *range(len(names)))], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    items = spark.createDataFrame([(1, "what is the capital of this country")], "item_id long, text string")
    for out in (quality.keep_good(d), neardup.one_of_each(d), decontam.clean(d, items), mixing.mixed(d)):
        assert out.columns == d.columns and out.collect() == d.collect()


def test_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if r.random() > 0.02 else f"x{r.randrange(999)}" for w in base)) for i in range(400)] + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(30)]
    want, _ = brute_components(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def test_links_inside_a_crowd_of_form_letters(spark):
    r = random.Random(8)
    fill_in = lambda: f"s{r.randrange(40)}"
    letters = [[fill_in() for _ in range(19)] for _ in range(500)]
    for i in range(50):  # one of the letters with ten slots filled anew: about 0.82, the crowd is at 0.68
        anew = list(letters[i])
        for j in r.sample(range(19), 10):
            anew[j] = fill_in()
        letters.append(anew)
    r.shuffle(letters)
    rows = [(i, " ".join(w for j in range(200) for w in ((f"t{j}",) if j % 10 or not j else (x[j // 10 - 1],)))) for i, x in enumerate(letters)]
    want, _ = brute_components(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert sum(want[d] != d for d in want) >= 40 and {x.doc_id: x.component_id for x in got.collect()} == want


def test_crowd_counts_all_texts_in_few_rows(spark):
    """All shingles of all texts are counted, whatever the partitions, and a task sends the same few rows for many texts."""
    r = random.Random(3)
    texts = [(" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(0, 60))),) for _ in range(700)] + [(None,)]
    sets = [neardup.shingle_hashes(t, 2) for (t,) in texts]
    want = np.bincount(np.concatenate(sets) >> np.uint64(44), minlength=1 << 20)
    for width in (1, 7):
        assert (neardup.shingle_counters(spark.createDataFrame(texts, "text string").repartition(width), 2) == want).all()
    assert (neardup.shingle_counters(spark.createDataFrame([], "text string"), 2) == 0).all()
    for times in (1, 3):
        batches = [pa.record_batch([pa.array([t for (t,) in texts])], ["text"])] * times
        assert sum(b.num_rows for b in neardup._counted(iter(batches), 2)) == neardup.COUNTER_PARTS
    h = max(sets, key=len)
    assert sorted(neardup._rare_first(h, want)) == sorted(h) and (np.diff(want[neardup._rare_first(h, want) >> np.uint64(44)]) >= 0).all()


def brute_removed(rows, k=50):
    first = {}
    for d, raw in sorted((d, t.encode()) for d, t in rows if d is not None and t):
        for i in range(len(raw) - k + 1):
            first.setdefault(raw[i : i + k], d)
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - k + 1):
            if d is not None and first[raw[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        runs = sum(1 for i, c in enumerate(gone) if c and (i == 0 or not gone[i - 1]))
        out[(d, t)] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffixes(docs, rows):
    more = rows + [(950, "q" * 400), (951, "q" * 49), (952, "ab" * 60 + "q" * 55), (953, "é" * 80), (954, "é" * 26 + "tail")]
    d = docs.sparkSession.createDataFrame(more, "doc_id long, text string")
    want = brute_removed(more)
    got = suffixes.deduplicated(d).collect()
    assert len(got) == len(more)
    have = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert have == collections.Counter((d, *want[(d, t)]) for d, t in more)
    assert sum(v[1] for v in want.values()) > 5000 and suffixes.deduplicated(d.limit(0)).count() == 0


def test_suffixes_free_their_shuffles_and_move_bytes_late(docs, monkeypatch):
    sc = docs.sparkSession.sparkContext
    shuffles = lambda: {x for x in sc._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n") if x.startswith("shuffle_")}
    before, left, split = shuffles(), [], []
    cut, reranked = suffixes.cut, suffixes._reranked

    def watched(df, label, **more):
        out = cut(df, label, **more)
        for _ in range(50):  # files go in the background
            if shuffles() - before:
                time.sleep(0.1)
        left.append(shuffles() - before)
        return out

    monkeypatch.setattr(suffixes, "cut", watched)
    monkeypatch.setattr(suffixes, "_reranked", lambda rows, extra: split.append(rows.columns) or reranked(rows, extra))
    suffixes.repeats(docs)
    # the two steps that move most; in small ones Spark may replace a join whose files then go with the driver's garbage
    assert len(left) > 2 and not any(left[:2])
    assert "data" not in split[1] and "data" in split[2]


def test_workers_give_back_memory():
    from loomgraph.llm.common import giving_back

    held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024
    pins = []

    def run(batches):
        for n in batches:
            some = [bytes(65_536) for _ in range(n)]
            for x in some:
                memoryview(x)
            pins.append(bytes(65_536))  # keeps the end of the heap from shrinking
            yield len(some)

    before = held()
    kept = list(run([3000]))
    grown = held() - before
    assert kept == list(giving_back(run)([3000])) and held() - before < max(40, grown / 2)


def test_anchor_runs_cover_every_window_once():
    r = np.random.default_rng(2)
    raws = [r.integers(97, 100, n).astype(np.uint8).tobytes() for n in (10, 50, 51, 300, 49, 1000)]
    ends = np.cumsum([len(x) for x in raws])
    starts = ends - [len(x) for x in raws]
    lo, hi, anchor, _, _ = suffixes.anchor_runs(np.frombuffer(b"".join(raws), np.uint8), starts, ends)
    windows = [p for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)]
    assert windows == [p for s, e in zip(starts, ends, strict=True) for p in range(s, e - 49)]
    assert all(b - a <= 34 and 0 <= c - b and c - a <= 34 for a, b, c in zip(lo, hi, anchor, strict=True))


def test_lm_base_scores_and_rows(docs, rows):
    count = collections.Counter()
    for d, t in rows:
        if lm.is_training(d):
            count.update((t or "").encode().lower().split())
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    got = lm.scores(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(d, not lm.is_training(d), len(w), sum(count[x] > 0 for x in w), n, round(base, 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.scores(docs.limit(0)).count() == 0


def test_lm_rare_words_are_joined(docs, monkeypatch):
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    full = {r.row: r for r in lm.base_scores(numbered)[0].collect()}
    monkeypatch.setattr(lm.head_of, "__defaults__", (20,))
    few = {r.row: r for r in lm.base_scores(numbered)[0].collect()}
    assert all(full[k].n_known == few[k].n_known and abs(full[k].base_score - few[k].base_score) < 1e-9 for k in full)


def table(n=500, seed=3):
    import pandas as pd

    r = np.random.default_rng(seed)
    seen = [(int(a), int(b)) for a, b in r.integers(0, n, (4000, 2)) ** 2 // n]
    count = collections.Counter(seen)
    pairs = pd.DataFrame([(a, b, c) for (a, b), c in sorted(count.items())], columns=["prev", "id", "c"])
    counts = np.bincount(pairs["id"], pairs["c"], n).astype(np.int64)
    cls, _ = lm.classes_of(counts, np.arange(n) % 2)
    by_class = pairs.assign(cls=cls[pairs["id"]]).groupby(["prev", "cls"], as_index=False)["c"].sum()
    return lm.Table(counts, np.arange(n) % 2, by_class, pairs[pairs["c"] > 1].sort_values("c"))


def test_lm_table_is_a_distribution():
    t, ids = table(), np.arange(500)
    for before in (0, 1, 7, 250, 499, 500):
        inside = np.exp(t.log_inside(np.full(500, before), ids))
        classes = np.exp(t.prior[before].astype(float))
        assert abs(classes.sum() - 1) < 1e-5 and np.allclose(np.bincount(t.cls, inside), 1, atol=1e-4)
        assert abs((inside * classes[t.cls]).sum() - 1) < 1e-4


def test_lm_holds_every_pair_it_is_given():
    r, n = np.random.default_rng(6), 2000
    keys = np.unique(r.integers(0, n * n, 200_000))
    c = r.integers(1, 9, len(keys))
    cls, _ = lm.classes_of(np.bincount(keys % n, c, n).astype(np.int64), np.arange(n) % 2)
    total = np.zeros((n + 1, lm.CLASSES))
    np.add.at(total, (keys // n, cls[keys % n]), c)
    prev, k = np.nonzero(total)
    t = lm.Table(np.bincount(keys % n, c, n).astype(np.int64), np.arange(n) % 2, {"prev": prev, "cls": k, "c": total[prev, k]}, {"prev": keys // n, "id": keys % n, "c": c})
    assert np.allclose(t.shares(keys), (c - lm.DISCOUNT) / total[keys // n, cls[keys % n]], rtol=1e-5)
    assert not t.shares(np.setdiff1d(np.arange(n * n), keys)).any()


def test_lm_rare_pairs_are_joined(docs, monkeypatch):
    numbered = docs.withColumn("row", F.monotonically_increasing_id()).cache()
    full = {r.row: r.score for r in lm.model_scores(numbered).collect()}
    tables, table_of = [], lm.table_of
    for most in (50, 0):
        monkeypatch.setattr(lm, "table_of", lambda pairs, starts, most=most: tables.append(table_of(pairs, starts, most)) or tables[-1])
        few = {r.row: r.score for r in lm.model_scores(numbered).collect()}
        assert few.keys() == full.keys() and all(abs(full[k] - few[k]) < 1e-4 * abs(full[k]) for k in full)
    assert [(t.key >= 0).sum() <= most and rare.count() > 1000 for (t, rare), most in zip(tables, (50, 0), strict=True)] == [True, True]


def test_lm_counts_all_pairs(docs):
    path = tokens.vocabulary_path()
    ids = lm.encoded(docs.withColumn("row", F.monotonically_increasing_id()), path).cache()
    dtype, n = lm._encoder(path).dtype, lm._encoder(path).n_ids
    want = collections.Counter()
    for r in ids.filter("train").collect():
        a = np.frombuffer(lm.zstandard.ZstdDecompressor().decompress(bytes(r.ids)), dtype).tolist()
        want.update(zip([n, *a[:-1]], a, strict=True))
    assert {(r.prev, r.id): r.c for r in lm.pair_counts(ids, n, dtype).collect()} == want


def test_lm_every_id_is_a_target_once():
    r = np.random.default_rng(2)
    docs = [r.integers(0, 500, n) for n in (1, 3, lm.CONTEXT, lm.WINDOW, lm.WINDOW + 1, 97, 5000)]
    got = collections.Counter()
    for before, now, valid in lm._batches(docs, 500):
        assert len(now) <= lm.BATCH
        got.update(zip(before[valid].tolist(), now[valid].tolist(), strict=True))
    assert got == collections.Counter((int(a), int(b)) for d in docs for a, b in zip([500, *d[:-1]], d, strict=True))


def test_lm_scores_do_not_depend_on_partitions(spark, docs, rows):
    d = spark.createDataFrame([x for x in rows if x[0] is not None], "doc_id long, text string")
    one, other = ({(r.doc_id, r.n_tokens): r.score for r in lm.scores(x).collect()} for x in (d.coalesce(1), d.orderBy(F.rand(3)).repartition(5)))
    assert one == other


def test_lm_gradients():
    r = np.random.default_rng(1)
    p = {k: x.astype(np.float64) for k, x in lm.initial().items()}
    c, b, t, ok = r.integers(0, lm.CLASSES + 1, (3, lm.WINDOW)), r.integers(0, lm.BUCKETS, (3, lm.WINDOW)), r.integers(0, lm.CLASSES, (3, lm.WINDOW)), r.random((3, lm.WINDOW)) < 0.8
    prior = r.normal(size=(3, lm.WINDOW, lm.CLASSES))
    _, g = lm.gradients(p, c, b, prior, t, ok)
    for k, at in (("qkv", (3, 5)), ("qkv", (3, 20)), ("qkv", (3, 40)), ("out", (2, 2)), ("logit", (1, 4)), ("class", (c[0, 3], 1)), ("bucket", (b[0, 3], 1)), ("place", (2, 3))):
        x = p[k][at]
        p[k][at] = x + 1e-4
        up, _ = lm.gradients(p, c, b, prior, t, ok)
        p[k][at] = x - 1e-4
        down, _ = lm.gradients(p, c, b, prior, t, ok)
        p[k][at] = x
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-6


def test_lm_scores_each_id_once_and_causally():
    p, t, ids = lm.initial(), table(), np.random.default_rng(3).integers(0, 500, 97)
    for n in (1, 3, lm.CONTEXT, lm.WINDOW, lm.WINDOW + 1, lm.STRIDE + lm.CONTEXT, 97):
        want, seen, before = 0.0, np.zeros(n, int), np.r_[500, ids[: n - 1]]
        c, b = np.where(before < 500, t.cls[np.minimum(before, 499)], lm.CLASSES), np.where(before < 500, before % lm.BUCKETS, 0)
        for s in lm._windows(n):
            at = np.arange(s, min(n, s + lm.WINDOW))
            x = p["class"][c[at]] + p["bucket"][b[at]] + p["place"][: len(at)]
            for j, i in enumerate(at):
                if s == 0 or j >= lm.CONTEXT:
                    q, k, v = np.split(x[: j + 1] @ p["qkv"], 3, axis=1)
                    w = np.exp(k @ q[j] / math.sqrt(lm.DIM))
                    z = (x[j] + (w @ v / w.sum()) @ p["out"]) @ p["logit"] + t.prior[before[i]]
                    seen[i] += 1
                    want += z[t.cls[ids[i]]] - np.log(np.exp(z).sum()) + t.log_inside(before[i : i + 1], ids[i : i + 1])[0]
        assert (seen == 1).all() and abs(lm.log_probabilities([ids[:n]], p, t)[0] - want) < 1e-3


def test_lm_steps_reuse_their_arrays():
    import tracemalloc

    r, t, p, room = np.random.default_rng(1), table(), lm.initial(), lm.Room()
    (before, now, valid), *_ = lm._batches([r.integers(0, 500, 5000)], 500)
    step = lambda: lm.gradients(p, np.r_[t.cls, lm.CLASSES][before], before % lm.BUCKETS, t.prior[before], t.cls[now], valid, room)
    first = step()
    tracemalloc.start()
    again = step()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first[0] == again[0] and all((first[1][k] == again[1][k]).all() for k in p)
    # one array of attention has 0.4 MB, and a step goes through some fifteen of this size
    assert len(now) == lm.BATCH and peak < 3 << 20


def test_lm_context_has_no_queries():
    r, p = np.random.default_rng(4), lm.initial()
    x = r.normal(size=(5, lm.WINDOW, lm.DIM)).astype(np.float32)
    some, whole = lm.forward(p, x, lm.CONTEXT, lm.Room()), lm.forward(p, x, 0, lm.Room())
    assert some[3].shape[1] == lm.STRIDE and np.allclose(some[-1], whole[-1][:, lm.CONTEXT :], atol=1e-5)


def test_lm_words_are_encoded_once(monkeypatch):
    import tracemalloc

    w, r = lm.Words(tokens.vocabulary_path()), np.random.default_rng(7)
    words = [bytes(x) for x in r.integers(97, 123, (20_000, 6)).astype(np.uint8)] + ["\u00a0a".encode(), b"\x1cx\x1c", b"\xff\xfe", "\u4e2d\u2003b".encode(), b"<|endoftext|>", b"it's"]
    texts = [b"", b" \n", b"\t".join(words[-6:]), *(b" ".join(words[i : i + 500]) for i in range(0, len(words), 500)), b" ".join(words[::7])]
    want = [np.array([i for x in t.split() for i in w.tokenizer.encode(" " + x.decode("utf-8", "replace"), add_special_tokens=False).ids] + [w.end_id], w.dtype).tobytes() for t in texts]
    lm.words_of([b" ".join(words * 2)])  # its own tables
    tracemalloc.start()
    got = w(texts)
    kept = tracemalloc.get_traced_memory()[0] - sum(map(len, got))
    tracemalloc.stop()
    assert all(a == b for a, b in zip(got, want, strict=True)) and kept < 90 * len(words), kept
    with monkeypatch.context() as m:
        m.setattr(w, "_learn", None)  # nothing is left to learn
        assert all(a == b for a, b in zip(w(texts), want, strict=True))
    monkeypatch.setattr(lm, "CACHE_WORDS", 700)
    w.forget()
    assert all(w([t]) == [x] for t, x in zip(texts, want, strict=True)) and all(a == b for a, b in zip(w(texts), want, strict=True))


def test_lm_training_beats_the_counts():
    r = np.random.default_rng(5)

    def text(n):  # what follows depends on the id three places before
        out = list(r.integers(0, 500, 3))
        for _ in range(n):
            out.append((out[-3] * 7 + 1) % 500 if r.random() < 0.8 else int(r.integers(0, 500)))
        return np.array(out)

    t, p = table(), lm.initial()
    test = [text(300) for _ in range(20)]
    q, _ = lm.train_locally(p, [text(300) for _ in range(600)], t)
    assert lm.log_probabilities(test, q, t).sum() > 0.97 * lm.log_probabilities(test, p, t).sum()


def test_encoder_holds_its_model_once(rows):
    """A second model over lines, and what reading it took, were 36 MB of every worker."""
    code = """
from loomgraph.llm import tokens
from tokenizers import Tokenizer
from loomgraph.llm.common import give_back
held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024
path, before = tokens.vocabulary_path(), held()
one = Tokenizer.from_file(path)
give_back()
first = held() - before
enc = tokens.Encoder(path)
print(first, held() - before - first)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert float(out[1]) < 1.5 * float(out[0])
    enc = tokens.Encoder(tokens.vocabulary_path())
    texts = [t or "" for _, t in rows]
    assert enc(texts) == [enc._whole(t) + enc.end for t in texts]


def test_encoder_equals_the_library_on_odd_texts():
    r = np.random.default_rng(11)
    enc, parts = tokens.Encoder(tokens.vocabulary_path()), [*"aZé's09_-.,!  \t\n\r\u00a0µª×÷ñłɏ\xad¿", "'s", "'re", "'ll", "'S", " '", "  ", "abcdefghijklmnop", "é" * 9, "\0", "<|", "\x1f", "中"]
    texts = ["", " ", "\n", "'", "'s's", "a  \u00a0", "\u00a0a", *("".join(parts[i] for i in r.integers(0, len(parts) - 4 * int(k % 5 > 0), k % 40)) for k in range(3000))]
    want = [enc._whole(t) + enc.end for t in texts]
    assert sum(map(tokens.is_plain, texts)) > 2000 and enc(texts) == want
    enc.most = 40
    enc.forget()
    assert [x for i in range(0, len(texts), 9) for x in enc(texts[i : i + 9])] == want


def test_encoder_keeps_pieces_that_recur(monkeypatch):
    enc, learned, merged = tokens.Encoder(tokens.vocabulary_path(), 100), [], tokens.Encoder._merged
    monkeypatch.setattr(enc, "_merged", lambda b, start, size: learned.append(len(start)) or merged(enc, b, start, size))
    often = " ".join(f"w{'abcdefghij'[i]}" for i in range(10))
    for i in range(40):
        enc([often + "".join(f" {'abcdefghijklmnop'[k]}{'abcdefghijklmnop'[i % 16]}{'xyz'[i // 16]}" for k in range(16))])
    assert learned[0] == 26 and sum(learned) == 10 + 40 * 16


def test_encoder_looks_up_known_pieces_cheaply():
    """The regular expression, a set and a look-up of each piece took 1.9 times what the regular expression takes, and a piece 124 bytes."""
    import tracemalloc

    words = ["".join(x) for x in np.random.default_rng(12).choice(list("abcdefghijklmnopqrstuvwxyz"), (30_000, 7))]
    texts, enc = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)] * 4, tokens.Encoder(tokens.vocabulary_path())
    tracemalloc.start()
    want = enc(texts)
    kept = tracemalloc.get_traced_memory()[0] - sum(map(len, want))
    tracemalloc.stop()

    def seconds(run):
        began = time.thread_time()
        run()
        return time.thread_time() - began

    assert kept < 100 * len(words), kept
    assert min(seconds(lambda: enc(texts)) for _ in range(5)) < 1.2 * min(seconds(lambda: [tokens._PIECE.findall(t) for t in texts]) for _ in range(5))


def test_lm_encodes_plain_texts_by_pieces():
    path, r = tokens.vocabulary_path(), np.random.default_rng(13)
    words = ["".join(x) for x in r.choice(list("abcdefghijklmnopqrstuvwxyzé"), (12_000, 7))]
    texts = [" ".join(w + ".,;!?"[i % 5] for w in words[i : i + 200]).encode() for i in range(0, len(words), 50)]
    odd = [b"", b" \n", "a b     c".encode(), b"it's  's\t'", b"a\0b", b"\x1c x", b"<|endoftext|> y", "中 b".encode(), b"\xff", "µ² ½x".encode()]
    lm._encoder(path).forget()
    by_words = lm.Words(path)
    assert lm._encoder(path)(odd + texts) == by_words(odd + texts)

    def seconds(encode):
        encode.forget()
        began = time.thread_time()
        encode(texts)
        return time.thread_time() - began

    assert min(seconds(lm._encoder(path)) for _ in range(3)) < 0.7 * min(seconds(by_words) for _ in range(3))


def test_lm_first_windows_go_with_the_others(monkeypatch):
    """The contexts of documents' first windows went through all operations of a step a second time."""
    calls, forward, r = [], lm.forward, np.random.default_rng(14)
    monkeypatch.setattr(lm, "forward", lambda *x: calls.append(len(x[1])) or forward(*x))
    docs = [r.integers(0, 500, 100) for _ in range(20)]
    lm.train_locally(lm.initial(), docs, table())
    lm.log_probabilities(docs, lm.initial(), table())
    assert calls == [80 + 20] * 2


def test_lm_hashes_words_alike_wherever_they_stand():
    r = np.random.default_rng(15)
    words = [bytes(x) for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 200) for x in r.integers(97, 99, (40, n)).astype(np.uint8)] + [b"a\0", b"a\0\0", b"\0"]
    one, other = lm.words_of([b" ".join(words)]), lm.words_of([b"", b"\n", *words[::-1], b" "])
    assert (one[0] == other[0][::-1]).all() and other[3].tolist() == list(range(2, len(words) + 2))
    assert len(set(one[0].tolist())) == len(set(words)) and [one[4][i:j] for i, j in zip(one[1], one[2], strict=True)] == words


def test_lm_gradients_of_windows_that_go_on(monkeypatch):
    """Contexts are the last places of the window before; those of a first window in a batch have none."""
    monkeypatch.setattr(lm, "BATCH", 4)
    r, t, p = np.random.default_rng(15), table(), {k: x.astype(np.float64) for k, x in lm.initial().items()}
    docs = [r.integers(0, 500, n) for n in (170, 1, 60, 9)]
    for before, now, valid in lm._batches(docs, 500):
        step = lambda: lm.gradients(p, np.r_[t.cls, lm.CLASSES][before], before % lm.BUCKETS, t.prior[before], t.cls[now], valid)
        _, g = step()
        for k in ("class", "bucket", "place", "qkv", "out"):
            for i in np.argsort(-np.abs(g[k]).ravel())[[0, 1, 5]]:
                at, up = np.unravel_index(i, g[k].shape), 1e-5
                p[k][at] += up
                more = step()[0]
                p[k][at] -= 2 * up
                less = step()[0]
                p[k][at] += up
                assert abs((more - less) / (2 * up) - g[k][at]) < 1e-6


def test_lm_products_of_a_step(monkeypatch):
    """Places of the context have no products of their own, neither keys nor values."""
    done, times, gram = [0], lm._times, lm._gram
    monkeypatch.setattr(lm, "_times", lambda a, b, out: done.__setitem__(0, done[0] + a.size // a.shape[-1] * b.size) or times(a, b, out))
    monkeypatch.setattr(lm, "_gram", lambda a, b: done.__setitem__(0, done[0] + a.size * b.shape[-1]) or gram(a, b))
    docs, most = [np.random.default_rng(16).integers(0, 500, lm.CONTEXT + lm.BATCH * lm.STRIDE)], (lm.BATCH + 1) * lm.STRIDE * lm.DIM
    lm.train_locally(lm.initial(), docs, table())
    assert done[0] <= most * (6 * lm.DIM + 3 * lm.CLASSES)
    done[0] = 0
    lm.log_probabilities(docs, lm.initial(), table())
    assert done[0] <= most * (2 * lm.DIM + lm.CLASSES)
