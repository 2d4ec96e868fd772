"""MinHash near-duplicates by an LSH forest.

1. Every document becomes its set of distinct word shingles (64-bit hashes) and a signature of TREES x DEPTH minhash
   values. Documents with equal sets are one class, represented by the smallest doc_id: copies are never paired.
2. Each tree is one sorted order of the classes by their DEPTH values. Rows are dealt out by range of the order, so a
   region of any density spreads over tasks, and neighbours in the order with MIN_PREFIX common values or more are
   candidates. The last rows of a range meet the first of the next in a second small step.
3. A first pass over few trees and places joins the bulk of large groups. The second pass, over the other trees, skips
   pairs that are joined already and compares REACH places on each side, at any depth.
4. Regions are refined to the depth they need: one whose rows share CROWD_PREFIX values, is larger than the places
   compared and holds several components is crowded. All classes of its components are joined exactly by a prefix
   filter: of two sets with the similarity, the rarest shingles of each (a fifth) share one. Which shingles are rare is
   told by counters that several of them share; any order gives the same links.
5. Candidates that cannot be similar are dropped by set sizes and places (exact) and by a 128-bit sketch far below the
   threshold; the rest are confirmed on full sets, of 64-bit hashes of all shingles.
6. Links become components by star contraction.

What is collected are COUNTERS counts. A pair at the similarity shares no prefix of depth
CROWD_PREFIX in any tree of the second pass with a probability of 6e-7, pairs above it with less; every other pair is
compared, joined by others or in a crowd that is joined exactly.

Defined results of the odd cases
* null or empty text, white space only: an empty set, linked with nothing, its own component, kept.
* fewer words than a shingle has: the whole sequence is the one shingle.
* null doc_id: its own component (null), kept. Repeated rows and equal doc_ids: one document; each row is returned. If
  the texts of one doc_id differ, the one with words and the least hash is the document's; the other rows keep their
  own n_shingles and the document's component.
* extra columns: not read by ``near_duplicates``, kept by ``one_of_each`` under any name.
* equal sets: linked. Ties in an order: by doc_id. Very long texts: whole. Empty table: an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, forget_others, fresh, giving_back, read, slices_of, width
from loomgraph.operators.components import components

TREES, DEPTH = 24, 8
FIRST_TREES = 4
MIN_PREFIX, DEEP = 2, 6
#: Places on each side that are compared in the first trees and in the others.
FIRST_REACH, REACH = 4, 4
#: Depth at which a region with more rows than are compared counts as crowded.
CROWD_PREFIX = 3
SKETCH = 128
#: Sketch bits that must agree; two sets with similarity 0.8 agree in 115 on average, with deviation 3.4.
SKETCH_AGREE = 96
SIMILARITY = 80
#: Classes of one block of confirmed pairs (about).
BLOCK = 512
#: Counters (a power of two) that the shingles of all crowded classes share by hash, to be ordered; and parts that they
#: travel in.
COUNTERS, COUNTER_PARTS = 1 << 20, 64
#: Rows of one shingle that meet in one block.
POSTINGS = 4096
#: Shingles that a task remembers before it builds a document's set anew.
HELD_SHINGLES = 200_000
#: Pairs whose ids are broadcast at most, 16 bytes each.
BROADCAST_PAIRS = 250_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {"up": _powers(_BASE, 1 << 16), "down": _powers(_INVERSE, 1 << 16)}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_tables["up"]):
        size = 1 << (n - 1).bit_length()
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"][:n], _tables["down"]


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word of ``text`` (already lower-cased)."""
    return placed_words(text)[0]


def placed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, from differences of a running sum."""
    b = np.frombuffer(text, np.uint8)
    inside = ~_SPACES[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edge):
        return np.zeros(0, _U), edge, edge
    start, end = edge[0::2], edge[1::2]
    up, down = _table(len(b) + 1)
    total = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(_U)), start, end


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, _U)
    for j in range(min(k, len(words))):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    return np.unique(_mix(out))


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets (sorted distinct hashes) reach the similarity."""
    if 100 * min(len(s), len(t)) < SIMILARITY * max(len(s), len(t)) or not len(s) or not len(t):
        return False
    both = np.sort(np.concatenate([s, t]))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= SIMILARITY * (len(s) + len(t) - shared)


_rng = np.random.default_rng(20_250)
_MUL = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def signature(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """TREES x DEPTH values of three bytes, and the sketch."""
    low = np.full(TREES * DEPTH, 2**64 - 1, _U)
    for i in range(0, len(hashes), 2048):
        np.minimum(low, (np.multiply.outer(_MUL, hashes[i : i + 2048]) + _ADD[:, None]).min(axis=1), out=low)
    low = _mix(low)
    values = (low >> _U(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    return values.tobytes(), np.packbits((low[:SKETCH] & _U(1)).astype(np.uint8)).tobytes()


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, tie (the text's hash), n, print (fingerprint of the set, null if empty), sketch and the values of the first
    and the other trees."""
    cut_at = FIRST_TREES * DEPTH * 3

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("neardup")
        for b in slices_of(batches):
            n, prints, sketches, first, other = [], [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(text, k)
                n.append(len(h))
                if not len(h):
                    for c in (prints, sketches, first, other):
                        c.append(None)
                    continue
                at = np.arange(1, len(h) + 1, dtype=_U)
                prints.append(b"".join(x.tobytes() for x in ((_mix(h) * (at * _U(2) + _U(1))).sum(dtype=_U), _mix(h ^ _U(_BASE)).sum(dtype=_U))))
                sig, sketch = signature(h)
                sketches.append(sketch), first.append(sig[:cut_at]), other.append(sig[cut_at:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), *[pa.array(c, pa.binary()) for c in (prints, sketches, first, other)]], ["doc_id", "tie", "n", "print", "sketch", "first", "other"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(giving_back(sign), "doc_id long, tie long, n long, print binary, sketch binary, first binary, other binary")


_ROW = "label binary, sketch binary, id long, n long, comp long"
_OUT = "a long, b long, part int, label binary, sketch binary, id long, n long, comp long"


def _orders(classes: DataFrame, first: int, last: int) -> DataFrame:
    """One row for each class and tree: the tree's number and values as one sortable label."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = DEPTH * 3
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, last - first, step)
            for t in range(first, last):
                labels = np.concatenate([np.full((b.num_rows, 1), t, np.uint8), sig[:, t - first]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in labels], pa.binary()), b.column(4), b.column(0), b.column(1), b.column(2)], ["label", "sketch", "id", "n", "comp"])

    return classes.select("id", "n", "comp", "sig", "sketch").mapInArrow(giving_back(explode), _ROW)


def _neighbours(rows: dict[str, np.ndarray], reach: int, mark: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows in label order; with ``mark``, crowded components as pairs with themselves.

    Unless ``mark``, rows with a common prefix of DEEP are compared with their direct neighbours only: there everything
    chains up, and what doesn't is left to the trees that mark.
    """
    labels, n = rows["label"], len(rows["id"])
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = labels[1:] == labels[:-1]
    groups = np.concatenate([same[:, :1], same[:, 1:].reshape(n - 1, DEPTH, 3).all(axis=2)], axis=1)
    near = np.where(groups.all(axis=1), DEPTH + 1, groups.argmin(axis=1)) - 1  # common values; -1: another tree
    out_a, out_b, common = [], [], near
    for d in range(1, min(reach, n - 1) + 1):
        if d > 1:
            common = np.minimum(common[:-1], near[d - 1 :])
        i = np.flatnonzero((common >= MIN_PREFIX) & ((common < DEEP) | (d == 1 or mark)))
        if not len(i):
            break
        j = i + d
        small, large = np.minimum(rows["n"][i], rows["n"][j]), np.maximum(rows["n"][i], rows["n"][j])
        i = i[(rows["id"][i] != rows["id"][j]) & (rows["comp"][i] != rows["comp"][j]) & (100 * small >= SIMILARITY * large)]
        if len(i):
            apart = np.bitwise_count(rows["sketch"][i] ^ rows["sketch"][i + d]).sum(axis=1)
            i = i[SKETCH - apart >= SKETCH_AGREE]
            out_a.append(rows["id"][i]), out_b.append(rows["id"][i + d])
    own = np.zeros(0, np.int64)
    if mark and n > reach + 1:
        # a region reaches beyond the places compared; its components meet at a border, so windows that hold one find all
        size = reach + 1
        deep = np.lib.stride_tricks.sliding_window_view(near, size).min(axis=1) >= CROWD_PREFIX
        border = np.lib.stride_tricks.sliding_window_view(rows["comp"][1:] != rows["comp"][:-1], size).any(axis=1)
        crowd = np.zeros(n, bool)
        for i in np.flatnonzero(deep & border).tolist():
            crowd[i : i + size + 1] = True
        own = np.unique(rows["comp"][crowd])
    a, b = (np.concatenate([*x, own]) for x in (out_a, out_b))
    return np.minimum(a, b), np.maximum(a, b)


def _load(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {
        "label": np.frombuffer(b"".join(b.column("label").to_pylist()), np.uint8).reshape(b.num_rows, 1 + 3 * DEPTH),
        "sketch": np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, SKETCH // 8),
        **{c: b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "comp")},
    }


def _pairs(batches: Iterator[pa.RecordBatch], reach: int, mark: bool) -> Iterator[pa.RecordBatch]:
    """Candidates of one range, and its first and last rows with the range's number."""
    from pyspark import TaskContext

    part, tail, head, most = TaskContext.get().partitionId(), None, 0, reach + 1

    def rim(rows: dict[str, np.ndarray], i: slice) -> pa.RecordBatch:
        k = len(rows["id"][i])
        cols = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([part] * k, pa.int32()), *[pa.array([x.tobytes() for x in rows[c][i]], pa.binary()) for c in ("label", "sketch")], *[pa.array(rows[c][i], pa.int64()) for c in ("id", "n", "comp")]]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "part", "label", "sketch", "id", "n", "comp"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _load(batch)
        if head < most:
            yield rim(rows, slice(0, most - head))
            head += min(most - head, batch.num_rows)
        if tail is not None:
            rows = {c: np.concatenate([tail[c], rows[c]]) for c in rows}
        a, b = _neighbours(rows, reach, mark)
        tail = {c: rows[c][-most:] for c in rows}
        if len(a):
            k = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), *[pa.nulls(k, pa.int64())] * 3], ["a", "b", "part", "label", "sketch", "id", "n", "comp"])
    if tail is not None:
        yield rim(tail, slice(None))


def candidates(classes: DataFrame, first: int = 0, last: int = TREES, reach: int = REACH, mark: bool = True) -> DataFrame:
    """Distinct pairs a < b of classes (id, n, comp, sig, sketch) that are near in one of the sorted orders, and, with
    ``mark``, a = b for components that are crowded in one.

    ``sig`` has the values of the trees from ``first`` to before ``last``.
    """
    ordered = _orders(classes, first, last).repartitionByRange(width(classes.sparkSession), "label", "id").sortWithinPartitions("label", "id")
    found = cut(ordered.mapInArrow(giving_back(lambda batches: _pairs(batches, reach, mark)), _OUT), "forest")
    rims = found.filter("part is not null").select("label", "sketch", "id", "n", "comp").distinct()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if b.num_rows:
                rows = _load(b)
                if tail is not None:
                    rows = {c: np.concatenate([tail[c], rows[c]]) for c in rows}
                tail = {c: rows[c][-(reach + 1) :] for c in rows}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _neighbours(rows, reach, mark)], ["a", "b"])

    # at most 2 * (reach + 1) rows for each range of the order meet here
    seams = rims.coalesce(1).sortWithinPartitions("label", "id").mapInArrow(across, "a long, b long")
    return found.filter("a is not null").select("a", "b").unionByName(seams).distinct()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for b in slices_of(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])


def _packed(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id and compressed text; of documents in ``ids`` alone if those are few enough to be broadcast."""
    docs = docs.select("doc_id", "text")
    if n <= BROADCAST_PAIRS:
        docs = docs.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    return docs.mapInArrow(giving_back(_pack), "doc_id long, packed binary")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(src, dst) of the ``pairs`` (a, b) whose full shingle sets reach the similarity. ``docs``: doc_id, text.

    Texts travel compressed, once to their pairs and once with each pair. Texts of documents in no pair stay where they
    are as long as the pairs are few enough for their ids to be broadcast; beyond, the join by doc_id drops them.
    """
    pairs = cut(pairs, "pairs")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        left = None  # key and packed text of a pair's first row
        sets: dict[int, np.ndarray] = {}
        held = 0

        def of(doc: int, packed: bytes) -> np.ndarray:
            nonlocal held
            if doc not in sets:
                if held > HELD_SHINGLES:
                    sets.clear()
                    held = 0
                sets[doc] = shingle_hashes(z.decompress(packed).decode("utf-8", "surrogatepass"), k)
                held += len(sets[doc])
            return sets[doc]

        for batch in batches:
            a, b = [], []
            for x, y, doc, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if left is not None and left[0] == (x, y):
                    if left[1] != doc and similar(of(left[1], left[2]), of(doc, packed)):
                        a.append(x), b.append(y)
                else:
                    left = ((x, y), doc, packed)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    held = ends.join(_packed(docs, ends, pairs.count()), "doc_id").select("a", "b", "doc_id", "packed")
    return held.repartition(width(docs.sparkSession), "a", "b").sortWithinPartitions("a", "b", "doc_id").mapInArrow(giving_back(compare), "src long, dst long")


def _counter(h: np.ndarray) -> np.ndarray:
    """Numbers of the counters of the shingles ``h``."""
    return (h >> _U(65 - COUNTERS.bit_length())).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The counters of all shingles of a task's texts, packed in COUNTER_PARTS rows however many these are."""
    total = None
    for b in slices_of(batches):
        total = np.zeros(COUNTERS, np.int64) if total is None else total
        total += np.bincount(_counter(np.concatenate([shingle_hashes(t, k) for t in b.column(0).to_pylist()])), minlength=COUNTERS)
    if total is not None:
        z = zstandard.ZstdCompressor(level=1)
        parts = [z.compress(x.tobytes()) for x in total.reshape(COUNTER_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])


def shingle_counters(texts: DataFrame, k: int) -> np.ndarray:
    """How many of the ``texts`` (one column) have each counter's shingles."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, total = zstandard.ZstdDecompressor(), np.zeros(COUNTERS // COUNTER_PARTS, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(z.decompress(x.as_buffer()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    counted = texts.mapInArrow(giving_back(lambda batches: _counted(batches, k)), "part int, counts binary")
    total = np.zeros((COUNTER_PARTS, COUNTERS // COUNTER_PARTS), np.int64)
    for r in counted.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        total[r.part] = np.frombuffer(bytes(r["counts"]), np.int64)
    return total.ravel()


def _rare_first(h: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The shingles ``h`` from rare to frequent by their counters, then by hash."""
    return h[np.lexsort((h, counters[_counter(h)]))]


def _met_postings(run: np.ndarray, own: np.ndarray, inside: np.ndarray, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of rows with equal ``run`` numbers (ascending) that pass the filters; from two blocks unless ``inside``."""
    end = np.searchsorted(run, run, side="right")
    i, d, out = np.arange(len(run)), 1, [np.zeros((0, 2), np.int64)]
    while len(i := i[i + d < end[i]]):
        j = i + d
        need = SIMILARITY * (rows["n"][i] + rows["n"][j])
        ok = (rows["comp"][i] != rows["comp"][j]) & (rows["id"][i] != rows["id"][j]) & (inside[i] | (own[i] != own[j]))
        ok &= (100 + SIMILARITY) * np.minimum(rows["left"][i], rows["left"][j]) >= need
        a, b = i[ok], j[ok]
        apart = np.bitwise_count(rows["sketch"][a] ^ rows["sketch"][b]).sum(axis=1)
        close = SKETCH - apart >= SKETCH_AGREE
        out.append(np.stack([rows["id"][a[close]], rows["id"][b[close]]], axis=1))
        d += 1
    return tuple(np.unique(np.sort(np.concatenate(out), axis=1), axis=0).T)


def crowded_pairs(crowd: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Pairs a < b of the classes ``crowd`` (id, comp, sketch) with different comp that a prefix filter does not exclude.

    Every pair that reaches the similarity is among them: it shares one of the rarest shingles of each set, and at the
    first that it shares as many shingles are left in both as the similarity takes.
    """
    spark = docs.sparkSession
    texts = cut(crowd.join(docs.select(F.col("doc_id").alias("id"), "text"), "id"), "crowd")
    held = spark.sparkContext.broadcast(shingle_counters(texts.select("text"), k))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                tokens, at, n, left = [], [], [], []
                for i, t in enumerate(b.column(3).to_pylist()):
                    h = _rare_first(shingle_hashes(t, k), held.value)
                    size = len(h) - -(-SIMILARITY * len(h) // 100) + 1 if len(h) else 0
                    tokens.append(h[:size]), at.append(np.full(size, i)), n.append(np.full(size, len(h))), left.append(len(h) - np.arange(size))
                own = pa.array(np.concatenate(at))
                cols = [pa.array(np.concatenate(tokens).view(np.int64)), *(b.column(c).take(own) for c in range(3)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (n, left))]
                yield pa.RecordBatch.from_arrays(cols, ["token", "id", "comp", "sketch", "n", "left"])

    rows = cut(texts.select("id", "comp", "sketch", "text").mapInArrow(giving_back(prefixes), "token long, id long, comp long, sketch binary, n long, left long"), "prefixes")
    shared = rows.groupBy("token").agg(F.ceil(F.count("*") / POSTINGS).cast("int").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").drop("low", "high")
    placed = rows.join(shared, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "comp", "sketch", "n", "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
            run = np.r_[0, np.cumsum(_changes(b))]
            rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "n", "left")}
            rows["sketch"] = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, SKETCH // 8)
            own, inside = b.column("own").to_numpy(), b.column("x").to_numpy() == b.column("y").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _met_postings(run, own, inside, rows)], ["a", "b"])

        for b in batches:
            if b.num_rows:
                whole = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
                ends = np.flatnonzero(_changes(whole))
                done = int(ends[-1]) + 1 if len(ends) else 0
                rest = whole.slice(done)
                if done:
                    yield pairs(whole.slice(0, done))
        if rest is not None:
            yield pairs(rest)

    key = ["token", "x", "y"]
    return placed.repartition(width(spark), *key).sortWithinPartitions(*key).mapInArrow(giving_back(meet), "a long, b long").distinct()


def _changes(b: pa.RecordBatch) -> np.ndarray:
    """Whether token, x or y differ between each row and the next."""
    return np.logical_or.reduce([np.diff(b.column(c).to_numpy()) != 0 for c in ("token", "x", "y")])


def linked_in_blocks(pairs: DataFrame, docs: DataFrame, k: int, n_classes: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets reach the similarity; a text goes once to each block of pairs."""
    blocks = F.lit(max(1, math.ceil(n_classes / BLOCK)))
    block = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    pairs = cut(pairs.withColumn("x", block("a")).withColumn("y", block("b")), "crowd-pairs")
    wanted = cut(pairs.select("x", "y", F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "crowd-texts")
    texts = wanted.join(_packed(docs, wanted, wanted.count()).dropDuplicates(["doc_id"]), "doc_id")

    def compare(some: pa.Table, held: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        sets = {d: shingle_hashes(z.decompress(t).decode("utf-8", "surrogatepass"), k) for d, t in zip(held.column("doc_id").to_pylist(), held.column("packed").to_pylist(), strict=True)}
        out = [(a, b) for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True) if similar(sets[a], sets[b])]
        return pa.table({"src": pa.array([a for a, _ in out], pa.int64()), "dst": pa.array([b for _, b in out], pa.int64())})

    return pairs.groupBy("x", "y").cogroup(texts.groupBy("x", "y")).applyInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    if similarity != SIMILARITY:
        raise ValueError("the sketch and the trees are dimensioned for a similarity of 80 per cent")
    rows = cut(signed(docs, k), "signed")
    named = rows.filter("print is not null and doc_id is not null")
    # of several texts under one doc_id the one with the least hash stands for the document
    several = named.groupBy("doc_id").agg(F.min("tie").alias("least"), F.max("tie").alias("most")).filter("least < most")
    others = cut(named.join(several, "doc_id").filter("tie > least").select("doc_id", "tie").distinct(), "others")
    others = F.broadcast(others) if others.count() <= BROADCAST_PAIRS else others
    named = named.join(others, ["doc_id", "tie"], "left_anti")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(others, ["doc_id", "tie"], "left_anti").select("doc_id", "text")
    # written, so that the join below can split a print that very many documents have
    classes = cut(named.groupBy("print", "n").agg(F.min("doc_id").alias("id")), "classes")
    members = cut(named.select("doc_id", "print", "n").join(classes, ["print", "n"]).select("doc_id", "n", "id").distinct(), "members")
    links = members.filter("doc_id <> id").select(F.col("doc_id").alias("src"), F.col("id").alias("dst"))
    ids = members.filter("doc_id = id").select("id", "n").distinct()

    def heads(comp: DataFrame, sig: str) -> DataFrame:
        """Classes with the values of the trees in ``sig``; a row for each row of the representing document."""
        values = named.select(F.col("doc_id").alias("id"), "n", F.col(sig).alias("sig"), "sketch")
        return comp.join(values, ["id", "n"]).select("id", "n", "comp", "sig", "sketch")

    star_of = lambda joined: joined.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    comp_of = lambda joined: ids.join(joined, ids["id"] == joined["node"], "left").select("id", "n", F.coalesce("component", "id").alias("comp"))
    met = candidates(heads(ids.withColumn("comp", F.col("id")), "first"), 0, FIRST_TREES, FIRST_REACH, False)
    joined = components(confirmed(met, docs, k))
    before = cut(comp_of(joined), "joined")
    met = cut(candidates(heads(before, "other"), FIRST_TREES, TREES), "candidates")
    joined = components(star_of(joined).unionByName(confirmed(met.filter("a < b"), docs, k)))
    crowded = cut(before.join(met.filter("a = b").select(F.col("a").alias("comp")).distinct(), "comp", "left_semi").select("id"), "crowded")
    crowd = heads(comp_of(joined).join(crowded, "id"), "first").select("id", "comp", "sketch").dropDuplicates(["id"])
    last = linked_in_blocks(crowded_pairs(crowd, docs, k), docs, k, crowded.count())
    found = components(star_of(joined).unionByName(last).unionByName(links))
    named_components = found.withColumnRenamed("component", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(named_components, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once if its row is repeated.

    Columns of ``docs`` besides doc_id and text are kept as they are, whatever their names.
    """
    from pyspark.sql.window import Window

    own, row = fresh(docs, "kept_id", "row")
    kept = near_duplicates(docs.select("doc_id", "text"), k).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(own)), "left_semi")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = Window.partitionBy("doc_id").orderBy(F.desc(worded), F.xxhash64("text"))
    return rows.withColumn(row, F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.row_number().over(once))).filter(F.col(row) == 1).select(*docs.columns)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)
