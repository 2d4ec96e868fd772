"""Suffix-array deduplication of long byte strings by distributed prefix doubling.

Every byte that a THRESHOLD-byte string covers which also starts in a document with a smaller doc_id is removed.

Prefix doubling ranks suffixes by ever longer prefixes: Spark sorts (rank, rank at a growing offset), equal pairs share
the new rank, and a suffix leaves once it is unique or its prefix has passed the threshold. Three things keep that
affordable over whole corpora:

* Sampled suffixes. The first rank is that of the SEED-byte prefix. Of the suffixes in a THRESHOLD-byte window only the
  one with the least hash of its seed takes part, its anchor. That depends on the window's bytes alone, so equal
  windows have equal anchors at equal offsets, and a window is repeated only if its anchor's rank is.
* Classes of contexts. A run of windows with one anchor spans at most 2 * THRESHOLD - SEED bytes, its context. Runs of
  equal rank and equal context agree in all their windows: all but those in the smallest doc_id are removed at once,
  first inside each chunk of the scan, where classes of HOT runs or more are known to the rest of the task (so a passage
  in a third of all documents costs a few rows for each task of the scan), then after the sort. If a rank has one context only, or one document, it is done.
* Refinement. What is left (one run for each context) is ranked by longer prefixes: a node of a tree over the anchor's
  offsets holds the bytes that all its windows share; the pair (rank of the parent, those bytes) is the new rank. The
  common prefix grows from SEED to THRESHOLD bytes, where rank and context coincide.

Rows of one rank are processed as a stream in sort order with a state of one row or one document's rows. Texts are
shuffled up to three times, compressed: to the runs that need refinement, to those that still do after its first step
(which moves hashes without bytes), and to the removed intervals. Shuffle files go as soon as a step is written.

Defined results of the odd cases
* null or empty text: 0 bytes, nothing removed. null doc_id: compared with nothing, nothing removed.
* equal doc_ids: one document; its rows don't remove each other's bytes. Rows of one doc_id with different texts are
  kept apart by a 20-bit checksum of the text. Repeated rows: each is returned, with the same result.
* texts shorter than THRESHOLD: nothing removed. Very long texts: whole; one text is held in memory at a time.
* empty table: an empty result. Extra columns: not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, giving_back, read, width

THRESHOLD, SEED = 50, 16
#: Runs of one class in a chunk from which on the rest of the task knows the class.
HOT = 8
#: Offsets of an anchor in its window: 0 to REACH.
REACH = THRESHOLD - SEED
#: Bytes of text that are scanned at once (a longer document is one chunk).
CHUNK = 1 << 20
#: Runs that are handed on at once with their bytes, at least (a batch for each document costs more than its runs).
SLICES = 4096
FANOUT = 3

_U = np.uint64
_rng = np.random.default_rng(50_016)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_MUL = [int(x) | 1 for x in _rng.integers(1, 2**63, 10, dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x9FB21C651E98DF25)
    x ^= x >> _U(35)
    return x


def _joined(h: np.ndarray, step: int, mul: int) -> np.ndarray:
    """Hash of twice (or step more than) the bytes: h[i] * mul + h[i + step]."""
    out = h * _U(mul)
    out[: max(0, len(h) - step)] += h[step:]
    return out


def anchor_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window start, anchor, rank of its seed, context hash."""
    n = len(buf)
    h = _BYTE[buf]
    for i, step in enumerate((1, 2, 4, 8)):
        h = _joined(h, step, _MUL[i])
    seed = _mix(h)
    whole = _mix(_joined(_joined(h, 16, _MUL[4]), THRESHOLD - 32, _MUL[5]))
    del h
    low = (seed & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    size = 1
    while size < REACH + 1:
        step = min(size, REACH + 1 - size)
        low[: max(0, n - step)] = np.minimum(low[: max(0, n - step)], low[step:])
        size += step
    valid = np.zeros(n + 1, np.int8)
    long = ends - starts >= THRESHOLD
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - THRESHOLD + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:n], dtype=np.int8))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    anchor = (low[at] & _U(0xFFFFFFFF)).astype(np.int64)
    del low
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    lo, hi, anchor = at[first], at[np.r_[first[1:] - 1, len(at) - 1]], anchor[first]
    rank = (seed[anchor] >> _U(16)).astype(np.int64)
    context = _mix(whole[lo] * _U(_MUL[6]) + whole[hi] * _U(_MUL[7]) + (64 * (anchor - lo) + hi - lo).astype(_U)).view(np.int64)
    return lo, hi, anchor, rank, context


def _tag(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFF


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of intervals sorted by document and start."""
    if not len(doc):
        return doc, start, end
    group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.r_[True, (start + lift)[1:] > reach[:-1]] | np.r_[True, doc[1:] != doc[:-1]])
    return doc[new], start[new], (reach - lift)[np.r_[new[1:] - 1, len(doc) - 1]]


ROW = "rank long, context long, doc long, at long"


def scan(docs: DataFrame) -> DataFrame:
    """Anchor runs of all documents, and (with at < 0, context = start << 32 | end) intervals that a chunk removes itself."""

    def chunk(ids: list[int], raws: list[bytes], hot: list[np.ndarray]) -> pa.RecordBatch | None:
        buf = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        starts = ends - [len(r) for r in raws]
        lo, hi, anchor, rank, context = anchor_runs(buf, starts, ends)
        if not len(lo):
            return None
        d = np.searchsorted(ends, lo, side="right")
        doc, base = np.array(ids, np.int64)[d], starts[d]
        tag = np.array([_tag(r) for r in raws], np.int64)[d]
        both = rank.view(_U) * _U(0x5851F42D4C957F2D) ^ context.view(_U)
        order = np.argsort(both, kind="stable")
        same = both[order]
        first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        least = np.minimum.reduceat(doc[order], first)
        runs = np.diff(np.r_[first, len(order)])
        gone = np.zeros(len(lo), bool)
        gone[order] = doc[order] > np.repeat(least, runs)
        if len(hot[0]):
            at_hot = np.minimum(np.searchsorted(hot[0], both), len(hot[0]) - 1)
            gone |= (hot[0][at_hot] == both) & (doc > hot[1][at_hot])
        if (runs >= HOT).any():
            keys, least_of = np.r_[hot[0], same[first][runs >= HOT]], np.r_[hot[1], least[runs >= HOT]]
            by = np.lexsort((least_of, keys))
            new = np.r_[True, keys[by][1:] != keys[by][:-1]]
            hot[0], hot[1] = keys[by][new], least_of[by][new]
        stay = ~gone
        at = tag << 43 | (lo - base) << 12 | (hi - lo) << 6 | (anchor - lo)
        m = np.flatnonzero(gone)
        which, s, e = merged(d[m], (lo - base)[m], (hi - base)[m] + THRESHOLD)
        ids_, tags = np.array(ids, np.int64)[which], np.array([_tag(raws[i]) for i in which], np.int64)
        spread = (_mix(ids_.view(_U) * _U(0x9E3779B97F4A7C15) + s.view(_U)) >> _U(16)).astype(np.int64)
        cols = [np.r_[rank[stay], spread], np.r_[context[stay], s << 32 | e], np.r_[doc[stay], ids_], np.r_[at[stay], -1 - tags]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rank", "context", "doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        raws: list[bytes] = []
        hot, size = [np.zeros(0, _U), np.zeros(0, np.int64)], 0  # keys of hot classes, ascending, and their least doc_ids
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py()
                if raw is None or len(raw) < THRESHOLD:
                    continue
                if raws and size + len(raw) > CHUNK:
                    out = chunk(ids, raws, hot)
                    if out is not None:
                        yield out
                    ids, raws, size = [], [], 0
                ids.append(b.column(0)[i].as_py()), raws.append(raw)
                size += len(raw)
        if raws:
            out = chunk(ids, raws, hot)
            if out is not None:
                yield out

    return docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(giving_back(run), ROW)


def _reranked(rows: DataFrame, extra: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Sort by rank and context; removed intervals (start, end) and the runs that need a longer prefix.

    Streams the sorted rows. ``held`` are the rows of the last rank that may still turn out to need refinement: those
    of one document. Rows with at = PHANTOM stand for what has been emitted already.
    """
    phantom = -(1 << 62)
    names = ["rank", "context", "doc", "at", *(n for n, _ in extra)]
    types = [pa.int64()] * 4 + [t for _, t in extra]
    schema = pa.schema(list(zip(names, types, strict=True)))
    spark_types = {pa.int32(): "int", pa.binary(): "binary"}

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False

        def out(t: pa.Table, start, end) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            cols = [t.column(n) for n in names if n != "context"]
            n = t.num_rows
            cols += [pa.array(start, pa.int64()) if start is not None else pa.nulls(n, pa.int64()), pa.array(end, pa.int64()) if end is not None else pa.nulls(n, pa.int64())]
            yield from pa.Table.from_arrays(cols, [*(n for n in names if n != "context"), "start", "end"]).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).cast(schema)
            if held is not None:
                t = pa.concat_tables([held, t])
            rank, context, doc, at = (t.column(n).to_numpy() for n in names[:4])
            n = len(rank)
            done = (at < 0) & (at != phantom)  # intervals that the scan found
            if done.any():
                i = np.flatnonzero(done)
                yield from out(t.take(pa.array(i)), context[i] >> 32, context[i] & 0xFFFFFFFF)
                i = np.flatnonzero(~done)
                if not len(i):
                    continue
                t = t.take(pa.array(i))
                rank, context, doc, at = rank[i], context[i], doc[i], at[i]
                n = len(rank)
            new_rank = np.r_[True, rank[1:] != rank[:-1]]
            new_class = new_rank | np.r_[True, context[1:] != context[:-1]]
            c, g = np.cumsum(new_class) - 1, np.cumsum(new_rank) - 1
            cs, gs = np.flatnonzero(new_class), np.flatnonzero(new_rank)
            least = np.minimum.reduceat(doc, cs)
            lo, hi = np.minimum.reduceat(doc, gs), np.maximum.reduceat(doc, gs)
            classes = np.diff(np.r_[c[gs], c[-1] + 1])
            several = (classes > 1) & (hi > lo)
            if known:
                several[0] = True
            real = at != phantom
            gone = (doc > least[c]) & real
            if gone.any():
                i = np.flatnonzero(gone)
                start = at[i] >> 12 & 0x7FFFFFFF
                yield from out(t.take(pa.array(i)), start, start + (at[i] >> 6 & 63) + THRESHOLD)
            left = several[g] & ~gone & real
            if left.any():
                yield from out(t.take(pa.array(np.flatnonzero(left))), None, None)
            # the last rank may go on in the next batch
            tail, known = int(gs[-1]), bool(several[-1])
            stand_in = {"rank": rank[-1], "context": context[-1], "doc": least[-1] if known else hi[-1], "at": phantom}
            ghost = pa.Table.from_arrays([pa.array([stand_in[x]], pa.int64()) for x in names[:4]] + [pa.nulls(1, ty) for ty in types[4:]], schema=schema)
            if known:
                held = ghost
            else:
                keep = np.flatnonzero((np.arange(n) >= tail) & ~gone & real)
                held = pa.concat_tables([t.take(pa.array(keep)), ghost])

    dealt = rows.repartition(width(rows.sparkSession), "rank").sortWithinPartitions("rank", "context", "doc")
    cols = "rank long, doc long, at long" + "".join(f", {n} {spark_types[t]}" for n, t in extra) + ", start long, end long"
    return dealt.mapInArrow(giving_back(rerank), cols)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(x or b"") for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(giving_back(pack), "doc_id long, packed binary")


def _node(lo: int, hi: int) -> int:
    return lo << 8 | hi


#: Most bytes of a run, and the coefficients of multilinear hashes over them.
_SPAN = THRESHOLD + REACH
_SHARED, _OWN = _rng.integers(1, 2**64 - 1, (2, _SPAN), dtype=np.uint64) | _U(1)


def split_runs(rank: np.ndarray, at: np.ndarray, node: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each part of each node: rows with windows in it, their new rank, context, place, node, bytes and a mask of them.

    ``data`` is a matrix of the runs' bytes. The new rank is that of the pair (rank, bytes that all windows of the part
    share), the context that of the bytes of the run's own windows in the part.
    """
    span, off = at >> 6 & 63, at & 63
    columns = np.arange(_SPAN)
    for value in np.unique(node).tolist():
        lo, hi = value >> 8, value & 255
        rows = np.flatnonzero(node == value)
        step = -(-(hi - lo + 1) // FANOUT)
        for a in range(lo, hi + 1, step):
            e = min(hi, a + step - 1)
            first, last = np.maximum(a, off[rows] - span[rows]), np.minimum(e, off[rows])  # offsets of the run's windows in this part
            has = first <= last
            r, first, last = rows[has], first[has], last[has]
            if not len(r):
                continue
            size = THRESHOLD - (e - a)
            shared = np.take_along_axis(data[r], (off[r] - a)[:, None] + columns[:size], 1).astype(_U) @ _SHARED[:size]
            mask = columns < (last - first + THRESHOLD)[:, None]
            own = np.where(mask, np.take_along_axis(data[r], np.minimum((off[r] - last)[:, None] + columns, _SPAN - 1), 1), np.uint8(0))
            new = _mix(_mix(shared + np.full(1, a << 8 | e, _U) * _U(_MUL[8])) + rank[r].view(_U) * _U(_MUL[9]))
            context = _mix(_mix(own.astype(_U) @ _OWN) + (first << 8 | last).astype(_U) * _U(_MUL[8]))
            moved = (at[r] >> 12 << 12) + ((off[r] - last) << 12) | (last - first) << 6 | last
            yield r, new.view(np.int64), context.view(np.int64), moved, np.full(len(r), _node(a, e), np.int32), own, mask


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values as rows of a matrix, padded with zeros."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    out = np.zeros((len(column), _SPAN), np.uint8)
    out[np.arange(_SPAN) < np.diff(offsets)[:, None]] = flat
    return out


_NODE, _DATA = ("node", pa.int32()), ("data", pa.binary())


def _refine(rows: DataFrame, keep: bool = True) -> DataFrame:
    """Runs with their bytes (rank, doc, at, node, data) ranked by the parts of their nodes; without ``keep`` the bytes are dropped."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank, doc, at, node = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for r, new, context, moved, part, own, mask in split_runs(rank, at, node, _matrix(b.column(4).cast(pa.binary()))):
                cols = [pa.array(new), pa.array(context), pa.array(doc[r]), pa.array(moved), pa.array(part)]
                if keep:
                    ends = np.r_[0, np.cumsum(mask.sum(axis=1))].astype(np.int32)
                    cols.append(pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own[mask].tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, ["rank", "context", "doc", "at", "node", "data"][: len(cols)])

    parts = rows.select("rank", "doc", "at", "node", "data").mapInArrow(giving_back(split), f"{ROW}, node int" + ", data binary" * keep)
    return _reranked(parts, [_NODE, _DATA] if keep else [_NODE])


def _with_bytes(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """The runs (rank, doc, at, node) with their bytes as data."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held: tuple[list, ...] = ([], [], [], [], [])

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types, strict=True)], ["rank", "doc", "at", "node", "data"])
            for x in held:
                x.clear()
            return done

        for b in batches:
            for i in range(b.num_rows):
                doc, packed, ranks, ats, nodes = (b.column(j)[i].as_py() for j in range(5))
                raw = z.decompress(packed)
                tag = _tag(raw)
                mine = [(r, at, n, raw[(s := at >> 12 & 0x7FFFFFFF) : s + (at >> 6 & 63) + THRESHOLD]) for r, at, n in zip(ranks, ats, nodes, strict=True) if at >> 43 == tag]
                for x, more in zip(held, ([r for r, _, _, _ in mine], [doc] * len(mine), [at for _, at, _, _ in mine], [n for _, _, n, _ in mine], [d for _, _, _, d in mine]), strict=True):
                    x += more
                if len(held[0]) >= SLICES:
                    yield out()
        if held[0]:
            yield out()

    lists = runs.groupBy("doc").agg(F.collect_set(F.struct("rank", "at", "node")).alias("r"))
    return _packed(docs).join(lists, F.col("doc_id") == F.col("doc")).select("doc_id", "packed", "r.rank", "r.at", "r.node").mapInArrow(giving_back(slices), "rank long, doc long, at long, node int, data binary")


def repeats(docs: DataFrame) -> DataFrame:
    """doc, tag, start and end of intervals that are to be removed (they may overlap); ``docs``: doc_id, text."""
    found = cut(_reranked(scan(docs), []), "suffixes", free=True)
    tag = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.shiftright("at", 43)).alias("tag")
    out = found.filter("start is not null").select("doc", tag, "start", "end")
    left = found.filter("start is null").select("rank", "doc", "at", F.lit(_node(0, REACH)).alias("node"))
    size = REACH + 1
    while size > 1:
        keep = size <= REACH
        # most runs leave with the first split, so their bytes aren't shuffled by it and those that stay fetch theirs again
        found = cut(_refine(left if "data" in left.columns else _with_bytes(left, docs), keep), "suffixes", free=True)
        out = out.unionByName(found.filter("start is not null").select("doc", tag, "start", "end"))
        left = found.filter("start is null").select("rank", "doc", "at", "node", *["data"] * keep)
        size = -(-size // FANOUT)
        if size > 1 and left.isEmpty():
            break
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left, undecodable bytes replaced), n_bytes, n_removed, spans and kept_sha256 of every row."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, packed, tags, starts, ends in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                raw = z.decompress(packed)
                spans = []
                if tags:
                    tag = _tag(raw)
                    mine = np.array(sorted((s, e) for t, s, e in zip(tags, starts, ends, strict=True) if t == tag), np.int64).reshape(-1, 2)
                    _, s, e = merged(np.zeros(len(mine), np.int64), mine[:, 0], mine[:, 1])
                    spans = list(zip(s.tolist(), e.tolist(), strict=True))
                kept, last = [], 0
                for s, e in spans:
                    kept.append(raw[last:s])
                    last = e
                kept.append(raw[last:])
                rest = b"".join(kept)
                rows.append((doc, rest, len(raw), len(raw) - len(rest), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(rest).hexdigest()))
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "kept", "n_bytes", "n_removed", "spans", "kept_sha256"])

    spans = repeats(docs).distinct().groupBy("doc").agg(F.collect_list(F.struct("tag", "start", "end")).alias("s"))
    joined = _packed(docs).join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "packed", "s.tag", "s.start", "s.end")
    return joined.mapInArrow(giving_back(strip), "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
