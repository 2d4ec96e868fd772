"""Language-model scoring: a causal self-attention model trained in numpy, beside a smoothed word unigram model.

The model reads subword ids (lower-cased words, each encoded with a blank before it, and an end id). The probability of
an id is that of its class times that within its class. The class is predicted by one causal attention layer with a
residual, whose logits add to the logarithms of how often the class stands behind the id before; within its class an
id has the discounted share of its pair with the id before and a part of its own frequency (``Table``). All counts are over
all training documents, of all pairs however rare: those of frequent pairs are broadcast, those of all others are joined.
The weights are trained on all windows of every training document: each id is a target once.

Training deals documents into groups by the hash of their ids. The first group trains alone, all others take steps from
its weights, each in the order of that hash, and the weights are averaged. Scores therefore don't depend on the partitioning of the input.

Scoring cuts a document into windows of WINDOW ids that overlap by CONTEXT: a window scores the ids behind its
context, so every id is scored exactly once. Windows of many documents go through masked attention in batches.

Base counts: words travel as 64-bit hashes. The counts of the most frequent ones (HEAD_WORDS at most) are broadcast,
those of all others are joined, so every word of every document gets its exact count.

Defined results of the odd cases
* null or empty text, white space only: the end token alone. null doc_id: its checksum is that of no text, so it
  trains or is held out like any other; repeated rows and equal doc_ids: each row counts and is returned.
* no training documents: counts are 0, N and V are 0, the base score follows the formula; the model is untrained.
* very long texts: whole. Ties in frequency: by id. Empty table: an empty result. Extra columns: not read.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, forget_others, give_back, giving_back, read, remember, slices_of
from loomgraph.llm.neardup import _SPACES, _mix, placed_words
from loomgraph.llm.tokens import Encoder, groups_of, is_plain, vocabulary_path

FOLDS = 10
SMOOTH = 0.1
HEAD_WORDS = 200_000
WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
DIM, CLASSES, BUCKETS = 16, 32, 512
BATCH, RATE = 128, 0.02
#: Share of the rate at which the groups that start from the first one's weights train.
LATER_RATE = 0.3
#: Documents' ids that one group of the training trains on, about; groups start from common weights and are averaged.
GROUP_BYTES = 8 << 20
#: Slots of the table of frequent pairs of ids (a power of two, half of them used; other pairs are joined), and what is
#: taken off each pair's count for the class's other ids.
PAIR_SLOTS, DISCOUNT = 1 << 20, 0.75
#: Weight of the class frequencies in the class distribution behind an id.
PRIOR = 4.0
END_TOKEN = "<|endoftext|>"
#: Words whose ids a worker remembers: some 14 bytes each and two slots of 12 bytes or more.
CACHE_WORDS = 1_000_000
#: Half the pieces of plain texts that a worker remembers, some 70 bytes each.
CACHE_PIECES = 500_000
#: Windows that are scored at once, whatever the steps of the training are.
SCORED_WINDOWS = 256
#: Ids that are scored at once, unless one document has more.
SCORED_IDS = 1 << 16
#: Parts of one in which logarithms of joined pairs are summed: whole numbers add up alike in any order.
PARTS = 1 << 30


class Words:
    """For texts that aren't plain: ids of lower-cased words by the words' hashes; CACHE_WORDS of them (more if one block has more) are remembered before it starts afresh.

    Word ``i`` has ``size[i]`` ids in ``flat`` from ``at[i]`` on. Its number stands in the first slot from its hash's own
    on that was free; word 0 is the end id, which has no slot.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.n_ids = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.n_ids <= 65_536 else np.dtype("<u4")
        self.end_id = self.tokenizer.token_to_id(END_TOKEN)
        if self.end_id is None:
            self.end_id = self.n_ids - 1
        self.break_id = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self, slots: int = 1 << 12) -> None:
        self.at, self.size, self.flat = np.zeros(1, np.int32), np.ones(1, np.int32), np.array([self.end_id], self.dtype)
        self.key, self.word = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.key).bit_length())).astype(np.int64)

    def _look(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with the hashes ``h``, -1 of those that aren't known."""
        slot = self._slot(h)
        out = self.word[slot]
        open_ = np.flatnonzero((self.key[slot] != h) & (out != -1))
        while len(open_):
            slot[open_] = at = (slot[open_] + 1) % len(self.key)
            out[open_] = self.word[at]
            open_ = open_[(self.key[at] != h[open_]) & (out[open_] != -1)]
        return out

    def _enter(self, h: np.ndarray, word: np.ndarray) -> None:
        """Give the hashes ``h``, which have none, slots for the numbers ``word``."""
        slot, open_ = self._slot(h), np.arange(len(h))
        while len(open_):
            at = slot[open_]
            free = self.word[at] == -1
            self.word[at[free]], self.key[at[free]] = word[open_[free]], h[open_[free]]
            open_ = open_[self.word[at] != word[open_]]  # the others' slots are taken
            slot[open_] = (slot[open_] + 1) % len(self.key)

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        if 2 * (len(self.at) + len(h)) > len(self.key):
            held, number = self.key[self.word != -1], self.word[self.word != -1]
            slots = 1 << (4 * (len(self.at) + len(h))).bit_length() - 1
            self.key, self.word = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            self._enter(held, number)
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, t in enumerate(texts) if t.split() == [t]] if len(self.break_id) == 1 else []
        order, sizes, flat, done = [], [], [self.flat], np.zeros(len(texts), bool)
        for first in range(0, len(plain), 6400):
            groups = [plain[i : i + 100] for i in range(first, min(first + 6400, len(plain)), 100)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([" " + texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                cuts = np.flatnonzero(ids == self.break_id[0])
                if len(cuts) == len(group) - 1:
                    order.append(group), sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                    flat.append(np.delete(ids, cuts))
                    done[group] = True
        for i in np.flatnonzero(~done).tolist():
            flat.append(np.array(self.tokenizer.encode(" " + texts[i], add_special_tokens=False).ids, self.dtype))
            order.append([i]), sizes.append([len(flat[-1])])
        known, size = len(self.at), np.concatenate(sizes).astype(np.int32)
        self.at = np.r_[self.at, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)]
        self.size, self.flat = np.r_[self.size, size], np.concatenate(flat)
        self._enter(h[np.concatenate(order).astype(np.int64)], np.arange(known, known + len(h), dtype=np.int32))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts with the end id."""
        return [x for some in blocks_of(texts) for x in self._block(some)]

    def _block(self, texts: list[bytes]) -> list[bytes]:
        h, start, end, doc, joined = words_of(texts)
        of = self._look(h)
        new, first = np.unique(h[of == -1], return_index=True)
        if len(new):
            at = np.flatnonzero(of == -1)[first]
            if len(self.at) + len(new) > CACHE_WORDS:
                self.forget()
                new, at = np.unique(h, return_index=True)
            self._learn(new, [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            of = self._look(h)
        # all words one after the other, with the end id behind each text's
        sequence = np.zeros(len(h) + len(texts), np.int64)
        sequence[np.arange(len(h)) + doc] = of
        lengths = self.size[sequence].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.at[sequence] - before, lengths) + np.arange(int(lengths.sum()))].tobytes()
        last = np.cumsum(np.bincount(doc, minlength=len(texts)) + 1) - 1
        cuts = np.r_[0, (before + lengths)[last]] * self.dtype.itemsize
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def blocks_of(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``most`` bytes; a longer text is one by itself."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


#: Bytes of a word that are read eight at a time; longer words, which are few, hash as ``placed_words`` does.
EIGHTS = 64
#: What is kept of eight bytes of which so many are the word's.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, start, end and text number of every word of the texts, and the texts joined by blanks."""
    joined = b" ".join(texts)
    b = np.frombuffer(joined + bytes(EIGHTS), np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACES[b[: len(joined)]], prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    size, eight = end - start, np.ndarray(len(b) - 7, "<u8", b, strides=(1,))
    h = _mix((eight[start] & _KEPT[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(8, EIGHTS, 8):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        h[at] = _mix(h[at] * np.uint64(0xC2B2AE3D27D4EB4F) + (eight[start[at] + k] & _KEPT[np.minimum(size[at] - k, 8)]))
    long = np.flatnonzero(size > EIGHTS)
    if len(long):
        h[long] = placed_words(joined)[0][long]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts]))
    return h, start, end, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends), prepend=0)), joined


class Texts:
    """Ids of lower-cased texts: those of plain ones by the pieces, of the others by the words.

    Words with a blank before each, one after the other, have the pieces of each alone, as a blank that a word follows
    begins a piece; a blank of two bytes might go with those around it, so texts with one count as not plain.
    """

    def __init__(self, path: str):
        self.words = Words(path)
        self.tokenizer, self.n_ids, self.dtype = self.words.tokenizer, self.words.n_ids, self.words.dtype
        self.pieces = Encoder(path, CACHE_PIECES, self.words.end_id, self.tokenizer)

    def forget(self) -> None:
        self.words.forget()
        self.pieces.forget()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Serialized ids of each text, with the end id."""
        out: list[bytes | None] = [None] * len(texts)
        spaced = [b" ".join([b"", *t.split()]).decode("utf-8", "replace") for t in texts]
        plain = [i for i, t in enumerate(spaced) if is_plain(t) and "\xa0" not in t]
        at = iter(plain)
        for group in groups_of([spaced[i] for i in plain]):
            for x in self.pieces.plain(group):
                out[next(at)] = x
        others = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(others, self.words([texts[i] for i in others]), strict=True):
            out[i] = x
        return out


_texts: dict[str, Texts] = {}


def _encoder(path: str) -> Texts:
    if path not in _texts:
        _texts[path] = Texts(path)
        remember("lm words", _texts[path].forget)
    return _texts[path]


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS != 0


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


# ---------------------------------------------------------------- base: smoothed unigrams over words


def word_counts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(hash, c) of every distinct token of the training documents, the number of tokens and of distinct ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["hash", "c"])

        for b in slices_of(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for some in blocks_of([_lower(t) for d, t in zip(ids, texts, strict=True) if is_training(d)]):
                held += [words_of(some)[0], np.full(len(some), _END_HASH)]
                n += len(held[-2]) + len(some)
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counts = cut(docs.select("doc_id", "text").mapInArrow(giving_back(count), "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c")), "word-counts", free=True)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    return counts, total.n, total.v


#: Hash of the end token; words hash through the same finaliser, from other inputs.
_END_HASH = _mix(np.array([0x656E642D6F662D74], np.uint64))[0]


def head_of(counts: DataFrame, most: int = HEAD_WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the most frequent tokens, at most ``most``, and the count from which on all are in it."""
    sizes = counts.groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()  # one row for each eighth of a power of two
    least, n = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if n + r.n > most:
            break
        n, least = n + r.n, r.c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 62
    got = counts.filter(F.col("c") >= least).toPandas()
    h = got["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["c"].to_numpy(np.int64)[order], least


def base_scores(docs: DataFrame, row: str = "row") -> tuple[DataFrame, int]:
    """row, n_tokens, n_known and base_score of every row of ``docs`` (row, doc_id, text), and the training tokens."""
    counts, n, v = word_counts(docs)
    head, c_head, least = head_of(counts)
    log_head = np.log10(c_head + SMOOTH)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices_of(batches):
            rows, done = b.column(0).to_numpy(zero_copy_only=False), 0
            for texts in blocks_of([_lower(t) for t in b.column(1).to_pylist()]):
                r, n = rows[done : done + len(texts)].astype(np.int64), len(texts)
                done += n
                h, _, _, doc, _ = words_of(texts)
                h, doc = np.r_[h, np.full(n, _END_HASH)], np.r_[doc, np.arange(n)]
                distinct, of = np.unique(h, return_inverse=True)
                at = np.searchsorted(head, distinct)
                at[at == len(head)] = 0
                hit = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
                logs = np.where(hit, log_head[at], 0.0) if len(head) else np.zeros(len(distinct))
                # words that the broadcast counts lack, once for each text
                tail = ~hit[of]
                pair, tf = np.unique(doc[tail] * len(distinct) + of[tail], return_counts=True)
                # and the row itself, under a hash of its own
                own = (r + 1) * 0x5DEECE66D2B79F5
                zeros = np.zeros(len(pair), np.int64)
                cols = [np.r_[r, r[pair // len(distinct)]], np.r_[own, distinct[pair % len(distinct)].view(np.int64)], np.r_[np.zeros(n, np.int64), tf], np.r_[np.bincount(doc, logs[of], n), zeros.astype(float)], np.r_[np.bincount(doc, minlength=n), zeros], np.r_[np.bincount(doc, hit[of], n).astype(np.int64), zeros]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["row", "hash", "tf", "sum", "n_tokens", "known"])

    flat = docs.select(row, "text").mapInArrow(giving_back(look), "row long, hash long, tf long, sum double, n_tokens long, known long")
    rare = counts.filter(F.col("c") < least).withColumnRenamed("hash", "__hash")
    met = flat.join(rare, F.col("hash") == F.col("__hash"), "left")
    c = F.coalesce("c", F.lit(0))
    sums = met.groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"), (F.sum("known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"), (F.sum("sum") + F.sum(F.col("tf") * F.log10(c + SMOOTH))).alias("logs"))
    return sums.select("row", "n_tokens", "n_known", (F.col("logs") - F.col("n_tokens") * math.log10(n + SMOOTH * (v + 1))).alias("base_score")), n


# ---------------------------------------------------------------- the attention model


def classes_of(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id and its log probability within the class.

    Ids that start words and ids that go on are split, in order of frequency, into classes of about equal mass.
    """
    cls = np.zeros(len(counts), np.int64)
    for half in (0, 1):
        ids = np.flatnonzero(starts == half)
        ids = ids[np.lexsort((ids, -counts[ids]))]
        mass = np.cumsum(counts[ids] + SMOOTH)
        k = CLASSES // 2
        cls[ids] = half * k + np.minimum(k - 1, ((mass - (counts[ids] + SMOOTH)) / mass[-1] * k).astype(np.int64)) if len(ids) else 0
    total = np.bincount(cls, counts + SMOOTH, CLASSES)
    return cls, np.log((counts + SMOOTH) / total[cls])


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda *s: (r.normal(size=s) * 0.3 / math.sqrt(s[0] if len(s) > 1 and s[0] == DIM else 1) * (0.4 if s[0] != DIM else 1)).astype(np.float32)
    return {"class": w(CLASSES + 1, DIM), "bucket": w(BUCKETS, DIM), "place": w(WINDOW, DIM), "qkv": w(DIM, 3 * DIM), "out": w(DIM, DIM), "logit": w(DIM, CLASSES) * np.float32(0.1)}


#: The most that a place's exponent to each place may be: none behind it.
_LIMIT = np.where(np.tril(np.ones((WINDOW, WINDOW))) > 0, 30, -np.inf).astype(np.float32)


class Room:
    """Arrays by name that are used again: fresh ones of this size get new pages from the system each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, dtype=np.float32) -> np.ndarray:
        size = math.prod(shape)
        got = self.held.get(name)
        if got is None or got.size < size or got.dtype != dtype:
            got = self.held[name] = np.empty(size, dtype)
        return got[:size].reshape(shape)


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


#: Multiplications of one product: up to a million, OpenBLAS doesn't pack its factors, which halves the time of such narrow ones.
SMALL = 900_000


def _times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """The product of the flattened ``a`` and ``b``, some rows at a time."""
    a, out, b = _flat(a), _flat(out), np.ascontiguousarray(b)
    rows = max(1, SMALL // b.size)
    for i in range(0, len(a), rows):
        np.matmul(a[i : i + rows], b, out=out[i : i + rows])


def _gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of the flattened and transposed ``a`` and ``b``, some rows at a time."""
    a, b = _flat(a), _flat(b)
    rows = max(1, SMALL // (a.shape[1] * b.shape[1]))
    return sum(a[i : i + rows].T @ b[i : i + rows] for i in range(0, len(a), rows))


def with_heads(x: np.ndarray, n: int, heads: np.ndarray) -> None:
    """Put the contexts of the windows ``heads`` of the first ``n`` in ``x`` behind them, as windows of their own with these places behind a context."""
    x[n:] = 0
    x[n:, CONTEXT : 2 * CONTEXT] = x[heads, :CONTEXT]


def _at_most(x: np.ndarray, most: float) -> None:
    if x.size and x.max() > most:  # seldom, and cheaper to see than to do
        np.minimum(x, x.dtype.type(most), out=x)


def joined_of(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Queries' and keys' matrices in one, scaled, and values' and outputs' in one: one head as wide as the inputs needs no others."""
    w = p["qkv"]
    return w[:, :DIM] @ w[:, DIM : 2 * DIM].T * w.dtype.type(1 / math.sqrt(DIM)), w[:, 2 * DIM :] @ p["out"]


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: int, room: Room, heads: int = 0, joined: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Attention of the places from ``first`` on over all places up to them, in embedded inputs ``x`` (windows, places, DIM).

    In the last ``heads`` windows the places before ``first`` are hidden. ``joined_of`` the weights is computed where it isn't given.

    Inputs of those places, what they ask of the inputs, all inputs turned (and a row of ones), normalised attention, the inputs' means by it, and last
    states. The last states times ``logit`` are what attention adds to the logits. All are held in ``room``.
    """
    n, size, _ = x.shape
    some, of = size - first, x.dtype
    mine, q, o, h = (room(k, n, some, DIM, dtype=of) for k in ("mine", "q", "o", "h"))
    turned, a = room("turned", n, DIM + 1, size, dtype=of), room("a", n, some, size, dtype=of)
    asked, given = joined or joined_of(p)
    mine[...] = x[:, first:]
    _times(mine, asked, q)
    np.copyto(turned[:, :DIM], x.transpose(0, 2, 1))  # faster than as a view
    turned[:, DIM] = 1
    np.matmul(q, turned[:, :DIM], out=a)
    np.minimum(a, _LIMIT[first:size, :size], out=a)
    np.exp(a, out=a)
    if heads:
        a[-heads:, :, :first] = 0
    a *= (1 / (_flat(a) @ np.ones(size, of) + of.type(1e-30))).reshape(n, some, 1)
    np.matmul(a, x, out=o)
    _times(o, given, h)
    h += mine
    return mine, q, turned, a, o, h


#: Places of the rows of a table with DIM columns in its pairs of cells one after the other.
_CELLS = np.arange(max(CLASSES + 1, BUCKETS) * DIM // 2).reshape(-1, DIM // 2)


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` (of DIM numbers, in double precision) by their index ``at`` below ``n``; two are added at once, as a complex number."""
    out = np.zeros(n * DIM // 2, np.complex128)
    np.add.at(out, _CELLS.take(at, axis=0).ravel(), rows.view(np.complex128).ravel())
    return out.view(np.float64).reshape(n, DIM)


def gradients(p: dict[str, np.ndarray], cin: np.ndarray, bin_: np.ndarray, prior: np.ndarray, target: np.ndarray, valid: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the valid places, and its gradients.

    Places of the context are attended to only, but in windows that score them (the first ones of documents), where
    they attend to each other: beside the windows, in windows of their own. In the others they are the last places of the window before.
    """
    heads = heads_of(valid)
    rows = beside(prior, heads).astype(p["class"].dtype)
    return _gradients(p, cin, bin_, heads, rows, beside(target, heads), beside(valid, heads, 0), room or Room())


def heads_of(valid: np.ndarray) -> np.ndarray:
    """Windows that score their context."""
    return np.flatnonzero(valid[:, :CONTEXT].any(axis=1))


def beside(x: np.ndarray, heads: np.ndarray, rest=None) -> np.ndarray:
    """What belongs to the places that windows score: those behind the context, then the contexts of ``heads``, filled up with ``rest`` (or with what is there)."""
    more = x[heads, :STRIDE]
    if rest is not None:
        more[:, CONTEXT:] = rest
    return np.concatenate([x[:, CONTEXT:], more])


def _gradients(p: dict[str, np.ndarray], cin: np.ndarray, bin_: np.ndarray, heads: np.ndarray, d: np.ndarray, wanted: np.ndarray, valid: np.ndarray, room: Room, with_loss: bool = True, g: dict | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """``gradients`` from the priors ``d`` (which are overwritten), targets and validity of the places ``beside`` the windows, in the arrays ``g`` if given; a loss of 0 unless ``with_loss``."""
    of, n, every = p["class"].dtype, len(cin), len(d)
    x, dx = (room(k, every, WINDOW, DIM, dtype=of) for k in ("x", "dx"))
    np.take(p["class"], cin, axis=0, out=x[:n], mode="clip")
    np.take(p["bucket"], bin_, axis=0, out=dx[:n], mode="clip")
    x[:n] += dx[:n]
    x[:n] += p["place"]
    with_heads(x, n, heads)
    share = valid.astype(of).ravel()
    share /= of.type(max(1, int(valid.sum())))
    mine, q, turned, a, o, h = forward(p, x, CONTEXT, room, len(heads), joined := joined_of(p))
    more = room("ds", *d.shape, dtype=of)
    _times(h, p["logit"], more)
    d += more
    _at_most(d, 60)
    np.exp(d, out=d)
    cells, d = d.reshape(-1), _flat(d)
    sums, at = d @ np.ones(CLASSES, of), np.arange(0, d.size, CLASSES) + wanted.ravel()
    loss = float(-(np.log(np.maximum(cells.take(at) / sums, 1e-30)) * share).sum()) if with_loss else 0.0
    d *= (share / sums)[:, None]
    cells[at] -= share
    g = {k: np.empty_like(v) for k, v in p.items()} if g is None else g
    (asked, given), wq, wk, wv = joined, p["qkv"][:, :DIM], p["qkv"][:, DIM : 2 * DIM], p["qkv"][:, 2 * DIM :]
    g["logit"][...] = _gram(h, d)
    dh, dq, do = room("dh", *mine.shape, dtype=of), room("dq", *mine.shape, dtype=of), room("do", every, STRIDE, DIM + 1, dtype=of)
    dx2, ds = room("dx2", *x.shape, dtype=of), room("ds", *a.shape, dtype=of)
    _times(d, p["logit"].T, dh)
    dgiven = _gram(o, dh)
    g["out"][...], g["qkv"][:, 2 * DIM :] = wv.T @ dgiven, dgiven @ p["out"].T
    # what is taken off as a place's attention sums to one goes with the row of ones
    do, wide = do[..., :DIM], do
    _times(dh, given.T, do)
    np.subtract(mine, h, out=dq)
    dq *= dh
    wide[..., DIM] = (_flat(dq) @ np.ones(DIM, of)).reshape(every, STRIDE)
    np.matmul(wide, turned, out=ds)
    ds *= a
    np.matmul(ds, x, out=dq)
    dasked = _gram(mine, dq) * of.type(1 / math.sqrt(DIM))
    g["qkv"][:, :DIM], g["qkv"][:, DIM : 2 * DIM] = dasked @ wk, dasked.T @ wq
    np.matmul(a.transpose(0, 2, 1), do, out=dx)
    np.matmul(ds.transpose(0, 2, 1), q, out=dx2)
    dx += dx2
    _times(dq, asked.T, q)
    dh += q
    dx[:, CONTEXT:] += dh
    dx[heads, :CONTEXT] += dx[n:, CONTEXT : 2 * CONTEXT]
    dx = dx[:n]
    np.sum(dx, axis=0, out=g["place"])
    # each place once: contexts go to the window before, but for those of the first window and of documents' first
    own = heads if len(heads) and heads[0] == 0 else np.concatenate([[0], heads])
    rows = room("rows", n * STRIDE + len(own) * CONTEXT, DIM, dtype=np.float64)
    rows[n * STRIDE :].reshape(-1, CONTEXT, DIM)[...] = dx[own, :CONTEXT]
    dx[own, :CONTEXT] = 0
    dx[:-1, STRIDE:] += dx[1:, :CONTEXT]
    rows[: n * STRIDE].reshape(n, STRIDE, DIM)[...] = dx[:, CONTEXT:]
    for k, index in (("class", cin), ("bucket", bin_)):
        g[k][...] = _summed(np.concatenate([index[:, CONTEXT:].ravel(), index[own, :CONTEXT].ravel()]), rows, len(p[k]))
    return loss, g


def _windows(n: int) -> np.ndarray:
    """Starts of the windows of a document with ``n`` ids."""
    return np.arange(0, max(1, n - CONTEXT), STRIDE)


def encoded(docs: DataFrame, path: str, row: str = "row") -> DataFrame:
    """row, train and the compressed ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = _encoder(path), zstandard.ZstdCompressor(level=1)
        for b in slices_of(batches):
            ids = enc([_lower(t) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([is_training(d) for d in b.column(1).to_pylist()]), pa.array([z.compress(x) for x in ids], pa.binary())], ["row", "train", "ids"])

    return docs.select(row, "doc_id", "text").mapInArrow(giving_back(run), "row long, train boolean, ids binary")


def pair_counts(ids: DataFrame, n_ids: int, dtype: np.dtype) -> DataFrame:
    """(prev, id, c) of every pair of neighbouring ids of the training documents; before the first id stands ``n_ids``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, held, n = zstandard.ZstdDecompressor(), [], 0
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fold() -> None:
            nonlocal keys, sums, held, n
            k, c = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.r_[keys, k], return_inverse=True)
            keys, sums = both, np.bincount(at, np.r_[sums, c]).astype(np.int64)
            held, n = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // n_ids), pa.array(keys % n_ids), pa.array(sums)], ["prev", "id", "c"])

        for b in batches:
            for x in b.column(0).to_pylist():
                a = np.frombuffer(z.decompress(x), dtype).astype(np.int64)
                held.append(np.r_[n_ids, a[:-1]] * n_ids + a)
                n += len(a)
                if n > 1_000_000:
                    fold()
                    if len(keys) > 2_000_000:
                        yield out()
                        keys, sums = keys[:0], sums[:0]
        if held:
            fold()
        yield out()

    return ids.filter("train").select("ids").mapInArrow(giving_back(count), "prev long, id long, c long").groupBy("prev", "id").agg(F.sum("c").alias("c"))


class Table:
    """What corpus counts give: the class behind an id, and the id within its class behind an id.

    ``prior`` are logarithms of the class probabilities behind each id. Within a class an id has the discounted share of
    its pair and, by its own frequency, a part of what all pairs of the class leave. The shares of the pairs that are held
    are looked up, each in the first free slot from its own on; ``rare_pairs`` has what the others add.
    """

    def __init__(self, counts: np.ndarray, starts: np.ndarray, by_class, pairs):
        """``by_class``: columns prev, cls, c and n (number) of all pairs; ``pairs``: prev, id, c of those that are held (all, without n)."""
        self.n_ids = n = len(counts)
        self.cls, self.log_own = classes_of(counts, starts)
        self.own = np.exp(self.log_own)
        mass = np.bincount(self.cls, counts + SMOOTH, CLASSES)
        total = np.zeros((n + 1, CLASSES))
        total[by_class["prev"], by_class["cls"]] = by_class["c"]
        self.prior = np.log(np.maximum(total + PRIOR * mass / mass.sum(), 1e-9) / (total.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)
        key = np.asarray(pairs["prev"], np.int64) * n + np.asarray(pairs["id"], np.int64)
        self.key, self.share = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, np.float32)
        prev, cls = key // n, self.cls[key % n]
        share = (np.asarray(pairs["c"], float) - DISCOUNT) / total[prev, cls]
        slot, open_ = self._slot(key), np.arange(len(key))
        while len(open_):
            at = slot[open_]
            free = self.key[at] == -1
            self.key[at[free]] = key[open_[free]]
            self.share[at[free]] = share[open_[free]]
            lost = self.key[at] != key[open_]  # to another pair
            self.share[at[~lost]] = share[open_[~lost]]
            open_ = open_[lost]
            slot[open_] = (slot[open_] + 1) % PAIR_SLOTS
        left = np.ones((n + 1, CLASSES))
        if "n" in by_class:
            left[by_class["prev"], by_class["cls"]] = DISCOUNT * np.asarray(by_class["n"], float) / np.asarray(by_class["c"], float)
        else:
            np.subtract.at(left, (prev, cls), share)
        self.left = np.maximum(left, 1e-9).astype(np.float32)
        self.inside = np.zeros(PAIR_SLOTS)
        at = np.flatnonzero(self.key != -1)
        self.inside[at] = self.log_inside(self.key[at] // n, self.key[at] % n, self.share[at])

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        h = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - PAIR_SLOTS.bit_length() + 1)
        return h.view(np.int64)

    def places(self, key: np.ndarray) -> np.ndarray:
        """Slots of the pairs ``key``, -1 of those that aren't held."""
        slot = self._slot(key)
        found = self.key.take(slot)
        open_ = np.flatnonzero(found != key)
        found = found[open_]
        while len(open_):
            slot[open_[found == -1]] = -1
            open_ = open_[found != -1]
            slot[open_] = at = (slot[open_] + 1) % PAIR_SLOTS
            found = self.key[at]
            open_, found = open_[found != key[open_]], found[found != key[open_]]
        return slot

    def shares(self, key: np.ndarray) -> np.ndarray:
        """Shares of the pairs ``key``, 0 of those that aren't held."""
        at = self.places(key)
        return np.where(at >= 0, self.share[at], np.float32(0))

    def log_inside_at(self, places: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``log_inside`` of pairs with these ``places``: that of held ones is there already."""
        out, at = self.inside.take(places, mode="wrap"), np.flatnonzero(places < 0)
        out[at] = self.log_inside(before[at], ids[at], np.float32(0))
        return out

    def log_inside(self, before: np.ndarray, ids: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each id within its class behind the id before it (n_ids: none); of a pair that isn't held without its share."""
        shares = self.shares(before * self.n_ids + ids) if shares is None else shares
        return np.log(shares + self.left.ravel().take(before * CLASSES + self.cls.take(ids)) * self.own.take(ids))


def rare_pairs(pairs: DataFrame, table: Table, by_class) -> DataFrame:
    """(key, more): what the shares of ``pairs`` that aren't held add to ``log_inside``, in PARTS."""
    total = np.zeros((table.n_ids + 1, CLASSES), np.float32)
    total[by_class["prev"], by_class["cls"]] = by_class["c"]
    known = pairs.sparkSession.sparkContext.broadcast((table.n_ids, table.cls, table.log_own, table.left, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cls_of, log_own, left, total = known.value
        for b in batches:
            prev, ids, c = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cls = cls_of[ids]
            more = np.log1p((c - DISCOUNT) / total[prev, cls] / (left[prev, cls] * np.exp(log_own[ids])))
            yield pa.RecordBatch.from_arrays([pa.array(prev * n + ids), pa.array(np.rint(more * PARTS).astype(np.int64))], ["__key", "more"])

    return pairs.select("prev", "id", "c").mapInArrow(giving_back(run), "__key long, more long")


def table_of(pairs: DataFrame, starts: np.ndarray, most: int = PAIR_SLOTS // 2) -> tuple[Table, DataFrame | None]:
    """The table of all ``pairs`` (materialised), and the ``rare_pairs`` if there are more than ``most``.

    What is collected is bounded by ids, ids x CLASSES and PAIR_SLOTS.
    """
    spark, n = pairs.sparkSession, len(starts)
    got = pairs.groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(n, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    cls, _ = classes_of(counts, starts)
    named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls)], "id long, cls int")
    by_class = pairs.join(F.broadcast(named), "id").groupBy("prev", "cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toPandas()
    levels = pairs.groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    least, held, rest = 1 << 62, 0, sum(r.n for r in levels)
    for r in sorted(levels, key=lambda r: -r["level"]):
        if held + r.n > most:
            break
        held, rest, least = held + r.n, rest - r.n, r.c
    table = Table(counts, starts, by_class, pairs.filter(F.col("c") >= least).toPandas())
    return table, rare_pairs(pairs.filter(F.col("c") < least), table, by_class) if rest else None


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def _parts(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _unpack(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v.copy() for k, v in _parts(np.frombuffer(raw, "<f4"), like).items()}


def _placed(docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The ids of all documents one after the other; of each window its place there, and its document's number, start and end."""
    sizes = np.array([len(x) for x in docs])
    ends = np.cumsum(sizes)
    n = np.maximum(1, -(-(sizes - CONTEXT) // STRIDE))
    doc = np.repeat(np.arange(len(docs)), n)
    start = (ends - sizes)[doc]
    return np.concatenate(docs), start + (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * STRIDE, doc, start, ends[doc]


def _batches(docs: list[np.ndarray], n_ids: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All windows of the documents, BATCH at a time: the ids before each place (n_ids: none), the ids there, and
    whether the window scores them."""
    if not docs:
        return
    flat, first, _, start, end = _placed(docs)
    place = np.arange(WINDOW)
    for i in range(0, len(first), BATCH):
        of = slice(i, i + BATCH)
        f, e = first[of, None], end[of, None]
        at, head = f + place, np.flatnonzero(first[of] == start[of])
        scored = at < e
        scored[:, :CONTEXT] = False
        scored[head, :CONTEXT] = at[head, :CONTEXT] < e[head]
        np.minimum(at, e - 1, out=at)
        now = flat.take(at)
        at -= 1  # behind the end of a document with one id that is another's, and isn't scored
        before = flat.take(at, mode="clip").astype(np.int64)
        before[head, 0] = n_ids
        yield before, now.astype(np.int64), scored


def train_locally(p: dict[str, np.ndarray], docs: list[np.ndarray], table: Table, rate: float = RATE) -> tuple[dict[str, np.ndarray], float]:
    """Adam steps over all windows of ``docs`` (id arrays) from the weights ``p``; every id is a target once."""
    # all weights in one array, of which those by name are parts
    w = np.concatenate([p[k].ravel() for k in sorted(p)])
    p = _parts(w, p)
    m, s, change, root, new = (np.zeros_like(w) for _ in range(5))
    g = _parts(new, p)
    loss, steps, room = 0.0, -(-sum(len(_windows(len(d))) for d in docs) // BATCH), Room()
    cls, bucket = np.r_[table.cls, CLASSES], np.r_[np.arange(table.n_ids) % BUCKETS, 0]
    for t, (before, now, valid) in enumerate(_batches(docs, table.n_ids), 1):
        heads = np.flatnonzero(valid[:, 0])
        seen, wanted, scored = (beside(x, heads, rest) for x, rest in ((before, None), (now, None), (valid, 0)))
        prior = room("prior", *seen.shape, CLASSES, dtype=table.prior.dtype)
        np.take(table.prior, seen, axis=0, out=prior, mode="clip")
        loss, _ = _gradients(p, cls.take(before), bucket.take(before), heads, prior, table.cls.take(wanted), scored, room, t == steps, g)
        pace = rate * max(0.1, 1 - t / (steps + 1))
        m += 0.1 * (new - m)
        np.multiply(new, new, out=root)
        root -= s
        root *= 0.01
        s += root
        np.sqrt(np.divide(s, 1 - 0.99**t, out=root), out=root)
        root += 1e-8
        np.multiply(m, pace / (1 - 0.9**t), out=change)
        change /= root
        w -= change
    return {k: v.copy() for k, v in p.items()}, loss


def train(ids: DataFrame, p: dict[str, np.ndarray], table: Table, dtype: np.dtype) -> dict[str, np.ndarray]:
    """Weights from all windows of all training documents (row, train, ids).

    Documents are dealt into groups by the hash of their ids, as many as their size asks for, and each group trains in
    the order of that hash, so the weights don't depend on how the input is partitioned. The groups' weights are
    averaged by their ids, in two levels, so the driver gets a few rows.
    """
    spark = ids.sparkSession
    some = ids.filter("train").select("ids", F.xxhash64("ids").alias("tie"))
    size = some.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).head()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    n_weights, shared = sum(v.size for v in p.values()), spark.sparkContext.broadcast(table)
    grouped = some.withColumn("grp", F.pmod("tie", F.lit(groups)))

    def local(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("lm")
        give_back()
        z = zstandard.ZstdDecompressor()
        rows = sorted((t, x) for b in batches for x, t in zip(b.column("ids").to_pylist(), b.column("tie").to_pylist(), strict=True))
        docs = [np.frombuffer(z.decompress(x), dtype) for _, x in rows]
        del rows
        mine, _ = train_locally(_unpack(raw, p), docs, shared.value, rate)
        n = sum(map(len, docs))
        yield pa.RecordBatch.from_arrays([pa.array([(np.frombuffer(_pack(mine), "<f4").astype(np.float64) * n).tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([key[0].as_py()], pa.int64())], ["sum", "n", "grp"])

    # weights that start apart can't be averaged: one group gives all others their common start
    raw, rate = _pack(p), RATE
    for r in grouped.filter("grp = 0").groupBy("grp").applyInArrow(local, "sum binary, n long, grp long").collect():
        p = _unpack((np.frombuffer(bytes(r["sum"])) / max(1, r.n)).astype("<f4").tobytes(), p)
    raw, rate = _pack(p), RATE * LATER_RATE
    each = cut(grouped.filter("grp > 0").groupBy("grp").applyInArrow(local, "sum binary, n long, grp long"), "weights", free=True)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(n_weights), 0
        for _, x, k in sorted((g, x, k) for b in batches for x, k, g in zip(*(b.column(c).to_pylist() for c in ("sum", "n", "grp")), strict=True)):
            total, n = total + np.frombuffer(x), n + k
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([key[0].as_py()], pa.int64())], ["sum", "n", "part"])

    few = max(1, math.isqrt(groups))
    sums = sorted(each.withColumn("part", F.col("grp") % few).groupBy("part").applyInArrow(add, "sum binary, n long, part long").collect(), key=lambda x: x.part)
    n = sum(x.n for x in sums)
    shared.unpersist()
    return _unpack((sum(np.frombuffer(bytes(x["sum"])) for x in sums) / n).astype("<f4").tobytes(), p) if n else p


def embedded(p: dict[str, np.ndarray], table: Table) -> np.ndarray:
    """Every id, and none, as attention reads it, but for its place."""
    return np.vstack([p["class"][table.cls] + p["bucket"][np.arange(table.n_ids) % BUCKETS], p["class"][CLASSES] + p["bucket"][0]]).astype(np.float32)


def pairs_of(ids: list[np.ndarray], table: Table) -> tuple[np.ndarray, ...]:
    """The ids of all arrays one after the other, the id before each (n_ids: none), its array's number, and the pair's place in ``table``."""
    size = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype(np.int64)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[np.cumsum(size) - size] = table.n_ids
    return flat, before, np.repeat(np.arange(len(ids)), size), table.places(before * table.n_ids + flat)


def log_probabilities(ids: list[np.ndarray], p: dict[str, np.ndarray], table: Table, pairs: tuple | None = None, vectors: np.ndarray | None = None, room: Room | None = None) -> np.ndarray:
    """Natural log probability of each id array; every id is scored once, behind CONTEXT ids or more where there are.

    ``pairs_of`` the arrays and the ``embedded`` ids are computed where they aren't given.
    """
    flat, before, of_id, places = pairs or pairs_of(ids, table)
    vectors, room = embedded(p, table) if vectors is None else vectors, room or Room()
    _, first, doc, start, end = _placed(ids)
    wanted, place, joined = table.cls.take(flat), np.arange(WINDOW), joined_of(p)
    inside = np.bincount(of_id, table.log_inside_at(places, before, flat), len(ids))

    out = np.zeros(len(first))
    for i in range(0, len(first), SCORED_WINDOWS):
        of = slice(i, i + SCORED_WINDOWS)
        f, e = first[of, None], end[of, None]
        at, heads = f + place, np.flatnonzero(first[of] == start[of])
        own, n, last = beside(at, heads), len(at), np.concatenate([e, e[heads]])
        scored = own < last
        scored[n:, CONTEXT:] = False
        last -= 1
        np.minimum(at, e - 1, out=at)
        np.minimum(own, last, out=own)
        x = room("x", len(scored), WINDOW, DIM)
        np.take(vectors, before.take(at), axis=0, out=x[:n], mode="clip")
        x[:n] += p["place"]
        with_heads(x, n, heads)
        h, logits, prior = forward(p, x, CONTEXT, room, len(heads), joined)[-1], *(room(k, *scored.shape, CLASSES) for k in ("logits", "prior"))
        np.take(table.prior, before.take(own), axis=0, out=prior, mode="clip")
        _times(h, p["logit"], logits)
        logits += prior
        _at_most(logits, 60)
        lp = logits.reshape(-1).take(np.arange(0, logits.size, CLASSES) + wanted.take(own).ravel())
        np.exp(logits, out=logits)
        lp -= np.log(_flat(logits) @ np.ones(CLASSES, np.float32))
        sums = (lp.reshape(scored.shape) * scored).sum(axis=1, dtype=np.float64)
        out[of] = sums[:n]
        out[i + heads] += sums[n:]
    return inside + np.bincount(doc, out, len(ids))


def unheld(pairs: tuple, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the id array, key and count of the pairs in it that ``table`` doesn't hold, of ``pairs_of`` the arrays."""
    flat, before, doc, places = pairs
    at = np.flatnonzero(places < 0)
    distinct, of = np.unique(before[at] * table.n_ids + flat[at], return_inverse=True)
    pair, tf = np.unique(doc[at] * max(1, len(distinct)) + of, return_counts=True)
    return pair // max(1, len(distinct)), distinct[pair % max(1, len(distinct))], tf


def model_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """row and the model's log10 probability of every row of ``docs`` (row, doc_id, text)."""
    path = path or vocabulary_path()
    words = _encoder(path)
    ids = cut(encoded(docs, path), "ids")
    starts = np.array([int((words.tokenizer.id_to_token(i) or "").startswith("Ġ")) for i in range(words.n_ids)])
    dtype = words.dtype
    table, rare = table_of(cut(pair_counts(ids, words.n_ids, dtype), "pairs", free=True), starts)
    p = train(ids, initial(), table, dtype)
    packed, shared, all_held = _pack(p), docs.sparkSession.sparkContext.broadcast(table), rare is None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("lm")
        give_back()
        z, q, room = zstandard.ZstdDecompressor(), _unpack(packed, p), Room()
        vectors = embedded(q, shared.value)
        rows: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            r, pairs = np.array(rows, np.int64), pairs_of(held, shared.value)
            lp = log_probabilities(held, q, shared.value, pairs, vectors, room) / math.log(10)
            # the row itself, under a key of its own, and its pairs that the table lacks
            cols = [r, -1 - r, np.zeros(len(r), np.int64), lp]
            if not all_held:
                doc, key, tf = unheld(pairs, shared.value)
                cols = [np.r_[x, y] for x, y in zip(cols, (r[doc], key, tf, np.zeros(len(key))), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["row", "key", "tf", "score"])

        for b in batches:
            for r, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(z.decompress(x.as_buffer()), dtype)
                if held and n + len(ids) > SCORED_IDS:
                    yield out()
                    rows, held, n = [], [], 0
                rows.append(r), held.append(ids)
                n += len(ids)
        if held:
            yield out()

    scored = ids.select("row", "ids").mapInArrow(giving_back(score), "row long, key long, tf long, score double")
    if all_held:
        return scored.select("row", "score")
    more = F.sum(F.col("tf") * F.coalesce("more", F.lit(0))) / (PARTS * math.log(10))
    return scored.join(rare, F.col("key") == F.col("__key"), "left").groupBy("row").agg((F.sum("score") + more).alias("score"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    # written once with its numbers: they join scores to rows however often a task runs
    numbered = cut(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    base, n = base_scores(numbered)
    model = model_scores(numbered)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    named = numbered.select("row", "doc_id", (remainder == 0).alias("held_out"))
    return named.join(base, "row").join(model, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
