"""Token-ID output: documents as id arrays in a block file format with a shared zstandard dictionary.

File format (one Parquet row is one block file; any store Spark writes to will do)
* ``part``, ``block``: order of the blocks; ascending pairs hold ascending doc_ids.
* ``dict_hash``: sha256 of the shared dictionary, which lies beside the blocks and is trained on serialized id arrays.
* ``doc_ids``, ``offsets``, ``n_tokens``: the index. ``payload[offsets[i]:offsets[i + 1]]`` is the zstandard frame of
  document i alone, so that one short document is read without its neighbours.
* ``first``: ids before the block within its part.
A frame holds the ids as little-endian unsigned 16-bit integers (32-bit where the vocabulary needs it).

Documents are dealt out by range of doc_id before encoding, so ascending order costs one shuffle of the texts and no
task sees more than its range. Positions across parts need one sum for each part.

Defined results of the odd cases
* null or empty text: only the end id. null doc_id: first in order. Repeated rows and equal doc_ids: each row is
  written; ties are ordered by the text's hash. Very long texts: whole, one frame each.
* empty table: no blocks, an empty result. Extra columns: not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import forget_others, give_back, giving_back, read, remember, shared_dir, slices_of, width

END_ID = 2
BLOCK_BYTES = 4 << 20
#: Documents and ids of each that the dictionary is trained on, at most; it shapes sizes only, never results.
DICT_DOCS, DICT_IDS, DICT_BYTES = 1_000, 8_192, 64 << 10
#: Half the pieces that an encoder remembers (some 60 bytes each); of a full memory those that have recurred are kept.
CACHE_PIECES = 250_000
#: Characters of texts whose pieces are looked up, and learned, at once.
GROUP_CHARS = 1 << 19
#: Pieces of at most so many bytes are told apart by two integers, which hold those bytes and their number.
KEY_BYTES = 15

BLOCKS = "part int, block int, first long, dict_hash string, doc_ids array<long>, offsets array<int>, n_tokens array<long>, payload binary"

#: The byte-level pre-tokenizer's pieces for texts of the plain range, where Python's classes agree with the library's.
_PIECE = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x00\x1c-\x1f\x85²³¹¼½¾]|[^\x00-ɏ]")
_ODD_BYTES = "\x00\x1c\x1d\x1e\x1f\x85²³¹¼½¾".encode("latin-1")

#: Classes of characters that pieces are cut by; the zero byte stands behind each text.
LETTER, DIGIT, OTHER, BLANK, MARK = range(5)


def _class_of(char: str) -> int:
    return next(k for k, x in ((LETTER, r"[^\W\d_]"), (DIGIT, r"\d"), (BLANK, r"\s"), (OTHER, "")) if re.match(x, char))


#: Of every byte (those of longer characters count as letters), and of characters that begin with C2 or C3 by their second byte.
_CLASS = np.array([MARK, *map(_class_of, map(chr, range(1, 128))), *[LETTER] * 128], np.uint8)
_WIDE = np.array([[LETTER] * 128 + [_class_of(bytes([lead, x]).decode()) for x in range(128, 192)] + [LETTER] * 64 for lead in (0xC2, 0xC3)], np.uint8)
#: What an integer of eight bytes keeps of a piece's first, and of its next, bytes by the piece's size.
_LOW, _HIGH = (np.array([(1 << 8 * min(8, max(0, n - less))) - 1 for n in range(KEY_BYTES + 1)], np.uint64) for less in (0, 8))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_plain(text: str) -> bool:
    """Whether ``text`` stays in the range where the pieces agree."""
    if "<|" in text:
        return False
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.search(text)
    return len(raw.translate(None, _ODD_BYTES)) == len(raw)


def groups_of(texts: list[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; a longer text is one by itself."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _cut(b: np.ndarray, n: int) -> np.ndarray:
    """Starts of the pieces in the first ``n`` bytes of ``b``, which are plain texts with a zero byte behind each.

    As ``_PIECE`` cuts: a run of one class is a piece, the last blank of a run goes with what follows it or stands alone.
    """
    c = _CLASS[b[:n]]
    wide = np.flatnonzero((b[:n] & 0xFE) == 0xC2)
    if len(wide):
        kind = _WIDE[b[wide] & 1, b[wide + 1]]
        wide, kind = wide[kind != LETTER], kind[kind != LETTER]
        c[wide] = c[wide + 1] = kind
    start = np.ones(n, bool)
    np.not_equal(c[1:], c[:-1], out=start[1:])
    start |= c == MARK
    last = (c[:-1] == BLANK) & (c[1:] < BLANK)
    start[:-1] |= last
    start[1:] &= ~(last & (b[: n - 1] == 32))
    if len(wide):  # the blank of two bytes
        at = np.flatnonzero(last & (b[: n - 1] == 0xA0))
        start[at], start[at - 1] = False, True
    at = np.flatnonzero((b[:n] == 39) & start)
    if len(at):
        one, two = b[at + 1], b[at + 2]
        size = 2 * ((one == 115) | (one == 116) | (one == 109) | (one == 100)) + 3 * ((((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108)))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        start[at + size] = True
    return np.flatnonzero(start)


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of ``size`` from ``at`` on, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _value(at, size):
    """One integer for the ids of a piece: never 0, and growing with ``at``."""
    return (at + 1) << 32 | size


def _parts_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (value >> np.uint64(32)).astype(np.int64) - 1, (value & np.uint64((1 << 32) - 1)).astype(np.int64)


def _sorted(low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of pieces without a value, equal ones together, and which of them are the first of their kind."""
    new = np.flatnonzero(value == 0)
    order = new[np.lexsort((high[new], low[new]))]
    return order, np.r_[np.ones(min(1, len(order)), bool), (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])]


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of pieces.

    A byte-level BPE merges inside pre-tokenizer pieces only, so a piece's ids don't depend on its neighbours. Texts
    with characters outside the plain range, or with what may be a special token, are encoded whole.

    A piece of up to KEY_BYTES bytes stands in ``table`` as those bytes themselves, in the first slot from its own on that was
    free, beside its value: where its ids begin in ``flat`` and how many they are. Longer pieces are few and in a dictionary.
    The mark behind a text is a piece whose id is the end id.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES, end: int = END_ID, tokenizer=None):
        """``tokenizer``: that of ``path``, if there is one already."""
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer or Tokenizer.from_file(path)
        # the same model (held once) over lines: pieces that are known to be pieces needn't be cut again
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if n <= 65_536 else np.dtype("<u4")
        self.end = np.array([end], self.dtype).tobytes()
        # the vocabulary's characters for bytes: the printable ones are themselves, the others those from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = np.zeros(256, "<u4")
        self.shown[shown] = shown
        self.shown[self.shown == 0] = 256 + np.arange(256 - len(shown))
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self.forget()
        give_back()  # what reading the vocabulary took

    def forget(self) -> None:
        """Frees the remembered pieces."""
        self._start(np.array([[0, 1 << 56, _value(0, 1)]], np.uint64), np.frombuffer(self.end, self.dtype))

    def _start(self, rows: np.ndarray, flat: np.ndarray) -> None:
        """Remember the pieces ``rows`` with the ids ``flat``, and no others."""
        self.flat, self.n_flat, self.n, self.long = flat, len(flat), 0, {}
        self.table, self.seen = np.zeros((1 << 12, 3), np.uint64), np.zeros(1 << 12, bool)
        self._enter(rows)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _look(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of the pieces with these bytes, 0 of those that aren't known."""
        slot = self._slot(low, high)
        row = self.table.take(slot, axis=0)  # faster than by index
        open_ = np.flatnonzero(((row[:, 0] != low) | (row[:, 1] != high)) & (row[:, 1] != 0))
        while len(open_):
            slot[open_] = at = (slot[open_] + 1) % len(self.table)
            row[open_] = met = self.table.take(at, axis=0)
            open_ = open_[((met[:, 0] != low[open_]) | (met[:, 1] != high[open_])) & (met[:, 1] != 0)]
        self.seen[slot] = True
        return row[:, 2].copy()

    def _enter(self, rows: np.ndarray) -> None:
        """Give the distinct pieces ``rows`` (bytes and value), which have none, slots."""
        self.n += len(rows)
        if 5 * self.n > 3 * len(self.table):
            held, seen = self.table[at := np.flatnonzero(self.table[:, 1])], self.seen[at]
            slots = 2 * len(self.table)
            while 5 * self.n > 3 * slots:
                slots *= 2
            self.table, self.seen = np.zeros((slots, 3), np.uint64), np.zeros(slots, bool)
            self.seen[self._put(held)] = seen
        self.seen[self._put(rows)] = False

    def _put(self, rows: np.ndarray) -> np.ndarray:
        slot, open_ = self._slot(rows[:, 0], rows[:, 1]), np.arange(len(rows))
        while len(open_):
            at = slot[open_]
            free = np.flatnonzero(self.table[at, 1] == 0)
            self.table[at[free]] = rows[open_[free]]
            open_ = open_[self.table[at, 2] != rows[open_, 2]]  # the others' slots are taken; values differ
            slot[open_] = (slot[open_] + 1) % len(self.table)
        return slot

    def _drop(self) -> None:
        """Forget the pieces that haven't recurred since the last time, or all if those that have are too many."""
        rows = self.table[self.seen & (self.table[:, 2] > np.uint64(_value(0, 1)))]
        if len(rows) > self.most:
            return self.forget()
        at, size = _parts_of(rows[:, 2])
        ids = self.flat[_spread(at, size)]
        self.forget()
        self._add(rows[:, 0], rows[:, 1], size, ids)

    def _add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = self._keep(ids) + np.cumsum(size) - size
        value = _value(at, size).astype(np.uint64)
        self._enter(np.stack([low, high, value], axis=1))
        return value

    def _keep(self, ids: np.ndarray) -> int:
        """Put ``ids`` behind the others in ``flat``; returns where."""
        at, self.n_flat = self.n_flat, self.n_flat + len(ids)
        if self.n_flat > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(self.n_flat // 2 + len(ids), self.dtype)])
        self.flat[at : self.n_flat] = ids
        return at

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merged(self, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of the pieces at ``start`` in ``b``, and all their ids: a hundred pieces are one text of lines."""
        ends = np.cumsum(size + 1)
        lines = np.full(ends[-1], 10, "<u4")
        lines[_spread(ends - size - 1, size)] = self.shown[b[_spread(start, size)]]
        cuts = np.unique(np.r_[0, ends[99::100], ends[-1]])
        texts = [lines[i : j - 1].tobytes().decode("utf-32-le") for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        ids = np.concatenate([np.array(e.ids, self.dtype) for i in range(0, len(texts), 64) for e in self.lines.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)])
        # ids stand for as many bytes as their tokens have characters
        done, wanted = np.cumsum(self.bytes_of[ids]), np.cumsum(size)
        last = np.searchsorted(done, wanted)
        if len(done) == 0 or done[-1] != wanted[-1] or (done[last] != wanted).any():
            raise ValueError("the vocabulary lacks a byte")
        return np.diff(last, prepend=-1), ids

    def _values(self, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Values of the pieces at ``start`` in ``b``; those that aren't known are learned."""
        short = np.minimum(size, KEY_BYTES)
        eight = np.ndarray(len(b) - 7, "<u8", b, strides=(1,))
        low, high = eight[start] & _LOW[short], eight[start + 8] & _HIGH[short] | size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > KEY_BYTES)
        low[long], high[long] = 0, 1 << 56  # as the mark
        value = self._look(low, high)
        order, first = _sorted(low, high, value)
        if self.n + len(self.long) + np.count_nonzero(first) > 2 * self.most:
            self._drop()
            value = self._look(low, high)
            order, first = _sorted(low, high, value)
        if len(order):
            at = order[first]
            value[order] = self._add(low[at], high[at], *self._merged(b, start[at], size[at]))[np.cumsum(first) - 1]
        if len(long):
            keys = [b[i : i + n].tobytes() for i, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
            at = [long[i] for k, i in {k: i for i, k in enumerate(keys)}.items() if k not in self.long]
            if at:
                n, ids = self._merged(b, start[at], size[at])
                begin = self._keep(ids) + np.cumsum(n) - n
                self.long.update(zip([b[i : i + k].tobytes() for i, k in zip(start[at].tolist(), size[at].tolist(), strict=True)], _value(begin, n).tolist(), strict=True))
            value[long] = [self.long[k] for k in keys]
        return value

    def plain(self, texts: list[str]) -> Iterator[bytes]:
        """Serialized ids of plain texts, with the end id."""
        raw = "\0".join([*texts, ""]).encode()
        b, n = np.frombuffer(raw + bytes(16), np.uint8), len(raw)
        start = _cut(b, n)
        at, size = _parts_of(self._values(b, start, np.diff(start, append=n)))
        ids = self.flat[_spread(at, size)].tobytes()
        ends = (np.cumsum(size)[b[start] == 0] * self.dtype.itemsize).tolist()
        return (ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text, with the end id."""
        out: list[bytes] = []
        for group in groups_of(texts):
            plain = [is_plain(t) for t in group]
            ids = self.plain([t for t, p in zip(group, plain, strict=True) if p]) if any(plain) else iter(())
            out += [next(ids) if p else self._whole(t) + self.end for t, p in zip(group, plain, strict=True)]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int = CACHE_PIECES) -> Encoder:
    """One encoder for each Python worker."""
    forget_others(f"tokens {path}")
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
        remember(f"tokens {path}", _encoders[path].forget)
    _encoders[path].most = most
    return _encoders[path]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """The shared dictionary, from about DICT_DOCS documents chosen by hash; empty where there is too little to train on."""
    n = docs.count()
    if not n:
        return b""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x[: DICT_IDS * enc.dtype.itemsize] for x in enc([t or "" for t in b.column(0).to_pylist()])], pa.binary())], ["ids"])

    share = max(1, n // DICT_DOCS)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(share)) == 0).select(F.substring("text", 1, 6 * DICT_IDS).alias("text")).limit(2 * DICT_DOCS)
    samples = sorted(bytes(r.ids) for r in chosen.mapInArrow(giving_back(sample), "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to train on
        return b""


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, cache_pieces: int = CACHE_PIECES) -> str:
    """Encode ``docs`` (doc_id, text) and write the blocks and the dictionary; returns the folder.

    ``cache_pieces`` trades the workers' memory (some 60 bytes each, twice as many) for encoding time.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    path = path or f"{shared_dir(spark)}/loomgraph-tokens-{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, vocabulary)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(vocabulary, cache_pieces), TaskContext.get().partitionId()
        z = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False)
        block = first = held = 0
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype(np.int32)
            cols = [[part], [block], [first], [digest], [ids], [offsets], [counts], [b"".join(frames)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "block", "first", "dict_hash", "doc_ids", "offsets", "n_tokens", "payload"])

        for b in batches:
            group = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // GROUP_CHARS
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                some = b.slice(i, j - i)
                for doc_id, raw in zip(some.column(0).to_pylist(), enc([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    frame = z.compress(raw)
                    if frames and held + len(frame) > BLOCK_BYTES:
                        yield flush()
                        give_back()
                        block, first, held = block + 1, first + sum(counts), 0
                        ids, frames, counts = [], [], []
                    ids.append(doc_id)
                    frames.append(frame)
                    counts.append(len(raw) // enc.dtype.itemsize)
                    held += len(frame)
        if frames:
            yield flush()

    order = ["doc_id", "__tie"]
    dealt = docs.withColumn("__tie", F.xxhash64("text")).repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(giving_back(encode), BLOCKS).write.parquet(f"{path}/blocks")
    return path


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").head()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary doesn't match its hash")
    return row.dict_hash, bytes(row.dictionary)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, vocabulary_ids: int = 50_257) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files at ``path``."""
    digest, dictionary = _dictionary(spark, path)
    dtype = np.dtype("<u2") if vocabulary_ids <= 65_536 else np.dtype("<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    starts, total = {}, 0
    for part, n in totals:
        starts[part], total = total, total + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                payload, offsets = memoryview(r["payload"]), r["offsets"]
                ids = [np.frombuffer(z.decompress(payload[a:e]), dtype).astype("<u4") for a, e in zip(offsets[:-1], offsets[1:], strict=True)]
                if [len(x) for x in ids] != r["n_tokens"]:
                    raise ValueError("a block's index doesn't match its frames")
                counts = np.array(r["n_tokens"], np.int64)
                start = starts[r["part"]] + r["first"] + np.cumsum(counts) - counts
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return blocks.select("part", "first", "dict_hash", "doc_ids", "offsets", "n_tokens", "payload").mapInArrow(giving_back(decode), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int, vocabulary_ids: int = 50_257) -> list[int]:
    """The ids of one document: its block is found by the index, and only its frame is decompressed."""
    _, dictionary = _dictionary(spark, path)
    dtype = np.dtype("<u2") if vocabulary_ids <= 65_536 else np.dtype("<u4")
    key = F.lit(doc_id).cast("long")
    at = F.array_position("doc_ids", key).cast("int")
    begin, end = F.get("offsets", at - 1), F.get("offsets", at)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    row = blocks.filter(F.array_contains("doc_ids", key)).select(F.substring("payload", begin + 1, end - begin).alias("frame")).head()
    if row is None:
        raise KeyError(doc_id)
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(z.decompress(bytes(row.frame)), dtype).tolist()


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(read(spark, sf_dir, "documents"), cache_pieces=600_000))
