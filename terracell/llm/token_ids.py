"""Token ids in a binary format of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents.  It is cut into blocks of 1024 ids; a
block stores its minimum, and the differences to it packed at the width that a
percentile of them needs; the others are stored whole in an exception list.  An index
has the start of each block in the packed words, so any block can be read alone.

Packing is vertical: a block is 32 rows of 32 lanes, and each lane packs its own 32
values into ``width`` words, so packing and unpacking are a few numpy operations per row
for all blocks of one width at once.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas._libs.hashtable import Int64Factorizer
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import new_path
from .vectext import chunks, give_back, run_codes, text_buffers, tidy

#: Format constants (fixed values): magic, version, rows and lanes of a block.
MAGIC, VERSION, ROWS, LANES = b"PFOR", 1, 32, 32
BLOCK = ROWS * LANES
#: Share of a block's values whose width is packed; the rest may become exceptions.
PERCENTILE = 0.98
#: Ids after which a segment ends; a document is never split.
SEGMENT_IDS = 1 << 18
#: End of a document (fixed value of the contract).
END_ID = 2
#: Bytes of text encoded at once.
CHUNK_BYTES = 2 << 20
#: Parts written for each shuffle partition: a part is sorted by one task and sent to Python in few batches, so it is kept small.
PARTS_PER_PARTITION = 4
#: Distinct text pieces whose ids a worker remembers.
CACHE_PIECES = 600_000

_HEADER = struct.Struct("<4sHHQII")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of non-negative integers below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode_pfor(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Packs unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    x = padded.reshape(blocks, BLOCK)
    low = x.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = x - low[:, None]
    place = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _bits(np.partition(rest, place, axis=1)[:, place]) if blocks else np.zeros(0, np.uint8)
    outlier = _bits(rest) > width[:, None]
    block, position = np.nonzero(outlier)
    values = rest[block, position]
    rest[outlier] = 0
    start = np.concatenate(([0], np.cumsum(width.astype(np.uint64) * LANES))).astype("<u8")
    words = np.zeros(int(start[-1]), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            words[(start[which].astype(np.int64)[:, None] + np.arange(int(w) * LANES)).ravel()] = _pack(rest[which].reshape(-1, ROWS, LANES), int(w)).ravel()
    counts = np.bincount(block, minlength=blocks).astype("<u2")
    parts = [low.astype("<u4"), width, counts, start, words.astype("<u4"), position.astype("<u2"), values.astype("<u4")]
    return _HEADER.pack(MAGIC, VERSION, BLOCK, n, blocks, len(values)) + b"".join(p.tobytes() for p in parts)


def _pack(x: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(x), w + 1, LANES), np.uint32)
    for r in range(ROWS):
        word, shift = divmod(r * w, 32)
        out[:, word] |= x[:, r] << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= x[:, r] >> np.uint32(32 - shift)
    return out[:, :w]


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    mask = np.uint32((1 << w) - 1)
    out = np.empty((len(words), ROWS, LANES), np.uint32)
    for r in range(ROWS):
        word, shift = divmod(r * w, 32)
        v = words[:, word] >> np.uint32(shift)
        if shift + w > 32:
            v = v | words[:, word + 1] << np.uint32(32 - shift)
        out[:, r] = v & mask
    return out


def decode_pfor(blob: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its blocks from ``first_block`` to before ``last_block``."""
    magic, version, size, n, blocks, outliers = _HEADER.unpack_from(blob)
    if magic != MAGIC or version != VERSION or size != BLOCK:
        raise ValueError("not a segment of packed ids")
    at = _HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    low, width, counts, start = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks + 1).astype(np.int64)
    words = take("<u4", int(start[-1]))
    position, values = take("<u2", outliers), take("<u4", outliers)
    a = min(first_block, blocks)
    b = blocks if last_block is None else max(a, min(last_block, blocks))
    out = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]):
        if w:
            which = np.flatnonzero(width[a:b] == w)
            lane_words = words[start[a + which][:, None] + np.arange(int(w) * LANES)].reshape(-1, int(w), LANES)
            out[which] = _unpack(lane_words, int(w)).reshape(-1, BLOCK)
    edge = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    s, e = int(edge[a]), int(edge[b])
    out[np.repeat(np.arange(b - a), counts[a:b]), position[s:e]] = values[s:e]
    out += low[a:b, None]
    return out.ravel()[: max(0, min(n, b * BLOCK) - a * BLOCK)]


# --- encoding ---------------------------------------------------------------------------------------------------------

#: Bytes that may begin white space beyond ASCII or a control that some libraries count as space.
_ODD = (0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3)
_ODD_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80"
_SIMPLE = re.compile(r"\x20?\S+")
#: Kinds of bytes: beyond ASCII, letter or digit, other mark, space, other ASCII white space.
_ALNUM, _MARK, _BLANK = 1, 2, 3
#: Flag beside the kind of bytes that may begin something unusual.
_SUSPECT = 8
_KIND = np.array([0 if b > 127 else 3 if b == 32 else 4 if 9 <= b <= 13 else 1 if chr(b).isalnum() else 2 for b in range(256)], np.uint8)


class Encoder:
    """Token ids of whole texts through the tokenizers library, each distinct piece encoded once.

    Texts are cut only where the pre-tokenizer always parts them: before a lone white space between two other characters,
    after it unless it is a space, and between an ASCII letter or digit and a following ASCII mark.  A text with unusual
    white space or a token that the vocabulary adds to the model's is one piece.

    What is remembered is bounded; when it is full, the pieces met most often since the last time stay, up to half of it.

    Pieces are looked up by fingerprint and then compared: by length and outer bytes, which are all bytes of pieces of up to 32, and
    longer ones byte by byte.  Should a fingerprint ever stand for two pieces, the texts of that chunk are encoded whole.
    """

    #: Pieces joined to one text for the tokenizers library, whose cost for a text grows faster than its length.
    joined = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._heed([t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content])

    def _heed(self, added: list[str]) -> None:
        """Gets ready for texts, in which the added tokens may occur."""
        self.added, tokens = added, [x.encode() for x in added]
        self.whole = re.compile(b"|".join([_ODD_SPACE, *map(re.escape, tokens)]))
        kind = _KIND.copy()
        kind[sorted({*_ODD, *(x[0] for x in tokens)})] += _SUSPECT
        self.kind = kind.tobytes()
        newline = self._flat(["\n"])
        self.newline = newline[0] if len(newline) == 1 else None
        self._start()

    def _flat(self, texts: list[str]) -> np.ndarray:
        return np.array([i for e in self.tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids], np.uint32)

    def _start(self) -> None:
        # An open-addressing table that numbers pieces in order of appearance; number 0 is the end of a document.
        self.numbers = Int64Factorizer(CACHE_PIECES)
        self.numbers.factorize(np.array([END_ID], np.int64))
        self.length, self.total = np.zeros(1 << 16, np.int32), 1
        self.begin = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 1
        self.ids[0], self.length[0] = END_ID, 1  # slot 0 ends a document
        self.shape, self.inner = np.zeros((2, 1 << 16), np.uint64), np.zeros((2, 1 << 16), np.uint64)
        self.bytes, self.met = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.long: dict[int, bytes] = {}

    def _forget(self) -> None:
        """Keeps the pieces met most often since the last time, up to half of what is remembered."""
        met = self.met[1 : self.total]
        least = max(2, int(np.partition(met, -(CACHE_PIECES // 2))[-(CACHE_PIECES // 2)]) + 1)
        kept = np.concatenate(([0], 1 + np.flatnonzero(met >= least)))
        codes = self.numbers.uniques.to_array()[kept]
        self.numbers = None  # before there is another
        self.numbers = Int64Factorizer(CACHE_PIECES)
        self.numbers.factorize(codes)
        self.total, size = len(kept), self.length[kept].astype(np.int64)
        begin = np.cumsum(size) - size
        self.used = int(size.sum())
        self.ids[: self.used] = self.ids[np.arange(self.used) + np.repeat(self.begin[kept] - begin, size)]
        self.begin[: self.total], self.length[: self.total] = begin, size
        for x in (self.bytes, *self.shape, *self.inner):
            x[: self.total] = x[kept]
        self.met[:] = 0
        self.long = {new: self.long[old] for new, old in enumerate(kept.tolist()) if old in self.long}

    def _learn(self, pieces: list[bytes], plain: list[bool]) -> None:
        """Ids of the pieces with the next numbers; plain ones are known to be simple."""
        text = [None if known else p.decode() for p, known in zip(pieces, plain)]
        simple = [i for i, p in enumerate(text) if p is None or _SIMPLE.fullmatch(p) and not any(x in p for x in self.added)]
        # A line feed between such pieces is always an id of its own, so many are encoded in one call and parted there.
        parts = [b"\n".join([pieces[i] for i in simple[a : a + self.joined]]).decode() for a in range(0, len(simple), self.joined)]
        gap = np.array([self.newline or 0], np.uint32)
        calls = (self.tokenizer.encode_batch(parts[a : a + 256], add_special_tokens=False) for a in range(0, len(parts), 256))
        joined = np.concatenate([x for found in calls for e in found for x in (gap, np.array(e.ids, np.uint32))][1:]) if parts else gap[:0]
        edge = np.flatnonzero(joined == self.newline)
        if self.newline is None or len(edge) != len(simple) - 1:
            simple, joined, edge = [], joined[:0], edge[:0]
        alone = sorted(set(range(len(pieces))) - set(simple))
        found = [e.ids for e in self.tokenizer.encode_batch([pieces[i].decode() for i in alone], add_special_tokens=False)]
        part = np.diff(np.concatenate(([-1], edge, [len(joined)]))) - 1 if simple else np.zeros(0, np.int64)
        order = np.array(simple + alone, np.int64)
        size = np.concatenate([part, np.fromiter(map(len, found), np.int64, len(found))]).astype(np.int64)
        flat = np.concatenate([joined[joined != self.newline] if simple else joined, np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found)))]).astype(np.uint32)
        count = len(pieces)
        slot = self.total + order
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.total + count > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.length, np.zeros_like(self.length)])
            self.bytes, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bytes, self.met))
            self.shape, self.inner = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.shape, self.inner))
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[slot] = self.used + np.cumsum(size) - size
        self.length[slot] = size
        self.used += len(flat)
        self.total += count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, each with the end id; ids of each document)."""
        n_docs, n = len(offsets) - 1, len(data)
        raw = data.tobytes()
        cut = np.zeros(n + 1, bool)
        flagged = np.frombuffer(raw.translate(self.kind), np.uint8)
        kind, suspect = flagged & (_SUSPECT - 1), flagged >= _SUSPECT
        if n > 2:
            alone = (kind[1:-1] >= _BLANK) & (kind[:-2] < _BLANK) & (kind[2:] < _BLANK)
            last = offsets[1:] - 1
            last = last[(last >= 1) & (last < n - 1)]
            alone[last - 1] = False
            first = offsets[:-1]
            first = first[(first >= 1) & (first < n - 1)]
            alone[first - 1] = False
            cut[1 : n - 1] = alone
            cut[2:n] |= alone & (kind[1:-1] > _BLANK)
            cut[1:n] |= (kind[1:] == _MARK) & (kind[:-1] == _ALNUM)
            odd = np.unique(np.searchsorted(offsets, np.flatnonzero(suspect), "right") - 1)
            for d in odd.tolist():
                if self.whole.search(data[offsets[d] : offsets[d + 1]]):
                    cut[offsets[d] : offsets[d + 1]] = False
        cut[offsets[:-1]] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        codes = run_codes(data, start, end) if len(start) else np.zeros(0, np.uint64)
        if self.total > CACHE_PIECES:
            self._forget()
        slots = self.numbers.factorize(codes.view(np.int64))
        # Numbers grow with each first appearance, so new pieces are where the running maximum rises.
        highest = np.maximum.accumulate(np.concatenate(([self.total - 1], slots)))
        new = np.flatnonzero(highest[1:] > highest[:-1])
        bytes_at = np.ndarray(n + 1, "<u8", raw + bytes(8), strides=(1,))
        piece = end - start
        head, tail = bytes_at[start], bytes_at[np.maximum(start, end - 8)]
        short, long = np.flatnonzero(piece < 8), np.flatnonzero(piece > 16)
        head[short] &= (np.uint64(1) << (piece[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        # The bytes behind a short piece are not its own.
        tail[short] = 0
        second, third = bytes_at[start[long] + 8], bytes_at[end[long] - 16]
        longest = long[piece[long] > 32]
        if len(new):
            first = self.total
            # Pieces are simple without a second look if nothing but their first byte is a space, which does not stand alone.
            unusual = np.flatnonzero((kind > _BLANK) | (kind == _BLANK) & ~cut[:-1] | suspect)
            plain = (np.searchsorted(unusual, start[new]) == np.searchsorted(unusual, end[new])) & ((kind[start[new]] != _BLANK) | (piece[new] > 1))
            self._learn([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())], plain.tolist())
            self.shape[:, first : self.total] = head[new], tail[new]
            self.bytes[first : self.total] = piece[new]
            at = np.flatnonzero(slots[long] >= first)
            self.inner[:, slots[long[at]]] = second[at], third[at]
            for i in longest[slots[longest] >= first].tolist():
                self.long.setdefault(int(slots[i]), raw[start[i] : end[i]])
        alike = (self.shape[0][slots] == head).all() and (self.shape[1][slots] == tail).all() and (self.bytes[slots] == piece).all()
        alike = alike and (self.inner[0][slots[long]] == second).all() and (self.inner[1][slots[long]] == third).all()
        if not alike or any(self.long[k] != raw[a:b] for k, a, b in zip(slots[longest].tolist(), start[longest].tolist(), end[longest].tolist())):
            return self._whole(raw, offsets)
        self.met[: self.total] += np.bincount(slots, minlength=self.total)
        # Documents without bytes share the start of the next one; their only id is the end id.
        doc_first = np.searchsorted(start, offsets)
        slots = np.insert(slots, doc_first[1:], 0)
        size = self.length[slots].astype(np.int64)
        ends = np.cumsum(size)
        gather = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[slots] - (ends - size), size)
        closing = doc_first[1:] + np.arange(n_docs)
        per_doc = np.diff(np.concatenate(([0], ends[closing])))
        return self.ids[gather], per_doc

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], add_special_tokens=False)
        ids = [np.append(np.array(e.ids, np.uint32), np.uint32(END_ID)) for e in found]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.fromiter(map(len, ids), np.int64, len(ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own and no more
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_SEGMENT = "part int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_segments(docs: DataFrame, tokenizer_path: str, out: str, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every whole text and writes the ids to ``out`` in ascending order of ``doc_id``.

    ``out`` is a folder of Parquet files: a row is a segment, with its place (part, segment, ids of the part
    before it), its documents and their lengths, and the packed ids.  Spark's commit protocol makes a lost or repeated task harmless.

    Null and empty texts have the end id only.  Null ids come first; rows with equal ids follow one another by length of text
    and a hash of it, and may be in several parts.  Other columns are ignored.  An empty table writes an empty folder.
    """
    n = PARTS_PER_PARTITION * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.length("text").asc(), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number, before = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held
            ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            doc_ids = [d for x in held for d in x[0]]
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                   pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([encode_pfor(ids)], pa.binary())]
            number, before, held = number + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays(row, ["part", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"])

        size = 0
        for b in batches:
            for c in chunks(b, "text", CHUNK_BYTES):
                ids, lengths = e.encode(*text_buffers(c.column("text")))
                give_back()
                held.append((c.column("doc_id").to_pylist(), ids, lengths))
                size += len(ids)
                if size >= segment_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ordered.mapInArrow(tidy(run), _SEGMENT).write.parquet(out)


def read_segments(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a folder of :func:`write_segments`, from the packed ids.

    start: ids of all documents before it.  Null ids, repeated ids and texts without ids come back as they were written; an empty folder gives no rows.
    The window runs over one row per written part; their number is that of the
    writer's tasks, so these rows are broadcast and the packed ids are read where they lie.
    """
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(base), segments["part"] == base["_part"]).select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, doc_ids, lengths, payload = (b.column(k)[i] for k in range(4))
                ids = memoryview(decode_pfor(payload.as_py()).astype("<u4").tobytes())
                size = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
                end = np.cumsum(size)
                first = end - size
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(first.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first + start.as_py()), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    """Contract query: encode, write, read back."""
    out = new_path(spark, "token-ids")
    write_segments(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary(), out)
    return read_segments(spark, out)
