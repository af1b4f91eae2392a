"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

Encoding passes a text through three states, each of bounded size: what may still become an added token, the piece
that the pre-tokenizer has not closed, and the bytes of that piece whose tokens may still change.  How many these can
be follows from the merge list: see :func:`sufficient_lookahead`.  A token that ends before the last so many bytes is
final and leaves the transducer, so a piece of any length takes constant memory.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import Encoder, public_vocabulary
from .vectext import chunks, give_back, text_buffers, tidy

#: Pieces of the byte-level pre-tokenizer (fixed values); white space is the Unicode property.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = r"\p{White_Space}"
_RUNS = {"letter": r"\p{L}", "number": r"\p{N}", "mark": rf"[^{_SPACE}\p{{L}}\p{{N}}]"}
_PIECE = regex.compile(
    rf"{_CONTRACTIONS}|" + "|".join(rf" ?(?P<{k}>{v}+)" for k, v in _RUNS.items()) + rf"|(?P<blank>{_SPACE}+)(?![^{_SPACE}])|{_SPACE}+"
)
#: The rest of a run that began before; of white space all but the last character before another one.
_REST = {k: regex.compile(f"(?:{v})*") for k, v in _RUNS.items()} | {"blank": regex.compile(rf"(?:{_SPACE}+(?![^{_SPACE}]))?")}
#: Characters behind a piece that decide whether it ends there: an apostrophe needs two.
PIECE_LOOKAHEAD = 2
#: Characters of a text taken at once.
FEED = 1 << 16
#: Bytes of text encoded at once.
CHUNK_BYTES = 2 << 20
#: An open piece is merged when it holds this many times the lookahead.
HOLD = 8
_NONE = np.int64(1) << np.int64(62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next one from U+0100."""
    out, n = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


class MergeList:
    """Ids, bytes and ranked merges of a byte-level vocabulary file.

    Files with anything that would change ids beyond the merges raise: normalizers, post-processors that add
    bytes, dropout, unknown tokens, prefixes of words, merges whose parts no earlier merge makes.
    """

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if spec["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in plain) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that depend on their surroundings")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.pairs: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
        made = {int(i): -1 for i in self.first}
        for rank, (a, b, ab) in enumerate(self.pairs):
            if a not in made or b not in made:
                raise ValueError(f"merge {rank} of {path} uses a part that no earlier merge makes")
            made.setdefault(ab, rank)
        self.size = size
        self.rule = {(a, b): (rank, ab) for rank, (a, b, ab) in reversed(list(enumerate(self.pairs)))}
        keys = np.array([a * size + b for a, b in self.rule], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in self.rule.values()], np.int64)[order], _NONE)
        self.makes = np.array([ab for _, _, ab in self.pairs], np.int64)
        self.lookahead = sufficient_lookahead(self.pairs, self.bytes)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def sufficient_lookahead(pairs: list[tuple[int, int, int]], bytes_of: list[bytes]) -> int:
    """Bytes that must follow a token before nothing that comes later can change it.

    More text can undo a token only through a chain of merges that moves to the left: it makes a merge (a, b) happen or
    not happen, where b begins at the border of what has changed, and then a has changed too.  The next merge of the chain has a higher
    rank, since the list is applied by rank and no merge has a part that only a later one makes; its right part begins where a began, so a
    is that part or the left part of it, or of its left part, and so on.  The border moves by the bytes of a each time, so the answer is the heaviest such chain, by
    one pass over the merges in order.
    """
    left: dict[int, set[int]] = {}
    for a, _, ab in pairs:
        left.setdefault(ab, set()).add(a)
    best: dict[int, int] = {}
    most = 0
    for a, b, _ in pairs:
        reach, parts = 0, [b]
        while parts:
            part = parts.pop()
            reach = max(reach, best.get(part, 0))
            parts += left.get(part, ())
        reach += len(bytes_of[a])
        best[a] = max(best.get(a, 0), reach)
        most = max(most, reach)
    return most


def merge_pieces(m: MergeList, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, ids of each): in every round each piece that is not done takes its lowest-ranked merge, the leftmost of equal ones."""
    count = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = m.first[np.frombuffer(b"".join(pieces), np.uint8)]
    nothing = np.flatnonzero(count == 0)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(nothing, count[nothing], symbols[:0])]
    which = np.flatnonzero(count)
    size = count[which]
    rank = _NONE * np.ones(len(symbols), np.int64)
    if len(symbols) > 1:
        rank[:-1] = m.ranks_of(symbols[:-1], symbols[1:])
    rank[np.cumsum(size) - 1] = _NONE
    while len(which):
        end = np.cumsum(size)
        start = end - size
        low = np.minimum.reduceat(rank, start)
        still = low < _NONE
        if not still.all():
            keep = np.repeat(still, size)
            done.append((which[~still], size[~still], symbols[~keep]))
            which, size, low, symbols, rank = which[still], size[still], low[still], symbols[keep], rank[keep]
            if not len(which):
                break
            end = np.cumsum(size)
            start = end - size
        hit = np.flatnonzero(rank == np.repeat(low, size))
        piece = np.searchsorted(end, hit, "right")
        at = hit[np.concatenate(([True], piece[1:] != piece[:-1]))]
        symbols[at] = m.makes[low]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # Positions once one symbol of each piece is gone.
        at = at - np.arange(len(at))
        symbols, rank, size = symbols[keep], rank[keep], size - 1
        end = np.cumsum(size)
        start = end - size
        for pos in (at, (at - 1)[at > start]):
            inner = pos[pos + 1 < end[np.searchsorted(end, pos, "right")]]
            rank[inner] = m.ranks_of(symbols[inner], symbols[inner + 1])
        last = at[at + 1 == end]
        rank[last] = _NONE
    which, size = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    flat = np.concatenate([d[2] for d in done])
    order = np.argsort(which, kind="stable")
    end = np.cumsum(size)
    out_size = size[order]
    out_end = np.cumsum(out_size)
    gather = np.arange(len(flat)) + np.repeat((end - size)[order] - (out_end - out_size), out_size)
    return flat[gather], out_size


def merge_window(m: MergeList, data: bytes) -> list[int]:
    """Ids of one long piece, by a heap of its merges."""
    symbol: list[int] = m.first[np.frombuffer(data, np.uint8)].tolist()
    n = len(symbol)
    before, after, rule = list(range(-1, n - 1)), list(range(1, n + 1)), m.rule
    heap = [(r[0], i, symbol[i], symbol[i + 1], r[1]) for i in range(n - 1) if (r := rule.get((symbol[i], symbol[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, ab = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue
        symbol[i], symbol[j], k = ab, -1, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if r := rule.get((ab, symbol[k])):
                heapq.heappush(heap, (r[0], i, ab, symbol[k], r[1]))
        h = before[i]
        if h >= 0 and (r := rule.get((symbol[h], ab))):
            heapq.heappush(heap, (r[0], h, symbol[h], ab, r[1]))
    return [s for s in symbol if s >= 0]


class BpeStream:
    """Encodes one text that arrives in parts: :meth:`feed` returns the ids that are final, :meth:`finish` the others."""

    def __init__(self, merges: MergeList):
        self.m = merges
        names = sorted(merges.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.longest = max(map(len, names), default=0)
        self.text = ""  # may still become an added token
        self.tail = ""  # not yet certain pieces
        self.run: str | None = None  # kind of the piece that is open in ``open``
        self.open = b""

    @property
    def held(self) -> int:
        """Bytes of text in the transducer."""
        return len(self.text.encode()) + len(self.tail.encode()) + len(self.open)

    def feed(self, text: str) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(text), FEED):
            out += self._feed(text[i : i + FEED], False)
        return np.concatenate(out)

    def finish(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self._feed("", True)])

    def _feed(self, text: str, last: bool) -> list[np.ndarray]:
        text, out, at = self.text + text, [], 0
        if self.special is not None:
            for hit in self.special.finditer(text):
                if not last and hit.end() > len(text) - self.longest + len(hit.group()):
                    break  # a longer token may begin here
                out += [*self._pieces(text[at : hit.start()], True), np.array([self.m.added[hit.group()]], np.int64)]
                at = hit.end()
        keep = len(text)
        if not last and self.longest:
            # What could be the beginning of an added token stays.
            tail = text[max(at, len(text) - self.longest + 1) :]
            keep -= next((len(tail) - i for i in range(len(tail)) if any(n.startswith(tail[i:]) or tail[i:].startswith(n) for n in self.m.added)), 0)
        self.text = text[keep:]
        return out + self._pieces(text[at:keep], last)

    def _pieces(self, text: str, last: bool) -> list[np.ndarray]:
        """Ids that are final after more text without added tokens."""
        buf, out, at = self.tail + text, [], 0
        sure = len(buf) if last else len(buf) - PIECE_LOOKAHEAD
        if self.run is not None:
            at = _REST[self.run].match(buf).end()
            at, closed = (at, True) if last or at <= sure else (max(0, sure), False)
            out += self._extend(buf[:at].encode(), closed)
            if not closed:
                self.tail = buf[at:]
                return out
            self.run = None
        pieces, tail = [], None
        for hit in _PIECE.finditer(buf, at):
            if hit.end() > sure:
                tail = hit
                break
            pieces.append(hit.group())
            at = hit.end()
        if pieces:
            out.append(self._closed(pieces))
        self.tail = buf[at:]
        # A long run goes on as an open piece; white space before its end is certain as long as more than one character of it follows.
        kind = tail.lastgroup if tail is not None else None
        if kind and sure - at > HOLD * self.m.lookahead:
            self.run, self.tail = kind, buf[sure:]
            out += self._extend(buf[at:sure].encode(), False)
        return out

    def _closed(self, pieces: list[str]) -> np.ndarray:
        raw = [p.encode() for p in pieces]
        long = [i for i, p in enumerate(raw) if len(p) > self.m.lookahead]
        if not long:
            return merge_pieces(self.m, raw)[0]
        out, at = [], 0
        for i in long:
            out += [merge_pieces(self.m, raw[at:i])[0], *self._extend(raw[i], True)]
            at = i + 1
        return np.concatenate([*out, merge_pieces(self.m, raw[at:])[0]])

    def _extend(self, data: bytes, closed: bool) -> list[np.ndarray]:
        """More bytes of the open piece, in steps of bounded size: all tokens that end before the lookahead are final."""
        out, step = [], HOLD * self.m.lookahead
        for i in range(0, len(data), step):
            self.open += data[i : i + step]
            if len(self.open) > step:
                ids = np.array(merge_window(self.m, self.open), np.int64)
                end = np.cumsum([len(self.m.bytes[k]) for k in ids.tolist()])
                n = int(np.searchsorted(end, len(self.open) - self.m.lookahead, "right"))
                out.append(ids[:n])
                self.open = self.open[int(end[n - 1]) if n else 0 :]
        if closed:
            out.append(np.array(merge_window(self.m, self.open), np.int64))
            self.open = b""
        return out


class Transducer:
    """Whole texts through :class:`BpeStream`, under the names by which :class:`~terracell.llm.token_ids.Encoder` calls an encoder of pieces."""

    class _Ids:
        def __init__(self, ids: np.ndarray):
            self.ids = ids

    def __init__(self, merges: MergeList):
        self.m = merges

    def encode(self, text: str) -> np.ndarray:
        s = BpeStream(self.m)
        return np.concatenate([s.feed(text), s.finish()])

    def encode_batch(self, texts: list[str], add_special_tokens: bool = False) -> list["Transducer._Ids"]:
        return [self._Ids(self.encode(t)) for t in texts]


class BpeEncoder(Encoder):
    """Batches of texts: parts between which the pre-tokenizer always cuts pass the transducer once and are remembered, up to a bound."""

    #: The transducer merges all pieces of a text at once.
    joined = 20_000

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.tokenizer = Transducer(self.merges)
        self._heed(list(self.merges.added))

    def _start(self) -> None:
        super()._start()
        self.length[0] = 0  # no end of document

    def _flat(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *map(self.tokenizer.encode, texts)]).astype(np.uint32)

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._flat([raw[a:b].decode()]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.fromiter(map(len, ids), np.int64, len(ids))


class TextState:
    """Bytes of tokens to text: holds at most the three bytes of a character that has not ended.

    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character, as if the whole were decoded at once.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a first byte: open if its character needs more bytes than there are and none of those is wrong
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if need > back and self._open(data[-back:]):
                    cut -= back
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _open(part: bytes) -> bool:
        """Whether some character begins with these bytes."""
        try:
            part.decode("utf-8")
        except UnicodeDecodeError as e:
            return e.reason == "unexpected end of data" and e.start == 0
        return False

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


_ENCODERS: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BpeEncoder(path)
    return _ENCODERS[path]


_MERGES: dict[str, MergeList] = {}


def encode_texts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, without special tokens at its ends; no shuffle.

    Null and empty texts have no ids.  Rows are independent of one another: repeated rows and null ids come back as
    they are, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for b in batches:
            for c in chunks(b, "text", CHUNK_BYTES):
                ids, size = e.encode(*text_buffers(c.column("text")))
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])
                give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, tokenizer_path: str, keep: list[str], ids: str = "ids", into: str = "text") -> DataFrame:
    """The ``keep`` columns, the ids and their text, special tokens included; a null list is an empty text, unknown and null ids are skipped.

    No shuffle; the tokens of a row pass the state machine in steps.
    """
    names = [*keep, ids]
    if into in names:
        raise ValueError(f"the rows have a column {into!r}")
    rows = rows.select(*[F.col(k) for k in names])
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names) + f", `{into}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _MERGES:
            _MERGES[tokenizer_path] = _ENCODERS[tokenizer_path].merges if tokenizer_path in _ENCODERS else MergeList(tokenizer_path)
        table = _MERGES[tokenizer_path].bytes
        known = range(len(table))
        for b in batches:
            at = b.schema.get_field_index(ids)
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                texts = []
                for row in c.column(at):
                    state, out = TextState(), []
                    values = row.values.fill_null(-1).to_numpy(zero_copy_only=False) if row.is_valid else ()
                    for j in range(0, len(values), FEED):
                        part = values[j : j + FEED].tolist()
                        if not 0 <= min(part) <= max(part) < len(table):
                            part = [k for k in part if k in known]
                        out.append(state.feed(b"".join(map(table.__getitem__, part))))
                    texts.append("".join([*out, state.finish()]))
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(texts, pa.string())], [*names, into])

    return rows.mapInArrow(tidy(run), schema)


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole text to ids and back, with digests of both."""
    path = public_vocabulary()
    ids = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    both = decode_ids(ids, path, ["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
