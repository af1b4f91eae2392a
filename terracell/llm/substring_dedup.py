"""Removal of word sequences that occur earlier, with an FM-index per shard.

1. The windows of a document are grouped into runs with the same anchor, the smallest
   fingerprint among the short word runs inside the window.  Equal windows have equal
   anchors, so a window whose anchor occurs once anywhere is unique and goes no further.
   Anchors and fingerprints choose what is searched where; they decide no repeat.
2. The other windows are material.  A task gathers a shard of it, indexes the shard, and
   streams its documents through the index by backward search: windows whose matching
   statistic reaches the window's length occur twice, those of one interval being equal; all
   but the earliest are repeats already.
3. The earliest ones travel to shards by content, by their anchor, or by the window itself for
   anchors with very many runs, so no shard grows with one passage.  Each of these
   shards is searched in the same way, and the runs of later windows are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .vectext import chunks, mix64, space_table, text_buffers, tidy, U64, windows, words, Words

_IS_WORD = space_table()
#: Words in a window (fixed value of the contract) and in the runs that anchors are chosen from.
WINDOW, ANCHOR = 20, 5
#: Words indexed together, unless one anchor has more; an anchor has fewer than HOT_RUNS runs there.
SHARD_WORDS = 1 << 19
#: Anchors with so many runs are hot: each of their windows chooses a shard of its own.
HOT_RUNS = 4096
#: Runs of one anchor in a chunk of documents that make it hot at once; only their number is shuffled by anchor.
CHUNK_RUNS = 32
#: A place is ``first window << 32 | windows``, with this bit for runs of hot anchors.
_HOT = 1 << 31
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def anchors(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, anchor) of every window, and the fingerprints of the short runs by first word."""
    n = len(w.code)
    at, code = windows(w, k)
    short = np.full(n + window, _TOP)
    short[at] = code
    low = short.copy()
    width, reach = window - k + 1, 1
    while reach < width:
        by = min(reach, width - reach)
        low[: len(low) - by] = np.minimum(low[: len(low) - by], low[by:])
        reach += by
    per = np.maximum(w.counts() - window + 1, 0)
    start = np.arange(int(per.sum())) + np.repeat(w.first[:-1] - (np.cumsum(per) - per), per)
    return start, low[start], short


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal values ends and the next begins, with 0 and the length."""
    n = len(columns[0])
    change = np.zeros(max(0, n - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [n])) if n else np.zeros(1, np.int64)


def _pieces(columns: list[np.ndarray], types: list[pa.DataType], names: list[str], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + rows], t) for c, t in zip(columns, types)], names)


def _anchored_runs(source: DataFrame, window: int, k: int) -> DataFrame:
    """``key, doc_id, place, here``: runs of windows with one anchor, keyed by it; a run that may repeat itself counts twice in ``here``.

    Where a chunk has many runs of an anchor, the first one stands for all and makes the anchor hot; the others have 0 in
    ``here`` and are keyed at large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                w = words(*text_buffers(c.column("text")), _IS_WORD)
                start, anchor, short = anchors(w, window, k)
                if not len(start):
                    continue
                row = np.searchsorted(w.first, start, "right") - 1
                edge = _runs(anchor, row)
                s, n = edge[:-1], np.diff(edge)
                # A run in which the anchor stands at two places may hold the same window twice.
                reach = n + window - k
                spot = np.arange(int(reach.sum())) + np.repeat(start[s] - (np.cumsum(reach) - reach), reach)
                inside = np.add.reduceat((short[spot] == np.repeat(anchor[s], reach)).astype(np.int64), np.cumsum(reach) - reach)
                anchor, doc, place, here = anchor[s], c.column("doc_id").to_numpy()[row[s]], ((start[s] - w.first[row[s]]) << 32) | n, np.minimum(inside, 2)
                order = np.argsort(anchor, kind="stable")
                edge = _runs(anchor[order])
                many = np.diff(edge) >= CHUNK_RUNS
                crowd = order[np.repeat(many, np.diff(edge))]
                key = anchor.copy()
                key[crowd], here[crowd] = mix64(doc[crowd].astype(U64) * U64(31) + place[crowd].astype(U64)), 0
                lead = order[edge[:-1][many]]
                key[lead], here[lead] = anchor[lead], HOT_RUNS
                yield from _pieces([key.view(np.int64), doc, place, here.astype(np.int32)], [pa.int64(), pa.int64(), pa.int64(), pa.int32()], ["key", "doc_id", "place", "here"])

    return source.mapInArrow(tidy(run), "key long, doc_id long, place long, here int")


def _repeated_runs(runs: DataFrame) -> DataFrame:
    """``doc_id, place``: the runs whose anchor occurs more than once, those of hot anchors marked."""
    times = F.sum("here").over(Window.partitionBy("key"))
    known = runs.withColumn("times", times).where("times > 1 or here = 0")
    hot = (F.col("here") == 0) | (F.col("times") >= HOT_RUNS)
    return known.select("doc_id", F.when(hot, F.col("place").bitwiseOR(F.lit(_HOT))).otherwise(F.col("place")).alias("place"))


def _judge(doc: np.ndarray, at: np.ndarray, n: np.ndarray, flat: np.ndarray, window: int) -> np.ndarray:
    """For every window of a shard's pieces, in the order given: 0 the earliest of its kind, 1 a later one, 2 the same place again.

    Pieces: ``n`` windows from window ``at`` of a document; ``flat`` has the word codes of all pieces, ``n + window - 1`` each.
    """
    size = n + window - 1
    source = np.cumsum(size) - size
    order = np.lexsort((at, doc))
    size, count = size[order], n[order]
    # A 0 after each piece ends matches.
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[inside + np.repeat(begin, size)] = np.unique(flat[inside + np.repeat(source[order], size)], return_inverse=True)[1] + 1
    which = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    length, interval = FMIndex(text, window).statistics(text, which + np.repeat(begin, count) + window)
    found = np.flatnonzero(length == window)
    # The documents were streamed in order, so the first window of an interval is the earliest.
    _, first, group = np.unique(interval[found], return_index=True, return_inverse=True)
    lead = found[first[group]]
    doc, at = np.repeat(doc[order], count), np.repeat(at[order], count) + which
    verdict = np.zeros(len(doc), np.int8)
    verdict[found] = np.where(found == lead, 0, np.where((doc[found] == doc[lead]) & (at[found] == at[lead]), 2, 1))
    out = np.empty_like(verdict)
    out[np.repeat((np.cumsum(n) - n)[order], count) + which] = verdict
    return out


class _Material:
    """Repeated-looking windows of some documents, gathered until they fill a shard."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k
        self.clear()

    def clear(self) -> None:
        self.words = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, c: pa.RecordBatch) -> None:
        places = c.column("places")
        if places.null_count == len(places):
            return
        w = words(*text_buffers(c.column("text")), _IS_WORD)
        start, low, _ = anchors(w, self.window, self.k)
        per = np.maximum(w.counts() - self.window + 1, 0)
        first_window = np.concatenate(([0], np.cumsum(per)))
        size = pa.compute.list_value_length(places).fill_null(0).to_numpy()
        flat = places.flatten().to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        at, n, hot = flat >> 32, flat & (_HOT - 1), (flat & _HOT) > 0
        # Runs of another row with the same id may reach past this text.
        end = np.minimum(at + n, per[owner])
        at = np.minimum(at, end)
        marks = np.zeros((2, len(start) + 1), np.int32)
        for mark, some in zip(marks, (np.ones(len(at), bool), hot)):
            np.add.at(mark, (first_window[owner] + at)[some], 1)
            np.add.at(mark, (first_window[owner] + end)[some], -1)
        used, single = np.cumsum(marks[:, :-1], axis=1) > 0
        use = np.flatnonzero(used)
        if not len(use):
            return
        row = np.searchsorted(w.first, start[use], "right") - 1
        edge = _runs(row, use - np.arange(len(use)))
        s, n = edge[:-1], np.diff(edge)
        size = n + self.window - 1
        spot = np.arange(int(size.sum())) + np.repeat(start[use[s]] - (np.cumsum(size) - size), size)
        key = np.where(single[use], windows(w, self.window)[1][use], low[use])
        doc = c.column("doc_id").fill_null(0).to_numpy()[row[s]]
        self.parts.append((doc, start[use[s]] - w.first[row[s]], n, (w.code[spot] >> U64(32)).astype(np.uint32), key, single[use]))
        self.words += len(spot)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Pieces of windows that are the earliest here, for the shards of their keys, and runs of later ones (without codes)."""
        if not self.parts:
            return
        doc, at, n, flat, key, single = (np.concatenate(x) for x in zip(*self.parts))
        self.clear()
        verdict = _judge(doc, at, n, flat, self.window)
        piece = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        word = inside + np.repeat(np.cumsum(n + self.window - 1) - (n + self.window - 1), n)
        key = np.where(verdict == 0, key, U64(0))
        edge = _runs(piece, verdict, key, np.where(single & (verdict == 0), np.arange(len(piece)), 0))
        s, m = edge[:-1], np.diff(edge)
        s, m = s[verdict[s] < 2], m[verdict[s] < 2]
        doc, at, later = doc[piece[s]], at[piece[s]] + inside[s], verdict[s] == 1
        keys = np.where(later, mix64(doc.astype(U64)), key[s]).view(np.int64)
        for i in range(0, len(s), 1 << 15):
            r = slice(i, i + (1 << 15))
            blobs = [None if x else flat[p : p + c + self.window - 1].tobytes() for p, c, x in zip(word[s[r]].tolist(), m[r].tolist(), later[r].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys[r]), pa.array(doc[r]), pa.array(at[r].astype(np.int32)), pa.array(m[r].astype(np.int32)), pa.array(blobs, pa.binary())], _PIECE_NAMES)


_PIECE_NAMES = ["key", "doc_id", "at", "n", "codes"]
_PIECE = "key long, doc_id long, at int, n int, codes binary"


def _material(joined: DataFrame, window: int, k: int) -> DataFrame:
    """``key, doc_id, at, n, codes``: pieces for the shards (n windows from window ``at``, word codes); without codes: n known repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Material(window, k)
        for b in batches:
            for c in chunks(b, "text"):
                held.add(c)
                if held.words >= SHARD_WORDS:
                    yield from held.rows()
        yield from held.rows()

    return joined.mapInArrow(tidy(run), _PIECE)


def _report(material: DataFrame, n: int, window: int) -> DataFrame:
    """``doc_id, place``: runs of repeated windows found by the shards, and those that were known."""

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        doc, at, count = (t.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "at", "n"))
        later = _judge(doc, at, count, np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint32), window) == 1
        piece = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        edge = _runs(piece, later)
        s, m = edge[:-1], np.diff(edge)
        s, m = s[later[s]], m[later[s]]
        yield from _pieces([doc[piece[s]], ((at[piece[s]] + inside[s]) << 32) | m], [pa.int64()] * 2, ["doc_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            has = pa.compute.is_valid(b.column("codes"))
            known = b.filter(pa.compute.invert(has))
            yield from _pieces([known.column("doc_id").to_numpy(), (known.column("at").to_numpy().astype(np.int64) << 32) | known.column("n").to_numpy()], [pa.int64()] * 2, ["doc_id", "place"])
            b = b.filter(has)
            # Rows arrive sorted by key: a full shard ends where a key does.
            while b.num_rows:
                key = b.column("key").to_numpy()
                ends = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [False]))) + 1
                if held and key[0] != held[-1].column("key")[-1].as_py():
                    ends = np.concatenate(([0], ends))
                sums = size + np.cumsum(b.column("n").to_numpy().astype(np.int64) + window - 1)
                full = ends[np.where(ends > 0, sums[ends - 1], size) >= SHARD_WORDS]
                to = int(full[0]) if len(full) else b.num_rows
                if to:
                    held.append(b.slice(0, to))
                    size = int(sums[to - 1])
                if len(full):
                    yield from search(held)
                    held, size = [], 0
                b = b.slice(to)
        if held:
            yield from search(held)

    return material.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(run), "doc_id long, place long")


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, text, places``: every input row with the runs of its windows that occur earlier.

    A place is ``first window << 32 | windows``; null without any.  A window is ``window`` consecutive words, runs of
    characters other than ASCII white space, of one document; it occurs earlier if its words also start in a document with a smaller id, or in
    the same one before it.

    Null and empty texts, and texts of fewer words, have no windows.  Rows with a null id are neither judged nor
    count as earlier.  Ids are expected to be unique; rows that repeat an id are one document, windows at one place of it being one
    occurrence if their words are equal, and they share its places.  Other columns are ignored.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    runs = _repeated_runs(_anchored_runs(source.where("doc_id is not null"), window, anchor))
    per_doc = runs.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("place").alias("places"))
    judged = source.join(per_doc, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "places")
    found = _report(_material(judged, window, anchor), n, window)
    found = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("place").alias("places"))
    return source.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "places")


def remove_repeats(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256`` of :func:`repeated_windows`: words in no repeated window, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                data, offsets = text_buffers(c.column("text"))
                raw = data.tobytes()
                n_words, n_removed, kept, digests = [], [], [], []
                for i, places in enumerate(c.column("places").to_pylist()):
                    ws = raw[offsets[i] : offsets[i + 1]].split()
                    n_words.append(len(ws))
                    if places:
                        p = np.array(places, np.int64)
                        mark = np.zeros(len(ws) + 1, np.int32)
                        np.add.at(mark, np.minimum(p >> 32, len(ws)), 1)
                        np.add.at(mark, np.minimum((p >> 32) + (p & 0xFFFFFFFF) + window - 1, len(ws)), -1)
                        gone = np.cumsum(mark[:-1]) > 0
                        ws = [ws[j] for j in np.flatnonzero(~gone).tolist()]
                    n_removed.append(n_words[-1] - len(ws))
                    kept.append(b" ".join(ws))
                    digests.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests)],
                    ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return found.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed from every document and the digest of the rest."""
    found = repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return remove_repeats(found).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1
), flat AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT f.doc_id, f.word, f.p FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p WHERE g.p IS NULL
), agg AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (doc_id)
"""
