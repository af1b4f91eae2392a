"""Benchmark decontamination with suffix arrays over the training documents.

Each chunk of training documents is a shard.  Its words become ranks in the benchmark's
vocabulary; a suffix that starts with fewer in-vocabulary words than the shortest window has cannot
match one, so the shard's suffix array holds the other suffixes only, sorted by their
leading words.  All benchmark suffixes are then binary-searched in it at once.  The
interval of an item's suffix gives the locations of its window; its neighbours in
the array give the longest verbatim match.

A benchmark of at most ``piece_bytes`` travels to the executors whole.  A larger one meets the
documents through shuffles: documents whose windows have an anchor (the smallest fingerprint of the short word runs
inside) in common with some item's are cut into snippets, and shards are formed by anchor, with the
snippets of both sides; each shard is searched in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import new_path
from .components import join_hot
from .substring_dedup import _runs, anchors
from .vectext import alnum_table, chunks, fold_table, text_buffers, tidy, U64, Words, words

_IS_WORD, _FOLD = alnum_table(), fold_table()
#: Words in a window; shorter items are one window.
WINDOW = 10
#: Bytes of benchmark text up to which it is sent to all executors.
PIECE_BYTES = 16 << 20
#: Words in the short runs that anchors are chosen from.
ANCHOR = 5
#: Words that a shard by anchor holds at once, and runs of documents with one anchor after which it gets another shard.
SHARD_WORDS, ANCHOR_RUNS = 1 << 18, 4096


def split_words(texts: pa.Array) -> Words:
    return words(*text_buffers(texts), _IS_WORD, _FOLD)


class Queries:
    """The suffixes of benchmark items, or of snippets of them, as ranks in their vocabulary."""

    def __init__(self, ids: list, w: Words, window: int):
        self.vocabulary = np.unique(w.code)
        rank = np.searchsorted(self.vocabulary, w.code).astype(np.int32)
        # Rank 0 is "not in the vocabulary"; -1 ends an item and equals nothing.
        count = w.counts()
        item = w.doc()
        left = w.first[1:][item] - np.arange(len(rank))
        need = np.minimum(window, count[item])
        self.window = window
        self.text = np.concatenate([rank + 1, np.full(window, -1, np.int32)])
        self.stop = w.first[1:][item]
        self.count = count
        use = left >= need
        self.at, self.need, self.item = np.flatnonzero(use), need[use], item[use]
        self.ids = ids
        self.shortest = int(self.need.min()) if len(self.need) else 0
        # Distinct windows: the first suffix of each, and the suffixes of each one after another.
        key = np.concatenate([np.where(np.arange(window) < self.need[:, None], _keys(self.text, self.at, window), 0), self.need[:, None]], axis=1)
        _, self.sample, self.window_of = np.unique(key, axis=0, return_index=True, return_inverse=True)
        self.window_of = self.window_of.ravel()
        self.suffixes = np.argsort(self.window_of, kind="stable")
        self.edge = np.concatenate(([0], np.cumsum(np.bincount(self.window_of, minlength=len(self.sample))))).astype(np.int64)


def _keys(text: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return text[at[:, None] + np.arange(width)]


def _below(a: np.ndarray, b: np.ndarray, need: np.ndarray, or_equal: bool) -> np.ndarray:
    """Row-wise a < b (or <=) by the first ``need`` columns."""
    differs = (a != b) & (np.arange(a.shape[1]) < need[:, None])
    first = np.argmax(differs, axis=1)
    some = differs[np.arange(len(a)), first]
    less = a[np.arange(len(a)), first] < b[np.arange(len(a)), first]
    return np.where(some, less, or_equal)


class Shard:
    """Suffix array of one chunk of training documents over the vocabulary of ``q``."""

    def __init__(self, code: np.ndarray, first: np.ndarray, q: Queries):
        n = len(code)
        place = np.searchsorted(q.vocabulary, code)
        place[place == len(q.vocabulary)] = 0
        rank = np.where(q.vocabulary[place] == code, place + 1, 0).astype(np.int32) if len(q.vocabulary) else np.zeros(n, np.int32)
        # A document's end stops a run as an unknown word does: each position knows where its run of known words ends.
        stop = np.where(rank == 0, np.arange(n), n)
        ends = first[1:][np.diff(first) > 0]
        run_end = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
        run_end = np.minimum(run_end, np.repeat(ends, np.diff(first)[np.diff(first) > 0])) if n else run_end
        known = run_end - np.arange(n)
        self.text = np.concatenate([rank, np.zeros(q.window, np.int32)])
        self.run_end = run_end
        at = np.flatnonzero(known >= max(1, q.shortest))
        keys = _keys(self.text, at, q.window)
        keys[np.arange(q.window) >= known[at][:, None]] = 0
        order = np.lexsort(keys.T[::-1])
        self.at, self.keys = at[order], keys[order]

    def search(self, wanted: np.ndarray, need: np.ndarray, right: bool) -> np.ndarray:
        """For each wanted row the first place whose suffix is not below it (right: is above it)."""
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.at), np.int64)
        while len(active := np.flatnonzero(lo < hi)):
            mid = (lo[active] + hi[active]) // 2
            below = _below(self.keys[mid], wanted[active], need[active], right)
            lo[active] = np.where(below, mid + 1, lo[active])
            hi[active] = np.where(below, hi[active], mid)
        return lo

    def longest(self, q: Queries, start: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that agree from the item positions ``start`` and the shard positions ``at`` on."""
        n = np.zeros(len(start), np.int64)
        stop = np.minimum(q.stop[start] - start, self.run_end[at] - at)
        active = np.flatnonzero(stop > 0)
        while len(active):
            same = q.text[start[active] + n[active]] == self.text[at[active] + n[active]]
            active = active[same]
            n[active] += 1
            active = active[n[active] < stop[active]]
        return n


    def before(self, q: Queries, start: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Words that agree just before the item positions ``start`` and the shard positions ``at``, back to the item's first word ``begin``."""
        n = np.zeros(len(start), np.int64)
        stop = np.minimum(start - begin, at)
        active = np.flatnonzero(stop > 0)
        while len(active):
            i, j = start[active] - n[active] - 1, at[active] - n[active] - 1
            # Words of the document before are behind the end of a run of known words.
            active = active[(q.text[i] == self.text[j]) & (self.run_end[j] >= self.run_end[at[active]])]
            n[active] += 1
            active = active[n[active] < stop[active]]
        return n


def row_chunks(batch: pa.RecordBatch, field: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch by the bytes of one field of its column ``row``."""
    at = 0
    for c in chunks(pa.RecordBatch.from_arrays([batch.column("row").field(field)], ["text"]), "text"):
        yield batch.slice(at, c.num_rows)
        at += c.num_rows


def _places(w: Words, q: Queries) -> tuple[np.ndarray, np.ndarray, Shard]:
    """(number of the distinct window, first word in ``w``) of every occurrence of a window, and the shard."""
    s = Shard(w.code, w.first, q)
    wanted, need = _keys(q.text, q.at[q.sample], q.window), q.need[q.sample]
    lo, hi = s.search(wanted, need, False), s.search(wanted, need, True)
    size = hi - lo
    which = np.repeat(np.arange(len(size)), size)
    place = s.at[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)] if len(which) else np.zeros(0, np.int64)
    return which, place, s


def _spread(edge: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of ``which``, position) of all positions in the groups ``which`` that ``edge`` bounds."""
    size = edge[which + 1] - edge[which]
    of = np.repeat(np.arange(len(which)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[which], size)


def _occurrences(w: Words, q: Queries) -> tuple[np.ndarray, np.ndarray, Shard]:
    """(number of the item suffix, first word in ``w``) of every occurrence of an item's window, and the shard."""
    which, place, s = _places(w, q)
    of, at = _spread(q.edge, which)
    return q.suffixes[at], place[of], s


def _scan(w: Words, q: Queries) -> tuple[np.ndarray, list[list[tuple]]]:
    """For one chunk: hit flags of its words, and for each document the longest match (item, item word, document word, words) with each item that has a window in it.

    Windows that items share are looked up once, and only their first place in a document meets the items: what a document
    costs is its occurrences of windows and the items it has, not their product.
    """
    matches: list[list[tuple]] = [[] for _ in range(len(w.first) - 1)]
    hit = np.zeros(len(w.code) + 1, np.int32)
    if len(w.code) and len(q.at):
        which, place, s = _places(w, q)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + q.need[q.sample][which], -1)
        doc = np.searchsorted(w.first, place, "right") - 1
        # The first place of each window in each document.
        order = np.lexsort((place, which, doc))
        doc, which, place = doc[order], which[order], place[order]
        first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (which[1:] != which[:-1]))) if len(doc) else np.zeros(0, bool)
        doc, which, place = doc[first], which[first], place[first]
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, [d, d + 1])
            of, at = _spread(q.edge, which[a:b])
            suffix, p = q.suffixes[at], place[a:b][of]
            # What only continues the match a word before is part of it.
            order = np.argsort(suffix, kind="stable")
            suffix, p = suffix[order], p[order]
            follows = np.zeros(len(suffix), bool)
            follows[1:] = (q.at[suffix[1:]] == q.at[suffix[:-1]] + 1) & (q.item[suffix[1:]] == q.item[suffix[:-1]]) & (p[1:] == p[:-1] + 1)
            suffix, p = suffix[~follows], p[~follows]
            item = q.item[suffix]
            begin = q.stop[q.at[suffix]] - q.count[item]
            back = s.before(q, q.at[suffix], p, begin)
            start, p = q.at[suffix] - back, p - back
            length = s.longest(q, start, p)
            best = np.lexsort((start, p, -length, item))
            best = best[np.concatenate(([True], item[best][1:] != item[best][:-1]))]
            low = int(w.first[d])
            matches[d] = [(q.ids[t], i, x - low, n) for t, i, x, n in zip(item[best].tolist(), (start - begin)[best].tolist(), p[best].tolist(), length[best].tolist())]
    return np.cumsum(hit[:-1]) > 0, matches


_MATCH_NAMES = ("item_id", "item_word", "doc_word", "words")
_MATCH = pa.struct([("item_id", pa.int64()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])


def _found(c: pa.RecordBatch, w: Words, covered: np.ndarray, matches: list[list[tuple]]) -> pa.RecordBatch:
    flags = np.split(covered, w.first[1:-1]) if len(w.first) > 1 else []
    return pa.RecordBatch.from_arrays(
        [c.column("doc_id"), c.column("row"), pa.array(w.counts(), pa.int64()), pa.array([f.tobytes() for f in flags], pa.binary()), pa.array([[dict(zip(_MATCH_NAMES, x)) for x in m] for m in matches], pa.list_(_MATCH))],
        ["doc_id", "row", "n_words", "hit", "matches"])


# --- a benchmark that is too large to send -----------------------------------------------------------------------------


def _keyed(source: DataFrame, window: int, lengths: list[int] | None) -> DataFrame:
    """``n, key, id, place`` of ``id, text``: runs of windows of ``n`` words with one anchor; a place is ``first window << 32 | windows``.

    Windows have each of ``lengths`` (documents), or ``window`` or as many words as a shorter text has (items, without lengths).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                w = split_words(c.column("text"))
                count = w.counts()
                for n in lengths or np.unique(np.minimum(count[count > 0], window)).tolist():
                    start, anchor, _ = anchors(w, n, min(n, ANCHOR))
                    row = np.searchsorted(w.first, start, "right") - 1
                    if lengths is None:
                        own = np.minimum(count[row], window) == n
                        start, anchor, row = start[own], anchor[own], row[own]
                    if len(start):
                        edge = _runs(anchor, row)
                        s = edge[:-1]
                        place = ((start[s] - w.first[row[s]]) << 32) | np.diff(edge)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), n, np.int32)), pa.array(anchor[s].view(np.int64)), c.column("id").take(pa.array(row[s])), pa.array(place)], ["n", "key", "id", "place"])

    return source.mapInArrow(tidy(run), "n int, key long, id long, place long")


def _snippets(source: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """``n, key, salts, id, at, codes``: the words of each run of ``places (n, key, salts, id, place)``, as fingerprints."""
    per = places.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("n", "key", "salts", "place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                w = split_words(c.column("text"))
                lists = c.column("places")
                row = np.repeat(np.arange(c.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                n, place = flat.field("n").to_numpy(), flat.field("place").to_numpy()
                at = w.first[row] + (place >> 32)
                end = at + (place & 0xFFFFFFFF) + n - 1
                blobs = [w.code[s:e].tobytes() for s, e in zip(at.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([flat.field("n"), flat.field("key"), flat.field("salts"), c.column("id").take(pa.array(row)), pa.array((place >> 32).astype(np.int32)), pa.array(blobs, pa.binary())], _SNIPPET)

    return source.join(per, F.col("id") == F.col("_id")).select("id", "text", "places").mapInArrow(tidy(run), "n int, key long, salts long, id long, at int, codes binary")


_SNIPPET = ["n", "key", "salts", "id", "at", "codes"]


def _words_of(codes: list[bytes]) -> Words:
    size = np.fromiter((len(x) // 8 for x in codes), np.int64, len(codes))
    none = np.zeros(0, np.int64)
    return Words(none, none, np.frombuffer(b"".join(codes), U64), np.concatenate(([0], np.cumsum(size))))


def _shard_hits(sides: DataFrame, n: int, window: int) -> DataFrame:
    """``id, at, n, item, item_at``: occurrences of item windows in the snippets ``n, key, salt, side, id, at, codes`` of items (side 0) and documents (1)."""

    def search(items: dict[tuple[int, int], bytes], docs: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if items and docs:
            q, w = Queries(list(items), _words_of(list(items.values())), window), _words_of([x[2] for x in docs])
            which, place, _ = _occurrences(w, q)
            begin = np.searchsorted(q.item, np.arange(len(items)), "left")
            doc = np.searchsorted(w.first, place, "right") - 1
            item = q.item[which]
            ids, ats = (np.array([x[k] for x in docs], np.int64) for k in (0, 1))
            item_ids, item_ats = (np.array([x[k] for x in items], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array((ats[doc] + place - w.first[doc]).astype(np.int32)), pa.array(q.need[which].astype(np.int32)), pa.array(item_ids[item]),
                 pa.array((item_ats[item] + q.at[which] - q.at[begin[item]]).astype(np.int32))], ["id", "at", "n", "item", "item_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by group, items first; a full shard keeps the items of the group that goes on.
        items: dict[tuple[int, int], bytes] = {}
        own: dict[tuple[int, int], bytes] = {}
        docs: list[tuple[int, int, bytes]] = []
        held, group = 0, None
        for b in batches:
            for n, key, salt, side, i, at, codes in zip(*(b.column(k).to_pylist() for k in ("n", "key", "salt", "side", "id", "at", "codes"))):
                if (n, key, salt) != group:
                    group, own = (n, key, salt), {}
                if held >= SHARD_WORDS:
                    yield from search(items, docs)
                    items, docs, held = dict(own), [], 0
                if side == 0:
                    own[i, at] = items[i, at] = codes
                else:
                    docs.append((i, at, codes))
                held += len(codes) // 8
        yield from search(items, docs)

    by = ["n", "key", "salt"]
    return sides.repartition(n, *by).sortWithinPartitions(*by, "side").mapInArrow(tidy(run), "id long, at int, n int, item long, item_at int")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """A written copy with a number for each row in ``id``."""
    return _written(df.withColumn("id", F.monotonically_increasing_id()), name)


def _find_by_shards(docs: DataFrame, items: DataFrame, schema, window: int) -> DataFrame:
    """:func:`find_contamination` for ``doc_id, row, text`` and ``item_id, text``, both of any size."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs, items = _numbered(docs, "documents"), _numbered(items, "benchmark")
    texts = docs.select("id", "text")
    item_runs = _written(_keyed(items.select("id", "text"), window, None), "item-runs")
    lengths = sorted(r["n"] for r in item_runs.select("n").distinct().collect())  # at most ``window`` of them
    near = _keyed(texts, window, lengths).join(item_runs.select("n", "key").distinct(), ["n", "key"], "left_semi") if lengths else _keyed(texts, window, [window]).limit(0)
    near = _written(near, "document-runs")
    # Anchors that both sides have; one with many runs of documents has several shards, and the items' snippets go to each.
    met = near.groupBy("n", "key").agg(F.count("*").alias("rows"))
    met = _written(met.withColumn("salts", F.ceil(F.col("rows") / ANCHOR_RUNS)), "anchors")
    theirs = _snippets(texts, join_hot(near, met, ["n", "key"], "rows"), window).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    ours = _snippets(items.select("id", "text"), item_runs.join(met, ["n", "key"]), window).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    hits = _shard_hits(ours.withColumn("side", F.lit(0)).unionByName(theirs.withColumn("side", F.lit(1))), n, window)
    named = hits.join(items.select(F.col("id").alias("item"), "item_id"), "item")
    per = named.groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("at", "n", "item", "item_at", "item_id")).alias("hits"))
    both = docs.join(per, F.col("id") == F.col("_id"), "left").select("doc_id", "row", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                w = split_words(c.column("text"))
                hit = np.zeros(len(w.code) + 1, np.int32)
                matches: list[list[tuple]] = []
                for first, found in zip(w.first[:-1].tolist(), c.column("hits").to_pylist()):
                    # Hits that go on word by word in an item and the document are one match.
                    runs: list[list] = []
                    for h in sorted(found or [], key=lambda h: (h["item"], h["item_at"] - h["at"], h["at"])):
                        hit[first + h["at"]] += 1
                        hit[first + h["at"] + h["n"]] -= 1
                        last = runs[-1] if runs else None
                        if last and last[0] == h["item"] and last[1][2] + last[1][3] == h["at"] + h["n"] - 1 and last[1][1] - last[1][2] == h["item_at"] - h["at"]:
                            last[1][3] += 1
                        else:
                            runs.append([h["item"], [h["item_id"], h["item_at"], h["at"], h["n"]]])
                    longest: dict[int, tuple] = {}
                    for item, m in sorted(runs, key=lambda r: (-r[1][3], r[1][2], r[1][1])):
                        longest.setdefault(item, tuple(m))
                    matches.append(list(longest.values()))
                yield _found(c, w, np.cumsum(hit[:-1]) > 0, matches)

    return both.mapInArrow(tidy(run), schema)


# --- both ---------------------------------------------------------------------------------------------------------------


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Verbatim matches of benchmark windows in whole documents.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Returns
    ``doc_id, n_words, hit binary, matches array<struct<item_id,item_word,doc_word,words>>`` and the input's columns in
    ``row`` (a struct); ``hit`` has a byte for each word, 1 inside an occurrence of a window; ``matches`` has, for each
    item with a window in the document, the longest verbatim match at a first occurrence of one of its windows, the earliest of equally long ones.  One row per input row.  Nothing is shuffled if the benchmark has
    at most ``piece_bytes`` of text; the results are the same beyond that.

    Null and empty texts have no words and no hits.  Items without words never match; rows of one item_id are one
    item.  Items with a null id match as others do, with a null in ``matches``.  Repeated rows repeat, repeated ids with other texts are judged by their own.
    """
    keep = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = keep.select(
        "doc_id", "row", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<struct<item_id:bigint,item_word:int,doc_word:int,words:int>>").alias("matches")
    ).schema
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > piece_bytes:
        return _find_by_shards(keep.withColumn("text", F.col("row")[text].cast("string")), items, schema, window)
    sent = items.orderBy("item_id", "text").collect()
    ids, texts = [r["item_id"] for r in sent], [r["text"] for r in sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(ids, split_words(pa.array(texts, pa.string())), window)
        for b in batches:
            # The text is read where it lies, in the row, so it is sent once.
            where = b.schema.field("row").type.get_field_index(text)
            for c in row_chunks(b, where):
                w = split_words(c.column("row").field(where))
                yield _found(c, w, *_scan(w, q))

    return keep.mapInArrow(tidy(run), schema)


def contamination_summary(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of :func:`find_contamination`.

    Items with a null id count in n_hit and contaminated; n_items and the digest are about named items.
    """
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item_id"].cast("string")))))
    hits = F.length(F.regexp_replace(F.hex("hit"), "00", "")) / 2
    return found.select("doc_id", "n_words", hits.cast("long").alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with their own columns.

    Null and empty texts and rows with a null id stay if nothing hits them; items with a null id count.  Repeated rows stay or go together.
    """
    found = find_contamination(docs, benchmark, **options)
    return found.where(F.size("matches") == 0).select("row.*")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: hits and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return contamination_summary(found)


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bwin AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bwin
), dwin AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)
), occ AS (
  SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.k = b.k
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
