"""N-gram Jaccard self-join by MinHash banding with exact verification.

1. Every document gets a fingerprint of its set of word n-grams and its band hashes; the
   number of bands and rows follows from the threshold and the target recall.
   Documents with equal sets collapse into one representative.
2. Representatives meet on band hashes.  Buckets with the same members are one unit.  A
   bucket yields one edge from each member to its smallest member, never its pairs;
   connected through these edges are the candidate components.
3. The documents of a component, or of each of its units if that is less work, are
   gathered, in blocks if they are many, and every pair of a block or of two blocks
   is compared on full n-gram sets by matrix products.  A pair counts where its first common band
   is looked at, so once, and only if it has one.  Each document leaves with the number of
   its links and the smallest document it is connected to, so no pair is ever a row.
4. Components over the verified links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_hot
from ..store import cut
from .vectext import chunks, mix64, space_table, text_buffers, tidy, U64, windows, _WORD_POWERS, words, Words

_IS_WORD = space_table()
#: Words in an n-gram and similarity of a link (fixed values of the contract).
NGRAM, SIMILARITY = 5, 0.8
#: Probability with which a pair at the threshold shares a band.
RECALL = 0.999
#: Hash functions a document is signed with at most.
MAX_HASHES = 128
#: Documents in a block of a component or unit; those of more than 16 blocks get larger blocks, up to four times as large.
#: A task verifies one block or two; larger blocks mean fewer copies of a document in the shuffle.
BLOCK_DOCS = 256
#: n-grams (or 8 bytes of text each) that a task compares at once.  Where the texts of a task hold more, the n-grams are dealt to parts by
#: fingerprint; each part counts what its documents share, and the counts are added.  So long texts bound memory without more copies of them.
BLOCK_GRAMS = 1 << 22
#: n-grams that are columns of one matrix product.
_SLAB = 4096


def bands_and_rows(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective banding (most rows) within ``max_hashes`` that finds a pair at the threshold with probability ``recall``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        if p < 1e-9:
            break
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, edges per document) of all n-grams; a document of fewer words, but not none, has one of all its words."""
    _, code = windows(w, k)
    counts = w.counts()
    size = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        up, _ = _WORD_POWERS.upto(k + 1)
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += w.code[w.first[short[has]] + j] * up[j]
        at = np.cumsum(size)[short]
        code = np.insert(code, at, mix64(extra + counts[short].astype(U64)))
        size = size.copy()
        size[short] = 1
    return code, np.concatenate(([0], np.cumsum(size)))


def _signatures(batch: pa.RecordBatch, k: int, bands: int, rows: int) -> pa.RecordBatch:
    data, offsets = text_buffers(batch.column("text"))
    code, edge = shingles(words(data, offsets, _IS_WORD), k)
    size = np.diff(edge)
    some = np.flatnonzero(size)
    out = np.zeros((len(some), bands), U64)
    fp1, fp2 = np.zeros(len(size), U64), np.zeros(len(size), U64)
    if len(some):
        at = edge[some]
        for b in range(bands):
            h = np.full(len(some), b + 1, U64)
            for r in range(rows):
                i = np.arange(1, 3, dtype=U64) * U64(2 * (b * rows + r) + 1)
                a, c = mix64(i * U64(0x9E3779B97F4A7C15))
                h = mix64(h * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(code * (a | U64(1)) + c, at))
            out[:, b] = h
        # A fingerprint of the set of n-grams: sums over distinct ones.
        doc = np.repeat(np.arange(len(some)), size[some])
        order = np.lexsort((code, doc))
        c, d = code[order], doc[order]
        first = np.ones(len(c), bool)
        first[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        c, start = c[first], np.searchsorted(d[first], np.arange(len(some)))
        fp1[some] = np.add.reduceat(mix64(c), start)
        fp2[some] = np.add.reduceat(mix64(c ^ U64(0x5851F42D4C957F2D)), start)
    flat = pa.array(out.ravel().view(np.int64))
    where = np.zeros(len(size) + 1, np.int32)
    where[1:] = np.cumsum(np.where(size > 0, bands, 0))
    load = np.maximum(size, np.diff(offsets) >> 3).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("th"), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(size > 0), pa.ListArray.from_arrays(pa.array(where), flat), pa.array(load)],
        ["doc_id", "th", "fp1", "fp2", "has_words", "bands", "load"],
    )


def _labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row of a symmetric link matrix is connected to."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return label
        label = new


def _first_common(bands: np.ndarray) -> np.ndarray:
    """For each pair of rows the first column in which they agree, or the number of columns."""
    m, width = bands.shape
    first = np.full((m, m), width, np.uint8)
    for b in range(width - 1, -1, -1):
        first[np.equal.outer(bands[:, b], bands[:, b])] = b
    return first


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """For each pair of sets the number of common n-grams."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    gram, doc = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, column, count = np.unique(gram, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # an n-gram of one document is in no intersection
    place = np.cumsum(count > 1) - 1
    column, doc = place[column[shared]], doc[shared]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    both = np.zeros((m, m), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, _SLAB):
        a, b = np.searchsorted(column, [lo, lo + _SLAB])
        x = np.zeros((m, min(_SLAB, width - lo)), np.float32)
        x[doc[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    return both


def _link(ids: np.ndarray, block: np.ndarray, copies: np.ndarray, size: np.ndarray, both: np.ndarray, bands: np.ndarray, mask: int, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of every document of a task: pairs of block i if i equals j, else pairs between i and j, whose first common band is in ``mask``."""
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    wanted = np.array([mask >> b & 1 for b in range(bands.shape[1])] + [0], bool)
    linked &= wanted[_first_common(bands)]
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]
    # Texts of one id are in one class, linked or not.
    return linked @ copies, _labels(linked | np.equal.outer(ids, ids), ids)


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a sorted stream with equal keys; one key may have several in a row."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            yield tuple(c[s] for c in cols), b.slice(s, e - s)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a sorted stream."""
    for _, run in groupby(_pieces(batches, keys), itemgetter(0)):
        yield pa.Table.from_batches([piece for _, piece in run]).combine_chunks()


_TASK = ["whole", "group", "i", "j"]
_ABOUT = "node long, th long, copies long, bands array<long>, mask long, final boolean, block int, whole boolean, group long, i int, j int"
_FOUND = "node long, th long, links long, label long, final boolean"


def _found(ids, th, links, label, final) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(th), pa.array(links.astype(np.int64)), pa.array(label), pa.array(final)], ["node", "th", "links", "label", "final"])


def _compared(tasks: DataFrame, n: int, ngram: int, threshold: float) -> DataFrame:
    """Links and labels of the documents of each task, whose texts come together."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, _TASK):
            first = {k: t.column(k)[0].as_py() for k in ("mask", "i", "j")}
            ids, signature = t.column("node").to_numpy(), t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            grams: list[np.ndarray] = []
            for c in chunks(t.to_batches()[0], "text"):
                code, edge = shingles(words(*text_buffers(c.column("text")), _IS_WORD), ngram)
                grams += [np.unique(code[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            links, label = _link(ids, t.column("block").to_numpy(), t.column("copies").to_numpy(), size, _shared(grams), signature, **first, threshold=threshold)
            yield _found(ids, t.column("th").to_numpy(), links, label, t.column("final").to_numpy(zero_copy_only=False))

    # Ranges rather than hashes: pairs of large blocks are dealt evenly.
    gathered = tasks.repartitionByRange(n, *_TASK).sortWithinPartitions(*_TASK)
    return gathered.mapInArrow(tidy(verify), _FOUND)


def _compared_in_parts(tasks: DataFrame, n: int, ngram: int, threshold: float) -> DataFrame:
    """The same for tasks with ``parts`` above 1: no text and no more than a part of the n-grams comes together.

    Each text leaves its n-grams by part.  A part gives one row for each document with the numbers of n-grams that it
    shares with others, and a task adds them up as they stream in, holding one matrix over its documents.
    """
    about = [f.split()[0] for f in _ABOUT.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch, "text"):
                code, edge = shingles(words(*text_buffers(c.column("text")), _IS_WORD), ngram)
                for r in range(c.num_rows):
                    grams, parts = np.unique(code[edge[r] : edge[r + 1]]), c.column("parts")[r].as_py()
                    part = (mix64(grams) % U64(parts)).astype(np.int64)
                    grams = grams[np.argsort(part, kind="stable")]
                    ends = np.cumsum(np.bincount(part, minlength=parts))
                    held = [x.tobytes() for x in np.split(grams, ends[:-1])]
                    same = pa.Table.from_batches([c.slice(r, 1).select(about)]).take(np.zeros(parts, np.int64)).combine_chunks()
                    yield same.append_column("part", pa.array(np.arange(parts), pa.int32())).append_column("grams", pa.array(held, pa.binary())).to_batches()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, [*_TASK, "part"]):
            sets = [np.frombuffer(x.as_py(), U64) for x in t.column("grams")]
            both, node, th = _shared(sets), t.column("node").to_numpy(), t.column("th").to_numpy()
            with_some = [np.flatnonzero(row) for row in both]
            other = [np.stack([node[k], th[k]]).tobytes() for k in with_some]
            shared = [row[k].astype(np.int64).tobytes() for row, k in zip(both, with_some)]
            out = t.select(about).append_column("size", pa.array([len(x) for x in sets], pa.int64()))
            yield from out.append_column("other", pa.array(other, pa.binary())).append_column("shared", pa.array(shared, pa.binary())).to_batches(max_chunksize=64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, run in groupby(_pieces(batches, _TASK), itemgetter(0)):
            at: dict[tuple[int, int], int] = {}
            both, size, rows = np.zeros((64, 64)), np.zeros(64, np.int64), []
            for _, piece in run:
                for r in piece.to_pylist():
                    other, shared = np.frombuffer(r["other"], np.int64).reshape(2, -1), np.frombuffer(r["shared"], np.int64)
                    me = at.setdefault((r["node"], r["th"]), len(at))
                    if me == len(rows):
                        rows.append(None)
                    if rows[me] is None:
                        rows[me] = {k: r[k] for k in about}
                    them = []
                    for key in zip(*other.tolist()):
                        them.append(at.setdefault(key, len(at)))
                        if them[-1] == len(rows):
                            rows.append(None)
                    if len(at) > len(size):
                        more = max(len(at), 2 * len(size)) - len(size)
                        both, size = np.pad(both, (0, more)), np.pad(size, (0, more))
                    both[me, them] += shared
                    size[me] += r["size"]
            m, first = len(rows), rows[0]
            column = lambda k: np.array([r[k] for r in rows])  # noqa: B023, E731
            links, label = _link(column("node"), column("block"), column("copies"), size[:m], both[:m, :m], column("bands"), first["mask"], first["i"], first["j"], threshold)
            yield _found(column("node"), column("th"), links, label, column("final"))

    dealt = tasks.mapInArrow(tidy(deal), f"{_ABOUT}, part int, grams binary").repartitionByRange(n, *_TASK, "part").sortWithinPartitions(*_TASK, "part")
    counted = dealt.mapInArrow(tidy(count), f"{_ABOUT}, size long, other binary, shared binary").repartitionByRange(n, *_TASK).sortWithinPartitions(*_TASK)
    return counted.mapInArrow(tidy(add), _FOUND)


def _units(sets: DataFrame) -> DataFrame:
    """``rep, th, leader, unit, mask, n, weight``: for each set its units (buckets with the same members), the bands they stand for, their smallest id, size and n-grams."""
    members = sets.select("rep", "th", "load", F.posexplode("bands").alias("no", "band"))
    print_of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "rep", "th"))
    buckets = members.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n"), F.sum("load").alias("weight"), print_of(1).alias("f1"), print_of(2).alias("f2")).where("n > 1")
    buckets = cut(buckets.select("band", "leader", "n", "weight", F.xxhash64("f1", "f2", "n").alias("unit")))
    met = join_hot(members, buckets, ["band"], "n")
    return met.groupBy("rep", "th", "leader", "unit").agg(F.bit_or(F.expr("shiftleft(1L, no)")).alias("mask"), F.max("n").alias("n"), F.max("weight").alias("weight"))


def _placed(sets: DataFrame) -> DataFrame:
    """``node, th, copies, bands, whole, size, groups``: the groups that each set is compared in.

    A component is one group if that means no more pairs than its units have together; otherwise its units are the groups.
    """
    units = cut(_units(sets))
    components = connected_components(units.where("rep <> leader").select(F.col("rep").alias("u"), F.col("leader").alias("v")))
    each = units.groupBy(F.col("rep").alias("node"), "th").agg(F.sum("n").alias("pairs"), F.collect_list(F.struct(F.col("unit").alias("group"), "mask", "n", "weight")).alias("units"))
    mine = sets.select(F.col("rep").alias("node"), "th", "copies", "bands", "load")
    held = cut(each.join(mine, ["node", "th"]).join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    per = cut(held.groupBy("component").agg(F.count("*").alias("size"), F.sum("pairs").alias("pairs"), F.sum("load").alias("weight")).select("component", "size", "weight", (F.col("size") * F.col("size") <= F.col("pairs")).alias("whole")))
    both = join_hot(held, per, ["component"], "size")
    alone = F.array(F.struct(F.col("component").alias("group"), F.lit(-1).cast("long").alias("mask"), F.col("size").alias("n"), "weight"))
    return both.select("node", "th", "copies", "bands", "whole", "size", F.when(F.col("whole"), alone).otherwise(F.col("units")).alias("groups"))


def ngram_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, threshold: float = SIMILARITY, recall: float = RECALL,
                  block_docs: int = BLOCK_DOCS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies``, one row per input row.

    n_links: other documents whose sets of ``ngram``-word runs have a Jaccard similarity of ``threshold`` or more,
    exact copies included; n_copies: documents with the same set.  class_id: smallest id connected through links.
    Words are runs of characters other than ASCII white space.

    Documents without words (null, empty) and rows with a null id are linked to nothing; their class is their own id.
    Repeated rows are copies.  Rows of one id with different texts each count in links and copies; texts with the same
    smallest id are in one class.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bands, rows = bands_and_rows(threshold, recall)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Rows of one id are told apart by a hash of their text.
    source = source.withColumn("th", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                yield _signatures(c, ngram, bands, rows)

    signed = cut(source.mapInArrow(tidy(sign), "doc_id long, th long, fp1 long, fp2 long, has_words boolean, bands array<long>, load long"))
    usable = signed.where("has_words and doc_id is not null")
    # Copies: one representative for each set of n-grams (the bands follow from the set).
    sets = usable.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("load").alias("load"))
    sets = cut(sets.select("fp1", "fp2", F.col("least.doc_id").alias("rep"), F.col("least.th").alias("th"), "copies", "bands", "load"))
    placed = _placed(sets)
    # Rows that repeat one another have one text to compare.
    texts = source.withColumnRenamed("doc_id", "node").join(placed, ["node", "th"]).dropDuplicates(["node", "th"])
    tasks = texts.select("node", "th", "text", "copies", "bands", "whole", "size", F.explode("groups").alias("g")).select("*", "g.group", "g.mask", "g.n", "g.weight").drop("g")
    tasks = tasks.withColumn("blocks", F.ceil(F.col("n") / F.least(F.greatest(F.col("n") / 16, F.lit(block_docs)), F.lit(4 * block_docs))).cast("int"))
    # A component compared in one block needs no further look at its links: the labels are its classes.
    tasks = tasks.withColumn("block", F.pmod(F.xxhash64("node", "th"), F.col("blocks")).cast("int")).withColumn("final", F.col("whole") & (F.col("blocks") == 1))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.ceil(F.col("weight") * F.least(F.lit(2), F.col("blocks")) / F.col("blocks") / block_grams).cast("int")
    tasks = tasks.select("text", *[F.col(f.split()[0]) for f in _ABOUT.split(", ")], parts.alias("parts"))
    together = _compared(tasks.where("parts <= 1").drop("parts"), n, ngram, threshold)
    verified = together
    if not placed.where(F.exists("groups", lambda g: g["weight"] > block_grams)).isEmpty():
        verified = together.unionByName(_compared_in_parts(tasks.where("parts > 1"), n, ngram, threshold))
    verified = cut(verified)
    joined = connected_components(verified.where("not final").select(F.col("node").alias("u"), F.col("label").alias("v")))
    classes = verified.groupBy("node", "th").agg(F.sum("links").alias("links"), F.min("label").alias("label")).join(joined, "node", "left")
    classes = classes.select(F.col("node").alias("rep"), "th", "links", F.coalesce("component", "label").alias("label"))
    found = sets.drop("bands", "load").join(classes, ["rep", "th"], "left")
    found = cut(found.select("fp1", "fp2", "copies", F.coalesce("label", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = join_hot(usable.select("doc_id", "fp1", "fp2"), found, ["fp1", "fp2"], "copies").select("doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"))
    alone = signed.where("not (has_words and doc_id is not null)").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return named.unionByName(alone)


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id, with the columns of ``docs``.

    Rows with a null id stay, as do rows that repeat the id of a document that stays.
    """
    lost = ngram_classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_lost")).distinct()
    rows = docs.select(F.col("doc_id").alias("_kept"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(lost, F.col("_kept") == F.col("_lost"), "left_anti").select("row.*")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract query: class and links of every document."""
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
