"""Line deduplication with DataFrame operations only.

Line keys become 128-bit hashes.  They are range-partitioned and sorted by hash, document
(largest first) and position, and a window streams over each hash in that order: the first
occurrences are those of the document that keeps the line, and the rank of the last one is the number of
documents.  A hash that many lines share is dealt to several ranges by document; the first documents of
each range are enough to decide it.  The result of the operator is a compressed bitmap per document, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut

#: Characters stripped from both ends of a line (fixed values: \x20, \x09-\x0D).
_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than this fraction (1/HOT_KEYS) of all lines is dealt to several ranges; at most so many keys have one.
HOT_KEYS = 1000
#: Keys that the sketch follows which finds the hot ones; it has at most this size in every task, and its error is below half of 1/HOT_KEYS.
SKETCH_KEYS = 1 << 13
#: Lines in one word of a bitmap.
WORD_BITS = 32


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: str, text: str) -> list[Column]:
    """Rows are told apart by id and text, so rows that share an id do not mix."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_row")]


def _hot_keys(lines: DataFrame, hot_keys: int) -> DataFrame:
    """``a1, salts``: first hashes of the keys with many lines, and the number of ranges that each is dealt to.

    The counts come from a sketch of bounded size.  What it misses or adds changes how rows are dealt, never what is found.
    """
    total, top = lines.agg(F.count("*"), F.expr(f"approx_top_k(h1, {hot_keys}, {max(SKETCH_KEYS, 2 * hot_keys)})")).first()
    found = [(x["item"], x["count"] * hot_keys // total + 1) for x in top or [] if x["count"] > 2 and x["count"] * hot_keys > total]
    return lines.sparkSession.createDataFrame(found, "a1 long, salts long")


def line_keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Bitmaps of the lines to keep, for the documents that lose any.

    A key is a line without surrounding ASCII white space and with A-Z lower-cased.
    Keys of ``min_chars`` code points or more in ``min_docs`` documents or more lose all
    their lines except those of the largest ``doc_id`` holding them.

    Returns ``doc_id, _row, keep map<int,int>``: word ``w`` has bit ``b`` set if line ``32*w + b`` is kept; words whose lines all stay are left out.

    Null or empty texts have one empty line and are kept.  Rows that repeat an id are one document: they count once, and
    keep or lose the same keys.  Rows with a null id are one document, the smallest.  Other columns are ignored.
    """
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    stripped = F.transform(F.split(folded, "\n", -1), lambda x: F.btrim(x, F.lit(_STRIP)))
    keys = F.transform(stripped, lambda x: F.when(F.length(x) >= min_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))))
    lines = docs.select(*_row_key(doc_id, text), F.posexplode(keys).alias("pos", "h")).where("h is not null")
    lines = cut(lines.select("doc_id", "_row", "pos", "h.h1", "h.h2"))

    hot = _hot_keys(lines, hot_keys)
    dealt = lines.join(F.broadcast(hot), F.col("h1") == F.col("a1"), "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(-1))).drop("a1", "salts")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["h1", "h2", "salt"]
    ordered = dealt.repartitionByRange(n, *key).sortWithinPartitions(*key, F.col("doc_id").desc_nulls_last(), "pos")
    ranked = ordered.withColumn("rank", F.dense_rank().over(Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last())))
    ranked = ranked.withColumn("docs", F.max("rank").over(Window.partitionBy(*key)))
    ranked = cut(ranked.where((F.col("docs") >= min_docs) | (F.col("salt") >= 0)))

    # A key that was dealt to several ranges: its first documents in each, at most min_docs.
    heads = ranked.where((F.col("salt") >= 0) & (F.col("rank") <= min_docs)).select("h1", "h2", F.struct("doc_id").alias("doc")).distinct()
    wide = heads.groupBy(F.col("h1").alias("a1"), F.col("h2").alias("a2")).agg(F.max("doc").alias("keeper"), F.count("*").alias("n"))
    salted = ranked.where("salt >= 0").join(F.broadcast(wide.where(F.col("n") >= min_docs)), (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")))
    dropped = ranked.where("salt < 0 and rank > 1").select("doc_id", "_row", "pos").unionByName(
        salted.where(~F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))).select("doc_id", "_row", "pos")
    )
    words = dropped.groupBy("doc_id", "_row", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr(f"shiftleft(1, pos % {WORD_BITS})"))).alias("bits")
    )
    return words.groupBy("doc_id", "_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` from documents and the bitmaps of :func:`line_keep_bitmaps`."""
    mine = docs.select(*_row_key(doc_id, text), split_lines(F.col(text)).alias("lines"))
    there = bitmaps.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"), "keep")
    both = mine.join(there, mine["doc_id"].eqNullSafe(there["_id"]) & (mine["_row"] == there["_r"]), "left")

    def bit(i: Column) -> Column:
        word = F.try_element_at(F.col("keep"), F.floor(i / WORD_BITS).cast("int"))
        return F.coalesce(F.call_function("getbit", word, F.pmod(i, F.lit(WORD_BITS))), F.lit(1).cast("tinyint"))

    kept = F.when(F.col("keep").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: bit(i) == 1))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept")).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text")
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: line counts and the digest of the kept text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = apply_bitmaps(docs, line_keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT y.doc_id, y.pos, y.line, (h.k IS NOT NULL AND y.doc_id <> h.keeper) AS gone
  FROM keyed y LEFT JOIN hot h ON y.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
