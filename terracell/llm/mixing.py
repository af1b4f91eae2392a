"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Every document of a source starts with the same expected number of copies, the ratio of
the source's target to its size.  The whole part is taken as it is; the fractional part is
mass, measured in words, that is settled by duels: a document meets the pool of all smaller
ones of its group, and mass moves from one to the other at random (so that expectations
hold) until the document is empty or full; the pool shares its gain or loss in
proportion, so its documents stay within their sizes.  Duels go from the largest
document to the smallest, so a small one is left unsettled: the smallest, or the one at
which the pool ran empty or full.  A document larger than all
smaller ones together, which they cannot settle, is left as it is.  What 64 groups leave
forms a group of the next level.  The tree ends with one document per source, usually a
small one, which is rounded at random, so the words taken from a source differ from its
target by less than one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import join_hot
from ..store import cut

#: Weights by rank of the source, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
#: Documents in a group of the reduction tree at the leaves, on average, and groups that meet in one above them.
FAN_IN = 64
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, docs, source_size, target``: one row per source.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all
    words.  A target stops at ``limit`` times its source and the excess is shared again by
    weight, which is the level at which ``min(limit * size, weight * level)`` adds up to the
    total; it is found from running sums over the sources in the order in which they fill up.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    # One row per source: these windows order sources, not documents, so one task sees as many rows as there are sources.
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per.select(
        "*", F.element_at(cycle, (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).alias("w"),
        (F.col("source_size") * limit).alias("cap"), (F.sum("source_size").over(everyone) * share).alias("total"),
    )
    fills = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    onward = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    # The first source in that order whose cap is not reached fixes the level for itself and all after it.
    found = levels.withColumn("settled", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everyone)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("settled"), F.col("cap")))
    return found.select("source", "docs", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


_ENTRY = "struct<size:bigint,key:bigint,id:bigint,mass:double>"
_DONE = "struct<key:bigint,id:bigint,pick:int>"


def _settle(entries: Column, last: Column, seed: int, level: int) -> Column:
    """Folds one group, in order of falling size: ``(left, done)``.

    ``left`` has the entry that remains and those larger than all smaller ones together; in the ``last`` group of a source only one.
    The mass of an entry that has not come yet is ``a * mass + b * size``: each duel moves the whole pool, of ``size`` and ``mass``, by one such step.
    """
    total = lambda field: F.aggregate(entries, F.lit(0.0), lambda t, e: t + e[field])
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), total("size").alias("size"), total("mass").alias("mass"),
                     F.expr(f"cast(array() as array<{_ENTRY}>)").alias("left"), F.expr(f"cast(array() as array<{_DONE}>)").alias("done"))
    tiny = 1e-6

    def meet(acc: Column, e: Column) -> Column:
        def pool(x: Column) -> Column:
            size, mass = acc["size"] - e["size"], F.greatest(acc["mass"] - x["mass"], F.lit(0.0))
            up, down = F.least(e["size"] - x["mass"], mass), F.least(x["mass"], size - mass)
            return F.struct(x["mass"].alias("own"), size.alias("size"), mass.alias("mass"), up.alias("up"), down.alias("down"))

        def move(x: Column) -> Column:
            gains = _uniform(F.lit(seed), F.lit(level), e["key"], e["id"]) * (x["up"] + x["down"]) < x["down"]
            enough = (x["up"] >= e["size"] - x["own"] - tiny) & (x["down"] >= x["own"] - tiny)
            still = (x["up"] <= tiny) | (x["down"] <= tiny) | (~last & ~enough & (e["size"] > x["size"]))
            shift = F.when(still, 0.0).when(gains, x["up"]).otherwise(-x["down"])
            part = F.when(still, 0.0).when(gains, x["up"] / x["mass"]).otherwise(x["down"] / (x["size"] - x["mass"]))
            return F.struct((x["own"] + shift).alias("own"), x["size"].alias("size"), (x["mass"] - shift).alias("mass"), part.alias("part"), (shift < 0).alias("fills"))

        def settle(x: Column) -> Column:
            whole = (x["own"] <= tiny) | (x["own"] >= e["size"] - tiny)
            out = F.struct(e["key"].alias("key"), e["id"].alias("id"), F.when(x["own"] >= e["size"] * 0.5, 1).otherwise(0).cast("int").alias("pick"))
            kept = F.struct(e["size"].alias("size"), e["key"].alias("key"), e["id"].alias("id"), x["own"].alias("mass"))
            keep = 1 - x["part"]
            return F.struct(
                (acc["a"] * keep).alias("a"), (acc["b"] * keep + F.when(x["fills"], x["part"]).otherwise(0.0)).alias("b"), x["size"].alias("size"), x["mass"].alias("mass"),
                F.when(whole, acc["left"]).otherwise(F.concat(acc["left"], F.array(kept))).alias("left"),
                F.when(whole, F.concat(acc["done"], F.array(out))).otherwise(acc["done"]).alias("done"),
            )

        own = F.struct((acc["a"] * e["mass"] + acc["b"] * e["size"]).alias("mass"))
        return _let(_let(_let(own, pool), move), settle)

    return F.aggregate(entries, start, meet)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0,
                weights: tuple[int, ...] = WEIGHTS, seed: int = 20_24) -> DataFrame:
    """Copies of each document such that every source takes its target of words.

    Returns ``doc_id, source, size, source_size, target, copies, taken``, one row per input row;
    ``taken = copies * size`` and ``copies`` is the source's ratio rounded up or down.  Runs with
    the same rows and seed agree, however the rows are partitioned.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, last
    in order.  Rows repeated in full (same id, source and size) are rounded together, so
    they get equal copies.  Other columns are ignored.  An empty table gives an empty result.
    """
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    # A key without null for the source; sources with much of the corpus are broadcast with their targets, all others are shuffled.
    sized = cut(sized.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    targets = cut(source_targets(sized, share, limit, weights).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"))
    rows = join_hot(sized, targets, ["_key"], "docs").drop("_key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(ratio + 1e-12).cast("long")).withColumn("part", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size"))
    rows = rows.withColumn("key", key)

    fractional = rows.where((F.col("part") > 1e-9) & (F.col("size") > 0))
    # Repeated rows count as one entry of their joint size: a group of them is never collected.
    entry = fractional.groupBy("source", "docs", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("part").alias("part"))
    leaves = F.greatest(F.ceil(F.col("docs") / FAN_IN), F.lit(1))
    live = entry.select(
        "source", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), leaves).alias("node"), leaves.alias("nodes"),
        F.struct("size", "key", F.col("doc_id").alias("id"), (F.col("size") * F.col("part")).alias("mass")).alias("e"),
    )
    most = targets.agg(F.max("docs")).first()[0] or 0
    picked, level = None, 0
    while True:
        group = live.groupBy("source", "node", "nodes").agg(F.sort_array(F.collect_list("e"), asc=False).alias("es"))
        folded = cut(group.select("source", "node", "nodes", _settle(F.col("es"), F.col("nodes") == 1, seed, level).alias("r")))
        done = folded.select(F.explode("r.done").alias("d")).select("d.key", "d.id", "d.pick")
        picked = done if picked is None else picked.unionByName(done)
        left = folded.select("source", F.floor(F.col("node") / FAN_IN).alias("node"), F.ceil(F.col("nodes") / FAN_IN).alias("nodes"), F.explode("r.left").alias("e"))
        level += 1
        if most <= FAN_IN:
            break
        most, live = -(-most // FAN_IN), left
    last = left.select(F.col("e.key").alias("key"), F.col("e.id").alias("id"), (_uniform(F.lit(seed), F.lit(-1), F.col("e.key")) * F.col("e.size") < F.col("e.mass")).cast("int").alias("pick"))
    picked = picked.unionByName(last).select(F.col("key").alias("_key"), F.col("id").alias("_id"), "pick")

    both = rows.join(picked, (rows["key"] == picked["_key"]) & rows["doc_id"].eqNullSafe(picked["_id"]), "left")
    copies = (F.col("base") + F.coalesce("pick", F.lit(0))).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their own columns, each as often as :func:`mix_sources` takes it.

    Rows without words (null and empty texts) are never taken; a row with a null id or source is taken as any other; repeated rows are
    taken equally often.  An empty table gives an empty one.
    """
    decided = mix_sources(docs, **options).where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), "copies").distinct()
    # The row travels as a struct, so its columns may have any names.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    return rows.join(decided, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: words taken from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """Sizes and targets of the sources, the part of op2 that SQL can express."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", word_count(F.col("text")).alias("size"))
    return source_targets(docs).select("source", "docs", "source_size", F.round("target", 3).alias("target"))


TARGETS_SQL = r"""
WITH s AS (
  SELECT source, count(*) AS docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS source_size FROM documents GROUP BY 1
), r AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), settled AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level <= cap / w)
SELECT source, docs, source_size, round(least(cap, coalesce(w * (SELECT level FROM settled), cap)), 3) AS target FROM l
"""
