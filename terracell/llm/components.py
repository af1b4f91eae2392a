"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, discard, new_path


#: A key with more than this fraction (1/HOT_KEYS) of all rows is hot; there are at most so many, whatever the size of the table.
HOT_KEYS = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with a table of unique keys, whose column ``weight`` has the number of rows of ``left`` with the key.

    The hot keys, at most HOT_KEYS, are broadcast, so their rows stay where they are; the rows of all others are shuffled.
    Both tables are read twice, so they should be written ones.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS > F.lit(total)
    hot = F.broadcast(right.where(is_hot))
    return left.join(hot, on).unionByName(left.join(F.broadcast(right.where(is_hot).select(*on)), on, "left_anti").join(right.where(~is_hot), on))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges (u long, v long)``; the component is its smallest node.

    Loops and nulls are ignored.  A node's smallest neighbour is aggregated before it meets the node's edges, and that of a hub
    is broadcast, so no neighbourhood is collected, and each step is a written table, so a lost executor costs one step.  Tables rather than
    checkpoints: a checkpoint hands on the size estimate of its plan, and those of joins multiply from round to round.
    Rounds grow with the logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    held: list[str] = []

    def keep(df: DataFrame, names: str) -> DataFrame:
        held.append(new_path(spark, "components"))
        df.write.parquet(held[-1])
        return spark.read.schema(names).parquet(held[-1])

    e = edges.where("u is not null and v is not null and u <> v")
    e = keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "u long, v long")
    if e.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "u long, m long, n long")
        large = keep(join_hot(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "u long, v long")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u long, m long, n long")
        small = join_hot(large, low, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "u long, v long")
        for path in held[:-1]:
            discard(spark, path)
        held[:] = held[-1:]
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = cut(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
    discard(spark, held[0])
    return found
