from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys as K
from ..plans import curate, guards
from ..plans import manifest as M
from .base import query, r6, table


def _features(spark, sf_dir):
    """Nations as features with short keys."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("dicofre"), F.col("n_name").alias("name"))


def _texts(spark, sf_dir):
    """Suppliers as an indicator table in text: decimal commas, thousands, gaps and junk."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 9
    whole, cents = F.floor(F.abs(F.col("s_acctbal"))).cast("string"), F.lpad((F.round(F.abs(F.col("s_acctbal")) * 100).cast("long") % 100).cast("string"), 2, "0")
    v = F.when(k == 0, "").when(k == 1, "nan").when(k == 2, "abc").when(k == 3, F.concat(whole, F.lit("d"))).when(k == 4, F.concat(F.lit("1.234,"), cents)).when(k == 5, F.concat(F.lit(" 1 234,"), cents)).when(k == 6, F.concat(F.lit("1 234,"), cents)).when(k == 7, "1e3").otherwise(F.concat(whole, F.lit(","), cents))
    key = F.when(F.col("s_suppkey") % 11 == 0, "nan").when(F.col("s_suppkey") % 13 == 0, "").otherwise(F.concat(F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit(" ")))
    return s.select(key.alias("ID"), F.col("s_suppkey").cast("string").alias("no"), v.alias("share"))


_TEXTS = """x AS (
  SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'nan' WHEN s_suppkey % 13 = 0 THEN '' ELSE lpad(CAST(s_nationkey AS VARCHAR), 3, '0') END AS id, CAST(s_suppkey AS DOUBLE) AS no, s_suppkey % 9 AS k,
         CAST(floor(abs(s_acctbal)) AS BIGINT) AS w, CAST(round(abs(s_acctbal) * 100) AS BIGINT) % 100 AS c FROM supplier
), i AS (
  SELECT id, no, CASE WHEN k IN (5, 6) THEN 1234 + c / 100.0 WHEN k = 7 THEN 1000.0 WHEN k = 8 THEN w + c / 100.0 END AS share FROM x WHERE id NOT IN ('nan', '')
)"""


@query(f"WITH {_TEXTS} SELECT id AS ID, no, round(share, 4) AS share FROM i")
def indicators(spark, sf_dir):
    """Keys and decimal commas of a text table."""
    return K.indicators(_texts(spark, sf_dir)).select("ID", "no", r6("share", 4).alias("share"))


@query(f"WITH {_TEXTS} SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS dicofre, n_name AS name, id AS ID, no, round(share, 4) AS share FROM nation LEFT JOIN i ON lpad(CAST(n_nationkey AS VARCHAR), 3, '0') = id")
def indicator_join(spark, sf_dir):
    """Keys padded to one width, then a left join that fans out."""
    f, v = K.pad_together((_features(spark, sf_dir), "dicofre"), (K.indicators(_texts(spark, sf_dir)), "ID"))
    return K.join_values(f, v).select("dicofre", "name", "ID", "no", r6("share", 4).alias("share"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '-' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, len(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') ELSE lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, len(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') END AS k FROM customer")
def zero_fill(spark, sf_dir):
    """Zeros after the sign, never shorter."""
    s = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", T.zfill(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("-"), s)).otherwise(s), 5).alias("k"))


@query(f"WITH {_TEXTS} SELECT m AS metric, count(v) AS present, count(*) - count(v) AS missing FROM (SELECT 'no' AS m, no AS v FROM i UNION ALL SELECT 'share', share FROM i) GROUP BY 1")
def column_counts(spark, sf_dir):
    """Present and missing values of each column."""
    return K.column_counts(K.indicators(_texts(spark, sf_dir)), ["no", "share"])


@query(f"WITH {_TEXTS} SELECT id AS ID, 'no' AS metric, no AS value FROM i UNION ALL SELECT id, 'share', round(share, 4) FROM i WHERE share IS NOT NULL")
def long_form(spark, sf_dir):
    """One row per key and metric."""
    v = K.indicators(_texts(spark, sf_dir))
    return K.long_form(v, "ID", K.value_columns(v, "ID")).withColumn("value", r6("value", 4))


@query("SELECT c_nationkey AS layer, count(*) AS rows, count(DISTINCT c_mktsegment) AS keys, count(*) > count(DISTINCT c_mktsegment) AS repeated FROM customer GROUP BY 1")
def key_summary(spark, sf_dir):
    """Rows, keys and repeats by layer."""
    return K.key_summary(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("layer"), "c_mktsegment"), "c_mktsegment", "layer")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def stacked_layers(spark, sf_dir):
    """Union by name, missing columns as NULL."""
    n = K.clean_columns(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias(" KEY "), F.col("n_name").alias("Name")))
    return K.stack([n, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("SELECT n_regionkey AS layer, CAST(max(n_nationkey) + 1 AS INTEGER) AS height, CAST(max(n_nationkey % 5) + 1 AS INTEGER) AS width FROM nation GROUP BY 1")
def grid_shapes(spark, sf_dir):
    """shapes of the inputs."""
    return guards.shapes(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("layer"), F.col("n_nationkey").alias("row"), (F.col("n_nationkey") % 5).alias("col")), "layer")


@query("""SELECT n_name AS name, upper(r_name) AS data_type, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN r_regionkey = 1 THEN 'postprocessed_only' ELSE 'copied' END ELSE 'reprojected' END AS action,
CASE WHEN r_regionkey = 1 THEN 1000.0 END AS resolution FROM nation JOIN region ON n_regionkey = r_regionkey""")
def curation_actions(spark, sf_dir):
    """What happens to a file, by rule and CRS."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    crs = F.when(F.col("n_nationkey") % 2 == 0, "ESRI:54009").otherwise("EPSG:4326")
    second = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.upper("r_name").alias("data_type"))
    lights = curate.rule_table(spark, {"NTL": curate.RULES["NTL"]}).drop("data_type")
    out = curate.actions(n.select(F.col("n_name").alias("name"), F.upper("r_name").alias("data_type"), crs.alias("crs")), second.join(lights))
    return out.select("name", "data_type", "action", "resolution")


@query("""WITH e AS (SELECT r_name AS folder, n_name AS name, n_nationkey AS seq, CASE WHEN n_nationkey % 2 = 0 THEN 'copied' ELSE 'reprojected' END AS action FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, n_name, n_nationkey + 100, 'derived' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0)
SELECT folder, name, arg_max(action, seq) AS action, arg_max(action, seq) = 'copied' AS copied_as_is, true AS has_null FROM e GROUP BY ALL""")
def manifest_upsert(spark, sf_dir):
    """Documents by folder, the last record of a file stays, through JSON text and back."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")

    def record(action):
        return M.entry(F.col("n_name"), F.lit("/a"), F.lit("/b"), action, F.lit("EPSG:4326"), F.lit("ESRI:54009"), none, F.lit(None), none, F.lit("ESRI:54009"), F.array(F.lit("x")))

    first = n.select(F.col("r_name").alias("folder"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq"), record(F.when(F.col("n_nationkey") % 2 == 0, "copied").otherwise("reprojected")).alias("entry"))
    again = n.where("n_nationkey % 5 = 0").select(F.col("r_name").alias("folder"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("seq"), record(F.lit("derived")).alias("entry"))
    text = M.manifests(first, at=F.lit("2024-01-01").cast("timestamp")).select("folder", M.to_text(F.col("manifest")).alias("text"))
    more = again.groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("name", "entry"))).alias("more"))
    none_yet = F.map_filter(M.from_text(F.lit("{"))["files"], lambda k, _: F.lit(False))
    both = text.join(more, "folder", "left").select("folder", "text", M.upsert(M.from_text(F.col("text")), F.coalesce("more", none_yet), F.col("folder")).alias("m"))
    files = both.select("folder", "text", F.explode("m.files").alias("name", "e"))
    return files.select("folder", "name", F.col("e.general.action").alias("action"), (F.col("e.general.action") == "copied").alias("copied_as_is"), F.col("text").contains("null").alias("has_null"))
