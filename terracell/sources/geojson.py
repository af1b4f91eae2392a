"""GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as P

_RING = "array<array<double>>"
_EMPTY = "array<array<array<struct<x:double,y:double>>>>"


def _points(rings):
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def parse_geometry(text):
    """GeoJSON text of a geometry to ``struct(type, polys)``; the polygonal members of a collection are gathered, others give no polygons."""
    kind = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")
    one = F.array(_points(F.from_json(coords, f"array<{_RING}>")))
    many = F.transform(F.from_json(coords, f"array<array<{_RING}>>"), _points)
    members = F.from_json(F.get_json_object(text, "$.geometries"), "array<struct<type:string,coordinates:string>>")

    def member(m):
        return F.when(m["type"] == "Polygon", F.array(_points(F.from_json(m["coordinates"], f"array<{_RING}>")))).when(
            m["type"] == "MultiPolygon", F.transform(F.from_json(m["coordinates"], f"array<array<{_RING}>>"), _points)
        ).otherwise(F.expr(f"cast(array() as {_EMPTY})"))

    polys = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).when(kind == "GeometryCollection", F.flatten(F.transform(members, member)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), polys.alias("polys")))


def read_features(spark: SparkSession, path: str, properties: StructType | str) -> DataFrame:
    """Properties as columns, ``geometry struct<type, polys>`` and ``crs``; polygons and multipolygons may be mixed."""
    props = properties if isinstance(properties, str) else properties.simpleString()[len("struct<") : -1].replace(":", " ")
    schema = f"crs struct<properties:struct<name:string>>, features array<struct<properties:struct<{_colons(props)}>,geometry:struct<type:string,coordinates:string,geometries:string>>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    f = doc.select(F.col("crs.properties.name").alias("crs"), F.explode("features").alias("f"))
    g = F.to_json(F.struct(F.col("f.geometry.type").alias("type")))
    shape = F.when(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"), F.concat(F.lit('{"type":"'), F.col("f.geometry.type"), F.lit('","coordinates":'), F.col("f.geometry.coordinates"), F.lit("}"))).when(
        F.col("f.geometry.type") == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":'), F.col("f.geometry.geometries"), F.lit("}"))
    ).otherwise(g)
    return f.select("f.properties.*", F.coalesce("crs", F.lit("OGC:CRS84")).alias("crs"), parse_geometry(shape).alias("geometry"))


def _colons(ddl: str) -> str:
    return ",".join(":".join(p.strip().split(None, 1)) if ":" not in p else p.strip() for p in ddl.split(","))


def to_feature_text(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``value``: one GeoJSON feature per row, NULL properties written."""
    props = F.to_json(F.struct(*[c for c in df.columns if c not in (geometry, "crs")]), {"ignoreNullFields": "false"})
    shape = F.coalesce(P.to_geojson(F.col(geometry)), F.lit("null"))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """GeoJSON text sequence; an existing result stays unless ``overwrite``."""
    to_feature_text(df).write.mode("overwrite" if overwrite else "ignore").text(path)
