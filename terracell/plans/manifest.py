"""Provenance manifests as nested rows and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "struct<name:string,src_path:string,dst_path:string>"
GENERAL = "struct<action:string,src_crs:string,dst_crs:string,reprojected:boolean,copied_as_is:boolean,resampling:string,target_resolution_m:double,output_resolution:string,target_crs:string>"
ENTRY = f"struct<file:{FILE},general:{GENERAL},specific:struct<postprocess:array<string>>>"
MANIFEST = f"struct<folder:string,generated_utc:string,files:map<string,{ENTRY}>>"
#: What happened to a file (fixed values).
ACTIONS = ("copied", "postprocessed_only", "reprojected", "derived")


def stamp(at: Column | None = None) -> Column:
    """UTC to the second with a trailing Z."""
    return F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def entry(name: Column, src: Column, dst: Column, action: Column, src_crs: Column, dst_crs: Column, resampling: Column, target_resolution: Column,
          output_resolution: Column, target_crs: Column, postprocess: Column) -> Column:
    """One file's record; unknown parts are NULL and are written as null."""
    return F.struct(
        F.struct(name.alias("name"), src.alias("src_path"), dst.alias("dst_path")).alias("file"),
        F.struct(action.alias("action"), src_crs.alias("src_crs"), dst_crs.alias("dst_crs"), (action == "reprojected").alias("reprojected"), (action == "copied").alias("copied_as_is"),
                 resampling.alias("resampling"), target_resolution.cast("double").alias("target_resolution_m"), output_resolution.alias("output_resolution"), target_crs.alias("target_crs")).alias("general"),
        F.struct(postprocess.alias("postprocess")).alias("specific"),
    ).cast(ENTRY)


def steps_text(nodata: str, units: str | None, months: tuple[int, ...], product: str, target: str) -> Column:
    """Audit trail of a seasonal product."""
    formula = "mean over years of (mean of the season - mean of the rest)" if product == "delta" else "mean over all months with a value"
    parts = [f"nodata: {nodata}"] + ([f"units: {units}"] if units else []) + [f"season months: {', '.join(f'{m:02d}' for m in months)}", f"{product}: {formula}", f"projection: {target}"]
    return F.array(*[F.lit(p) for p in parts])


def manifests(entries: DataFrame, folder: str = "folder", name: str = "name", record: str = "entry", order: str = "seq", at: Column | None = None) -> DataFrame:
    """``folder, manifest``: one document per folder; of several records of one file the last by ``order`` stays."""
    last = entries.groupBy(folder, name).agg(F.max_by(record, order).alias("_e"))
    files = last.groupBy(folder).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col("_e").alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("files"))
    return files.select(F.col(folder).alias("folder"), F.struct(F.col(folder).alias("folder"), stamp(at).alias("generated_utc"), "files").alias("manifest"))


def to_text(manifest: Column) -> Column:
    """JSON with explicit nulls, indented, other scripts kept."""
    return F.to_json(manifest, {"ignoreNullFields": "false", "pretty": "true"})


def from_text(text: Column) -> Column:
    """A manifest from JSON; a corrupt document is an empty one."""
    read = F.from_json(text, MANIFEST)
    empty = F.from_json(F.lit('{"files":{}}'), MANIFEST)
    return F.when(read.isNull() | read["files"].isNull(), empty).otherwise(read)


def upsert(old: Column, files: Column, folder: Column, at: Column | None = None) -> Column:
    """A document with entries added or replaced by file name, and a new stamp."""
    kept = F.map_filter(old["files"], lambda k, _: ~F.array_contains(F.map_keys(files), k))
    return F.struct(F.coalesce(old["folder"], folder).alias("folder"), stamp(at).alias("generated_utc"), F.map_concat(kept, files).alias("files"))


def write(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One text file per folder partition."""
    manifest.select("folder", to_text(F.col("manifest")).alias("value")).write.mode(mode).partitionBy("folder").text(path)
