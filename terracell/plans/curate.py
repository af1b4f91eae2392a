"""Curation of raster layers: copy, post-process or reproject, by rule."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import clean, mollweide
from ..model import GridSpec
from ..operators.reproject import to_mollweide
from . import manifest as M


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rule:
    """What one data type needs; ``postprocess`` maps (value, nodata) Columns of band 1."""

    resolution: float | None = None
    postprocess: Callable[[Column, float | None], Column] | None = None
    name: str = "band1_postprocess"
    resampling: str = "bilinear"


#: Rules by data type, the upper-cased folder name (fixed values: night lights at 1000 m).
RULES: dict[str, Rule] = {"NTL": Rule(1000.0, lambda v, nodata: clean.lights_log(v, nodata), "log(x+2)", "bilinear")}


@dataclass(frozen=True)
class Config:
    raw_root: str
    curated_root: str
    mollweide_crs: str = mollweide.CODE
    resampling: str = "bilinear"
    rules: dict[str, Rule] = field(default_factory=lambda: dict(RULES))


def rule_for(data_type: str, cfg: Config) -> Rule:
    return cfg.rules.get(data_type.upper(), Rule(resampling=cfg.resampling))


def action(crs: str | None, rule: Rule) -> str:
    """``copied``, ``postprocessed_only`` or ``reprojected``."""
    if mollweide.is_mollweide_name(crs):
        return "postprocessed_only" if rule.postprocess else "copied"
    return "reprojected"


def actions(layers: DataFrame, rules: DataFrame, resampling: str = "bilinear") -> DataFrame:
    """``layers`` (with ``data_type, crs``) and what happens to each: ``action, resolution, postprocess, resampling``.

    ``rules``: ``data_type, resolution, postprocess, resampling``, one row per upper-cased data type; other types have no rule.
    """
    r = rules.select(F.col("data_type").alias("_type"), "resolution", "postprocess", F.col("resampling").alias("_how"))
    both = layers.join(r, F.upper("data_type") == F.col("_type"), "left")
    there = F.when(F.col("postprocess").isNotNull(), "postprocessed_only").otherwise("copied")
    action = F.when(F.coalesce(mollweide.is_mollweide(F.col("crs")), F.lit(False)), there).otherwise("reprojected")
    return both.select(*[layers[c] for c in layers.columns], action.alias("action"), "resolution", "postprocess", F.coalesce("_how", F.lit(resampling)).alias("resampling"))


def rule_table(spark: SparkSession, rules: dict[str, Rule]) -> DataFrame:
    """Rules as a table for :func:`actions`."""
    rows = [(k.upper(), r.resolution, r.name if r.postprocess else None, r.resampling) for k, r in rules.items()]
    return spark.createDataFrame(rows, "data_type string, resolution double, postprocess string, resampling string")


def progress(layers: DataFrame, folder: str = "data_type", name: str = "name") -> DataFrame:
    """``folder, name, number, of, percent, folders``: each layer's place in its folder and what is done when it is, and the number of folders.

    Windows run over one row per file.
    """
    mine, all_of = Window.partitionBy(folder).orderBy(name), Window.partitionBy(folder)
    counted = layers.withColumn("number", F.row_number().over(mine)).withColumn("of", F.count("*").over(all_of).cast("int"))
    folders = layers.agg(F.countDistinct(folder).cast("int").alias("folders"))
    return counted.select(folder, name, "number", "of", F.round(100.0 * F.col("number") / F.col("of"), 1).alias("percent")).crossJoin(F.broadcast(folders))


def copy_as_is(spark: SparkSession, layer: Layer, cfg: Config, overwrite: bool = False) -> tuple[bool, dict]:
    """(whether the file was copied, its manifest values) for a layer that needs neither a warp nor post-processing."""
    rule = rule_for(layer.data_type, cfg)
    if action(layer.grid.crs, rule) != "copied":
        raise ValueError(f"{layer.name} is not a layer to be copied")
    done = store.copy(spark, layer.src_path, layer.dst_path, overwrite)
    log.info("%s: %s", layer.name, "copied" if done else "there already")
    return done, _record(layer, layer.grid, rule, "copied", cfg)


@dataclass(frozen=True)
class Layer:
    """A raster file: its cells ``band, row, col, value`` and its grid."""

    name: str
    data_type: str
    cells: DataFrame
    grid: GridSpec
    nodata: float | None = None
    src_path: str = ""
    dst_path: str = ""


def curate(layer: Layer, cfg: Config) -> tuple[DataFrame, GridSpec, dict]:
    """(cells ``band, row, col, value``, grid, manifest entry values) of one layer; nothing runs."""
    rule = rule_for(layer.data_type, cfg)
    what = action(layer.grid.crs, rule)
    cells, grid = layer.cells, layer.grid
    if what == "reprojected":
        cells, grid = to_mollweide(cells, layer.grid, rule.resolution, rule.resampling, ["band"])
    if rule.postprocess:
        done = rule.postprocess(F.col("value"), layer.nodata)
        cells = cells.withColumn("value", clean.on_band(F.col("band"), 1, done, F.col("value")).cast("float").cast("double"))
    log.info("%s: CRS %s, %s onto %d x %d cells", layer.name, layer.grid.crs, what, grid.height, grid.width)
    return cells, grid, _record(layer, grid, rule, what, cfg)


def _record(layer: Layer, grid: GridSpec, rule: Rule, what: str, cfg: Config) -> dict:
    return {
        "name": layer.name, "src": layer.src_path, "dst": layer.dst_path, "action": what, "src_crs": layer.grid.crs, "dst_crs": grid.crs,
        "resampling": rule.resampling if what == "reprojected" else None, "target_resolution": rule.resolution if what == "reprojected" else None,
        "output_resolution": grid.resolution, "target_crs": cfg.mollweide_crs, "postprocess": [rule.name] if rule.postprocess else [],
    }


def curate_all(layers: list[Layer], cfg: Config, spark: SparkSession) -> tuple[DataFrame, DataFrame, dict[str, GridSpec]]:
    """(cells of all layers with ``layer, data_type``, manifest entries ``folder, name, seq, entry``, grids by layer) as one plan each."""
    if not layers:
        raise ValueError("no layers")
    log.info("found %d layers in %d folders", len(layers), len({x.data_type for x in layers}))
    out, records, grids = None, [], {}
    for i, layer in enumerate(sorted(layers, key=lambda x: (x.data_type, x.name))):
        cells, grid, record = curate(layer, cfg)
        tagged = cells.select(F.lit(layer.name).alias("layer"), F.lit(layer.data_type.upper()).alias("data_type"), "band", "row", "col", "value")
        out = tagged if out is None else out.unionByName(tagged)
        records.append((layer.data_type.upper(), i, *record.values()))
        grids[layer.name] = grid
    schema = "folder string, seq int, name string, src string, dst string, action string, src_crs string, dst_crs string, resampling string, target_resolution double, output_resolution string, target_crs string, postprocess array<string>"
    rows = spark.createDataFrame(records, schema)
    cols = ("name", "src", "dst", "action", "src_crs", "dst_crs", "resampling", "target_resolution", "output_resolution", "target_crs", "postprocess")
    return out, rows.select("folder", "name", "seq", M.entry(*[F.col(c) for c in cols]).alias("entry")), grids
