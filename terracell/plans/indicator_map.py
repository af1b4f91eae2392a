"""Parish polygons joined with indicators, and what a map needs from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as P
from ..operators import keys as K
from ..operators import overlay as O
from ..operators import vector as V

#: File name of the mainland layer (fixed value).
MAINLAND = "Cont_AAD_CAOP2016.shp"
#: Skipped layers named in a warning.
MOST_SKIPPED = 20


def split_layers(paths: list[str], mainland: str = MAINLAND) -> tuple[str, list[str]]:
    """(mainland, islands) by file name, in any case; paths are sorted first."""
    if not paths:
        raise ValueError("no vector layers")
    ordered = sorted(paths)
    main = next((p for p in ordered if p.rsplit("/", 1)[-1].lower() == mainland.lower()), None)
    if main is None:
        raise ValueError(f"no layer {mainland}")
    return main, [p for p in ordered if p != main]


def with_key(layers: dict[str, DataFrame], key: str = "dicofre") -> tuple[dict[str, DataFrame], str]:
    """(layers with a key column, their names in lower case; a warning that names up to 20 others, or '')."""
    kept, skipped = {}, []
    for name, df in layers.items():
        df = K.clean_columns(df)
        if key in df.columns:
            kept[name] = df
        else:
            skipped.append(name)
    more = f" and {len(skipped) - MOST_SKIPPED} more" if len(skipped) > MOST_SKIPPED else ""
    return kept, f"no {key} in " + ", ".join(skipped[:MOST_SKIPPED]) + more if skipped else ""


def parishes(layers: dict[str, DataFrame], key: str = "dicofre") -> DataFrame:
    """``layer, key, geometry``: cleaned polygons of all layers, the parts of a key in a layer dissolved into one geometry."""
    kept, _ = with_key(layers, key)
    if not kept:
        raise ValueError(f"no layer has {key}")
    both = K.stack([V.clean_geometries(d).select(F.lit(n).alias("layer"), F.col(key).cast("string").alias(key), "geometry") for n, d in kept.items()])
    return O.union(both, ["layer", key])


def indicator_map(layers: dict[str, DataFrame], table: DataFrame, key: str = "dicofre", value_key: str = "ID") -> DataFrame:
    """Polygons with their indicators: keys of both sides padded to one width over all layers, then a left join."""
    shapes, values = K.pad_together((parishes(layers, key), key), (K.indicators(table, value_key), value_key))
    return K.join_values(shapes, values, key, value_key)


def map_report(joined: DataFrame, columns: list[str], layer: str = "layer") -> tuple[DataFrame, DataFrame]:
    """(present and missing of each column, layers by area with their slot)."""
    return K.column_counts(joined, columns).where("present > 0"), V.layer_slots(joined, layer, P.area(F.col("geometry")["polys"]))
