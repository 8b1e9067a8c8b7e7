"""The three lifecycles as lazy compositions: synthetic build, satellite search, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes, geo, idents
from ..functions.taxonomy import BORDERS, REQUIRED_FILES, biomes, palettes
from ..operators import datasets, metrics, pyramid, ranking, raster

#: Radius of the blur of satellite renders.
SENSOR_BLUR = 0.8


def require_remote(path: str, local_ok: bool = False) -> str:
    """Results go to an object store unless a local folder is asked for."""
    if not local_ok and not path.startswith("gs://"):
        raise ValueError(f"{path} is local")
    return path


def synthetic_sources(files: DataFrame, entries: DataFrame, seed: int = 42, fraction: float = 0.15) -> DataFrame:
    """src_id, template and subset; raises on collisions and on a manifest that doesn't match, before a split can be frozen."""
    names = files.select(F.regexp_replace("filename", r"\.geojson$", "").alias("name"))
    datasets.require_empty(datasets.collisions(names), "names that become the same id")
    datasets.require_empty(datasets.reconcile(files, entries), "manifest and files differ")
    ids = names.select(idents.sanitised(F.col("name")).alias("src_id"))
    given = entries.select(idents.sanitised(F.regexp_replace("filename", r"\.geojson$", "")).alias("src_id"), "template")
    return datasets.stratified_split(datasets.with_template(ids, given), seed, fraction)


def label_pixels(features: DataFrame) -> DataFrame:
    """map_id, x, y, lc and topo of every pixel that a feature covers; the last feature wins."""
    look = biomes(features.sparkSession).select(F.col("biome").alias("_b"), F.col("lc").alias("_lc"))
    known = features.where("biome IS NOT NULL AND height IS NOT NULL").join(F.broadcast(look), F.col("biome") == F.col("_b"), "left")
    label = F.struct(classes.land_cover(F.col("height"), F.col("_lc")).alias("lc"), F.coalesce(classes.topography(F.col("height")), F.lit(255)).alias("topo"))
    return raster.rasterise(known.withColumn("label", label), "label").select("map_id", "x", "y", "label.*")


def rendered(pixels: DataFrame, style: str, canvas: DataFrame | None = None, feature: str = "lc") -> DataFrame:
    """Label pixels (map_id, x, y, lc) in a style: its palette, borders of its width around features, its background on the canvas, blur.

    A style that is not there is an error.
    """
    if style not in BORDERS:
        raise ValueError(f"no style {style}: {', '.join(BORDERS)}")
    shown = raster.colourised(pixels, palettes(pixels.sparkSession).where(F.col("style") == style).drop("style"))
    shown = raster.bordered(shown, feature, *BORDERS[style])
    if canvas is not None:
        shown = raster.on_background(shown, canvas, style)
    return raster.blurred(shown, SENSOR_BLUR, ["r", "g", "b"]) if style == "satellite" else shown.select("map_id", "x", "y", "r", "g", "b")


def complete_maps(objects: DataFrame) -> DataFrame:
    """Map ids that have all of the required files."""
    missing = datasets.missing_files(objects)
    return objects.select("map_id").distinct().join(missing, "map_id", "left_anti")


def tile_plan(maps: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Tiles of the maps that are not finished yet."""
    todo = maps if done is None else datasets.unfinished(maps, done, "map_id")
    return pyramid.tiles(pyramid.origins(todo)).select("*", pyramid.artifacts(F.col("tile_id")).alias("artifacts"))


def satellite_regions(cells: DataFrame, n: int = 200, year: int = 2023) -> DataFrame:
    """The most diverse cells as regions: id, bounds, season, score."""
    best = ranking.pick_regions(cells, n, [F.col("lat"), F.col("lon")])
    return best.select(idents.signed_id(F.col("lat"), F.col("lon")).alias("region_id"), F.array("lon", "lat", F.col("lon") + 1, F.col("lat") + 1).alias("bbox"), geo.season(F.col("lat") + 0.5, year).alias("datetime_range"), "score")


def evaluation(tiles: DataFrame, pixels: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Joint loss over the finest tiles of test maps; ids in the split are those of sources."""
    held = tiles.where(F.col("size") == pyramid.SCALES[-1]).withColumn("src_id", idents.source_of(F.col("map_id"))).join(test_ids, "src_id", "left_semi")
    keys = ["map_id", "pyramid_id", "tile_id"]
    return metrics.joint_nll(pixels.join(held.select(*keys), keys, "left_semi"))


__all__ = ["REQUIRED_FILES", "complete_maps", "evaluation", "label_pixels", "rendered", "require_remote", "satellite_regions", "synthetic_sources", "tile_plan"]
