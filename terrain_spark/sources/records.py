"""Records of catalogues, annotations and sidecar files: parsing into columns, and columns into JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import idents
from ..functions.taxonomy import TOPOGRAPHY_WEIGHT, WEIGHTS, weight_map
from ..operators import ranking
from ..operators.ordinals import numbered


def control_points(features: Column) -> Column:
    """Control points of the features (JSON texts) of an annotation; malformed ones go."""
    number = lambda f, path: F.get_json_object(f, path).try_cast("double")
    points = F.transform(
        features,
        lambda f: F.struct(
            number(f, "$.properties.resourceCoords[0]").alias("px"),
            number(f, "$.properties.resourceCoords[1]").alias("py"),
            number(f, "$.geometry.coordinates[0]").alias("lng"),
            number(f, "$.geometry.coordinates[1]").alias("lat"),
        ),
    )
    return F.filter(points, lambda p: p["px"].isNotNull() & p["py"].isNotNull() & p["lng"].isNotNull() & p["lat"].isNotNull())


def parsed_annotations(rows: DataFrame, text: str = "annotation") -> DataFrame:
    """Control points, bounds and image of each annotation (JSON text); those with fewer than three points go."""
    get = lambda path: F.get_json_object(text, path)
    own = [c for c in rows.columns if c != text]
    once = lambda df, **c: df.select(*own, *[k for k in df.columns if k not in own and k not in c], F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))
    # a generator of one row keeps Catalyst from working its columns out again wherever they are used
    found = once(rows, _features=get("$.body.features"), _w=get("$.target.source.width").try_cast("int"), _h=get("$.target.source.height").try_cast("int"))
    out = once(found, gcps=control_points(F.from_json("_features", "array<string>"))).where(F.size("gcps") >= 3)
    ext = lambda f, c: f(F.transform("gcps", lambda p: p[c]))
    both = (F.col("_w") > 0) & (F.col("_h") > 0)
    return out.select(
        *own,
        "gcps",
        ext(F.array_min, "lng").alias("west"), ext(F.array_min, "lat").alias("south"), ext(F.array_max, "lng").alias("east"), ext(F.array_max, "lat").alias("north"),
        get("$.target.source.id").alias("image_id"),
        F.when(both, F.col("_w")).alias("image_w"), F.when(both, F.col("_h")).alias("image_h"),
        get("$.body.transformation.type").alias("transformation"),
        F.when(get("$.target.selector.type") == "SvgSelector", get("$.target.selector.value")).alias("mask_svg"),
        get("$.body._allmaps.id").alias("allmaps_id"),
        get("$.id").alias("annotation_id"),
    )


# Columns of a hand-off record and the fields they come from, and the page of a record.
RECORD_FIELDS = {"author": "Author", "publisher": "Publisher", "publisher_location": "Publisher Location", "country": "Country", "world_area": "World Area", "region": "Region", "city": "City", "scale": "Scale 1", "obj_height_cm": "Obj Height cm", "obj_width_cm": "Obj Width cm", "full_title": "Full Title", "reference": "Reference"}
RECORD_PAGE = "https://www.davidrumsey.com/luna/servlet/detail/"


def handoff(items: DataFrame) -> DataFrame:
    """The 21 columns of maps that need control points; ``items``: id, iiifManifest, urlSize0, urlSize4, fieldValues, status."""
    get = lambda name: idents.named_field(F.col("fieldValues"), name)
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    item_id = F.coalesce("id", F.lit(""))
    return items.select(
        item_id.alias("id"),
        F.coalesce(some(get("Title"), item_id), F.lit("")).alias("title"),
        F.coalesce(some(get("Date"), get("Pub Date")), F.lit("")).alias("date"),
        *[get(name).alias(c) for c, name in RECORD_FIELDS.items()],
        ranking.richness(F.col("fieldValues")).alias("richness_score"),
        F.col("urlSize0").alias("thumbnail_url"),
        F.col("urlSize4").alias("image_url"),
        F.col("iiifManifest").alias("iiif_manifest"),
        F.concat(F.lit(RECORD_PAGE), item_id).alias("rumsey_page"),
        "status",
    )


def sample_weights(maps: DataFrame, source: str) -> DataFrame:
    """map_id and the text of its weights file."""
    if source not in WEIGHTS:
        raise ValueError(f"no weights for {source}")
    body = F.to_json(F.struct(weight_map(source).alias("land_cover_weights"), F.lit(TOPOGRAPHY_WEIGHT).alias("topography_weight"), F.lit(source).alias("source"), F.col("map_file")))
    return maps.select("map_id", body.alias("json"))


def _in_parts(rows: DataFrame, fields: list[str], order: list[str], list_name: str, file_name: str, per: int) -> DataFrame:
    """name and text of files that hold a list of up to ``per`` rows each, in their order; places come from ranges, so no task holds all."""
    placed = numbered(rows.select(*fields), [F.col(c) for c in order], name="_place").withColumn("_file", F.floor((F.col("_place") - 1) / per))
    body = F.transform(F.array_sort(F.collect_list(F.struct("_place", F.struct(*fields).alias("row")))), lambda r: r["row"])
    lists = placed.groupBy("_file").agg(body.alias(list_name))
    return lists.select(F.format_string(f"{file_name}_%07d.json", "_file").alias("name"), F.to_json(F.struct(list_name)).alias("content"))


#: Rows of a manifest file.
PER_FILE = 10_000


def scene_manifest(scenes: DataFrame, per: int = PER_FILE) -> DataFrame:
    """name and content of the files that list all resolved scenes by region; ``files.resolved_scenes`` of their folder gives them back."""
    return _in_parts(scenes, ["region_id", "bbox", "datetime_range", "visual_href", "eo_cloud_cover"], ["region_id", "visual_href", "eo_cloud_cover"], "scenes", "resolved_scenes", per)


def coverage_summary(cells: DataFrame, per: int = PER_FILE) -> DataFrame:
    """name and content of the files that list cells (lat, lon, counts of classes); ``files.coverage_cells`` of their folder gives them back."""
    return _in_parts(cells, ["lat", "lon", "counts"], ["lat", "lon"], "cells", "coverage", per)


def scene_status(scenes: DataFrame) -> DataFrame:
    """``status`` of each region's scene: none found, without an image, or ok."""
    return scenes.withColumn("status", F.when(F.col("scene_id").isNull(), "no_scene").when(F.col("visual_href").isNull(), "missing_visual_asset").otherwise("ok"))


def metrics_file(scores: DataFrame, date: Column | None = None) -> DataFrame:
    """name and text of a metrics file for each config (config, joint_nll, variant, backbone)."""
    body = F.struct("config", "joint_nll", "variant", "backbone", (F.current_date() if date is None else date).cast("string").alias("eval_date"))
    return scores.where(idents.is_config_name(F.col("config"))).select(F.concat("config", F.lit("-nll.json")).alias("name"), F.to_json(body).alias("json"))
