"""Coverage, ranking, catalogue records, scenes and the accounting of what is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, idents
from ..functions.taxonomy import LAND_COVER, MAP_TYPES, UPWEIGHT, UPWEIGHTED, values
from .ordinals import numbered


def class_counts(rows: DataFrame, cell: list[str], label: str, n: int = len(LAND_COVER)) -> DataFrame:
    """Cells with an array of their class counts; cells without a known class go."""
    counts = F.array(*[F.count_if(F.col(label) == i) for i in range(n)]).alias("counts")
    return rows.groupBy(*cell).agg(counts).where(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) > 0)


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = lambda x: x / total
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, share(x) * F.ln(share(x))).otherwise(0.0))).otherwise(0.0)


def diversity(counts: Column) -> Column:
    present = reduce(lambda a, b: a + b, [F.when(F.get(counts, F.lit(i)) > 0, 1).otherwise(0) for i in UPWEIGHTED])
    return entropy(counts) * F.pow(F.lit(UPWEIGHT), present)


def pick_regions(cells: DataFrame, n: int, order: list[Column], seed: int = 42) -> DataFrame:
    """The n most diverse cells (``counts``); equal ones come in a seeded order, by the digest of the seed and ``order``, which names the cell."""
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in order]).cast("binary"))
    return cells.withColumn("score", F.round(diversity(F.col("counts")), 6)).orderBy(F.desc("score"), shuffled, *order).limit(n)


def type_allowed(kind: Column) -> Column:
    """Missing types pass."""
    return (F.coalesce(kind, F.lit("")) == "") | kind.isin(MAP_TYPES)


def year_allowed(date: Column, start: int, end: int) -> Column:
    """The year from the first four characters; what is no year passes."""
    year = F.substring(F.btrim(date), 1, 4).try_cast("int")
    return year.isNull() | year.between(start, end)


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregation with partial results, where a window would sort whole groups."""
    cols = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return rows.groupBy(*key).agg(first.alias("_f")).select(*key, "_f.*")


# Fields of a record and what each adds to its richness.
RICHNESS = [("Country", 4), ("World Area", 4), ("City", 2), ("Region", 2), ("Scale 1", 3), ("Reference", 2), ("Engraver or Printer", 1)]


def richness(fields: Column) -> Column:
    """Score of a record by the fields it has, and by the size of the object."""
    get = lambda name: F.coalesce(idents.named_field(fields, name), F.lit(""))
    score = reduce(lambda a, b: a + b, [F.when(get(n) != "", w).otherwise(0) for n, w in RICHNESS])
    area = get("Obj Height cm").try_cast("double") * get("Obj Width cm").try_cast("double")
    return score + F.when(area >= 500, 1).otherwise(0) + F.when(area >= 1200, 1).otherwise(0)


def top_n(rows: DataFrame, score: str, n: int, order: list[str]) -> DataFrame:
    return rows.orderBy(F.desc(score), *order).limit(n)


def lowest_cloud(regions: DataFrame, scenes: DataFrame, key: str, most: float = 10.0) -> DataFrame:
    """Each region with its least cloudy scene (``scene_id``, ``cloud``), the first of equal ones; null without any.

    A scene without a figure passes the filter and counts as 100.
    """
    fit = scenes.where(F.col("cloud").isNull() | (F.col("cloud") < most))
    best = fit.groupBy(key).agg(F.min(F.struct(F.coalesce("cloud", F.lit(100.0)).alias("c"), F.col("scene_id").alias("s"))).alias("b"))
    return regions.join(best, key, "left").select(*regions.columns, F.col("b.s").alias("scene_id"), F.col("b.c").alias("cloud"))


def latest_checkpoint(files: DataFrame, key: str) -> DataFrame:
    """The highest step that loads; ``files``: key, name, valid."""
    good = files.where("valid").withColumn("step", idents.checkpoint_step(F.col("name"))).where("step IS NOT NULL")
    return good.groupBy(key).agg(F.max("step").alias("step")).withColumn("name", idents.checkpoint_name(F.col("step")))


#: What can become of a record, the best first.
STATUSES = ["ok", "out_of_scale", "download_failed", "gcps_insufficient", "not_in_allmaps"]


def best_status(rows: DataFrame, key: str) -> DataFrame:
    """Per key the best status of its parts."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return rows.groupBy(key).agg(F.min(F.when(place > 0, place)).alias("p")).select(key, F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.col("p") - 1).cast("int")), F.lit(STATUSES[-1])).alias("status"))


def accounting(rows: DataFrame, statuses: list[str] = STATUSES) -> DataFrame:
    """Count of every status, zero where there is none."""
    spark = rows.sparkSession
    every = values(spark, "status", [(s,) for s in statuses])
    return every.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def alarms(rows: DataFrame) -> DataFrame:
    """Whether too many are out of scale, or too few ok."""
    share = lambda s: F.try_divide(F.count_if(F.col("status") == s), F.count(F.lit(1)))
    rates = rows.agg(F.count(F.lit(1)).alias("total"), share("out_of_scale").alias("scale_rate"), share("ok").alias("ok_rate"))
    return rates.select("total", F.round("scale_rate", 6).alias("scale_rate"), F.round("ok_rate", 6).alias("ok_rate"), F.coalesce(F.col("scale_rate") > 0.5, F.lit(False)).alias("scale_alarm"), F.coalesce(F.col("ok_rate") < 0.5, F.lit(False)).alias("ok_alarm"))


def plates(items: DataFrame, annotations: str) -> DataFrame:
    """A row for each annotation of an item with its ordinal; items without one stay."""
    return items.select(*[c for c in items.columns if c != annotations], F.posexplode_outer(annotations).alias("plate", "annotation"))


def in_scale(west: Column, south: Column, east: Column, north: Column, low: float = 100.0, high: float = 2000.0) -> Column:
    return geo.bbox_diagonal_km(west, south, east, north).between(low, high)


def usable_gcps(gcps: Column, image_id: Column, width: Column, height: Column) -> Column:
    return (F.size(gcps) >= 3) & (F.coalesce(image_id, F.lit("")) != "") & (width > 0) & (height > 0)


def gcp_bbox(points: DataFrame, key: str) -> DataFrame:
    """Bounds of control points (px, py, lng, lat) per key."""
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n_gcps"), F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))


def affine_fit(points: DataFrame, key: str) -> DataFrame:
    """Least-squares lng = a*px + b*py + c and lat = d*px + e*py + f per key, from sums about the means.

    Keys whose points lie on a line have nulls.
    """
    mean = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("px", "py", "lng", "lat")])
    d = points.join(mean, key).select(key, "n", *[f"m_{c}" for c in ("px", "py", "lng", "lat")], *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("px", "py", "lng", "lat")])
    s = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    sums = d.groupBy(key, "n", *[f"m_{c}" for c in ("px", "py", "lng", "lat")]).agg(s("px", "px"), s("px", "py"), s("py", "py"), s("px", "lng"), s("py", "lng"), s("px", "lat"), s("py", "lat"))
    det = F.col("px_px") * F.col("py_py") - F.col("px_py") * F.col("px_py")
    out = [F.col(key), F.col("n")]
    for target, (a, b, c) in {"lng": "abc", "lat": "def"}.items():
        x = F.try_divide(F.col(f"px_{target}") * F.col("py_py") - F.col(f"py_{target}") * F.col("px_py"), det)
        y = F.try_divide(F.col(f"py_{target}") * F.col("px_px") - F.col(f"px_{target}") * F.col("px_py"), det)
        out += [x.alias(a), y.alias(b), (F.col(f"m_{target}") - x * F.col("m_px") - y * F.col("m_py")).alias(c)]
    return sums.select(*out)


def region_tiles(boxes: DataFrame, step: int) -> DataFrame:
    """Grid tiles that each box (west, south, east, north) touches: a generator in place of a range join."""
    lat = boxes.select("*", F.explode(geo.tiles_between(F.col("south"), F.col("north"), step)).alias("lat_sw"))
    return lat.select("*", F.explode(geo.tiles_between(F.col("west"), F.col("east"), step)).alias("lon_sw"))


def unknown_codes(rows: DataFrame, code: str, known: list[int]) -> DataFrame:
    return rows.select(F.col(code).alias("code")).distinct().where(~F.col("code").isin([0, *known]))


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds percentages; the total is one row that is joined, so the rows stay where they are."""
    total = counts.agg(F.sum(n).alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("pct", F.try_divide(F.col(n) * 100.0, F.col("_t"))).drop("_t")


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def sampled(rows: DataFrame, key: str, share_of: int = 10, seed: int = 42) -> DataFrame:
    """A tenth of the rows, one at least, with the lowest seeded digests."""
    from .datasets import lowest_digests

    return lowest_digests(rows, key, seed, lambda n: F.greatest(F.lit(1), F.floor(n / share_of)), "_in").where("_in").drop("_in")


def selection(rows: DataFrame, by: list[str], chosen: Column, score: str) -> DataFrame:
    """How many rows are chosen, of how many, and the least and greatest score among them."""
    inside = F.when(chosen, F.col(score))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(chosen).alias("n_chosen"), F.min(inside).alias("low"), F.max(inside).alias("high"))


def every(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Every ``k``-th row of each run, with its step."""
    return rows.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.pmod(F.col("step"), F.lit(k)) == 0)


def item_status(items: DataFrame, plates: DataFrame, key: str) -> DataFrame:
    """Per item the best status of its plates. Without a manifest or plates it is not in the annotations; a lookup that failed is a failed download.

    ``items``: key, manifest, lookup_failed; ``plates``: key, status. ``raw_reason`` is what was found before precedence and defaults: no_manifest,
    lookup_failed, no_plates, or the statuses of all plates, each once, as ``insufficient points`` never shows behind a better plate.
    """
    place = lambda s: F.array_position(F.array(*[F.lit(x) for x in STATUSES]), s)
    found = plates.where(place(F.col("status")) > 0).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("status")), "+").alias("_all"))
    best = best_status(plates, key).withColumnRenamed("status", "_best").join(found, key, "left")
    early = F.when(F.coalesce(F.col("manifest"), F.lit("")) == "", STATUSES[-1]).when(F.col("lookup_failed"), "download_failed")
    raw = F.when(F.coalesce(F.col("manifest"), F.lit("")) == "", "no_manifest").when(F.col("lookup_failed"), "lookup_failed").otherwise(F.coalesce("_all", F.lit("no_plates")))
    return items.join(best, key, "left").select(key, F.coalesce(early, F.col("_best"), F.lit(STATUSES[-1])).alias("status"), raw.alias("raw_reason"))


def by_template(sources: DataFrame) -> DataFrame:
    """template, src_id and ``place``: each template's members in order, from 1; a template of all sources is spread over all tasks."""
    return numbered(sources.select("template", "src_id"), [F.col("src_id")], ["template"])
