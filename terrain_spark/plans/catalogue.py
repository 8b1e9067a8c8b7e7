"""Every query of the reference's own operators, by name, with the SQL that must give the same rows.

The given tables have other subjects, so each query names the columns that stand in for maps, pixels or scenes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, geo, idents
from ..functions.taxonomy import BIOMES, DESCRIPTIONS, INSPECTION, INSPECTION_TOPOGRAPHY, LAND_COVER, PALETTES, PROMPTS, REQUIRED_FILES, TILE_PREFIXES, TOPOGRAPHY, WEIGHTS, WORLD_COVER, biomes, inspection_palette, literal, palettes, source_weights, tile_prefixes, topography_palette, values, weight_map
from ..operators import assembly, blocks, datasets, metrics, pyramid, ranking, raster, samples, warp
from ..operators.spread import spread
from ..sources import files, png, pyramids, records, tiff
from ..sources.shared import new_path
from . import lifecycles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """A constant table in DuckDB's SQL."""
    text = lambda v: "[" + ", ".join(map(text, v)) + "]" if isinstance(v, list) else literal(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({columns})"


# --- coverage -------------------------------------------------------------------------------------------------

EVENTS = {"click": 0, "error": 3, "purchase": 4, "signup": 5, "view": 7}
_ent = " + ".join(f"CASE WHEN n{i} > 0 THEN (n{i} / t) * ln(n{i} / t) ELSE 0 END" for i in EVENTS.values())


def _event_class():
    return F.try_element_at(F.create_map(*[F.lit(x) for p in EVENTS.items() for x in p]), F.col("event_type"))


DIVERSITY_SQL = f"""
WITH c AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS t, {", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{e}') AS DOUBLE) AS n{i}" for e, i in EVENTS.items())}
           FROM events WHERE event_type IN ({", ".join(map(repr, EVENTS))}) GROUP BY user_id),
s AS (SELECT user_id, CAST(user_id % 140 - 70 AS INTEGER) AS lat, CAST(user_id % 350 - 175 AS INTEGER) AS lon,
        round(-({_ent}) * pow(1.5, (n4 > 0)::INT + (n5 > 0)::INT + (n7 > 0)::INT), 6) AS score FROM c)
SELECT user_id, printf('wc_%+03d_%+04d', lat, lon) AS region_id, score,
  CASE WHEN lat > 23.5 THEN '2023-05-01/2023-09-30' WHEN lat < -23.5 THEN '2022-12-01/2023-02-28' ELSE '2023-01-01/2023-12-31' END AS season
FROM s ORDER BY score DESC, md5('42:' || user_id), user_id LIMIT 20
"""


@query(DIVERSITY_SQL)
def diversity_topn(spark, sf):
    cells = ranking.class_counts(table(spark, sf, "events").select("user_id", _event_class().alias("class")), ["user_id"], "class")
    best = ranking.pick_regions(cells, 20, [F.col("user_id")])
    lat, lon = (F.col("user_id") % 140 - 70).cast("int"), (F.col("user_id") % 350 - 175).cast("int")
    return best.select("user_id", idents.signed_id(lat, lon).alias("region_id"), "score", geo.season(lat).alias("season"))


# --- labels ---------------------------------------------------------------------------------------------------

PARTS = "SELECT p_partkey, p_size * 2 AS h, CAST(p_partkey % 24 AS INTEGER) AS biome FROM part"
_biome_rows = rows_sql("biome, lc", [(i, LAND_COVER.index(c)) for i, _, c in BIOMES])
LABELS_SQL = f"""
WITH p AS ({PARTS}), b AS (SELECT * FROM {_biome_rows})
SELECT p.p_partkey, p.h, p.biome, CAST(CASE WHEN h < 20 THEN 0 ELSE coalesce(b.lc, 6) END AS INTEGER) AS lc,
  CAST(CASE WHEN h < 20 THEN NULL WHEN h <= 36 THEN 0 WHEN h <= 64 THEN 1 ELSE 2 END AS INTEGER) AS topo,
  round((h - 20) / 80.0 * 100.0, 6) AS norm_h
FROM p LEFT JOIN b USING (biome)
"""


def _labelled(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 2).alias("h"), (F.col("p_partkey") % 24).cast("int").alias("biome"))
    joined = rows.join(F.broadcast(biomes(spark).select("biome", "lc")), "biome", "left")
    return joined.select("p_partkey", "h", "biome", classes.land_cover(F.col("h"), F.col("lc")).alias("lc"), classes.topography(F.col("h")).alias("topo"))


@query(LABELS_SQL)
def topo_landcover(spark, sf):
    return _labelled(spark, sf).withColumn("norm_h", F.round(classes.normalised_height(F.col("h")), 6))


@query(f"WITH l AS ({LABELS_SQL}) SELECT p_partkey, lc, CAST(CASE WHEN lc = 0 THEN 255 ELSE coalesce(topo, 255) END AS INTEGER) AS topo FROM l")
def water_mask(spark, sf):
    return raster.masked_water(_labelled(spark, sf)).select("p_partkey", "lc", "topo")


CODE_SQL = "CAST(CASE WHEN l_orderkey % 11 = 0 THEN 95 WHEN l_orderkey % 13 = 0 THEN 100 WHEN l_orderkey % 17 = 0 THEN 33 ELSE l_linenumber * 10 END AS INTEGER)"


def _codes(spark, sf):
    k = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(F.when(k % 11 == 0, 95).when(k % 13 == 0, 100).when(k % 17 == 0, 33).otherwise(F.col("l_linenumber") * 10).cast("int").alias("code"))


@query(f"""WITH c AS (SELECT {CODE_SQL} AS code FROM lineitem), m AS (SELECT * FROM {rows_sql("code, lc", WORLD_COVER)})
SELECT c.code, CAST(coalesce(m.lc, 255) AS INTEGER) AS lc, count(*) AS n FROM c LEFT JOIN m USING (code) GROUP BY 1, 2""")
def wc_remap(spark, sf):
    return _codes(spark, sf).withColumn("lc", classes.from_world_cover(F.col("code"))).groupBy("code", "lc").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT {CODE_SQL} AS code FROM lineitem WHERE {CODE_SQL} NOT IN (0, {', '.join(str(a) for a, _ in WORLD_COVER)})")
def unknown_codes(spark, sf):
    return ranking.unknown_codes(_codes(spark, sf), "code", [a for a, _ in WORLD_COVER])


NAME_RULES = [("red", 1, 0), ("red widget", 1, 2), ("red w", 1, 1), ("small", 2, 0), ("small ri", 2, 1), ("o", 3, None), ("old anvil", 3, 1), ("cold gear", 4, 0)]


@query(f"""WITH r AS (SELECT * FROM {rows_sql("prefix, lc, topo", NAME_RULES)}),
m AS (SELECT p_partkey, p_name, prefix, lc, topo, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS rn FROM part JOIN r ON starts_with(p_name, prefix))
SELECT p_partkey, p_name, prefix, CAST(lc AS INTEGER) AS lc, CAST(topo AS INTEGER) AS topo FROM m WHERE rn = 1""")
def longest_prefix(spark, sf):
    rules = values(spark, "prefix, lc, topo", NAME_RULES)
    return samples.longest_prefix(table(spark, sf, "part").select("p_partkey", "p_name"), rules, "p_name", [len(r[0]) for r in NAME_RULES])


_stems = [p for p, _, _ in TILE_PREFIXES] + ["hex_river_bend", "hex_path"]
_tile_sql = f"""
n AS (SELECT p_partkey, list_extract([{", ".join(literal(s) for s in _stems)}], CAST(p_partkey % {len(_stems)} AS INTEGER) + 1) || '_' || p_partkey AS name FROM part),
r AS (SELECT * FROM {rows_sql("prefix, lc, topo", TILE_PREFIXES)}),
m AS (SELECT p_partkey, CAST(lc AS INTEGER) AS lc, CAST(topo AS INTEGER) AS topo, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS rn FROM n JOIN r ON starts_with(name, prefix)),
tiles AS (SELECT p_partkey, lc, topo FROM m WHERE rn = 1)"""


def _hex_name():
    return F.concat_ws("_", F.get(F.array(*[F.lit(s) for s in _stems]), (F.col("p_partkey") % len(_stems)).cast("int")), F.col("p_partkey").cast("string"))


def _hex_tiles(spark, sf):
    return samples.longest_prefix(table(spark, sf, "part").select("p_partkey", _hex_name().alias("name")), tile_prefixes(spark), "name", [len(r[0]) for r in TILE_PREFIXES]).select("p_partkey", "lc", "topo")


@query(f"WITH {_tile_sql} SELECT * FROM tiles")
def tile_labels(spark, sf):
    return _hex_tiles(spark, sf)


# --- manifests and splits -------------------------------------------------------------------------------------

@query("""
WITH f AS (SELECT CASE WHEN c_custkey % 37 = 0 THEN 'K' ELSE 'k' END || c_custkey // 100 || '_' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '.geojson' AS filename FROM customer),
e AS (SELECT DISTINCT 'k' || o_custkey // 100 || '_' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || '.geojson' AS filename,
        CASE WHEN o_custkey % 29 = 0 THEN 'other' ELSE 'k' || o_custkey // 100 END AS template FROM orders WHERE o_custkey % 5 <> 0
      UNION ALL SELECT 'ghost_01.geojson', 'ghost'),
j AS (SELECT coalesce(f.filename, e.filename) AS filename, f.filename IS NOT NULL AS there, e.filename IS NOT NULL AS listed, template FROM f FULL JOIN e ON f.filename = e.filename),
x AS (SELECT filename, CASE WHEN there AND NOT regexp_full_match(filename, '[a-z][a-z0-9_]*_[0-9]{2}\\.geojson') THEN 'bad_name' END AS error FROM j
      UNION ALL SELECT filename, CASE WHEN there AND NOT listed THEN 'unlisted' END FROM j
      UNION ALL SELECT filename, CASE WHEN listed AND NOT there THEN 'phantom' END FROM j
      UNION ALL SELECT filename, CASE WHEN there AND listed AND template <> regexp_replace(filename, '_[^_]*$', '') THEN 'template_mismatch' END FROM j)
SELECT filename, error FROM x WHERE error IS NOT NULL
""")
def manifest_reconcile(spark, sf):
    def name(k, upper):
        head = F.when(k % 37 == 0, "K").otherwise("k") if upper else F.lit("k")
        return F.concat(head, F.floor(k / 100).cast("string"), F.lit("_"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(".geojson"))

    files = table(spark, sf, "customer").select(name(F.col("c_custkey"), True).alias("filename"))
    k = F.col("o_custkey")
    listed = table(spark, sf, "orders").where(k % 5 != 0).select(name(k, False).alias("filename"), F.when(k % 29 == 0, "other").otherwise(F.concat(F.lit("k"), F.floor(k / 100).cast("string"))).alias("template")).distinct()
    return datasets.reconcile(files, listed.union(values(spark, "filename, template", [("ghost_01.geojson", "ghost")])))


@query("""
SELECT replace(c_name, '#', '_') AS src_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'seg_' || lower(c_mktsegment) ELSE lower(regexp_extract(replace(c_name, '#', '_'), '^(.+?)[ _-]+[0-9]+$', 1)) END AS template
FROM customer
""")
def template_fallback(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", idents.sanitised(F.col("c_name")).alias("src_id"))
    given = rows.where("c_custkey % 3 = 0").select("src_id", F.concat(F.lit("seg_"), F.lower("c_mktsegment")).alias("template"))
    return datasets.with_template(rows.select("src_id"), given)


@query("""
WITH n AS (SELECT DISTINCT p_name || list_extract(['#', '_', ' '], CAST(p_partkey % 3 AS INTEGER) + 1) || (p_partkey % 20) AS name FROM part),
s AS (SELECT name, regexp_replace(name, '[^a-zA-Z0-9_-]', '_', 'g') AS sid FROM n)
SELECT sid, list_sort(list(name)) AS names, count(*) AS n FROM s GROUP BY sid HAVING count(*) > 1
""")
def id_collisions(spark, sf):
    sign = F.get(F.array(F.lit("#"), F.lit("_"), F.lit(" ")), (F.col("p_partkey") % 3).cast("int"))
    return datasets.collisions(table(spark, sf, "part").select(F.concat("p_name", sign, (F.col("p_partkey") % 20).cast("string")).alias("name")))


SPLIT_SQL = """
s AS (SELECT CAST(c_custkey AS VARCHAR) AS src_id, c_mktsegment AS template FROM customer),
r AS (SELECT src_id, template, row_number() OVER (PARTITION BY template ORDER BY md5('42:' || template || ':' || src_id), src_id) AS rn, count(*) OVER (PARTITION BY template) AS n FROM s),
split AS (SELECT src_id, template, CASE WHEN rn <= least(n, greatest(1, round_even(n * 0.15, 0))) THEN 'test' ELSE 'train' END AS subset FROM r)"""


def _split(spark, sf):
    return datasets.stratified_split(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("src_id"), F.col("c_mktsegment").alias("template")))


@query(f"WITH {SPLIT_SQL} SELECT src_id, template, subset FROM split")
def stratified_split(spark, sf):
    return _split(spark, sf)


@query(f"WITH {SPLIT_SQL} SELECT o_orderkey, coalesce(subset, 'train') AS subset FROM orders LEFT JOIN (SELECT * FROM split WHERE subset = 'test') s ON s.src_id = CAST(o_custkey AS VARCHAR)")
def split_routing(spark, sf):
    test = _split(spark, sf).where("subset = 'test'").select(F.col("src_id").cast("bigint").alias("o_custkey"))
    return datasets.routed(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), test, "o_custkey").select("o_orderkey", "subset")


@query(f"WITH {SPLIT_SQL} SELECT o_custkey FROM orders EXCEPT SELECT CAST(src_id AS BIGINT) FROM split WHERE subset = 'test'")
def train_except_test(spark, sf):
    test = _split(spark, sf).where("subset = 'test'").select(F.col("src_id").cast("bigint").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").distinct().join(test, "o_custkey", "left_anti")


@query(f"WITH {SPLIT_SQL} SELECT template, count(*) AS n, count(*) FILTER (WHERE subset = 'test') AS n_test, list_sort(list(src_id))[1:5] AS first_ids FROM split GROUP BY template")
def template_members(spark, sf):
    rows = _split(spark, sf)
    first = ranking.by_template(rows).where("place <= 5").groupBy("template").agg(F.array_sort(F.collect_list("src_id")).alias("first_ids"))
    sizes = rows.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("subset") == "test").alias("n_test"))
    return sizes.join(first, "template").select("template", "n", "n_test", "first_ids")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS part FROM r
""")
def row_split(spark, sf):
    return datasets.row_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("""
WITH o AS (SELECT p_partkey AS map_id, unnest(['image.png', 'land_cover.png', 'topography.png', 'sample_weights.json']) AS name FROM part),
k AS (SELECT CAST(map_id AS VARCHAR) AS map_id, name FROM o WHERE (map_id + length(name)) % 7 <> 0 OR map_id % 10 = 0),
m AS (SELECT i.map_id, list_sort(list(r.name)) AS missing FROM (SELECT DISTINCT map_id FROM k) i CROSS JOIN (SELECT unnest(['image.png', 'land_cover.png', 'topography.png', 'sample_weights.json']) AS name) r
      LEFT JOIN k ON k.map_id = i.map_id AND k.name = r.name WHERE k.name IS NULL GROUP BY 1)
SELECT map_id, missing FROM m
""")
def required_files(spark, sf):
    return datasets.missing_files(_objects(spark, sf))


def _objects(spark, sf):
    every = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.lit(x) for x in REQUIRED_FILES])).alias("name"))
    return every.where("(id + length(name)) % 7 <> 0 OR id % 10 = 0").select(F.col("id").cast("string").alias("map_id"), "name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def incremental_skip(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return datasets.unfinished(table(spark, sf, "part").select("p_partkey", "p_name"), done, "p_partkey")


# --- catalogue records ----------------------------------------------------------------------------------------

@query("""
WITH d AS (SELECT d.doc_id, d.lang, CASE l.quality WHEN 1 THEN 'Map' WHEN 0 THEN 'Text Page' END AS kind,
             CASE doc_id % 4 WHEN 0 THEN '1600' WHEN 1 THEN ' 1699-1701' WHEN 2 THEN 'n.d.' ELSE '1799' END AS date FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, count(*) AS n FROM d WHERE (kind IS NULL OR kind = 'Map') AND doc_id % 4 <> 3 GROUP BY lang
""")
def null_pass_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    q, k = F.col("quality"), F.col("doc_id") % 4
    rows = docs.select("lang", F.when(q == 1, "Map").when(q == 0, "Text Page").alias("kind"), F.when(k == 0, "1600").when(k == 1, " 1699-1701").when(k == 2, "n.d.").otherwise("1799").alias("date"))
    return ranking.tally(rows.where(ranking.type_allowed(F.col("kind")) & ranking.year_allowed(F.col("date"), 1500, 1700)), "lang")


@query("""
WITH r AS (SELECT conv_id, turn, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(n_chars AS INTEGER) AS n_chars FROM r WHERE rn = 1
""")
def first_seen(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return ranking.first_seen(rows, ["conv_id"], ["turn", "text"]).select("conv_id", "turn", F.length("text").alias("n_chars"))


@query("""
WITH s AS (SELECT d.doc_id, CASE WHEN lang <> '' THEN 4 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END
   + CASE WHEN l.quality IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END
   + CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END + CASE WHEN n_chars >= 2400 THEN 1 ELSE 0 END AS score FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CAST(score AS INTEGER) AS score FROM s ORDER BY score DESC, doc_id LIMIT 50
""")
def richness_topk(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    one = lambda name, v: F.create_map(F.lit(name), F.array(v))
    some = lambda cond, v="x": F.when(cond, v).otherwise("")
    fields = F.array(one("country", F.col("lang")), one("World Area", some(F.col("doc_id") % 3 == 0)), one("SCALE 1", some(F.col("doc_id") % 5 == 0)), one("Reference", some(F.col("quality").isNotNull())), one("Engraver or Printer", some(F.col("toxic") == 1)), one("Obj Height cm", (F.col("n_chars") / 2).cast("string")), one("Obj Width cm", F.lit("1.0")))
    return ranking.top_n(docs.select("doc_id", ranking.richness(fields).alias("score")), "score", 50, ["doc_id"])


@query("""
WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 5 END AS cloud FROM events),
f AS (SELECT user_id, event_id, coalesce(cloud, 100.0) AS c FROM s WHERE cloud IS NULL OR cloud < 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c, event_id) AS rn FROM f)
SELECT c_custkey AS user_id, event_id AS scene_id, c AS cloud FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1) b ON b.user_id = c_custkey
""")
def lowest_cloud(spark, sf):
    scenes = table(spark, sf, "events").select("user_id", F.col("event_id").alias("scene_id"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 5).alias("cloud"))
    return ranking.lowest_cloud(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), scenes, "user_id", 0.5)


STATUS_OF = {"purchase": "ok", "view": "out_of_scale", "click": "download_failed", "signup": "gcps_insufficient", "error": "not_in_allmaps"}
STATUS_SQL = f"""
e AS (SELECT user_id, event_id % 400 AS item, CASE event_type {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(STATUS_OF))} END AS p FROM events),
best AS (SELECT user_id * 400 + item AS item, min(p) AS p FROM e GROUP BY user_id, item),
statuses AS (SELECT item, list_extract([{", ".join(map(literal, STATUS_OF.values()))}], CAST(p AS INTEGER) + 1) AS status FROM best)"""


def _statuses(spark, sf):
    status = F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS_OF.items() for x in p]), F.col("event_type"))
    rows = table(spark, sf, "events").select((F.col("user_id") * 400 + F.col("event_id") % 400).alias("item"), status.alias("status"))
    return ranking.best_status(rows, "item")


@query(f"WITH {STATUS_SQL} SELECT s.status, count(item) AS n FROM (SELECT unnest([{', '.join(map(literal, [*STATUS_OF.values(), 'never']))}]) AS status) s LEFT JOIN statuses USING (status) GROUP BY s.status")
def drop_accounting(spark, sf):
    return ranking.accounting(_statuses(spark, sf), [*ranking.STATUSES, "never"])


@query(f"WITH {STATUS_SQL}, r AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'out_of_scale') / count(*) AS a, count(*) FILTER (WHERE status = 'ok') / count(*) AS b FROM statuses) SELECT total, round(a, 6) AS scale_rate, round(b, 6) AS ok_rate, a > 0.5 AS scale_alarm, b < 0.5 AS ok_alarm FROM r")
def drop_alarm(spark, sf):
    return ranking.alarms(_statuses(spark, sf))


@query("SELECT o_custkey, max(o_orderkey) AS step, printf('step_%07d.pt', max(o_orderkey)) AS name FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def latest_checkpoint(spark, sf):
    files = table(spark, sf, "orders").select("o_custkey", idents.checkpoint_name(F.col("o_orderkey")).alias("name"), (F.col("o_orderstatus") != "P").alias("valid"))
    return ranking.latest_checkpoint(files, "o_custkey")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k FROM events")
def named_field(spark, sf):
    fields = F.array(F.transform_values(F.from_json("props", "map<string, string>"), lambda k, v: F.array(v)))
    return table(spark, sf, "events").select("event_id", idents.named_field(fields, "K", "none").alias("k"))


@query("SELECT source || '/full/!4096,4096/0/default.jpg' AS url, count(*) AS n FROM documents GROUP BY 1")
def iiif_urls(spark, sf):
    return ranking.tally(table(spark, sf, "documents").select(idents.iiif_url(F.concat("source", F.lit("/"))).alias("url")), "url")


@query("""
WITH c AS (SELECT conv_id, turn, role FROM conversations)
SELECT k.c_custkey AS item, CAST(row_number() OVER (PARTITION BY k.c_custkey ORDER BY turn, role) - 1 AS INTEGER) AS plate, role || '@' || turn AS annotation
FROM customer k JOIN c ON c.conv_id = k.c_custkey
UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM c)
""")
def annotation_plates(spark, sf):
    notes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit("@"), x["turn"].cast("string"))).alias("annotations"))
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("item")).join(notes, F.col("item") == F.col("conv_id"), "left").drop("conv_id")
    return ranking.plates(items, "annotations")


def _annotations(spark, sf):
    """Annotations of customers: two to five features, the first of every fourth malformed, sizes as text or zero."""
    c = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    feature = lambda i: F.to_json(F.struct(F.struct(F.array(F.col("c_custkey") % 97 + i, F.col("c_custkey") % 89).alias("resourceCoords")).alias("properties"), F.struct(F.array(F.col("c_nationkey") + i, F.col("c_custkey") % 50 - i).alias("coordinates")).alias("geometry")))
    n = F.col("c_custkey") % 4 + 2
    features = F.slice(F.array(F.when(F.col("c_custkey") % 4 == 3, F.lit('{"geometry":{"coordinates":["x"]}}')).otherwise(feature(0)), *[feature(i) for i in range(1, 5)]), F.lit(1), n.cast("int"))
    width = F.when(F.col("c_custkey") % 5 == 0, "0").otherwise((F.col("c_custkey") + 100).cast("string"))
    body = F.concat(F.lit('{"id":"a'), F.col("c_custkey").cast("string"), F.lit('","body":{"features":['), F.concat_ws(",", features), F.lit('],"transformation":{"type":"polynomial"}},"target":{"source":{"id":"img","width":"'), width, F.lit('","height":300},"selector":{"type":"SvgSelector","value":"<svg/>"}}}'))
    return c.select("c_custkey", body.alias("annotation"))


@query("""
WITH f AS (SELECT c_custkey, c_nationkey, unnest(range(CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END, c_custkey % 4 + 2)) AS i FROM customer)
SELECT c_custkey, CAST(count(*) AS INTEGER) AS n, CAST(min(c_nationkey + i) AS DOUBLE) AS west, CAST(min(c_custkey % 50 - i) AS DOUBLE) AS south, CAST(max(c_nationkey + i) AS DOUBLE) AS east, CAST(max(c_custkey % 50 - i) AS DOUBLE) AS north,
  'img' AS image_id, CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey + 100 END AS INTEGER) AS image_w, CAST(CASE WHEN c_custkey % 5 <> 0 THEN 300 END AS INTEGER) AS image_h, 'polynomial' AS transformation, '<svg/>' AS mask_svg, 'a' || c_custkey AS annotation_id
FROM f GROUP BY c_custkey, c_nationkey HAVING count(*) >= 3
""")
def annotation_parse(spark, sf):
    out = records.parsed_annotations(_annotations(spark, sf))
    return out.select("c_custkey", F.size("gcps").alias("n"), "west", "south", "east", "north", "image_id", "image_w", "image_h", "transformation", "mask_svg", "annotation_id")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 't' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title,
  CASE WHEN doc_id % 2 = 0 THEN '1650' ELSE '17??' END AS date, lang AS country, 'https://www.davidrumsey.com/luna/servlet/detail/' || doc_id AS rumsey_page, CAST(4 AS INTEGER) AS richness_score, source AS status
FROM documents
""")
def handoff_records(spark, sf):
    one = lambda name, v: F.create_map(F.lit(name), F.array(v))
    k = F.col("doc_id")
    fields = F.array(one("Country", F.col("lang")), one("TITLE", F.when(k % 3 == 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("")), one("date", F.when(k % 2 == 0, "1650").otherwise("")), one("Pub Date", F.lit("17??")))
    items = table(spark, sf, "documents").select(k.cast("string").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("iiifManifest", "urlSize0", "urlSize4")], fields.alias("fieldValues"), F.col("source").alias("status"))
    return records.handoff(items).select("id", "title", "date", "country", "rumsey_page", "richness_score", "status")


@query("""SELECT 'map' || s_suppkey AS map_id, '{"land_cover_weights":{"water":0.6,"trees":0.6,"shrubland":1.0,"grassland":1.0,"cropland":1.3,"built_up":1.3,"bare_sparse":1.0,"flooded_wetland":1.3,"snow_ice":1.0},"topography_weight":1.0,"source":"satellite","map_file":"' || s_name || '"}' AS json FROM supplier""")
def weights_files(spark, sf):
    maps = table(spark, sf, "supplier").select(F.concat(F.lit("map"), F.col("s_suppkey").cast("string")).alias("map_id"), F.col("s_name").alias("map_file"))
    return records.sample_weights(maps, "satellite")


@query("""SELECT 'c' || n_nationkey || '-nll.json' AS name, '{"config":"c' || n_nationkey || '","joint_nll":1.5,"variant":"A","backbone":"siglip","eval_date":"2024-01-02"}' AS json FROM nation""")
def metrics_files(spark, sf):
    scores = table(spark, sf, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("config"), F.lit(1.5).alias("joint_nll"), F.lit("A").alias("variant"), F.lit("siglip").alias("backbone"))
    return records.metrics_file(scores, F.lit("2024-01-02"))


@query("""
WITH s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type <> 'error') AS scene_id, bool_or(event_type = 'view') AS has FROM events GROUP BY user_id),
r AS (SELECT CASE WHEN scene_id IS NULL THEN 'no_scene' WHEN NOT has THEN 'missing_visual_asset' ELSE 'ok' END AS status FROM customer LEFT JOIN s ON user_id = c_custkey)
SELECT status, count(*) AS n FROM r GROUP BY status
""")
def scene_statuses(spark, sf):
    scenes = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("scene_id"), F.bool_or(F.col("event_type") == "view").alias("has"))
    rows = table(spark, sf, "customer").join(scenes, F.col("c_custkey") == F.col("user_id"), "left").select("scene_id", F.when(F.col("has"), "href").alias("visual_href"))
    return ranking.tally(records.scene_status(rows), "status")


# --- geography ------------------------------------------------------------------------------------------------

BOXES_SQL = "SELECT s_suppkey, (s_suppkey * 37 % 3300) / 10.0 - 165 AS west, (s_suppkey * 53 % 1300) / 10.0 - 65 AS south, s_suppkey % 7 + 0.5 AS w, s_suppkey % 5 + 0.25 AS h FROM supplier"


def _boxes(spark, sf):
    k = F.col("s_suppkey")
    b = table(spark, sf, "supplier").select("s_suppkey", ((k * 37 % 3300) / 10.0 - 165).alias("west"), ((k * 53 % 1300) / 10.0 - 65).alias("south"), (k % 7 + F.lit(0.5).cast("double")).alias("w"), (k % 5 + F.lit(0.25).cast("double")).alias("h"))
    return b.select("s_suppkey", "west", "south", (F.col("west") + F.col("w")).alias("east"), (F.col("south") + F.col("h")).alias("north"))


def _tiles_sql(step: int, name: str) -> str:
    return f"""
WITH b AS ({BOXES_SQL}), a AS (SELECT s_suppkey, unnest(range(CAST(floor(south / {step}) * {step} AS BIGINT), CAST(ceil(south + h) AS BIGINT), {step})) AS lat, west, w FROM b),
t AS (SELECT s_suppkey, lat, unnest(range(CAST(floor(west / {step}) * {step} AS BIGINT), CAST(ceil(west + w) AS BIGINT), {step})) AS lon FROM a)
SELECT s_suppkey, CAST(lat AS INTEGER) AS lat_sw, CAST(lon AS INTEGER) AS lon_sw, {name} AS tile FROM t"""


_ns, _ew = "CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END", "CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END"


@query(_tiles_sql(3, f"{_ns} || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || {_ew} || lpad(CAST(abs(lon) AS VARCHAR), 3, '0')"))
def region_tiles(spark, sf):
    return ranking.region_tiles(_boxes(spark, sf), 3).select("s_suppkey", "lat_sw", "lon_sw", idents.hemisphere_id(F.col("lat_sw"), F.col("lon_sw")).alias("tile"))


_dem = f"'Copernicus_DSM_COG_10_' || {_ns} || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || '_00_' || {_ew} || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '_00_DEM'"


@query(_tiles_sql(1, f"'{geo.DEM_BASE}/' || {_dem} || '/' || {_dem} || '.tif'"))
def elevation_tiles(spark, sf):
    return ranking.region_tiles(_boxes(spark, sf), 1).select("s_suppkey", "lat_sw", "lon_sw", geo.dem_url(F.col("lat_sw"), F.col("lon_sw")).alias("tile"))


_km = "2 * 6371.0 * asin(sqrt(pow(sin(radians(n - s) / 2), 2) + cos(radians(s)) * cos(radians(n)) * pow(sin(radians(e - w) / 2), 2)))"


@query(f"WITH b AS ({BOXES_SQL}), x AS (SELECT s_suppkey, west AS w, west + w AS e, south AS s, south + h AS n FROM b) SELECT s_suppkey, round({_km}, 4) AS km, {_km} BETWEEN 100 AND 800 AS in_scale FROM x")
def haversine_scale(spark, sf):
    b = [F.col(c) for c in ("west", "south", "east", "north")]
    return _boxes(spark, sf).select("s_suppkey", F.round(geo.bbox_diagonal_km(*b), 4).alias("km"), ranking.in_scale(*b, 100, 800).alias("in_scale"))


POINTS_SQL = "SELECT c_nationkey, c_custkey % 97 AS px, c_custkey % 89 AS py, 0.01::DOUBLE * (c_custkey % 97) + 0.002::DOUBLE * (c_custkey % 89) + c_nationkey AS lng, -0.02 * (c_custkey % 89) + 0.001 * (c_custkey % 97) + 40 + c_acctbal * 0.00001 AS lat FROM customer"


def _points(spark, sf):
    k, d = F.col("c_custkey"), lambda v: F.lit(v).cast("double")
    px, py = (k % 97).cast("double"), (k % 89).cast("double")
    return table(spark, sf, "customer").select("c_nationkey", px.alias("px"), py.alias("py"), (d(0.01) * px + d(0.002) * py + F.col("c_nationkey")).alias("lng"), (d(-0.02) * py + d(0.001) * px + 40 + F.col("c_acctbal") * d(0.00001)).alias("lat"))


@query(f"WITH p AS ({POINTS_SQL}) SELECT c_nationkey, count(*) AS n_gcps, round(min(lng), 6) AS west, round(min(lat), 6) AS south, round(max(lng), 6) AS east, round(max(lat), 6) AS north FROM p GROUP BY 1 HAVING count(*) >= 3")
def gcp_bbox(spark, sf):
    return ranking.gcp_bbox(_points(spark, sf), "c_nationkey").where("n_gcps >= 3").select("c_nationkey", "n_gcps", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


def _fit_sql(t: str, names: str) -> str:
    a = f"(covar_pop(px, {t}) * var_pop(py) - covar_pop(py, {t}) * covar_pop(px, py)) / (var_pop(px) * var_pop(py) - pow(covar_pop(px, py), 2))"
    b = f"(covar_pop(py, {t}) * var_pop(px) - covar_pop(px, {t}) * covar_pop(px, py)) / (var_pop(px) * var_pop(py) - pow(covar_pop(px, py), 2))"
    return f"round({a}, 5) + 0.0 AS {names[0]}, round({b}, 5) + 0.0 AS {names[1]}, round(avg({t}) - ({a}) * avg(px) - ({b}) * avg(py), 4) + 0.0 AS {names[2]}"


@query(f"WITH p AS ({POINTS_SQL}) SELECT c_nationkey, count(*) AS n, {_fit_sql('lng', 'abc')}, {_fit_sql('lat', 'def')} FROM p GROUP BY 1")
def affine_fit(spark, sf):
    return ranking.affine_fit(_points(spark, sf), "c_nationkey").select("c_nationkey", "n", *[(F.round(c, 4 if c in "cf" else 5) + F.lit(0.0)).alias(c) for c in "abcdef"])


@query("SELECT p_partkey, CAST(greatest(0, (300 + 40 * p_size - 1024) // 2) AS INTEGER) AS col_off, CAST(greatest(0, (300 + 40 * (p_partkey % 40) - 1024) // 2) AS INTEGER) AS row_off, CAST(least(300 + 40 * p_size, 1024) AS INTEGER) AS width, CAST(least(300 + 40 * (p_partkey % 40), 1024) AS INTEGER) AS height FROM part")
def centred_window(spark, sf):
    w, h = F.col("width"), F.col("height")
    return _maps(spark, sf).select(F.col("map_id").alias("p_partkey"), geo.window_start(w, 1024).alias("col_off"), geo.window_start(h, 1024).alias("row_off"), geo.window_size(w, 1024).alias("width"), geo.window_size(h, 1024).alias("height"))


@query(f"WITH b AS ({BOXES_SQL}) SELECT s_suppkey, CASE WHEN south > 23.5 THEN '2024-05-01/2024-09-30' WHEN south < -23.5 THEN '2023-12-01/2024-02-29' ELSE '2024-01-01/2024-12-31' END AS season, printf('wc_%+03d_%+04d', CAST(floor(south) AS INTEGER), CAST(floor(west) AS INTEGER)) AS region_id FROM b")
def season_range(spark, sf):
    return _boxes(spark, sf).select("s_suppkey", geo.season(F.col("south"), 2024).alias("season"), idents.signed_id(F.floor("south"), F.floor("west")).alias("region_id"))


@query(f"WITH p AS ({POINTS_SQL}), s AS (SELECT c_nationkey, px * 512 / 97.0 AS x, py * 512 / 89.0 AS y FROM p) SELECT c_nationkey, round(sum(x), 4) AS sum_x, round(sum(y), 4) AS sum_y FROM s GROUP BY 1")
def scaled_gcps(spark, sf):
    rows = _points(spark, sf).select("c_nationkey", geo.scaled(F.col("px"), F.lit(97.0), F.lit(512)).alias("x"), geo.scaled(F.col("py"), F.lit(89.0), F.lit(512)).alias("y"))
    return rows.groupBy("c_nationkey").agg(F.round(F.sum("x"), 4).alias("sum_x"), F.round(F.sum("y"), 4).alias("sum_y"))


@query(f"""WITH b AS ({BOXES_SQL}), r AS (SELECT s_suppkey, radians(south + h) AS p, radians(south + h / 2) AS p0, radians(w / 2) AS d FROM b),
k AS (SELECT *, 6371000.0 * sqrt(2.0 / (1 + sin(p0) * sin(p) + cos(p0) * cos(p) * cos(d))) AS k FROM r)
SELECT s_suppkey, round(k * cos(p) * sin(d), 2) AS x, round(k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(d)), 2) AS y FROM k""")
def equal_area(spark, sf):
    x, y = geo.laea(F.col("east"), F.col("north"), (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2)
    return _boxes(spark, sf).select("s_suppkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


# --- pyramids -------------------------------------------------------------------------------------------------

MAPS_SQL = "maps AS (SELECT p_partkey AS map_id, 300 + 40 * p_size AS width, 300 + 40 * CAST(p_partkey % 40 AS INTEGER) AS height FROM part)"
ORIGINS_SQL = f"""{MAPS_SQL},
g AS (SELECT map_id, width, height, unnest(range(0, height, 448)) AS oy FROM maps),
g2 AS (SELECT map_id, width, height, oy, unnest(range(0, width, 448)) AS ox FROM g),
origins AS (SELECT map_id, CAST(ox AS INTEGER) AS ox, CAST(oy AS INTEGER) AS oy, printf('py_r%03d_c%03d', oy // 448, ox // 448) AS pyramid_id FROM g2
  WHERE 2 * greatest(0, least(ox + 896, width) - ox) * greatest(0, least(oy + 896, height) - oy) >= 896 * 896)"""
TILES_SQL = f"""{ORIGINS_SQL},
q AS (SELECT q, q % 2 AS dx, q // 2 AS dy FROM range(4) t(q)),
tiles AS (
  SELECT map_id, pyramid_id, 0 AS level, '896' AS tile_id, CAST(NULL AS VARCHAR) AS parent_id, ox AS x, oy AS y, 896 AS size FROM origins
  UNION ALL SELECT map_id, pyramid_id, 1, '448_' || q, '896', ox + dx * 448, oy + dy * 448, 448 FROM origins CROSS JOIN q
  UNION ALL SELECT map_id, pyramid_id, 2, '224_' || a.q || '_' || b.q, '448_' || a.q, ox + a.dx * 448 + b.dx * 224, oy + a.dy * 448 + b.dy * 224, 224 FROM origins CROSS JOIN q a CROSS JOIN q b)"""


def _maps(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("map_id"), (F.col("p_size") * 40 + 300).alias("width"), ((F.col("p_partkey") % 40).cast("int") * 40 + 300).alias("height"))


def _tiles(spark, sf):
    return pyramid.tiles(pyramid.origins(_maps(spark, sf)))


@query(f"WITH {ORIGINS_SQL} SELECT map_id, ox, oy, pyramid_id FROM origins")
def pyramid_origins(spark, sf):
    return pyramid.origins(_maps(spark, sf)).select("map_id", "ox", "oy", "pyramid_id")


@query(f"WITH {TILES_SQL} SELECT map_id, pyramid_id, CAST(level AS INTEGER) AS level, tile_id, parent_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(size AS INTEGER) AS size FROM tiles")
def pyramid_tiles(spark, sf):
    return _tiles(spark, sf).select("map_id", "pyramid_id", "level", "tile_id", "parent_id", "x", "y", "size")


@query(f"WITH {TILES_SQL} SELECT map_id, pyramid_id, parent_id AS tile_id, list_sort(list(tile_id)) AS children FROM tiles WHERE parent_id IS NOT NULL GROUP BY 1, 2, 3")
def tile_tree(spark, sf):
    return pyramid.children(_tiles(spark, sf), ["map_id", "pyramid_id"])


_lost = "(length(tile_id) * 7 + map_id * 3 + x + y) % 11"


@query(f"WITH {TILES_SQL}, o AS (SELECT map_id || '/' || pyramid_id AS pyramid_id, tile_id || k AS name FROM tiles CROSS JOIN (SELECT unnest(['_image.png', '_land_cover.png', '_topography.png']) AS k) WHERE {_lost} <> 0 OR map_id % 2 = 0) SELECT pyramid_id, count(*) AS n_png FROM o GROUP BY 1 HAVING count(*) < 60")
def pyramid_complete(spark, sf):
    rows = _tiles(spark, sf).where(F.expr(f"{_lost} <> 0 OR map_id % 2 = 0"))
    named = rows.select("map_id", "pyramid_id", pyramid.artifacts(F.col("tile_id")).alias("a"))
    found = datasets.incomplete_pyramids(named.select("map_id", "pyramid_id", F.explode(F.array("a.image", "a.land_cover", "a.topography")).alias("name")), within=("map_id",))
    return found.select(F.concat_ws("/", F.col("map_id").cast("string"), "pyramid_id").alias("pyramid_id"), "n_png")


@query(f"WITH {TILES_SQL} SELECT DISTINCT map_id, pyramid_id FROM tiles WHERE size = 224 AND (x + y) % 5 = 0")
def distinct_groups(spark, sf):
    return _tiles(spark, sf).where("size = 224 AND (x + y) % 5 = 0").select("map_id", "pyramid_id").distinct()


# --- metrics --------------------------------------------------------------------------------------------------

def _pred_sql() -> str:
    d = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(12)]
    lse = lambda part: f"(greatest({', '.join(part)}) + ln({' + '.join(f'exp({x} - greatest({', '.join(part)}))' for x in part)}))"
    return f"""
e AS (SELECT vec_id, label AS lc, CAST(vec_id % 4 AS INTEGER) AS topo, list_extract(['historical', 'satellite', 'synthetic'], CAST(vec_id % 3 AS INTEGER) + 1) AS source, {", ".join(f"{x} AS d{i}" for i, x in enumerate(d))}, embedding FROM embeddings),
p AS (SELECT *, {lse([f"d{i}" for i in range(9)])} AS z, {lse(["d9", "d10", "d11"])} AS zt FROM e),
n AS (SELECT *, least(z - CAST(embedding[least(lc, 8) + 1] AS DOUBLE), 27.631021115928547) AS lc_nll, least(zt - CAST(embedding[10 + least(topo, 2)] AS DOUBLE), 27.631021115928547) AS topo_nll, lc BETWEEN 0 AND 8 AS lc_ok, topo BETWEEN 0 AND 2 AS topo_ok FROM p)"""


PRED_SQL = _pred_sql()


def _pixels(spark, sf):
    source = F.get(F.array(*[F.lit(s) for s in ("historical", "satellite", "synthetic")]), (F.col("vec_id") % 3).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("lc"), (F.col("vec_id") % 4).cast("int").alias("topo"), source.alias("source"), F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("logits"))


@query(f"WITH {PRED_SQL} SELECT count(*) FILTER (WHERE lc_ok AND topo_ok) AS n_valid, round(sum(lc_nll + topo_nll) FILTER (WHERE lc_ok AND topo_ok) / count(*) FILTER (WHERE lc_ok AND topo_ok), 6) AS joint_nll FROM n")
def joint_nll(spark, sf):
    return metrics.joint_nll(_pixels(spark, sf)).select("n_valid", F.round("joint_nll", 6).alias("joint_nll"))


@query(f"WITH {PRED_SQL} SELECT source, count(*) FILTER (WHERE lc_ok AND topo_ok) AS n_valid, round(avg(lc_nll) FILTER (WHERE lc_ok AND topo_ok), 6) AS lc_nll, round(avg(topo_nll) FILTER (WHERE lc_ok AND topo_ok), 6) AS topo_nll FROM n GROUP BY source")
def nll_per_head(spark, sf):
    return metrics.joint_nll(_pixels(spark, sf), ["source"]).select("source", "n_valid", F.round("lc_nll", 6).alias("lc_nll"), F.round("topo_nll", 6).alias("topo_nll"))


_weights_sql = rows_sql("source, lc, weight", [(s, i, w) for s, ws in WEIGHTS.items() for i, w in enumerate(ws)])


@query(f"""WITH {PRED_SQL}, w AS (SELECT source, lc, CAST(weight AS DOUBLE) AS weight FROM {_weights_sql}), j AS (SELECT n.*, weight FROM n LEFT JOIN w ON w.source = n.source AND w.lc = n.lc),
s AS (SELECT source, sum(weight * lc_nll) FILTER (WHERE lc_ok) / sum(weight) FILTER (WHERE lc_ok) AS a, avg(topo_nll) FILTER (WHERE topo_ok) AS b FROM j GROUP BY source)
SELECT source, round(a, 6) AS lc_loss, round(b, 6) AS topo_loss, round(a + b, 6) AS loss FROM s""")
def weighted_ce(spark, sf):
    out = metrics.weighted_ce(_pixels(spark, sf), source_weights(spark), ["source"])
    return out.select("source", *[F.round(c, 6).alias(c) for c in ("lc_loss", "topo_loss", "loss")])


@query("""WITH c AS (SELECT CAST(CASE WHEN label BETWEEN 0 AND 8 THEN label ELSE 9 END AS INTEGER) AS class, count(*) AS n FROM embeddings GROUP BY 1)
SELECT CAST(r.class AS INTEGER) AS class, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 6) AS pct FROM range(10) r(class) LEFT JOIN c USING (class)""")
def class_histogram(spark, sf):
    return ranking.share_of_total(metrics.histogram(table(spark, sf, "embeddings"), "label")).withColumn("pct", F.round("pct", 6))


@query("SELECT l_returnflag, round(avg(CASE WHEN l_linenumber = 7 THEN 1.0 ELSE 0.0 END) * 100, 6) AS nodata_pct FROM lineitem GROUP BY 1")
def nodata_pct(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 7, 255).otherwise(F.col("l_linenumber")).alias("lc"))
    return metrics.nodata_pct(rows, "lc", ["l_returnflag"]).withColumn("nodata_pct", F.round("nodata_pct", 6))


@query("SELECT o_orderstatus, round(sum(o_totalprice) / greatest(count(*), 1), 4) AS mean_loss FROM orders GROUP BY 1")
def epoch_mean(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(metrics.epoch_mean(F.sum("o_totalprice"), F.count(F.lit(1))), 4).alias("mean_loss"))


_w = lambda s: "[" + ", ".join(map(repr, WEIGHTS[s])) + "]"


@query(f"""WITH n AS (SELECT n_nationkey, len(list_filter(range({len(LAND_COVER)}), lambda i: (n_nationkey + i) % 5 = 0)) AS n_missing FROM nation)
SELECT n_nationkey, list_transform(range({len(LAND_COVER)}), lambda i: CASE WHEN (n_nationkey + i) % 5 <> 0 THEN CAST(n_nationkey + i AS DOUBLE) / 8 END) AS weights, CAST(n_missing AS INTEGER) AS n_missing FROM n""")
def weight_vectors(spark, sf):
    """Weights of each source in the order of the classes, from maps in another order that lack some of them."""
    names = F.reverse(F.array(*[F.struct(F.lit(c).alias("key"), F.lit(i).alias("i")) for i, c in enumerate(LAND_COVER)]))
    kept = F.filter(names, lambda n: (F.col("n_nationkey") + n["i"]) % 5 != 0)
    given = F.map_from_entries(F.transform(kept, lambda n: F.struct(n["key"], ((F.col("n_nationkey") + n["i"]) / 8).alias("value"))))
    return table(spark, sf, "nation").select("n_nationkey", metrics.weight_vector(given).alias("weights"), F.size(metrics.missing_weights(given)).alias("n_missing"))


@query(f"""WITH {PRED_SQL}, w AS (SELECT source, lc, CAST(weight AS DOUBLE) AS weight FROM {_weights_sql}), j AS (SELECT n.*, weight, vec_id % 30 AS sample FROM n LEFT JOIN w ON w.source = n.source AND w.lc = n.lc),
s AS (SELECT sample, coalesce(sum(weight * lc_nll) FILTER (WHERE lc_ok) / sum(weight) FILTER (WHERE lc_ok), 0) + coalesce(avg(topo_nll) FILTER (WHERE topo_ok), 0) AS loss FROM j GROUP BY sample HAVING bool_or(lc_ok OR topo_ok))
SELECT CAST(sample % 4 AS BIGINT) AS batch, count(*) AS n_samples, round(avg(loss), 6) AS loss FROM s GROUP BY 1""")
def batch_loss(spark, sf):
    pixels = _pixels(spark, sf).withColumn("sample", F.col("vec_id") % 30).withColumn("batch", F.col("sample") % 4)
    return metrics.batch_ce(pixels, source_weights(spark), ["sample"], ["batch"]).withColumn("loss", F.round("loss", 6))


@query("SELECT vec_id, CAST(len(embedding[1:9] || embedding[10:12]) AS INTEGER) AS n, CAST((embedding[1:9] || embedding[10:12])[11] AS DOUBLE) AS c10 FROM embeddings")
def stacked_channels(spark, sf):
    both = classes.stacked(F.slice("embedding", 1, 9), F.slice("embedding", 10, 3))
    return table(spark, sf, "embeddings").select("vec_id", F.size(both).alias("n"), F.get(both, F.lit(10)).cast("double").alias("c10"))


_names = "[" + ", ".join(map(literal, LAND_COVER)) + "]"


@query(f"SELECT n_nationkey, list_filter({_names}, lambda x: length(x) % 4 = n_nationkey % 4) AS missing, list_sort([n_name]) AS extra FROM nation")
def weight_keys(spark, sf):
    """Weight maps that lack some classes and have a name that is none."""
    names = F.array(*[F.lit(c) for c in LAND_COVER])
    keys = F.concat(F.filter(names, lambda x: F.length(x) % 4 != F.col("n_nationkey") % 4), F.array("n_name"))
    given = F.map_from_arrays(keys, F.transform(keys, lambda x: F.lit(1.0)))
    return table(spark, sf, "nation").select("n_nationkey", metrics.missing_weights(given).alias("missing"), metrics.extra_weights(given).alias("extra"))


@query("SELECT n_nationkey, round(n_nationkey::DOUBLE / 8 * (n_regionkey + 1) * 6, 6) AS hours FROM nation")
def probe_cost(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.round(metrics.probe_projection(F.col("n_nationkey") / 8, F.col("n_regionkey") + 1), 6).alias("hours"))


# --- rasters --------------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(CASE WHEN hi > lo THEN trunc((l_extendedprice - lo) / (hi - lo) * 255) ELSE 0 END AS INTEGER) AS byte, count(*) AS n FROM lineitem JOIN b USING (l_returnflag) GROUP BY 1, 2""")
def band_stretch(spark, sf):
    out = raster.stretch(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return ranking.tally(out, "l_returnflag", "byte")


GRID_SQL = "g AS (SELECT c_custkey AS id, CAST(c_custkey // 2500 AS INTEGER) AS map_id, CAST(c_custkey % 50 AS INTEGER) AS x, CAST(c_custkey % 2500 // 50 AS INTEGER) AS y, c_acctbal AS z FROM customer)"


def _grid(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.floor(k / 2500).cast("int").alias("map_id"), (k % 50).cast("int").alias("x"), F.floor(k % 2500 / 50).cast("int").alias("y"), F.col("c_acctbal").alias("z"))


def _grad_sql(axis: str, across: str) -> str:
    w = f"OVER (PARTITION BY id // 2500, {across} ORDER BY {axis})"
    return f"CASE WHEN lag(z) {w} IS NULL AND lead(z) {w} IS NULL THEN 0 WHEN lag(z) {w} IS NULL THEN (lead(z) {w} - z) / 10000.0 WHEN lead(z) {w} IS NULL THEN (z - lag(z) {w}) / 10000.0 ELSE (lead(z) {w} - lag(z) {w}) / 20000.0 END"


@query(f"""WITH {GRID_SQL}, d AS (SELECT map_id, x, y, {_grad_sql("x", "y")} AS dx, {_grad_sql("y", "x")} AS dy FROM g), s AS (SELECT map_id, x, y, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM d)
SELECT map_id, x, y, round(slope, 6) AS slope, CAST(CASE WHEN slope >= 15 THEN 2 WHEN slope >= 2 THEN 1 ELSE 0 END AS INTEGER) AS topo FROM s""")
def slope_classes(spark, sf):
    return raster.slope_classes(_grid(spark, sf), ["map_id"], "z", 10000.0).select("map_id", "x", "y", F.round("slope", 6).alias("slope"), "topo")


RINGS_SQL = "r AS (SELECT s_suppkey AS ord, s_suppkey * 7 % 60 AS x0, s_suppkey * 11 % 40 AS y0, s_suppkey % 9 + 4 AS w, s_suppkey % 6 + 3 AS h, CAST(s_suppkey % 9 AS INTEGER) AS lc FROM supplier)"


def _rings(spark, sf):
    k = F.col("s_suppkey")
    box = table(spark, sf, "supplier").select(k.alias("ord"), (k * 7 % 60).alias("x0"), (k * 11 % 40).alias("y0"), (k % 9 + 4).alias("w"), (k % 6 + 3).alias("h"), (k % 9).cast("int").alias("lc"))
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    # a right triangle: its slanted edge is tested between pixel centres
    return box.select(F.lit(0).alias("map_id"), "ord", "lc", F.array(pt(x0, y0), pt(x0 + w, y0), pt(x0, y0 + h)).alias("pts"))


@query(f"""WITH {RINGS_SQL}, gy AS (SELECT *, unnest(range(y0, y0 + h + 1)) AS y FROM r), gx AS (SELECT *, unnest(range(x0, x0 + w + 1)) AS x FROM gy),
i AS (SELECT ord, lc, x, y FROM gx WHERE y + 0.5 < y0 + h AND x + 0.5 >= x0 AND x + 0.5 < (x0 - (x0 + w)) * ((y + 0.5) - y0) / CAST(h AS DOUBLE) + (x0 + w)),
t AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY ord DESC) AS rn FROM i)
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, lc FROM t WHERE rn = 1""")
def rasterize_lastwins(spark, sf):
    return raster.rasterise(_rings(spark, sf), "lc").select("x", "y", "lc")


@query(f"""WITH {GRID_SQL}, b AS (SELECT * FROM (VALUES ('a', 40, 3), ('b', -2, 1), ('c', 10, 10)) t(tile_id, x0, y0)),
c AS (SELECT map_id, tile_id, x0, y0, tx, ty FROM (SELECT DISTINCT map_id FROM g), b, range(16) u(tx), range(16) v(ty))
SELECT c.map_id, tile_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CAST(coalesce(trunc(z), 255) AS INTEGER) AS v FROM c LEFT JOIN g ON g.map_id = c.map_id AND g.x = x0 + tx AND g.y = y0 + ty""")
def crop_pad(spark, sf):
    pixels = _grid(spark, sf).select("map_id", "x", "y", F.col("z").cast("int").alias("v"))
    box = lambda t, x, y: F.struct(F.lit(t).alias("tile_id"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(16).alias("size"))
    boxes = pixels.select("map_id").distinct().select("map_id", F.inline(F.array(box("a", 40, 3), box("b", -2, 1), box("c", 10, 10))))
    return pyramid.tile_pixels(boxes, pixels, ["map_id"], ["v"], side=16).select("map_id", "tile_id", "tx", "ty", "v")


def _cells(maps, low_x, high_x, low_y, high_y):
    """Every pixel of a box in each map."""
    span = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    return maps.select("map_id").distinct().select("map_id", span(low_x, high_x).alias("x")).select("map_id", "x", span(low_y, high_y).alias("y"))


def _squares(pixels, side, step):
    """Squares in steps over the whole of each map; the last ones reach beyond it."""
    size = pixels.groupBy("map_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.col(c), F.lit(step)))
    boxes = size.select("map_id", "my", steps("mx").alias("x")).select("map_id", "x", steps("my").alias("y"))
    return boxes.select("map_id", F.concat_ws("_", "x", "y").alias("tile_id"), "x", "y", F.lit(side).alias("size"))


_squares_sql = lambda side, step: f"""sz AS (SELECT map_id, max(x) AS mx, max(y) AS my FROM g GROUP BY map_id),
b0 AS (SELECT map_id, my, unnest(range(0, mx + 1, {step})) AS x0 FROM sz), b AS (SELECT map_id, x0, unnest(range(0, my + 1, {step})) AS y0 FROM b0)"""  # noqa: E731


@query(f"""WITH {GRID_SQL}, {_squares_sql(16, 16)}, c AS (SELECT map_id, x0 || '_' || y0 AS tile_id, x0, y0, tx, ty FROM b, range(16) u(tx), range(16) v(ty))
SELECT c.map_id, tile_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, CASE WHEN g.id IS NULL THEN [0.0::DOUBLE, 0.0::DOUBLE] ELSE [z / 10000, 1 - z / 10000] END AS p FROM c LEFT JOIN g ON g.map_id = c.map_id AND g.x = x0 + tx AND g.y = y0 + ty""")
def prior_crop(spark, sf):
    """The parent's probabilities at the pixels of each child tile, zeros beyond it."""
    parent = _grid(spark, sf).select("map_id", "x", "y", F.array(F.col("z") / 10000, 1 - F.col("z") / 10000).alias("p"))
    got = pyramid.prior_tiles(_squares(parent, 16, 16), parent, ["map_id"], 2, side=16)
    return blocks.unpacked(got, ["map_id", "tile_id"], {"p": "2f8"})


_held = lambda v, m: f"least(greatest({v}, 0.0), {m})"


@query(f"""WITH {GRID_SQL}, s AS (SELECT map_id, CAST(max(x) AS DOUBLE) AS mx, CAST(max(y) AS DOUBLE) AS my FROM g GROUP BY map_id),
t0 AS (SELECT *, unnest(range(2 * CAST(mx AS INTEGER) + 2)) AS x FROM s), t1 AS (SELECT *, unnest(range(2 * CAST(my AS INTEGER) + 2)) AS y FROM t0),
t AS (SELECT map_id, x, y, mx, my, {_held("(x + 0.5) * 0.5 - 0.5", "mx")} AS sx, {_held("(y + 0.5) * 0.5 - 0.5", "my")} AS sy FROM t1),
c AS (SELECT t.map_id, t.x, t.y, least(floor(sx) + i, mx) AS px, least(floor(sy) + j, my) AS py, (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS weight FROM t, range(2) a(i), range(2) b(j))
SELECT c.map_id, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, round(sum(weight * z), 6) AS z FROM c JOIN g ON g.map_id = c.map_id AND g.x = px AND g.y = py WHERE weight > 0 GROUP BY 1, 2, 3""")
def bilinear_resize(spark, sf):
    """Every map at twice its size."""
    source = _grid(spark, sf)
    size = source.groupBy("map_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) * 2 + 1))
    target = size.select("map_id", "my", upto("mx").alias("x")).select("map_id", "x", upto("my").alias("y"))
    target = target.withColumn("sx", raster.resize_places(1, 2, "x")).withColumn("sy", raster.resize_places(1, 2, "y"))
    return raster.bilinear(target, source, "z").select("map_id", "x", "y", F.round("z", 6).alias("z"))


@query(f"""WITH {GRID_SQL}, t AS (SELECT map_id, x, y, floor(x * 0.7 + 3) AS sx, floor(y * 0.6 - 1) AS sy FROM (SELECT DISTINCT map_id FROM g), range(80) u(x), range(90) v(y))
SELECT t.map_id, CAST(t.x AS INTEGER) AS x, CAST(t.y AS INTEGER) AS y, CAST(coalesce(trunc(z / 1000), 255) AS INTEGER) AS lc FROM t LEFT JOIN g ON g.map_id = t.map_id AND g.x = sx AND g.y = sy""")
def nearest_warp(spark, sf):
    source = _grid(spark, sf).select("map_id", "x", "y", (F.col("z") / 1000).cast("int").alias("lc"))
    target = _cells(source, 0, 80, 0, 90).withColumn("sx", F.col("x") * 0.7 + 3).withColumn("sy", F.col("y") * 0.6 - 1)
    return raster.nearest(target, source, "lc").select("map_id", "x", "y", "lc")


@query(f"""WITH {GRID_SQL} SELECT map_id, x, y, CAST(CASE WHEN id % 6 <> 0 THEN trunc(z / 100) ELSE 255 END AS INTEGER) AS v, id % 6 <> 0 AS valid FROM g""")
def coverage_mask(spark, sf):
    pixels = _grid(spark, sf).select("map_id", "x", "y", (F.col("z") / 100).cast("int").alias("v"))
    k = F.col("c_custkey")
    seen = table(spark, sf, "customer").where("c_custkey % 6 <> 0").select(F.floor(k / 2500).cast("int").alias("map_id"), (k % 50).cast("int").alias("x"), F.floor(k % 2500 / 50).cast("int").alias("y"))
    return raster.covered(pixels, seen, ["v"]).select("map_id", "x", "y", "v", "valid")


# tiles of ten rows of 50 pixels in steps of nine, so that rows overlap; one cell in eleven has no height
TARGET_SQL = """s AS (SELECT CAST(c_custkey // 2500 AS INTEGER) AS map_id, c_custkey // 500 AS tile_id, CAST(c_custkey % 50 AS INTEGER) AS x, CAST(c_custkey // 500 % 5 * 9 + c_custkey % 500 // 50 AS INTEGER) AS y,
  CAST(nullif(c_nationkey % 11 * 10, 0) AS INTEGER) AS code, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS z FROM customer),
m AS (SELECT map_id, x, y, arg_min(code, tile_id) FILTER (WHERE code IS NOT NULL) AS code, coalesce(arg_min(z, tile_id) FILTER (WHERE z IS NOT NULL), 0.0) AS z FROM s GROUP BY 1, 2, 3),
t AS (SELECT map_id, x // 2 AS x, y // 2 AS y, code, z FROM m WHERE x % 2 = 0 AND y % 2 = 0)"""
_slope = lambda axis, across: f"CASE WHEN lag(z) OVER w{axis} IS NULL AND lead(z) OVER w{axis} IS NULL THEN 0 WHEN lag(z) OVER w{axis} IS NULL THEN (lead(z) OVER w{axis} - z) / 10000.0 WHEN lead(z) OVER w{axis} IS NULL THEN (z - lag(z) OVER w{axis}) / 10000.0 ELSE (lead(z) OVER w{axis} - lag(z) OVER w{axis}) / 20000.0 END"


@query(f"""WITH {TARGET_SQL}, d AS (SELECT map_id, x, y, code, {_slope("x", "y")} AS dx, {_slope("y", "x")} AS dy FROM t WINDOW wx AS (PARTITION BY map_id, y ORDER BY x), wy AS (PARTITION BY map_id, x ORDER BY y)),
c AS (SELECT d.*, coalesce(lc, 255) AS lc, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM d LEFT JOIN (SELECT * FROM {rows_sql("code, lc", WORLD_COVER)}) w ON w.code = d.code)
SELECT map_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(lc AS INTEGER) AS lc, CAST(CASE WHEN lc IN (0, 255) THEN 255 WHEN slope >= 15 THEN 2 WHEN slope >= 2 THEN 1 ELSE 0 END AS INTEGER) AS topo FROM c""")
def assembled_labels(spark, sf):
    """Land cover and topography of every map at half its size, from mosaics of overlapping tiles with gaps."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.floor(k / 2500).cast("int").alias("map_id"), F.floor(k / 500).alias("tile_id"), (k % 50).cast("int").alias("x"), F.floor(k % 500 / 50).cast("int").alias("y"), (F.col("c_nationkey") % 11 * 10).cast("int").alias("code"), F.when(k % 11 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("z"))
    tiles = rows.select("map_id", "tile_id", F.lit(0).alias("left"), (F.col("tile_id") % 5 * 9).cast("int").alias("top")).distinct()
    cover, heights = (assembly.mosaic(tiles, rows.drop("map_id"), v, nodata) for v, nodata in (("code", 0), ("z", None)))
    target = cover.where("x % 2 = 0 AND y % 2 = 0").select("map_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y"), F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"))
    return assembly.georeferenced_labels(target, cover, heights, 10000.0)


COVER_GRID, HEIGHT_GRID, SPACING = warp.Grid(3, 30), warp.Grid(1, 10), 5000.0
_R = f"{geo.MERCATOR_RADIUS}::DOUBLE"
_E = f"{geo.EARTH_KM * 1000}::DOUBLE"
_lon0, _lat0 = "(s_suppkey * 37 % 40) / 10.0::DOUBLE", "(40.3::DOUBLE + (s_suppkey * 53 % 25) / 10.0::DOUBLE)"


def _laea_sql(lon: str, lat: str) -> tuple[str, str]:
    k = f"sqrt(2.0::DOUBLE / (1 + sin(radians(lat0)) * sin(radians({lat})) + cos(radians(lat0)) * cos(radians({lat})) * cos(radians({lon} - lon0))))"
    return f"{_E} * {k} * cos(radians({lat})) * sin(radians({lon} - lon0))", f"{_E} * {k} * (cos(radians(lat0)) * sin(radians({lat})) - sin(radians(lat0)) * cos(radians({lat})) * cos(radians({lon} - lon0)))"


_degrees_sql = lambda u, v: f"CASE epsg WHEN 4326 THEN {u} WHEN 3857 THEN degrees({u} / {_R}) END AS lon, CASE epsg WHEN 4326 THEN {v} WHEN 3857 THEN degrees(2 * atan(exp({v} / {_R})) - pi() / 2) END AS lat"
_side = lambda z, axis, n: f"CASE WHEN {n} = 1 THEN 0 WHEN {axis} = 0 THEN (lead({z}) OVER w{axis} - {z}) / {SPACING}::DOUBLE WHEN {axis} = {n} - 1 THEN ({z} - lag({z}) OVER w{axis}) / {SPACING}::DOUBLE ELSE (lead({z}) OVER w{axis} - lag({z}) OVER w{axis}) / {2 * SPACING}::DOUBLE END"
WARP_SQL = f"""WITH m AS (SELECT s_suppkey AS map_id, CASE WHEN s_suppkey % 7 = 6 THEN 32633 WHEN s_suppkey % 2 = 0 THEN 4326 ELSE 3857 END AS epsg, 8 + s_suppkey % 5 AS width, 6 + s_suppkey % 4 AS height,
  CASE WHEN s_suppkey % 2 = 0 THEN 0.07::DOUBLE ELSE 7000.0::DOUBLE END AS a, CASE WHEN s_suppkey % 2 = 0 THEN {_lon0} ELSE {_R} * radians({_lon0}) END AS c,
  CASE WHEN s_suppkey % 2 = 0 THEN {_lat0} ELSE {_R} * ln(tan(pi() / 4 + radians({_lat0}) / 2)) END AS f FROM supplier),
p AS (SELECT map_id, x, y, {_degrees_sql("(a * (x + 0.5) + c)", "(f - a * (y + 0.5))")} FROM (SELECT *, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height)) AS y FROM m))),
k AS (SELECT map_id, {_degrees_sql("(a * px + c)", "(f - a * py)")} FROM (SELECT m.*, unnest([width * i / 22.0::DOUBLE, width * i / 22.0::DOUBLE, 0, width]) AS px, unnest([0, height, height * i / 22.0::DOUBLE, height * i / 22.0::DOUBLE]) AS py FROM m, range(23) t(i))),
b AS (SELECT map_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM k WHERE lon IS NOT NULL GROUP BY 1),
sc AS (SELECT CAST((lon_sw + 180) * 10 + c_custkey % 30 AS BIGINT) AS x, CAST((87 - lat_sw) * 10 + c_custkey % 900 // 30 AS BIGINT) AS y, c_nationkey % 11 * 10 AS code FROM (SELECT *, c_custkey // 900 % 2 * 3 AS lon_sw, 39 + c_custkey // 1800 % 15 * 3 AS lat_sw FROM customer)
  WHERE c_nationkey % 11 > 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY c_custkey // 900) = 1),
sh AS (SELECT CAST((lon_sw + 180) * 10 + c_custkey % 10 AS BIGINT) AS x, CAST((89 - lat_sw) * 10 + c_custkey % 100 // 10 AS BIGINT) AS y, c_acctbal * 0.1::DOUBLE AS z FROM (SELECT *, c_custkey // 100 % 5 AS lon_sw, 40 + c_custkey // 500 % 40 AS lat_sw FROM customer)
  WHERE c_custkey % 13 > 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY c_custkey // 100) = 1),
q AS (SELECT map_id, lon0, lat0, min(lx) AS l, max(lx) AS r, max(ly) AS t, min(ly) AS d FROM (SELECT map_id, lon0, lat0, {_laea_sql("lon", "lat")[0]} AS lx, {_laea_sql("lon", "lat")[1]} AS ly FROM (
  SELECT map_id, (west + east) / 2 AS lon0, (south + north) / 2 AS lat0, unnest([west + (east - west) * i / 22, west + (east - west) * i / 22, west, east]) AS lon, unnest([south, north, south + (north - south) * i / 22, south + (north - south) * i / 22]) AS lat FROM b, range(23) t(i))) GROUP BY ALL),
gr AS (SELECT *, CAST(floor((r - l) / {SPACING}::DOUBLE) + 1 AS BIGINT) AS w, CAST(floor((t - d) / {SPACING}::DOUBLE) + 1 AS BIGINT) AS h FROM q),
gp AS (SELECT *, l + (x + 0.5) * {SPACING}::DOUBLE AS ux, t - (y + 0.5) * {SPACING}::DOUBLE AS uy FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM gr))),
gc AS (SELECT *, sqrt(ux * ux + uy * uy) AS rho, 2 * asin(least(sqrt(ux * ux + uy * uy) / (2 * {_E}), 1.0)) AS cc FROM gp),
gd AS (SELECT map_id, x, y, w, h, (lon0 + degrees(CASE WHEN rho > 0 THEN atan2(ux * sin(cc), rho * cos(radians(lat0)) * cos(cc) - uy * sin(radians(lat0)) * sin(cc)) ELSE 0 END) + 180.0) / 0.1::DOUBLE - 0.5 AS sx,
  (90.0 - degrees(CASE WHEN rho > 0 THEN asin(cos(cc) * sin(radians(lat0)) + uy * sin(cc) * cos(radians(lat0)) / rho) ELSE radians(lat0) END)) / 0.1::DOUBLE - 0.5 AS sy FROM gc),
gz AS (SELECT gd.map_id, gd.x, gd.y, w, h, sum(sh.z * (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END)) / sum(CASE WHEN sh.z IS NOT NULL THEN (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) END) AS z
  FROM gd CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) LEFT JOIN sh ON sh.x = CAST(floor(sx) AS BIGINT) + i AND sh.y = CAST(floor(sy) AS BIGINT) + j GROUP BY ALL),
gs AS (SELECT map_id, x, y, {_side("z", "x", "w")} AS dx, {_side("z", "y", "h")} AS dy FROM gz WINDOW wx AS (PARTITION BY map_id, y ORDER BY x), wy AS (PARTITION BY map_id, x ORDER BY y)),
gt AS (SELECT map_id, x, y, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM gs),
o AS (SELECT p.map_id, p.x, p.y, coalesce(lc, 255) AS lc, CAST(floor(({_laea_sql("p.lon", "p.lat")[0]} - l) / {SPACING}::DOUBLE) AS BIGINT) AS mx, CAST(floor((t - ({_laea_sql("p.lon", "p.lat")[1]})) / {SPACING}::DOUBLE) AS BIGINT) AS my
  FROM p JOIN gr ON gr.map_id = p.map_id LEFT JOIN sc ON sc.x = CAST(floor((p.lon + 180.0) / 0.1::DOUBLE) AS BIGINT) AND sc.y = CAST(floor((90.0 - p.lat) / 0.1::DOUBLE) AS BIGINT) LEFT JOIN {rows_sql("code, lc", WORLD_COVER)} ON t.code = sc.code)
SELECT o.map_id, CAST(o.x AS INTEGER) AS x, CAST(o.y AS INTEGER) AS y, CAST(lc AS INTEGER) AS lc, CAST(CASE WHEN lc IN (0, 255) OR slope IS NULL THEN 255 WHEN slope >= 15 THEN 2 WHEN slope >= 2 THEN 1 ELSE 0 END AS INTEGER) AS topo
FROM o LEFT JOIN gt ON gt.map_id = o.map_id AND gt.x = mx AND gt.y = my""".replace("LEFT JOIN (VALUES", "LEFT JOIN (SELECT * FROM (VALUES").replace("AS t(code, lc) ON t.code", "AS t(code, lc)) wc ON wc.code")


def _warped_maps(spark, sf):
    k = F.col("s_suppkey")
    flat = k % 2 == 0
    lon, lat = (k * 37 % 40) / 10.0, F.lit(40.3) + (k * 53 % 25) / 10.0
    north = F.lit(geo.MERCATOR_RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    side = F.when(flat, F.lit(0.07)).otherwise(F.lit(7000.0))
    epsg = F.when(k % 7 == 6, F.lit(32633)).when(flat, F.lit(warp.GEOGRAPHIC)).otherwise(F.lit(warp.MERCATOR))
    affine = [side.alias("a"), F.lit(0.0).alias("b"), F.when(flat, lon).otherwise(F.lit(geo.MERCATOR_RADIUS) * F.radians(lon)).alias("c"), F.lit(0.0).alias("d"), (-side).alias("e"), F.when(flat, lat).otherwise(north).alias("f")]
    return table(spark, sf, "supplier").select(k.alias("map_id"), epsg.alias("epsg"), (k % 5 + 8).alias("width"), (k % 4 + 6).alias("height"), *affine)


@query(WARP_SQL)
def warped_labels(spark, sf):
    """Labels of maps in two projections, from tiles of cover and heights on other grids, with holes in both."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    at = lambda v: F.floor(v).cast("int")
    cover = c.select(at(k / 900).alias("tile_id"), (at(k / 1800) % 15 * 3 + 39).alias("lat_sw"), (at(k / 900) % 2 * 3).alias("lon_sw"), (k % 30).cast("int").alias("x"), at(k % 900 / 30).alias("y"), (F.col("c_nationkey") % 11 * 10).alias("code"))
    heights = c.select(at(k / 100).alias("tile_id"), (at(k / 500) % 40 + 40).alias("lat_sw"), (at(k / 100) % 5).alias("lon_sw"), (k % 10).cast("int").alias("x"), at(k % 100 / 10).alias("y"), F.when(k % 13 > 0, F.col("c_acctbal") * 0.1).otherwise(float("nan")).alias("z"))
    return warp.labels(_warped_maps(spark, sf), cover, COVER_GRID, heights, HEIGHT_GRID, SPACING)


@query(f"WITH p AS ({POINTS_SQL}) SELECT c_nationkey, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, round(0.5::DOUBLE * px + 0.25::DOUBLE * py + c_nationkey, 6) AS lng, round(0.125::DOUBLE * px - 0.5::DOUBLE * py + 3, 6) AS lat, round(px::DOUBLE, 6) AS back_x, round(py::DOUBLE, 6) AS back_y FROM p")
def affine_world(spark, sf):
    """Places of control points by a given affine, and back."""
    c = [F.lit(0.5), F.lit(0.25), F.col("c_nationkey").cast("double"), F.lit(0.125), F.lit(-0.5), F.lit(3.0)]
    there = _points(spark, sf).select("c_nationkey", "px", "py", *[x.alias(n) for x, n in zip(assembly.world(*c, F.col("px"), F.col("py")), ("u", "v"), strict=True)])
    x, y = assembly.pixel(*c, F.col("u"), F.col("v"))
    return there.select("c_nationkey", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"), F.round("u", 6).alias("lng"), F.round("v", 6).alias("lat"), F.round(x, 6).alias("back_x"), F.round(y, 6).alias("back_y"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 <> 0 THEN 4326 END AS BIGINT) AS epsg, CAST(p_size AS INTEGER) AS width, CAST(p_partkey % 5 AS BIGINT) AS height FROM part WHERE p_partkey % 7 <> 0 AND p_size > 0 AND p_partkey % 5 > 0")
def valid_rasters(spark, sf):
    k = F.col("p_partkey")
    return tiff.valid(table(spark, sf, "part").select("p_partkey", F.when(k % 7 != 0, F.lit(4326)).cast("bigint").alias("epsg"), F.col("p_size").cast("int").alias("width"), (k % 5).cast("bigint").alias("height")))


@query(f"""WITH {GRID_SQL}, {_squares_sql(16, 8)},
t AS (SELECT g.map_id, g.x, g.y, CAST(id % 11 AS INTEGER) AS class FROM b JOIN g ON g.map_id = b.map_id AND g.x BETWEEN x0 AND x0 + 15 AND g.y BETWEEN y0 AND y0 + 15 WHERE id % 11 < 9)
SELECT class, count(*) AS raw, count(DISTINCT (map_id, x, y)) AS fair FROM t GROUP BY class""")
def fair_histogram(spark, sf):
    """Class counts over tiles that overlap by half, raw and with each pixel once."""
    pixels = _grid(spark, sf).select("map_id", "x", "y", ((F.col("map_id").cast("bigint") * 2500 + F.col("y") * 50 + F.col("x")) % 11).cast("int").alias("lc"))
    boxes = _squares(pixels, 16, 8)
    inside = pyramid.tile_pixels(boxes, pixels, ["map_id"], ["lc"], side=16).join(boxes.select("map_id", "tile_id", F.col("x").alias("x0"), F.col("y").alias("y0")), ["map_id", "tile_id"])
    return metrics.tile_histogram(inside.select("map_id", (F.col("x0") + F.col("tx")).alias("x"), (F.col("y0") + F.col("ty")).alias("y"), "lc"), "lc")


WINDOW = 20


@query(f"""WITH {GRID_SQL}, sz AS (SELECT map_id, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY map_id), s AS (SELECT *, least({WINDOW}, w, h) AS side FROM sz)
SELECT 'map_' || map_id || '.tif' AS name, CAST(4326 AS BIGINT) AS epsg, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST((w - side) // 2 AS INTEGER) AS x, y, CAST(sum(g.id % 251 + g.x + g.y) AS BIGINT) AS total
FROM g JOIN s USING (map_id) WHERE g.x >= (w - side) // 2 AND g.x < (w - side) // 2 + side AND y >= (h - side) // 2 AND y < (h - side) // 2 + side GROUP BY ALL""")
def raster_windows(spark, sf):
    """The lines of the centred window of every map, read by ranges from GeoTIFF files that are written first."""
    grid = _grid(spark, sf)
    k = F.col("map_id").cast("bigint") * 2500 + F.col("y") * 50 + F.col("x")
    pixels = grid.select("map_id", "x", "y", (k % 251).cast("int").alias("r"), F.col("x").alias("g"), F.col("y").alias("b"))
    affines = grid.groupBy("map_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).select("*", *[F.lit(v).alias(c) for c, v in (("west", 2.5), ("north", 48.0), ("dx", 0.01), ("dy", 0.01))])
    root = new_path(spark, "rasters")
    encoded = tiff.encoded(pixels, affines, ["r", "g", "b"])
    files.put(encoded.select(F.concat(F.lit("map_"), "map_id", F.lit(".tif")).alias("name"), "content"), root)
    return tiff.lines(spark, root, WINDOW).select(idents.basename(F.col("path")).alias("name"), "epsg", "width", "height", "x", "y", png.byte_sum("line").alias("total"))


@query(f"WITH {_tile_sql} SELECT n.name || '.png' AS name, lc, topo, 2 AS width, CAST(4 * (p_partkey % 251) AS BIGINT) AS total FROM tiles JOIN n USING (p_partkey)")
def hex_tile_scan(spark, sf):
    """Labels and pixels of the tiles that have a rule, from image files of all names that are written first."""
    grey = F.unhex(F.repeat(F.lpad(F.hex(F.col("p_partkey") % 251), 2, "0"), 4))
    named = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey").select(F.concat(_hex_name(), F.lit(".png")).alias("name"), png.encoded(grey, F.lit(2), F.lit(2), F.lit(1)).alias("content"))
    root = new_path(spark, "hex")
    files.put(named, root)
    found = files.hex_tiles(spark, root, tile_prefixes(spark), [len(r[0]) for r in TILE_PREFIXES])
    return found.select("name", "lc", "topo", "width", png.byte_sum("pixels").alias("total"))


@query("""SELECT 'n' || s_nationkey AS map_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS ord, CAST(CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 24 END AS INTEGER) AS biome, CAST(s_suppkey % 90 AS INTEGER) AS height, CAST(3 + s_suppkey % 3 AS INTEGER) AS n_points FROM supplier""")
def geojson_features(spark, sf):
    """Features of GeoJSON files, which are written first, with numbers that are none and points that lack a coordinate or have three."""
    k = F.col("s_suppkey")
    point = lambda *v: F.array(*[x.cast("double") for x in v])
    ring = F.concat(F.array(point(k, k), point(k + 1, k), point(k + 1, k + 1, k), point(k)), F.when(k % 3 > 0, F.array_repeat(point(k, k + 1), (k % 3).cast("int"))).otherwise(F.array().cast("array<array<double>>")))
    biome = F.when(k % 7 > 0, (k % 24).cast("string")).otherwise("?")
    feature = F.struct(k.alias("k"), F.struct(biome.alias("biome"), (k % 90).alias("height")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    every = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(feature)).alias("features"))).alias("content"))
    root = new_path(spark, "features")
    files.put(every.select(F.concat(F.lit("n"), "s_nationkey", F.lit(".geojson")).alias("name"), "content"), root)
    return files.features(spark, root).select("map_id", "ord", "biome", "height", F.size("pts").alias("n_points"))


SMALL, STEP = [32, 16, 8], 16


@query(f"""WITH {GRID_SQL}, sz AS (SELECT map_id, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY map_id),
o0 AS (SELECT *, unnest(range(0, h, {STEP})) AS oy FROM sz), o1 AS (SELECT *, unnest(range(0, w, {STEP})) AS ox FROM o0),
o AS (SELECT map_id, ox, oy, printf('py_r%03d_c%03d', oy // {STEP}, ox // {STEP}) AS pyramid_id FROM o1 WHERE 2 * greatest(0, least(ox + 32, w) - ox) * greatest(0, least(oy + 32, h) - oy) >= 32 * 32),
q AS (SELECT q, q % 2 AS dx, q // 2 AS dy FROM range(4) t(q)),
t AS (SELECT map_id, pyramid_id, '32' AS tile_id, ox AS x0, oy AS y0, 32 AS size FROM o
  UNION ALL SELECT map_id, pyramid_id, '16_' || q, ox + dx * 16, oy + dy * 16, 16 FROM o CROSS JOIN q
  UNION ALL SELECT map_id, pyramid_id, '8_' || a.q || '_' || b.q, ox + a.dx * 16 + b.dx * 8, oy + a.dy * 16 + b.dy * 8, 8 FROM o CROSS JOIN q a CROSS JOIN q b),
p AS (SELECT t.*, count(g.id) AS n, coalesce(sum(g.id % 251 + g.x + g.y), 0) AS rgb, coalesce(sum(g.id % 9), 0) AS lc, coalesce(sum(g.id % 3), 0) AS topo
  FROM t LEFT JOIN g ON g.map_id = t.map_id AND g.x BETWEEN x0 AND x0 + size - 1 AND g.y BETWEEN y0 AND y0 + size - 1 GROUP BY ALL),
f AS (SELECT *, unnest(['image', 'land_cover', 'topography']) AS kind FROM p)
SELECT CAST(map_id AS VARCHAR) AS map_id, pyramid_id, tile_id || '_' || kind || '.png' AS name, CAST(size AS INTEGER) AS side, CAST(CASE kind WHEN 'image' THEN rgb WHEN 'land_cover' THEN lc + 255 * (size * size - n) ELSE topo + 255 * (size * size - n) END AS BIGINT) AS total, TRUE AS sound FROM f""")
def pyramid_artifacts(spark, sf):
    """Images of all tiles of all maps, written, committed and read back; sums of their pixels, and whether the digests hold."""
    grid = _grid(spark, sf)
    k = F.col("map_id").cast("bigint") * 2500 + F.col("y") * 50 + F.col("x")
    pixels = grid.select("map_id", "x", "y", (k % 251).cast("int").alias("r"), F.col("x").alias("g"), F.col("y").alias("b"), (k % 9).cast("int").alias("lc"), (k % 3).cast("int").alias("topo"))
    maps = grid.groupBy("map_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    weights = maps.select("map_id", F.to_json(F.struct(F.lit("synthetic").alias("source"), F.concat(F.lit("map"), "map_id").alias("map_file"))).alias("weights"))
    root = new_path(spark, "pyramids")
    pyramids.write(pyramid.artifact_files(pyramid.origins(maps, SMALL[0], STEP), pixels, weights, SMALL, STEP), root)
    images = pyramids.read(spark, root, "*.png").select("map_id", "pyramid_id", "name", png.decoded("content").alias("d"))
    return images.join(pyramids.checked(spark, root), ["map_id", "pyramid_id"]).select("map_id", "pyramid_id", "name", F.col("d.width").alias("side"), png.byte_sum("d.pixels").alias("total"), "sound")


@query("""WITH p AS (SELECT CAST(l_orderkey % 48 AS INTEGER) AS x, CAST(l_partkey % 48 AS INTEGER) AS y, CAST(l_suppkey % 4 * 3 AS INTEGER) AS lat_sw, l_linenumber AS lc FROM lineitem),
c AS (SELECT lat_sw + 2 - y // 16 AS lat, x // 16 AS lon, lc FROM p WHERE x % 4 = 0 AND y % 4 = 0)
SELECT CAST(lat AS INTEGER) AS lat, CAST(lon AS INTEGER) AS lon, [count(*) FILTER (WHERE lc = 0), count(*) FILTER (WHERE lc = 1), count(*) FILTER (WHERE lc = 2), count(*) FILTER (WHERE lc = 3), count(*) FILTER (WHERE lc = 4), count(*) FILTER (WHERE lc = 5), count(*) FILTER (WHERE lc = 6), count(*) FILTER (WHERE lc = 7), count(*) FILTER (WHERE lc = 8)] AS counts FROM c GROUP BY 1, 2""")
def decimated_counts(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 48).cast("int").alias("x"), (F.col("l_partkey") % 48).cast("int").alias("y"), (F.col("l_suppkey") % 4 * 3).cast("int").alias("lat_sw"), F.lit(0).alias("lon_sw"), F.col("l_linenumber").alias("lc"))
    return raster.decimated_counts(rows, 4, "lc")


@query(f"WITH {RINGS_SQL} SELECT lc AS map_id, CAST(min(x0) AS DOUBLE) AS min_x, CAST(min(y0) AS DOUBLE) AS min_y, CAST(max(x0 + w) - min(x0) + 1 AS INTEGER) AS width, CAST(max(y0 + h) - min(y0) + 1 AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS reject_reason FROM r GROUP BY lc")
def canvas_bounds(spark, sf):
    rings = _rings(spark, sf).select(F.col("lc").alias("map_id"), "pts")
    return raster.canvas(rings).select("map_id", "min_x", "min_y", "width", "height", "reject_reason")


@query("""WITH b AS (SELECT s_suppkey, (s_suppkey % 60 - 30) * 100.0::DOUBLE AS l, (s_suppkey % 40) * 50.0::DOUBLE AS d FROM supplier),
e AS (SELECT s_suppkey, l + 1000 * i / 22 AS x, d + 500 * j / 22 AS y FROM b CROSS JOIN range(23) a(i) CROSS JOIN range(23) c(j) WHERE i IN (0, 22) OR j IN (0, 22))
SELECT s_suppkey, round(min(x / 100 + y * y / 1000000), 6) AS west, round(min(y / 100 - x * x / 1000000), 6) AS south, round(max(x / 100 + y * y / 1000000), 6) AS east, round(max(y / 100 - x * x / 1000000), 6) AS north FROM e GROUP BY 1""")
def densified_bounds(spark, sf):
    k = F.col("s_suppkey")
    boxes = table(spark, sf, "supplier").select("s_suppkey", ((k % 60 - 30) * 100.0).cast("double").alias("left"), ((k % 40) * 50.0).cast("double").alias("bottom"))
    boxes = boxes.withColumn("right", F.col("left") + 1000).withColumn("top", F.col("bottom") + 500)
    bent = lambda x, y: (x / 100 + y * y / 1000000, y / 100 - x * x / 1000000)
    return raster.densified_bounds(boxes, bent).select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query("SELECT p_partkey, p_size * 1000 * CAST(p_partkey AS BIGINT) <= 2000000000 // 1000 AS ok FROM part")
def raster_guard(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1000).alias("w"), (F.col("p_partkey") * 1000).alias("h"))
    return rows.select("p_partkey", raster.raster_ok(F.col("w"), F.col("h")).alias("ok"))


RGB_SQL = "SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_partkey * 13 % 256 AS INTEGER) AS g, CAST(p_size * 5 % 256 AS INTEGER) AS b FROM part"


def _rgb(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", (k * 7 % 256).cast("int").alias("r"), (k * 13 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b"))


_cut = lambda e: f"CAST(trunc(least(greatest({e}, 0.0), 255.0)) AS INTEGER)"
_sepia = lambda m, t: _cut(f"least(least(r * {m[0]}::DOUBLE + g * {m[1]}::DOUBLE + b * {m[2]}::DOUBLE, 255.0) * {t[0]}::DOUBLE + {t[1]}::DOUBLE, 255.0)")


@query(f"WITH c AS ({RGB_SQL}) SELECT p_partkey, {', '.join(f'{_sepia(m, t)} AS {n}' for m, t, n in zip(classes.SEPIA, classes.TINT, 'rgb', strict=True))} FROM c")
def sepia(spark, sf):
    out = classes.parchment(*[F.col(c).cast("double") for c in "rgb"])
    return _rgb(spark, sf).select("p_partkey", *[v.alias(c) for v, c in zip(out, "rgb", strict=True)])


GREY = "((r * 19595 + g * 38470 + b * 7471 + 32768) // 65536)"


@query(f"WITH c AS ({RGB_SQL}) SELECT p_partkey, CAST({GREY} AS INTEGER) AS luma FROM c")
def grayscale(spark, sf):
    return _rgb(spark, sf).select("p_partkey", classes.grey(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


_fade = lambda c: _cut(f"{_cut(f'm + ({_cut(f'l + ({c} - l) * 0.35::DOUBLE')} - m) * 0.6::DOUBLE')} * 1.15::DOUBLE")


@query(f"WITH c AS (SELECT *, {GREY}::DOUBLE AS l FROM ({RGB_SQL})), i AS (SELECT *, floor(avg(l) OVER () + 0.5) AS m FROM c) SELECT p_partkey, {_fade('r')} AS r, {_fade('g')} AS g, {_fade('b')} AS b FROM i")
def faded(spark, sf):
    rows = _rgb(spark, sf).withColumn("l", classes.grey(F.col("r"), F.col("g"), F.col("b")).cast("double"))
    mean = rows.agg(F.floor(F.avg("l") + 0.5).cast("double").alias("m"))
    return rows.join(F.broadcast(mean)).select("p_partkey", *[classes.faded(F.col(c), F.col("l"), F.col("m")).alias(c) for c in "rgb"])


@query(f"WITH c AS ({RGB_SQL}) SELECT p_partkey, CAST(round((r * b + 255 * (255 - b)) / 255.0) AS INTEGER) AS v FROM c")
def alpha_composite(spark, sf):
    return _rgb(spark, sf).select("p_partkey", classes.composite(F.col("r"), F.col("b"), 255).alias("v"))


_lut = rows_sql("lc, r, g, b", [(i, *(int(INSPECTION[n][k : k + 2], 16) for k in (1, 3, 5))) for i, n in enumerate(LAND_COVER)])


@query(f"WITH m AS (SELECT * FROM {_lut}) SELECT vec_id, {', '.join(f'CAST(coalesce({c}, 0) AS INTEGER) AS {c}' for c in 'rgb')} FROM embeddings LEFT JOIN m ON lc = label")
def colorize(spark, sf):
    return raster.colourised(table(spark, sf, "embeddings").select("vec_id", "label"), inspection_palette(spark), "label").select("vec_id", "r", "g", "b")


_topo_lut = rows_sql("topo, r, g, b", [(i, *(int(INSPECTION_TOPOGRAPHY[n][k : k + 2], 16) for k in (1, 3, 5))) for i, n in enumerate(TOPOGRAPHY)])


@query(f"SELECT e.vec_id, CAST(coalesce(r, 0) AS INTEGER) AS r, CAST(coalesce(g, 0) AS INTEGER) AS g, CAST(coalesce(b, 0) AS INTEGER) AS b FROM embeddings e LEFT JOIN (SELECT * FROM {_topo_lut}) l ON l.topo = e.label % 4")
def colorize_topography(spark, sf):
    """Topography in its colours for inspection; black for others."""
    look = topography_palette(spark).withColumnRenamed("topo", "lc")
    return raster.colourised(table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 4).alias("topo")), look, "topo").select("vec_id", "r", "g", "b")


_pal = rows_sql("style, lc, r, g, b", [(s, i, *c) for s, cs in PALETTES.items() for i, c in enumerate(cs)])


@query(f"WITH l AS ({LABELS_SQL}), p AS (SELECT * FROM {_pal}) SELECT p_partkey || '__' || style AS map_id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM l JOIN p USING (lc)")
def style_cross(spark, sf):
    styled = samples.styled(_labelled(spark, sf).withColumn("src_id", F.col("p_partkey").cast("string")), palettes(spark).select("style").distinct())
    return styled.join(F.broadcast(palettes(spark)), ["style", "lc"]).select("map_id", "r", "g", "b")


@query(f"WITH {RINGS_SQL} SELECT n, CAST(cell AS INTEGER) AS cell, CAST(cell % n AS INTEGER) AS image, CAST(cell % 3 * 228 + 4 AS INTEGER) AS \"left\", CAST(cell // 3 * 228 + 4 AS INTEGER) AS top FROM (SELECT DISTINCT w AS n FROM r) CROSS JOIN range(6) c(cell)")
def montage(spark, sf):
    sizes = table(spark, sf, "supplier").select((F.col("s_suppkey") % 9 + 4).alias("n")).distinct()
    return raster.montage(sizes, 2, 3, 224, 4).select("n", "cell", F.col("image").cast("int").alias("image"), F.col("left").cast("int").alias("left"), F.col("top").cast("int").alias("top"))


@query(f"""WITH c AS ({RGB_SQL}), a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [r] WHEN 1 THEN [r, g] ELSE [r, g, b] END AS v FROM c)
SELECT p_partkey, v[1] AS r, CASE WHEN len(v) = 1 THEN v[1] ELSE v[2] END AS g, CASE len(v) WHEN 1 THEN v[1] WHEN 2 THEN v[2] ELSE v[3] END AS b FROM a""")
def three_bands(spark, sf):
    k = F.col("p_partkey") % 3
    rows = _rgb(spark, sf).select(F.col("p_partkey").alias("map_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.when(k == 0, F.array("r")).when(k == 1, F.array("r", "g")).otherwise(F.array("r", "g", "b")).alias("bands"))
    return raster.three_bands(rows).select(F.col("map_id").alias("p_partkey"), "r", "g", "b")


# --- samples --------------------------------------------------------------------------------------------------

_desc = rows_sql("lc, topo, texts", DESCRIPTIONS)
_prompt = rows_sql("prompt_idx, prompt", list(enumerate(PROMPTS)))
AUGMENTATIONS = ["original", "grayscale", "parchment", "faded"]


@query(f"""WITH {_tile_sql}, k AS (SELECT *, count(*) OVER (PARTITION BY lc, topo) AS n FROM tiles), d AS (SELECT * FROM {_desc}), p AS (SELECT * FROM {_prompt}),
x AS (SELECT p_partkey, k.lc, k.topo, a.augmentation, l.layout, p.prompt_idx, p.prompt, d.texts FROM k CROSS JOIN (SELECT unnest({AUGMENTATIONS}) AS augmentation) a JOIN (SELECT unnest(['single', 'grid']) AS layout) l ON l.layout = 'single' OR k.n >= 2 CROSS JOIN p LEFT JOIN d ON d.lc = k.lc AND d.topo IS NOT DISTINCT FROM k.topo)
SELECT p_partkey, lc, topo, augmentation, layout, CAST(prompt_idx AS INTEGER) AS prompt_idx, prompt, coalesce(texts[prompt_idx % len(texts) + 1], list_extract([{", ".join(map(literal, LAND_COVER))}], lc + 1)) || CASE WHEN topo IS NULL THEN '' ELSE ' (' || list_extract([{", ".join(map(literal, TOPOGRAPHY))}], topo + 1) || ')' END AS answer FROM x""")
def prompt_cross(spark, sf):
    return samples.tuning_samples(_hex_tiles(spark, sf), AUGMENTATIONS)


@query(f"""WITH {_tile_sql}, g AS (SELECT p_partkey, lc, topo, row_number() OVER (PARTITION BY lc, topo ORDER BY md5('42:' || p_partkey), p_partkey) AS at, count(*) OVER (PARTITION BY lc, topo) AS n FROM tiles),
w AS (SELECT g.*, k FROM g CROSS JOIN range(1, 5) r(k) WHERE k < n)
SELECT w.p_partkey AS tile, o.p_partkey AS peer, CAST(k AS INTEGER) AS k FROM w JOIN g o ON o.lc = w.lc AND o.topo IS NOT DISTINCT FROM w.topo AND o.at = (w.at - 1 + k) % w.n + 1""")
def peer_sample(spark, sf):
    return samples.peers(_hex_tiles(spark, sf), "p_partkey")


@query("SELECT page_id, url FROM pages ORDER BY page_id OFFSET 20 LIMIT 10")
def paging(spark, sf):
    return ranking.page(table(spark, sf, "pages").select("page_id", "url"), ["page_id"], 20, 10)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def tally(spark, sf):
    return ranking.tally(table(spark, sf, "documents"), "lang", "source")


@query("""WITH r AS (SELECT page_id, row_number() OVER (ORDER BY md5('42:' || page_id), page_id) AS rn, count(*) OVER () AS n FROM pages) SELECT page_id FROM r WHERE rn <= greatest(1, n // 10)""")
def spot_check(spark, sf):
    return ranking.sampled(table(spark, sf, "pages").select("page_id"), "page_id")


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || page_id WHEN 1 THEN '../test/' || page_id WHEN 2 THEN 'data/test/' || page_id WHEN 3 THEN 'data/tests/' || page_id ELSE 'data/train/' || page_id END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 5 IN (0, 1) THEN 'traversal' WHEN page_id % 5 = 2 THEN 'leak' END AS problem, CAST(page_id AS VARCHAR) AS name FROM u""")
def path_guards(spark, sf):
    k = F.col("page_id") % 5
    head = F.when(k == 0, "/").when(k == 1, "../test/").when(k == 2, "data/test/").when(k == 3, "data/tests/").otherwise("data/train/")
    rows = table(spark, sf, "pages").select("page_id", F.concat(head, F.col("page_id").cast("string")).alias("path"))
    return datasets.guarded(rows).select("page_id", "problem", idents.basename(F.col("path")).alias("name"))


@query("SELECT c_custkey, lower(c_mktsegment || '-' || CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B c' END) AS config, c_custkey % 2 = 0 AS ok FROM customer")
def config_names(spark, sf):
    name = idents.config_name(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B c"))
    return table(spark, sf, "customer").select("c_custkey", name.alias("config"), idents.is_config_name(name).alias("ok"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'd' || p_partkey ELSE 'map ' || p_partkey END AS sample FROM part")
def sample_ids(spark, sf):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("raw/d"), k, F.lit("/source.tif"))).otherwise(F.concat(F.lit("raw/map "), k, F.lit(".tif")))
    return table(spark, sf, "part").select("p_partkey", idents.sample_id(path).alias("sample"))


@query(f"WITH {TILES_SQL} SELECT map_id, pyramid_id, tile_id, [CAST(CASE level WHEN 0 THEN 896 WHEN 1 THEN 896 + 448 ELSE 896 + 448 + 224 END AS DOUBLE)] AS p FROM tiles")
def recursive_prediction(spark, sf):
    """The walk from coarse to fine with a model that adds its size to its parent's prior."""
    def model(batches):
        for b in batches:
            b["p"] = [[float(s)] if p is None else [float(p[0]) + s] for s, p in zip(b["size"], b["prior"], strict=True)]
            yield b[["map_id", "pyramid_id", "tile_id", "p"]]

    return pyramid.recursive_predict(_tiles(spark, sf).select("map_id", "pyramid_id", "tile_id", "parent_id", "level", "size"), model, "map_id bigint, pyramid_id string, tile_id string, p array<double>", clustered=True)


@query(f"""WITH {TILES_SQL}, c AS (SELECT t.*, (x - ox) // 112 AS dx, (y - oy) // 112 AS dy, size // 112 AS n FROM tiles t JOIN origins USING (map_id, pyramid_id))
SELECT map_id, pyramid_id, tile_id, list_transform(range(n * n), lambda i: CAST(896 + (dy + i // n) * 8 + dx + i % n
  + CASE WHEN level > 0 THEN 448 + (dy % 4 + i // n) * 4 + dx % 4 + i % n ELSE 0 END + CASE WHEN level > 1 THEN 224 + i ELSE 0 END AS DOUBLE)) AS p FROM c""")
def cropped_prediction(spark, sf):
    """The walk from coarse to fine over maps of cells: each child reads the part of its parent's map that it covers."""
    def model(batches):
        for b in batches:
            b["p"] = [np.arange(s, s + (s // 112) ** 2, dtype=float) + (0 if p is None else p) for s, p in zip(b["size"], b["prior"], strict=True)]
            yield b[["map_id", "pyramid_id", "tile_id", "p"]]

    tiles = _tiles(spark, sf).select("map_id", "pyramid_id", "tile_id", "parent_id", "level", "x", "y", "size")
    return pyramid.recursive_predict(tiles, model, "map_id bigint, pyramid_id string, tile_id string, p array<double>", 112, clustered=True)


@query("SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n_rings, CAST(CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 0 END AS INTEGER) AS n_points FROM supplier")
def flattened_rings(spark, sf):
    """Rings of polygons and of parts of multi-polygons; a point without two coordinates is none."""
    k = F.col("s_suppkey").cast("double")
    ring = F.array(F.array(k, k + 1), F.array(k), F.array(k + 2, k, k))
    polygon = F.array(ring)
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Polygon").when(F.col("s_suppkey") % 3 == 1, "MultiPolygon").otherwise("Point")
    rings = table(spark, sf, "supplier").select("s_suppkey", raster.rings_of(kind, polygon, F.array(polygon, polygon)).alias("rings"))
    points = F.flatten(F.transform("rings", raster.points_of))
    return rings.select("s_suppkey", F.size("rings").alias("n_rings"), F.size(points).alias("n_points"))


@query("SELECT c_custkey, c_custkey % 5 >= 3 AND c_custkey % 7 > 1 AND c_custkey % 3 > 0 AND c_nationkey > 0 AS usable FROM customer")
def usable_annotations(spark, sf):
    """Annotations with three control points, an image and its size."""
    k = F.col("c_custkey")
    gcps = F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (k % 5).cast("int"))
    image = F.when(k % 7 == 1, "").when(k % 7 > 1, "image")
    return table(spark, sf, "customer").select("c_custkey", ranking.usable_gcps(gcps, image, k % 3, F.col("c_nationkey")).alias("usable"))


@query("""WITH o AS (SELECT p_partkey AS id, unnest(['image.png', 'land_cover.png', 'topography.png', 'sample_weights.json']) AS name FROM part)
SELECT CAST(id AS VARCHAR) AS map_id FROM o WHERE (id + length(name)) % 7 <> 0 OR id % 10 = 0 GROUP BY id HAVING count(*) = 4""")
def whole_maps(spark, sf):
    """Maps with all required files."""
    return lifecycles.complete_maps(_objects(spark, sf))


@query(f"""WITH c AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS t, {", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{e}') AS DOUBLE) AS n{i}" for e, i in EVENTS.items())}
           FROM events WHERE event_type IN ({", ".join(map(repr, EVENTS))}) GROUP BY user_id),
s AS (SELECT CAST(user_id // 350 - 70 AS INTEGER) AS lat, CAST(user_id % 350 - 175 AS INTEGER) AS lon,
        round(-({_ent}) * pow(1.5, (n4 > 0)::INT + (n5 > 0)::INT + (n7 > 0)::INT), 6) AS score FROM c)
SELECT printf('wc_%+03d_%+04d', lat, lon) AS region_id, [lon, lat, lon + 1, lat + 1] AS bbox,
  CASE WHEN lat + 0.5 > 23.5 THEN '2023-05-01/2023-09-30' WHEN lat + 0.5 < -23.5 THEN '2022-12-01/2023-02-28' ELSE '2023-01-01/2023-12-31' END AS datetime_range, score
FROM s ORDER BY score DESC, md5('42:' || lat || ':' || lon), lat, lon LIMIT 50""")
def scene_regions(spark, sf):
    """The most diverse cells as regions to search scenes for."""
    cells = ranking.class_counts(table(spark, sf, "events").select("user_id", _event_class().alias("class")), ["user_id"], "class")
    lat, lon = (F.floor(F.col("user_id") / 350) - 70).cast("int"), (F.col("user_id") % 350 - 175).cast("int")
    return lifecycles.satellite_regions(cells.select(lat.alias("lat"), lon.alias("lon"), "counts"), 50)


# a pixel is on the edge where one beside it is of another feature or not there
_near = "NOT EXISTS (SELECT 1 FROM p n WHERE n.lc = p.lc AND n.x = p.x + {i} AND n.y = p.y + {j})"
_outer = " OR ".join(_near.format(i=i, j=j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))


@query(f"""WITH {RINGS_SQL}, gy AS (SELECT *, unnest(range(y0, y0 + h + 1)) AS y FROM r), gx AS (SELECT *, unnest(range(x0, x0 + w + 1)) AS x FROM gy),
i AS (SELECT ord, lc, x, y FROM gx WHERE y + 0.5 < y0 + h AND x + 0.5 >= x0 AND x + 0.5 < (x0 - (x0 + w)) * ((y + 0.5) - y0) / CAST(h AS DOUBLE) + (x0 + w)),
p AS (SELECT x, y, lc FROM i QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY ord DESC) = 1),
e AS (SELECT p.x, p.y, ({_outer}) AS edge, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b FROM p LEFT JOIN (SELECT * FROM {_pal}) c ON c.lc = p.lc AND c.style = 'satellite'),
v AS (SELECT x, y, CASE WHEN edge THEN 80 ELSE r END AS r, CASE WHEN edge THEN 65 ELSE g END AS g, CASE WHEN edge THEN 45 ELSE b END AS b FROM e),
o AS (SELECT i, j, exp(-(i * i + j * j) / (2 * 0.6::DOUBLE * 0.6::DOUBLE)) AS w FROM range(-2, 3) a(i), range(-2, 3) b(j))
SELECT CAST(v.x AS INTEGER) AS x, CAST(v.y AS INTEGER) AS y, {", ".join(f"round(sum(w * n.{c}) / sum(w), 4) AS {c}" for c in "rgb")} FROM v, o, v n WHERE n.x = v.x + i AND n.y = v.y + j GROUP BY 1, 2""")
def blurred_render(spark, sf):
    """Polygons rendered with borders and blur."""
    pixels = raster.rasterise(_rings(spark, sf), "lc")
    shown = raster.colourised(pixels, palettes(spark).where("style = 'satellite'").drop("style"))
    edged = raster.bordered(shown, "lc", (80, 65, 45))
    return raster.blurred(edged, 0.6, ["r", "g", "b"]).select("x", "y", *[F.round(c, 4).alias(c) for c in "rgb"])


@query(f"""WITH {RINGS_SQL}, gy AS (SELECT *, unnest(range(y0, y0 + h + 1)) AS y FROM r), gx AS (SELECT *, unnest(range(x0, x0 + w + 1)) AS x FROM gy),
i AS (SELECT ord, lc, x, y FROM gx WHERE y + 0.5 < y0 + h AND x + 0.5 >= x0 AND x + 0.5 < (x0 - (x0 + w)) * ((y + 0.5) - y0) / CAST(h AS DOUBLE) + (x0 + w)),
p AS (SELECT x, y, lc FROM i QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY ord DESC) = 1),
o AS (SELECT x, y, lc FROM p WHERE {_outer}),
e AS (SELECT p.*, EXISTS (SELECT 1 FROM o WHERE o.lc = p.lc AND o.x = p.x AND o.y = p.y) AS one, EXISTS (SELECT 1 FROM o WHERE o.lc = p.lc AND abs(o.x - p.x) <= 1 AND abs(o.y - p.y) <= 1) AS two FROM p),
b AS (SELECT min(x0) AS ax, min(y0) AS ay, max(x0 + w) AS zx, max(y0 + h) AS zy FROM r),
c AS (SELECT x, unnest(range(ay, zy + 1)) AS y FROM (SELECT ay, zy, unnest(range(ax, zx + 1)) AS x FROM b)),
s AS (SELECT * FROM (VALUES ('flat', 100, 100, 100, 200, 220, 240), ('illustrated', 80, 65, 45, 210, 195, 165)) t(style, er, eg, eb, br, bg, bb)),
l AS (SELECT * FROM {_pal})
SELECT s.style, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, {", ".join(f"CAST(CASE WHEN e.lc IS NULL THEN b{k} WHEN CASE s.style WHEN 'flat' THEN one ELSE two END THEN e{k} ELSE l.{k} END AS INTEGER) AS {k}" for k in "rgb")}
FROM c CROSS JOIN s LEFT JOIN e ON e.x = c.x AND e.y = c.y LEFT JOIN l ON l.lc = e.lc AND l.style = s.style""")
def styled_renders(spark, sf):
    """Polygons on their canvas in two styles, with borders of one and two pixels and each style's background."""
    rings = _rings(spark, sf)
    pixels, canvas = raster.rasterise(rings, "lc"), raster.canvas(rings)
    both = [lifecycles.rendered(pixels, s, canvas).select(F.lit(s).alias("style"), "x", "y", "r", "g", "b") for s in ("flat", "illustrated")]
    return both[0].unionByName(both[1])


@query(f"""WITH x AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding[1:9]] AS l FROM embeddings), t AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e, l FROM x)
SELECT vec_id, list_transform(e, lambda v: round(v / list_sum(e), 6)) AS p, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS lc FROM t""")
def class_probabilities(spark, sf):
    """Probabilities of the land-cover classes from their logits, and the most likely one."""
    logits = F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", logits.alias("l"))
    return rows.select("vec_id", F.transform(classes.softmax(F.col("l")), lambda v: F.round(v, 6)).alias("p"), (F.array_position("l", F.array_max("l")) - 1).cast("int").alias("lc"))


@query(f"""WITH {MAPS_SQL}, {SPLIT_SQL}
SELECT count(*) AS n_maps FROM maps JOIN split ON split.src_id = CAST(map_id AS VARCHAR) WHERE subset = 'test'""")
def test_maps(spark, sf):
    maps = _maps(spark, sf).select(idents.styled_id(F.col("map_id").cast("string"), F.lit("flat")).alias("map_id"))
    test = _split(spark, sf).where("subset = 'test'").select("src_id")
    return maps.withColumn("src_id", idents.source_of(F.col("map_id"))).join(test, "src_id", "left_semi").agg(F.count(F.lit(1)).alias("n_maps"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_nationkey < 9) AS n_chosen, min(c_acctbal) FILTER (WHERE c_nationkey < 9) AS low, max(c_acctbal) FILTER (WHERE c_nationkey < 9) AS high FROM customer GROUP BY 1")
def selection_range(spark, sf):
    return ranking.selection(table(spark, sf, "customer"), ["c_mktsegment"], F.col("c_nationkey") < 9, "c_acctbal")


@query("SELECT o_custkey, o_orderkey, CAST(step AS INTEGER) AS step FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE step % 3 = 0")
def periodic_steps(spark, sf):
    return ranking.every(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


@query("SELECT c_custkey, md5('7:' || c_custkey) AS place FROM customer")
def shuffled_samples(spark, sf):
    return samples.shuffled(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 7)


@query("SELECT p_partkey, p_type || '/' || p_brand AS prefix FROM part")
def family_prefixes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", idents.family_prefix(F.col("p_type"), F.col("p_brand")).alias("prefix"))


@query("SELECT page_id, url_encode(url || ' ~*(ä)') AS quoted FROM pages")
def quoted_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", idents.quoted(F.concat("url", F.lit(" ~*(ä)"))).alias("quoted"))


@query(f"""WITH i AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'm' || c_custkey END AS manifest, c_custkey % 11 = 0 AS failed FROM customer),
b AS (SELECT user_id, min(CASE event_type {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(STATUS_OF))} END) AS p, array_to_string(list_sort(list(DISTINCT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items())} END)), '+') AS every FROM events GROUP BY user_id)
SELECT c_custkey, CASE WHEN coalesce(manifest, '') = '' THEN 'no_manifest' WHEN failed THEN 'lookup_failed' ELSE coalesce(nullif(every, ''), 'no_plates') END AS raw_reason, CASE WHEN coalesce(manifest, '') = '' THEN 'not_in_allmaps' WHEN failed THEN 'download_failed' ELSE coalesce(list_extract([{", ".join(map(literal, STATUS_OF.values()))}], CAST(p AS INTEGER) + 1), 'not_in_allmaps') END AS status FROM i LEFT JOIN b ON user_id = c_custkey""")
def lookup_statuses(spark, sf):
    k = F.col("c_custkey")
    items = table(spark, sf, "customer").select("c_custkey", F.when(k % 7 == 1, "").when(k % 7 != 0, F.concat(F.lit("m"), k.cast("string"))).alias("manifest"), (k % 11 == 0).alias("lookup_failed"))
    status = F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS_OF.items() for x in p]), F.col("event_type"))
    return ranking.item_status(items, table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), status.alias("status")), "c_custkey")


@query(f"""WITH {ORIGINS_SQL}, r AS (SELECT map_id, pyramid_id, row_number() OVER (ORDER BY md5('42:' || map_id || '/' || pyramid_id), map_id || '/' || pyramid_id) AS rn, count(*) OVER () AS n FROM origins)
SELECT map_id, pyramid_id, CASE WHEN rn <= floor(n * 0.2) THEN 'val' ELSE 'train' END AS part FROM r""")
def pyramid_split(spark, sf):
    """Whole pyramids on one side each."""
    return datasets.group_split(_tiles(spark, sf), ["map_id", "pyramid_id"])


@query(f"""WITH {TILES_SQL} SELECT map_id, pyramid_id, CASE map_id % 3 WHEN 1 THEN 'satellite' ELSE 'synthetic' END AS source, count(*) AS n, sum(size) AS sides FROM tiles
WHERE map_id % 3 <> 0 AND map_id % 10 <> 0 GROUP BY 1, 2, 3""")
def training_index(spark, sf):
    """Tiles of pyramids that have weights; those under test are left out before, as they would stop it."""
    k = F.col("map_id")
    found = pyramid.origins(_maps(spark, sf)).withColumn("path", F.concat(F.when(k % 10 == 0, "data/test/").otherwise("data/train/"), F.col("pyramid_id")))
    weights = found.where(k % 3 != 0).select("map_id", "pyramid_id", F.when(k % 3 == 1, "satellite").otherwise("synthetic").alias("source"))
    return pyramid.training_index(found.where(~idents.under_test(F.col("path"))), weights).groupBy("map_id", "pyramid_id", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sides"))


@query(f"WITH {TILES_SQL} SELECT map_id, count(*) AS n_tiles, min(tile_id || '_image.png') AS first_image FROM tiles WHERE map_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) GROUP BY map_id")
def tiles_to_do(spark, sf):
    """Tiles of maps that are not finished, with the names of their images."""
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("map_id"))
    plan = lifecycles.tile_plan(_maps(spark, sf), done)
    return plan.groupBy("map_id").agg(F.count(F.lit(1)).alias("n_tiles"), F.min("artifacts.image").alias("first_image"))


@query(f"""WITH {PRED_SQL}, t AS (SELECT n.*, vec_id % 50 AS map_id FROM n), k AS (SELECT * FROM t WHERE map_id % 5 = 0 AND vec_id % 3 <> 0)
SELECT count(*) FILTER (WHERE lc_ok AND topo_ok) AS n_valid, round(sum(lc_nll + topo_nll) FILTER (WHERE lc_ok AND topo_ok) / count(*) FILTER (WHERE lc_ok AND topo_ok), 6) AS joint_nll FROM k""")
def test_evaluation(spark, sf):
    """Joint loss over the finest tiles of the maps of test sources, whatever their style."""
    k = F.col("vec_id")
    keys = [F.concat_ws("__", (k % 50).cast("string"), F.when(k % 2 == 0, "flat").otherwise("ink")).alias("map_id"), F.lit("py_r000_c000").alias("pyramid_id"), k.cast("string").alias("tile_id")]
    pixels = _pixels(spark, sf).select(*keys, "lc", "topo", "logits")
    tiles = _pixels(spark, sf).select(*keys, F.when(k % 3 == 0, 448).otherwise(224).alias("size"))
    test = spark.range(0, 50, 5).select(F.col("id").cast("string").alias("src_id"))
    return lifecycles.evaluation(tiles, pixels, test).select("n_valid", F.round("joint_nll", 6).alias("joint_nll"))


# the first split holds whatever comes later: a second one with another seed and more sources is not written
@query(f"WITH {SPLIT_SQL} SELECT CAST(c_custkey AS VARCHAR) AS src_id, coalesce(subset, 'train') AS subset FROM customer LEFT JOIN split ON src_id = CAST(c_custkey AS VARCHAR) AND c_custkey % 9 <> 0")
def frozen_split(spark, sf):
    """The subset of every source by a split that was frozen before some of them were there; these are trained on."""
    every = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("src_id"), F.col("c_mktsegment").alias("template"))
    path = new_path(spark, "split")
    files.frozen(_split(spark, sf).where("subset = 'test' AND CAST(src_id AS BIGINT) % 9 <> 0").select("src_id"), path)
    test = files.frozen(every.where("false").select("src_id"), path)
    return every.join(test.withColumn("subset", F.lit("test")), "src_id", "left").select("src_id", F.coalesce("subset", F.lit("train")).alias("subset"))


@query("SELECT 'tile_' || p_partkey || '.tif' AS filename, CASE WHEN p_partkey % 4 = 0 THEN 'a' WHEN p_partkey % 4 = 1 THEN 'c' ELSE 'root' END AS folder, CAST(length(p_name) AS BIGINT) AS bytes FROM part WHERE p_partkey % 5 > 0")
def raster_listing(spark, sf):
    """All rasters below two folders, of which one lies in the other, each once; files of all kinds are written first."""
    k = F.col("p_partkey")
    folder = F.when(k % 4 == 0, "a/").when(k % 4 == 1, "b/c/").otherwise("")
    root = new_path(spark, "listing")
    files.put(spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey").select(F.concat(folder, F.lit("tile_"), k.cast("string"), F.when(k % 5 > 0, ".tif").otherwise(".png")).alias("name"), F.col("p_name").alias("content")), root)
    found = files.rasters(spark, f"{root}/a", root)
    parent = F.element_at(F.split("path", "/"), -2)
    return found.select("filename", F.when(parent.isin("a", "c"), parent).otherwise("root").alias("folder"), "bytes")


@query("""SELECT 'r' || o_orderkey AS region_id, CAST(o_custkey % 180 AS DOUBLE) AS west, CASE WHEN o_orderkey % 7 > 0 THEN 'https://x/' || o_orderkey END AS visual_href, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_custkey % 50 + o_orderkey % 100 AS DOUBLE) / 4 END AS cloud FROM orders""")
def scene_manifests(spark, sf):
    """Resolved scenes through their manifest files, which hold some thousand each, and back."""
    k = F.col("o_orderkey")
    west = (F.col("o_custkey") % 180).cast("double")
    scenes = table(spark, sf, "orders").select(F.concat(F.lit("r"), k.cast("string")).alias("region_id"), F.array(west, F.lit(0.0), west + 1, F.lit(1.0)).alias("bbox"), F.lit("2023-01-01/2023-12-31").alias("datetime_range"),
        F.when(k % 7 > 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("visual_href"), F.when(k % 11 > 0, (F.col("o_custkey") % 50 + k % 100).cast("double") / 4).alias("eo_cloud_cover"))
    root = new_path(spark, "scenes")
    files.put(records.scene_manifest(scenes, 4000), root)
    return files.resolved_scenes(spark, root).select("region_id", F.col("bbox")[0].alias("west"), "visual_href", F.col("eo_cloud_cover").alias("cloud"))


@query(f"""SELECT CAST(user_id // 350 - 70 AS INTEGER) AS lat, CAST(user_id % 350 - 175 AS INTEGER) AS lon, {", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in EVENTS)}
FROM events WHERE event_type IN ({", ".join(map(repr, EVENTS))}) GROUP BY user_id""")
def coverage_cache(spark, sf):
    """Class counts of cells through the files that keep them, and back."""
    counted = ranking.class_counts(table(spark, sf, "events").select("user_id", _event_class().alias("class")), ["user_id"], "class")
    cells = counted.select((F.floor(F.col("user_id") / 350) - 70).cast("int").alias("lat"), (F.col("user_id") % 350 - 175).cast("int").alias("lon"), "counts")
    root = new_path(spark, "coverage")
    files.put(records.coverage_summary(cells, 500), root)
    return files.coverage_cells(spark, root).select("lat", "lon", *[F.col("counts")[i].alias(e) for e, i in EVENTS.items()])


@query("SELECT CAST(p_partkey AS VARCHAR) AS map_id, CAST(1 AS BIGINT) AS n FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def completion_marks(spark, sf):
    """Marks of finished maps after two builds that share some; each map is marked once."""
    maps, path = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("map_id"), "p_partkey"), new_path(spark, "marks")
    for every in (3, 2):
        files.mark_complete(maps.where(F.col("p_partkey") % every == 0), path)
    return files.completed(spark, path).groupBy("map_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRID_SQL} SELECT map_id, lc, count(*) AS n, sum(x + 50 * y) AS places, count(*) FILTER (WHERE topo = 255) AS n_no_topo FROM (SELECT map_id, x, y, CAST(id % 9 AS INTEGER) AS lc, CASE WHEN id % 9 = 0 THEN 255 ELSE id % 3 END AS topo FROM g) GROUP BY ALL")
def label_files(spark, sf):
    """Label pixels through the files of their maps, and back."""
    k = F.col("map_id").cast("bigint") * 2500 + F.col("y") * 50 + F.col("x")
    path = new_path(spark, "labels")
    files.write_labels(_grid(spark, sf).select("map_id", "x", "y", (k % 9).cast("int").alias("lc"), F.when(k % 9 == 0, 255).otherwise(k % 3).cast("int").alias("topo")), path)
    return spark.read.parquet(path).groupBy("map_id", "lc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") + 50 * F.col("y")).alias("places"), F.count_if(F.col("topo") == 255).alias("n_no_topo"))


@query(f"""WITH {GRID_SQL}, sz AS (SELECT map_id, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY map_id), l AS (SELECT *, CAST(unnest(range(h)) AS INTEGER) AS line FROM sz)
SELECT l.map_id || '.tif' AS name, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, line AS y, CAST(coalesce(sum(g.id % 251 + g.x + g.y), 0) + 765 * (w - count(g.id)) AS BIGINT) AS total FROM l LEFT JOIN g ON g.map_id = l.map_id AND g.y = line GROUP BY l.map_id, w, h, line""")
def strip_rasters(spark, sf):
    """Every line of every map, from files of deflated strips that were packed apart; what no pixel covers is 255."""
    grid = _grid(spark, sf)
    k = F.col("map_id").cast("bigint") * 2500 + F.col("y") * 50 + F.col("x")
    pixels = grid.select("map_id", "x", "y", (k % 251).cast("int").alias("r"), F.col("x").alias("g"), F.col("y").alias("b"))
    affines = grid.groupBy("map_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).select("*", *[F.lit(v).alias(c) for c, v in (("west", 2.5), ("north", 48.0), ("dx", 0.01), ("dy", 0.01))])
    root = new_path(spark, "strips_of_maps")
    tiff.write(pixels, affines, ["r", "g", "b"], root, nodata=255, rows=7)
    return tiff.lines(spark, root).select(idents.basename(F.col("path")).alias("name"), "width", "height", "y", png.byte_sum("line").alias("total"))


@query("SELECT page_id, regexp_replace(CASE page_id % 3 WHEN 0 THEN 'gs://' || url WHEN 1 THEN url END, '^gs://', '') AS plain, page_id % 3 = 0 AS remote FROM pages")
def output_paths(spark, sf):
    """Paths without their scheme, and whether a build may write there; some are missing."""
    k = F.col("page_id")
    paths = table(spark, sf, "pages").select("page_id", F.when(k % 3 == 0, F.concat(F.lit("gs://"), "url")).when(k % 3 == 1, F.col("url")).alias("p"))
    return paths.select("page_id", idents.without_scheme(F.col("p")).alias("plain"), idents.is_remote(F.col("p")).alias("remote"))


__all__ = ["ORACLE_SQL", "QUERIES", "lifecycles"]
