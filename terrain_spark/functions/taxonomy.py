"""The shared class taxonomy and its lookup tables.

All tables here are fixed values that results depend on; they are small constants, so plans hold them as local
relations, which Catalyst folds or broadcasts by their known size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
NODATA = 255
LAND_COVER = ["water", "trees", "shrubland", "grassland", "cropland", "built_up", "bare_sparse", "flooded_wetland", "snow_ice"]
TOPOGRAPHY = ["flat", "hilly", "mountainous"]

#: (id, name, land cover) of the biomes of generated maps.
BIOMES = [
    (0, "Hot desert", "bare_sparse"),
    (1, "Savanna", "grassland"),
    (2, "Tropical dry forest", "trees"),
    (3, "Tropical wet forest", "trees"),
    (4, "Xeric shrubland", "shrubland"),
    (5, "Temperate dry grassland", "grassland"),
    (6, "Temperate wet grassland", "grassland"),
    (7, "Temperate deciduous forest", "trees"),
    (8, "Subtropical rain forest", "trees"),
    (9, "Cold desert", "bare_sparse"),
    (10, "Temperate rain forest", "trees"),
    (11, "Coniferous wet forest", "trees"),
    (12, "Temperate coniferous forest", "trees"),
    (13, "Subtaiga", "trees"),
    (14, "Boreal wet forest", "trees"),
    (15, "Boreal dry forest", "trees"),
    (16, "Subpolar scrub", "shrubland"),
    (17, "Subpolar desert", "bare_sparse"),
    (18, "Tundra", "bare_sparse"),
    (19, "Rocky desert", "bare_sparse"),
    (20, "Polar desert", "bare_sparse"),
    (21, "Glacier", "snow_ice"),
]

#: Codes of the global land-cover product and classes.
WORLD_COVER = [(10, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6), (70, 8), (80, 0), (90, 7), (95, 1), (100, 6)]

#: Beginnings of tile names, land cover, topography; the longest that fits counts.
TILE_PREFIXES = [
    ("hex_water_ocean", 0, None),
    ("hex_water_swamp", 7, 0),
    ("hex_coast_beach", 6, 0),
    ("hex_wetlands_damp", 7, 0),
    ("hex_snow", 8, 0),
    ("hex_sparse_trees_snowy", 8, 0),
    ("hex_forest_conifer_snowy", 1, 2),
    ("hex_forest_conifer_lush", 1, 1),
    ("hex_forest_deciduous_lush", 1, 0),
    ("hex_forest_mixed_lush", 1, 0),
    ("hex_sparse_trees_lush", 1, 0),
    ("hex_hill_with_tree", 1, 1),
    ("hex_mountains_foothills_snowy", 8, 1),
    ("hex_mountains_foothills_rocky", 6, 1),
    ("hex_mountains_foothills_lush", 3, 1),
    ("hex_mountains_low_snowy", 8, 2),
    ("hex_mountains_low_rocky", 6, 2),
    ("hex_mountains_low_lush", 1, 2),
    ("hex_mountains_medium_snowy", 8, 2),
    ("hex_mountains_medium_rocky", 6, 2),
    ("hex_mountains_medium_lush", 1, 2),
    ("hex_mountains_peak_snowy", 8, 2),
    ("hex_mountains_peak_rocky", 6, 2),
    ("hex_mountains_peak_lush", 6, 2),
    ("hex_mountain_volcano_snowy", 8, 2),
    ("hex_mountain_volcano_rocky", 6, 2),
    ("hex_mountain_volcano_lush", 1, 2),
    ("hex_hills_snowy", 8, 1),
    ("hex_hills_desert", 6, 1),
    ("hex_hills_lush", 3, 1),
    ("hex_plains_farmland", 4, 0),
    ("hex_plains_desert", 6, 0),
    ("hex_plains_damp", 3, 0),
    ("hex_plains_lush", 3, 0),
    ("hex_urban_farmland", 4, 0),
    ("hex_urban_farm", 4, 0),
    ("hex_urban_city", 5, 0),
    ("hex_urban_modern_town", 5, 0),
    ("hex_urban_monastery", 5, 0),
    ("hex_urban_tower", 5, 0),
    ("hex_urban_town", 5, 0),
]

# Fixed values.
#: Land cover, topography and the descriptions that answers take in turn.
DESCRIPTIONS = [
    (0, None, ["ocean", "sea", "open water", "coastal water"]),
    (1, 0, ["flat woodland", "lowland forest", "deciduous forest"]),
    (1, 1, ["forested hills", "wooded highlands", "hillside forest"]),
    (1, 2, ["mountain forest", "alpine forest", "forested mountains"]),
    (2, 0, ["shrubland", "scrubland", "low bushland"]),
    (2, 1, ["scrubby hills", "shrubby highlands"]),
    (3, 0, ["grassland", "plains", "flat meadow", "open fields"]),
    (3, 1, ["rolling hills", "grassy hills", "verdant highlands"]),
    (4, 0, ["farmland", "cropland", "agricultural fields"]),
    (5, 0, ["town", "city", "urban settlement", "built-up area"]),
    (6, 0, ["desert", "arid plains", "bare terrain", "sandy flats"]),
    (6, 1, ["rocky hills", "barren highlands", "desert hills"]),
    (6, 2, ["rocky mountains", "barren peaks", "high rocky mountains"]),
    (7, 0, ["wetland", "swamp", "marsh", "flooded terrain"]),
    (7, 1, ["wetland", "swamp"]),
    (8, 0, ["snow field", "snow plain", "ice field"]),
    (8, 1, ["snowy hills", "snow-covered highlands"]),
    (8, 2, ["snowy mountains", "snow-capped peaks", "alpine snowfield"]),
]

# Fixed values.
PROMPTS = [
    "What terrain type does this illustrated map tile show?",
    "Identify the land cover and topography in this map tile.",
    "What terrain is depicted in this fantasy map illustration?",
    "Describe the terrain type shown in this map tile.",
    "What kind of landscape does this map tile represent?",
]

# Fixed values.
#: Colours of the land-cover classes in each style, in the order of LAND_COVER.
PALETTES = {
    "flat": [(60, 120, 200), (34, 100, 34), (140, 170, 70), (180, 210, 100), (220, 200, 80), (160, 150, 140), (210, 190, 150), (70, 150, 140), (235, 245, 255)],
    "illustrated": [(90, 150, 200), (80, 130, 60), (160, 175, 90), (200, 215, 130), (215, 195, 90), (185, 170, 155), (220, 200, 165), (90, 160, 155), (240, 245, 250)],
    "satellite": [(40, 80, 130), (25, 80, 30), (110, 130, 55), (140, 165, 75), (175, 160, 55), (130, 120, 110), (185, 170, 135), (50, 120, 115), (220, 230, 235)],
}
BORDERS = {"flat": ((100, 100, 100), 1), "illustrated": ((80, 65, 45), 2), "satellite": (None, 0)}
BACKGROUNDS = {"flat": (200, 220, 240), "illustrated": (210, 195, 165), "satellite": (20, 50, 90)}
# Fixed values.
#: Colours for inspection, by class.
INSPECTION = {"water": "#3a7ca5", "trees": "#1b7a3d", "shrubland": "#9bbf4f", "grassland": "#b7d96b", "cropland": "#e8c060", "built_up": "#d1495b", "bare_sparse": "#c2a878", "flooded_wetland": "#5fa8a0", "snow_ice": "#eef0f5"}
INSPECTION_TOPOGRAPHY = {"flat": "#cfe8cf", "hilly": "#d8b878", "mountainous": "#8a5a3c"}

# Fixed values.
#: Loss weights of the land-cover classes by source, in the order of LAND_COVER; topography weighs 1 in all.
WEIGHTS = {
    "historical": [1.0, 0.3, 0.7, 0.7, 0.15, 0.1, 1.0, 0.5, 1.0],
    "satellite": [0.6, 0.6, 1.0, 1.0, 1.3, 1.3, 1.0, 1.3, 1.0],
    "synthetic": [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0],
}
TOPOGRAPHY_WEIGHT = 1.0
UPWEIGHTED, UPWEIGHT = [4, 5, 7], 1.5
MAP_TYPES = ["Atlas Map", "Separate Map", "Map", "Historical Map", "Wall Map", "Globe Map"]
REQUIRED_FILES = ["image.png", "land_cover.png", "topography.png", "sample_weights.json"]


def literal(value: object) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(literal, value)) + ")"
    return repr(value)


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A constant table that the optimiser knows the size of."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def land_cover_classes(spark: SparkSession) -> DataFrame:
    return values(spark, "idx, name", list(enumerate(LAND_COVER)))


def topography_classes(spark: SparkSession) -> DataFrame:
    return values(spark, "idx, name", list(enumerate(TOPOGRAPHY)))


def biomes(spark: SparkSession) -> DataFrame:
    return values(spark, "biome, biome_name, lc", [(i, n, LAND_COVER.index(c)) for i, n, c in BIOMES])


def world_cover(spark: SparkSession) -> DataFrame:
    return values(spark, "code, lc", WORLD_COVER)


def tile_prefixes(spark: SparkSession) -> DataFrame:
    return values(spark, "prefix, lc, topo", TILE_PREFIXES)


def descriptions(spark: SparkSession) -> DataFrame:
    return values(spark, "lc, topo, texts", DESCRIPTIONS)


def prompts(spark: SparkSession) -> DataFrame:
    return values(spark, "prompt_idx, prompt", list(enumerate(PROMPTS)))


def palettes(spark: SparkSession) -> DataFrame:
    return values(spark, "style, lc, r, g, b", [(s, i, *c) for s, colours in PALETTES.items() for i, c in enumerate(colours)])


def topography_palette(spark: SparkSession) -> DataFrame:
    return values(spark, "topo, r, g, b", [(i, *(int(INSPECTION_TOPOGRAPHY[n][k : k + 2], 16) for k in (1, 3, 5))) for i, n in enumerate(TOPOGRAPHY)])


def inspection_palette(spark: SparkSession) -> DataFrame:
    return values(spark, "lc, r, g, b", [(i, *(int(INSPECTION[n][k : k + 2], 16) for k in (1, 3, 5))) for i, n in enumerate(LAND_COVER)])


def source_weights(spark: SparkSession) -> DataFrame:
    return values(spark, "source, lc, weight", [(s, i, w) for s, ws in WEIGHTS.items() for i, w in enumerate(ws)])


def weight_map(source: str) -> Column:
    """The weights of a source as a map from class name."""
    return F.create_map(*[F.lit(x) for pair in zip(LAND_COVER, WEIGHTS[source], strict=True) for x in pair])
