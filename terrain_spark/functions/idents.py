"""Identifiers, names and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitised(c: Column, empty: str | None = None) -> Column:
    """Every character that is no letter, digit, ``_`` or ``-`` becomes ``_``; empty and null become ``empty`` if given."""
    out = F.regexp_replace(c, r"(?U)[^\w-]", "_")
    return out if empty is None else F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty)).otherwise(out)


def template_key(c: Column) -> Column:
    """The name without its number, in lower case; the whole name in lower case where nothing is left."""
    head = F.regexp_extract(c, r"^(.+?)[ _\-]+\d+$", 1)
    return F.coalesce(F.nullif(F.lower(F.btrim(F.when(head == "", c).otherwise(head), F.lit("_-"))), F.lit("")), F.lower(c))


def is_map_filename(c: Column) -> Column:
    return c.rlike(r"^[a-z][a-z0-9_]*_[0-9]{2}\.geojson$")


def expected_template(c: Column) -> Column:
    """What stands before the last ``_``."""
    return F.regexp_replace(c, r"_[^_]*$", "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def is_config_name(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9][a-z0-9\-]*$")


def config_name(backbone: Column, variant: Column) -> Column:
    return F.lower(F.concat_ws("-", backbone, variant))


def is_traversal(c: Column) -> Column:
    """Ids that could leave their folder."""
    return c.startswith("/") | F.array_contains(F.split(c, "/"), "..")


def under_test(c: Column) -> Column:
    """Paths with ``test`` as a component."""
    return F.array_contains(F.split(c, "/"), "test")


def sample_id(path: Column) -> Column:
    """The stem of a path, or its folder's name where the stem is ``source``."""
    return F.when(stem(path) == "source", F.try_element_at(F.split(path, "/"), F.lit(-2))).otherwise(stem(path))


def pyramid_id(ox: Column, oy: Column, stride: int = 448) -> Column:
    return F.format_string("py_r%03d_c%03d", (oy / stride).cast("int"), (ox / stride).cast("int"))


def signed_id(lat: Column, lon: Column) -> Column:
    return F.format_string("wc_%+03d_%+04d", lat.cast("int"), lon.cast("int"))


def hemisphere_id(lat: Column, lon: Column) -> Column:
    """``N48E002``: the south-west corner of a tile."""
    return F.concat(F.when(lat >= 0, "N").otherwise("S"), F.lpad(F.abs(lat).cast("string"), 2, "0"), F.when(lon >= 0, "E").otherwise("W"), F.lpad(F.abs(lon).cast("string"), 3, "0"))


def family_prefix(family: Column, subset: Column) -> Column:
    return F.concat_ws("/", family, subset)


def quoted(c: Column) -> Column:
    """Percent-encoded, with nothing but letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def checkpoint_name(step: Column) -> Column:
    return F.format_string("step_%07d.pt", step.cast("bigint"))


def checkpoint_step(name: Column) -> Column:
    return F.regexp_extract(name, r"^step_(\d+)\.pt$", 1).try_cast("bigint")


def without_scheme(c: Column) -> Column:
    return F.regexp_replace(c, "^gs://", "")


def is_remote(c: Column) -> Column:
    """Paths in an object store; null is none."""
    return F.coalesce(c.startswith("gs://"), F.lit(False))


def styled_id(source: Column, style: Column) -> Column:
    return F.concat(source, F.lit("__"), style)


def source_of(map_id: Column) -> Column:
    return F.get(F.split(map_id, "__"), F.lit(0))


def named_field(entries: Column, name: str, default: str | None = None) -> Column:
    """The first value under ``name``, in any case, of an array of maps to lists of text."""
    found = F.filter(F.flatten(F.transform(entries, lambda m: F.map_entries(m))), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(F.get(found, F.lit(0))["value"], F.lit(0)), F.lit(default))


def iiif_url(service: Column, edge: int = 4096) -> Column:
    return F.concat(F.rtrim(service, F.lit("/")), F.lit(f"/full/!{edge},{edge}/0/default.jpg"))
