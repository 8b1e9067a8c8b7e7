"""Class codes as column expressions: heights, slopes, remaps, colours, probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import LAND_COVER, NODATA, WORLD_COVER

SEA_LEVEL = 20
BARE = LAND_COVER.index("bare_sparse")


def normalised_height(h: Column) -> Column:
    return (h - SEA_LEVEL) / 80.0 * 100.0


def topography(h: Column) -> Column:
    """0 up to height 36, 1 up to 64, 2 above; null for water. Integer cuts of 20 and 55 % of the land range."""
    return F.when(h < SEA_LEVEL, F.lit(None).cast("int")).when(h <= 36, 0).when(h <= 64, 1).otherwise(2)


def land_cover(h: Column, mapped: Column) -> Column:
    """Water below sea level, else the biome's class, bare where the biome is unknown."""
    return F.when(h < SEA_LEVEL, 0).otherwise(F.coalesce(mapped, F.lit(BARE)))


def from_world_cover(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WORLD_COVER for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(NODATA))


def slope_degrees(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def slope_class(slope: Column, water: Column) -> Column:
    return F.when(water | slope.isNull() | F.isnan(slope), NODATA).when(slope >= 15, 2).when(slope >= 2, 1).otherwise(0)


def stretched(v: Column, low: Column, high: Column) -> Column:
    """0 to 255 between ``low`` and ``high``, cut towards zero; 0 where they are the same."""
    return F.when(high > low, ((v - low) / (high - low) * 255).cast("int")).otherwise(0)


def finite(v: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(F.isnan(v) | F.isnull(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def nll(p: Column) -> Column:
    return -F.ln(F.greatest(p, F.lit(1e-12)))


def nll_of(logits: Column, label: Column, n: int) -> Column:
    """The same of one class from its logit, with the exponentials summed once."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.least(top + F.ln(total) - F.get(logits, clamped(label, n).cast("int")), F.lit(-math.log(1e-12)))


def stacked(*channels: Column) -> Column:
    """Channels of several arrays as one: logits of both heads, or an image's with a prior's."""
    return F.concat(*channels)


def clamped(i: Column, n: int) -> Column:
    return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1))


def byte(v: Column) -> Column:
    """Within 0 and 255, cut towards zero."""
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("int")


def grey(r: Column, g: Column, b: Column) -> Column:
    """Luma in 16-bit fixed point, as image libraries compute it."""
    return F.shiftright((r * 19595 + g * 38470 + b * 7471 + 32768).cast("int"), 16)


def composite(v: Column, alpha: Column, background: int) -> Column:
    return F.round((v * alpha + F.lit(background) * (255 - alpha)) / 255.0).cast("int")


# The sepia matrix, and the tint of aged paper as factor and offset.
SEPIA = [(0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131)]
TINT = [(1.08, 18.0), (1.00, 10.0), (0.82, 0.0)]


def parchment(r: Column, g: Column, b: Column, noise: Column | None = None) -> list[Column]:
    """Sepia, tint and noise; blurring needs neighbours and is an operator of its own."""
    out = []
    for (x, y, z), (factor, offset) in zip(SEPIA, TINT, strict=True):
        sepia = F.least(r * x + g * y + b * z, F.lit(255.0))
        v = F.least(sepia * factor + offset, F.lit(255.0))
        out.append(byte(v if noise is None else v + noise))
    return out


def gaussian(seed: int, *place: Column) -> Column:
    """Noise of mean 0 and deviation 1 from a hash of the place, the same in any partitioning."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *place), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(F.lit(-2.0) * F.ln(u(0))) * F.cos(F.lit(2 * math.pi) * u(1))


def faded(channel: Column, luma: Column, mean_luma: Column) -> Column:
    """Saturation 0.35, contrast 0.6 about the image's mean, brightness 1.15."""
    pale = byte(luma + (channel - luma) * 0.35)
    flat = byte(mean_luma + (pale - mean_luma) * 0.6)
    return byte(flat * 1.15)
