"""Part of terrain_spark."""
