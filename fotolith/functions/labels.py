"""Rules that name things, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolith.schema import GroupConfig


def cluster_label(span_minutes: Column, aspect: Column, l: Column, a: Column, b: Column) -> Column:
    return (
        F.when(span_minutes < 10, "Burst / Moment")
        .when(span_minutes < 120, "Event")
        .when((aspect < 0.85) & (a > 5) & (b > 5), "Portraits")
        .when((aspect > 1.2) & ((a < -5) | (b < -5)), "Landscapes")
        .when(l > 80, "Bright Scenes")
        .when(l < 20, "Dark Scenes")
        .otherwise("Visual Harmony")
    )


def force_label(time: Column, color: Column, palette: Column) -> Column:
    """The greatest force; ties prefer time, then colour."""
    return F.when((time >= color) & (time >= palette), "Time").when(color >= palette, "Color").otherwise("Palette")


def config_forces(config: GroupConfig, rows: int) -> tuple[float, float, float]:
    """Shares of the weights in percent; thirds for no rows or no weight."""
    total = config.weight_time + config.weight_color + 0.2
    if not rows or total <= 1e-9:
        return 33.3, 33.3, 33.3
    return config.weight_time / total * 100, config.weight_color / total * 100, 0.2 / total * 100


def theme_folder(cluster_id: Column) -> Column:
    return F.when(cluster_id == 0, "Uncategorized").otherwise(F.concat(F.lit("Theme_"), cluster_id.cast("string")))


def theme_title(cluster_id: Column, n: Column) -> Column:
    return F.when(cluster_id == 0, "Miscellaneous").otherwise(F.concat(F.lit("Theme "), cluster_id.cast("string"), F.lit(" ("), n.cast("string"), F.lit(" items)")))


def log_severity(line: Column) -> Column:
    out = F.lit("OTHER")
    for word in ("DEBUG", "WARN", "ERROR"):
        out = F.when(F.contains(line, F.lit(word)), word).otherwise(out)
    return out
