"""Plans of file operations as frames; nothing is moved here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.functions.labels import theme_folder
from fotolith.functions.names import file_name, parent
from fotolith.session import positions

#: Smaller clusters stay where they are.
MIN_MEMBERS = 4


def theme_moves(assigned: DataFrame) -> DataFrame:
    """``cluster, src, dest`` of ``assigned(path, cluster)``: members of clusters of four or more go to the theme's folder."""
    big = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_MEMBERS)
    dest = F.concat_ws("/", parent(F.col("path")), theme_folder(F.col("cluster")), file_name(F.col("path")))
    return assigned.join(big.select("cluster"), "cluster").select("cluster", F.col("path").alias("src"), dest.alias("dest"))


def renames(wanted: DataFrame) -> DataFrame:
    """``src, dest`` of ``wanted(path, new_name)``: blank and unchanged names are no work."""
    live = wanted.where("trim(new_name) <> ''").where(F.col("new_name") != file_name(F.col("path")))
    return live.select(F.col("path").alias("src"), F.concat_ws("/", parent(F.col("path")), F.col("new_name")).alias("dest"))


def drops(dropped: DataFrame, existing: DataFrame) -> DataFrame:
    """``src, dest`` of ``dropped(path, target)``: not into the own folder, not nameless, not over an existing path."""
    name = file_name(F.col("path"))
    live = dropped.where(name != "").where(~F.col("target").eqNullSafe(parent(F.col("path"))))
    plan = live.select(F.col("path").alias("src"), F.concat_ws("/", F.col("target"), name).alias("dest"))
    return plan.join(existing.select(F.col("path").alias("dest")), "dest", "left_anti").select("src", "dest")


def save_as(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``src, dest, refused`` of ``wanted(path, dest)``: the same or an existing path is refused."""
    there = existing.select(F.col("path").alias("dest"), F.lit(True).alias("there")).distinct()
    same = F.col("path") == F.col("dest")
    refused = F.when(same, "same path").when(F.coalesce("there", F.lit(False)), "exists")
    return wanted.join(there, "dest", "left").select(F.col("path").alias("src"), "dest", refused.alias("refused"))


def cut(clicked: DataFrame, selected: DataFrame, pane: str) -> DataFrame:
    """``pane, clicked, path``: what a cut takes in each pane, from its one clicked item and its ``selected(pane, path)``.

    A selected item takes the whole selection with it, any other one goes alone.
    """
    hits = clicked.join(selected.select(pane, F.col("path").alias("clicked")), [pane, "clicked"], "left_semi")
    whole = hits.join(selected, pane).select(pane, "clicked", "path")
    alone = clicked.join(hits, [pane, "clicked"], "left_anti").select(pane, "clicked", F.col("clicked").alias("path"))
    return whole.unionByName(alone)


def progress(assigned: DataFrame) -> DataFrame:
    """``src, done, total`` of the moves of ``assigned(path, cluster)``: how many are done with each, in order of cluster and path."""
    placed = positions(theme_moves(assigned).select("cluster", "src"), ["cluster", "src"], "place")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    return placed.join(F.broadcast(total)).select("src", (F.col("place") + 1).alias("done"), "total")
