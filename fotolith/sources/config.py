"""Settings of the browser as JSON: favourites, read leniently."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolith.schema import FAVORITES


def parse_favorites(text: Column) -> Column:
    """The settings; where the text does not parse, with its backslashes doubled; else no favourites."""
    strict = lambda c: F.from_json(c, FAVORITES, {"mode": "PERMISSIVE"})
    ok = lambda c: F.when(strict(c)["favorites"].isNotNull(), strict(c))
    empty = F.from_json(F.lit('{"favorites":[]}'), FAVORITES)
    return F.coalesce(ok(text), ok(F.regexp_replace(text, r"\\", r"\\\\")), empty)


def favorites(rows: DataFrame, column: str = "text") -> DataFrame:
    """``name, path`` of all favourites in a column of settings texts."""
    return rows.select(F.explode(parse_favorites(F.col(column))["favorites"]).alias("f")).select("f.name", "f.path")


def dump_favorites(pairs: list[tuple[str, str]]) -> str:
    return json.dumps({"favorites": [{"name": n, "path": p} for n, p in pairs]}, indent=2)
