"""Schemas of the catalogue, in DDL."""

from __future__ import annotations

from dataclasses import dataclass

FILE_INFO = (
    "path string, name string, size long, dimensions struct<width:int,height:int>, modified timestamp, is_dir boolean, phash string"
)
IMAGE_METADATA = "name string, path string, dimensions struct<width:int,height:int>, size_bytes long, modified timestamp, format string"
IMAGE_FEATURE = (
    "path string, time double, l double, a double, b double, aspect_ratio double, phash_bits long, dominant_colors array<array<double>>"
)
IMAGES = "id long, path string, size long, modified long, exif_json string, phash string"
TAGS = "id long, name string"
IMAGE_TAGS = "image_id long, tag_id long"
COLLECTIONS = "id long, name string, created_at long"
COLLECTION_MEMBERS = "collection_id long, image_id long"
FAVORITES = "favorites array<struct<name:string,path:string>>"
REPORT = (
    "`Dataset Name` string, `Image Count` long, `Heterogeneity Rate` double, Algorithm string, `Time (ms)` long, `Peak Mem (MB)` double, "
    "`Cluster Count` long, `Silhouette Score` double"
)
AUDIT = "name string, success boolean, message string, status string, timestamp timestamp"

#: Columns of an analytic row.
FEATURE_COLUMNS = ("path", "time", "l", "a", "b", "aspect_ratio", "phash_bits", "dominant_colors")
#: Names of the five normalised dimensions, in order.
DIMENSIONS = ("time", "l", "a", "b", "aspect_ratio")


@dataclass(frozen=True)
class GroupConfig:
    """Settings of grouping; the defaults are those of the reference's form."""

    weight_time: float = 0.1
    weight_color: float = 0.2
    weight_name: float = 0.1
    eps: float = 0.6
    min_samples: int = 5
    std_floor: float = 1e-9

    @property
    def phash_weight(self) -> float:
        return self.eps * 0.4 * max(self.weight_name, 0.1)

    @property
    def palette_weight(self) -> float:
        return self.eps * 0.6 * max(self.weight_color, 0.1)

    @property
    def weights(self) -> tuple[float, ...]:
        return (self.weight_time, self.weight_color, self.weight_color, self.weight_color, 0.2)


#: Settings of the published benchmark.
BENCHMARK = GroupConfig(weight_time=1.0, weight_color=1.0, weight_name=0.0, eps=1.5, min_samples=4)
