"""Named surface features: parsing and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import as_col

FOLD = "UNICODE_CI_AI"  # ignores case and accents

def parse_features(docs: DataFrame, text: str = "value") -> DataFrame:
    """Feature collections (one GeoJSON document per row) to one row per named feature.

    Either spelling of a property is accepted; a missing, zero or unreadable diameter is 100 km;
    entries without a name or coordinates are dropped. Features are kept as raw JSON text and
    read by path, because two of the spellings differ only in case.
    """
    f = docs.select(F.explode(F.from_json(text, "features array<string>")["features"]).alias("_f"))

    def prop(*names):
        return F.coalesce(*[F.get_json_object("_f", f"$.properties.{n}") for n in names])

    size = prop("diameter", "diameter_km").try_cast("double")
    at = F.from_json(F.get_json_object("_f", "$.geometry.coordinates"), "array<double>")
    return f.select(
        prop("name", "Name").alias("name"),
        F.coalesce(prop("feature_type", "type"), F.lit("")).alias("kind"),
        F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"),
        F.when((size != 0) & ~F.isnan(size), size).otherwise(F.lit(100.0)).alias("diameter_km"),
        F.size(at).alias("_n")).where(
        (F.col("name") != "") & (F.col("_n") >= 2)).drop("_n")


def match_rank(name, query: str) -> Column:
    """0 for a prefix match, 1 + position for a match inside, NULL for none."""
    at = F.position(F.collate(F.lit(query.strip()), FOLD), F.collate(as_col(name), FOLD))
    return F.when(at > 0, F.when(at == 1, 0).otherwise(at))


def search(features: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """The best `limit` matches: prefix first, then by position, then by name."""
    if not query.strip():
        return features.withColumn("rank", F.lit(0)).where(F.lit(False))
    return (features.withColumn("rank", match_rank("name", query)).where(F.col("rank").isNotNull())
            .orderBy("rank", "name").limit(limit))


def ordered(features: DataFrame, by: str = "name", region: str = "region") -> DataFrame:
    """Features by name, or by region and then name; case and accents do not count, missing regions come last."""
    name = F.collate(F.col("name"), FOLD)
    if by == "name":
        return features.orderBy(name, "name")
    if by == "region":
        return features.orderBy(F.col(region).isNull(), F.collate(F.col(region), FOLD), name, "name")
    raise ValueError(f"unknown order {by!r}")
