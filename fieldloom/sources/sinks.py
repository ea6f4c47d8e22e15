"""Sinks: GeoJSON features, compact records without empty fields, Markdown tables, SVG paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature(id: Column, shape: Column, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as text; coordinates are JSON text, properties a struct or map."""
    return F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct(id.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(id.alias("v")))) - 6), F.lit(',"geometry":{"type":"'), shape, F.lit('","coordinates":'), coordinates, F.lit('},"properties":'), F.coalesce(F.to_json(properties), F.lit("{}")), F.lit("}"))


def write_features(features: DataFrame, path: str, order: list[str]) -> None:
    """Features as JSON lines, sorted within and across files."""
    features.repartitionByRange(*order).sortWithinPartitions(*order).select("feature").write.mode("overwrite").text(path)


def compact(rows: DataFrame) -> DataFrame:
    """Each row as JSON without null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def markdown_line(*columns: Column) -> Column:
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))


def svg_path(ring: Column) -> Column:
    """A closed path with two decimals."""
    point = lambda p: F.concat(F.format_number(p.x, "0.00"), F.lit(" "), F.format_number(p.z, "0.00"))
    return F.concat(F.lit("M"), F.array_join(F.transform(ring, point), " L"), F.lit(" Z"))
