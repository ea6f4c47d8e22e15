"""Evidence authority: what kind of source a row has, whether it stays, and what it keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that may come from independent sources.
INDEPENDENT = ("vegetation", "water", "terrain_detail")
#: Priority of vertical evidence.
PRIORITY = {"planning-explicit": 100, "planning-ffl": 98, "ride-elevation": 98, "water-level": 98, "terrain-level": 96, "feature-explicit": 90, "lidar-ground": 70, "terrain-sampler": 65, "derived-height": 55}
#: Ranks of evidence from none to the maker's drawings.
EVIDENCE_RANK = {"none": 0, "inferred": 1, "interpolated": 2, "lidar-derived": 3, "measured-lidar": 4, "planning-verified": 5, "surveyed": 6, "manufacturer-cad": 7}


def lookup(column: Column, table: dict[str, int], default: int = 0) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column], F.lit(default))


def derivation(provider: Column, id: Column, upstream: Column) -> Column:
    """From which open map a row stems, by provider or id, else by the text of its upstream sources; null if from none."""
    provider, id, upstream = (F.coalesce(F.lower(c), F.lit("")) for c in (provider, id, upstream))
    return (
        F.when(provider.contains("openstreetmap") | id.startswith("osm:"), "openstreetmap").when(provider.contains("overture") | id.startswith("overture:"), "overture")
        .when(upstream.contains("openstreetmap") | upstream.contains('"osm"'), "other-osm-derived")
    )


def map_derived(provider: Column, id: Column, upstream: Column) -> Column:
    return derivation(provider, id, upstream).isNotNull()


def disposition(excluded: Column, derived: Column, planning: Column, outlier: Column, kind: Column) -> Column:
    """The first that applies: excluded, map-derived, outlier reason of planning rows, planning, independent, dropped."""
    return (
        F.when(F.coalesce(excluded, F.lit(False)), "excluded").when(F.coalesce(derived, F.lit(False)), "map-derived").when(F.coalesce(planning, F.lit(False)) & outlier.isNotNull(), F.concat(F.lit("outlier:"), outlier))
        .when(F.coalesce(planning, F.lit(False)), "planning").when(kind.isin(*INDEPENDENT), "independent").otherwise("not-planning")
    )


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("disposition").isin("planning", "independent"))


def scrubbed(vertical: Column) -> Column:
    """struct<height, height_source, height_confidence, elevation, elevation_source> without what was taken over from the open map."""
    source = F.coalesce(F.lower(vertical["height_source"]), F.lit(""))
    height_out = source.contains("osm") | source.contains("retained-during-planning-override")
    elevation_out = F.coalesce(F.lower(vertical["elevation_source"]).contains("osm"), F.lit(False))
    keep = lambda c, out: F.when(~out, vertical[c]).alias(c)
    return F.struct(*(keep(c, height_out) for c in ("height", "height_source", "height_confidence")), *(keep(c, elevation_out) for c in ("elevation", "elevation_source")))


def construction_fence(semantic: Column, barrier: Column, state: Column, temporary: Column, colour: Column) -> Column:
    """Construction fences: named so, or temporary red ones."""
    semantic, state, colour = (F.coalesce(F.lower(c), F.lit("")) for c in (semantic, state, colour))
    fence = semantic.contains("fence") | F.coalesce(barrier == "fence", F.lit(False))
    red = colour.contains("red") | colour.isin("#ff0000", "#f00")
    return semantic.contains("construction-fence") | ((state.contains("temporary") | F.coalesce(temporary, F.lit(False))) & fence & red)


def planning_world(provider: Column, dataset: Column, adapter: Column, policy: Column, flagged: Column, named: Column) -> Column:
    """Whether a row is planning evidence for the world: by a source's name, a merge policy, a flag, or a planning tag (named: the first of them)."""
    has = lambda c: F.coalesce(F.lower(c).contains("planning"), F.lit(False))
    return has(provider) | has(adapter) | has(dataset) | F.coalesce(F.lower(policy).startswith("planning-"), F.lit(False)) | F.coalesce(flagged, F.lit(False)) | (F.coalesce(named, F.lit("")) != "")


def planning_graph(provider: Column, dataset: Column, authoritative: Column, named: Column) -> Column:
    """The narrower predicate of the graph: no adapter, policy or authority flag."""
    has = lambda c: F.coalesce(F.lower(c).contains("planning"), F.lit(False))
    return has(provider) | has(dataset) | F.coalesce(authoritative, F.lit(False)) | (F.coalesce(named, F.lit("")) != "")


def attribution(stated: Column, tagged: Column, planning: Column) -> Column:
    """Whose word counts for a geometry or an attribute."""
    return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(tagged, F.lit("")), F.when(planning, "planning-data").otherwise("independent-evidence"))


def merge_evidence(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct evidence (property, value, source) of each key in order of first appearance."""
    first = rows.groupBy(key, "property", "value", "source").agg(F.min(order).alias(order))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "property", "value", "source"))), lambda e: F.struct(e.property, e["value"], e.source)).alias("evidence"))
