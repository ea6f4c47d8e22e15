"""Nodes of the reconstruction graph: their type, and what is known of their height, material, state and trust."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.geometry import EARTH_M
from fieldloom.functions.kinds import tag
from fieldloom.functions.numbers import half_up, number_or_null, truthy_unless_denied

#: Kinds whose type has the same name, with hyphens.
SAME = ("ride_track", "ride_support", "ride_attachment", "building", "water", "vegetation", "barrier", "structure", "terrain_detail", "surface", "attraction", "rail", "amenity")


def node_type(kind: Column, subtype: Column, tags: Column) -> Column:
    """The type of a feature's node; null for boundaries and unknown kinds."""
    sub = F.coalesce(F.lower(subtype), F.lit(""))
    bridge = truthy_unless_denied(tags["bridge"]) | sub.contains("bridge") | sub.contains("boardwalk")
    tunnel = truthy_unless_denied(tags["tunnel"]) | sub.contains("tunnel") | sub.contains("underpass")
    return (
        F.when(kind.isin("path", "road"), F.when(bridge, "bridge").when(tunnel, "tunnel").otherwise(kind))
        .when(kind == "detail", F.when(F.lower(tags["man_made"]) == "support", "ride-support").otherwise("detail"))
        .when(kind.isin(*SAME), F.regexp_replace(kind, "_", "-"))
    )


def vertical(ground: Column, ground_source: Column, stated: Column, least: Column, height: Column, tags: Column) -> Column:
    """struct of ground, base, top and the evidence for them: a stated elevation comes before the ground, nothing is made up."""
    base = F.coalesce(stated, ground)
    record = lambda name, value, source: F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value.cast("string"), F.lit("@"), source))
    evidence = [
        record("ground", half_up(ground, 3), F.coalesce(ground_source, F.lit("terrain"))), record("elevation", stated, F.lit("feature-elevation")), record("height", height, F.lit("feature-height")),
        record("floor", number_or_null(tags["ffl_m"]), F.lit("planning-ffl")), record("planned", number_or_null(tags["elevation_m"]), F.lit("planning-elevation")),
    ]
    relation = F.coalesce(tag(tags, "planning_vertical_relationship"), F.when(truthy_unless_denied(tags["bridge"]), "bridge").when(truthy_unless_denied(tags["tunnel"]), "tunnel").otherwise("ground-associated"))
    return F.struct(
        half_up(ground, 3).alias("ground"), half_up(base, 3).alias("base"), half_up(base + F.coalesce(least, F.lit(0.0)) + height, 3).alias("top"),
        relation.alias("relation"), F.array_compact(F.array(*evidence)).alias("evidence"),
    )


def material(tags: Column, fused: Column, observed: Column) -> Column:
    """struct<resolved, evidence>: the first material that is known, and all of them with their sources."""
    known = [(tag(tags, "surface"), "planning-or-feature-surface"), (tag(tags, "material"), "planning-or-feature-material"), (tag(tags, "roof_material"), "roof-material"), (fused, "fidelity-fusion"), (observed, "orthophoto-evidence")]
    known = [(F.nullif(v, F.lit("")), s) for v, s in known]
    evidence = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(v, F.lit(f"@{s}"))) for v, s in known)))
    return F.struct(F.coalesce(*(v for v, _ in known)).alias("resolved"), evidence.alias("evidence"))


def lifecycle(tags: Column) -> Column:
    return F.lower(F.coalesce(*(tag(tags, k) for k in ("planning_feature_state", "feature_state", "state")), F.lit("unspecified")))


def trust(*values: Column) -> Column:
    """The least confidence that is known; null without any."""
    return half_up(F.array_min(F.array_compact(F.array(*values))), 3)


def vertex_mean(points: Column) -> Column:
    """Mean of a geometry's vertices, each counted as often as it is listed; three decimals."""
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("z")), lambda s, p: F.struct((s.x + p.x).alias("x"), (s.z + p.z).alias("z")))
    n = F.nullif(F.size(points), F.lit(0))
    return F.struct(half_up(total.x / n, 3).alias("x"), half_up(total.z / n, 3).alias("z"))


def dimension(geometry: Column) -> Column:
    return F.when(geometry.isin("Point", "MultiPoint"), 0).when(geometry.isin("LineString", "MultiLineString"), 1).when(geometry.isin("Polygon", "MultiPolygon"), 2)


def bbox(text: Column) -> Column:
    """'south,west,north,east' as a struct with centre and area in square kilometres; null unless the four are in order."""
    v = F.transform(F.split(text, ","), lambda x: number_or_null(F.trim(x)))
    s, w, n, e = (F.get(v, i) for i in range(4))
    ok = (F.size(v) == 4) & (w < e) & (s < n) & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90)
    lat = (s + n) / 2
    metre = math.pi / 180 * EARTH_M
    area = (e - w) * metre * F.cos(F.radians(lat)) * ((n - s) * metre) / 1e6
    return F.when(ok, F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east"), lat.alias("lat"), ((w + e) / 2).alias("lon"), area.alias("km2")))
