"""Kinds of mapped features from their tags: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the tag rules.
TREES = ("tree", "tree_row", "wood", "scrub", "shrub", "bush")
PLANTED = ("forest", "orchard", "vineyard", "plant_nursery")
COVERED = ("trees", "tree_cover", "shrubs", "scrub")
ROCKS = ("rock", "stone", "boulder", "cliff")
OUTCROPS = ("outcrop", "boulder")
#: Values of area:highway, and of highway, that are paths and not roads.
PEDESTRIAN_AREAS = ("footway", "path", "pedestrian", "steps", "corridor", "cycleway")
PEDESTRIAN_WAYS = ("footway", "path", "pedestrian", "steps", "corridor", "cycleway", "bridleway")
#: Tags that make a closed way an area.
AREA_TAGS = ("building", "landuse", "leisure", "natural", "attraction", "water", "amenity", "man_made", "area:highway")
#: Access tags that keep guests out.
CLOSED_ACCESS = ("private", "no", "permit", "delivery", "agricultural", "forestry")
#: Colour names.
COLOUR_NAMES = {
    "black": "#202124", "charcoal": "#343434", "grey": "#808080", "gray": "#808080", "dark grey": "#4b4b4b", "dark gray": "#4b4b4b", "light grey": "#c5c5c5", "light gray": "#c5c5c5",
    "white": "#f2f2f2", "red": "#a63d32", "brick": "#9b4b3f", "brown": "#765341", "buff": "#c8ad7f", "beige": "#c9b99a", "tan": "#b89363", "yellow": "#d5b53f", "orange": "#c87832", "blue": "#416b9b", "green": "#5f7f4a",
}


def tag(tags: Column, name: str) -> Column:
    """A tag's value; null for an empty one."""
    return F.nullif(tags[name], F.lit(""))


def _listed(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("yes", "true", "1", "designated"), F.lit(False))


def classified(tags: Column) -> Column:
    """Kind and subtype of a feature by an ordered cascade over its tags; null where no rule fits."""
    get = lambda k: tag(tags, k)
    has = lambda *ks: F.coalesce(*map(get, ks)).isNotNull()
    among = lambda k, values: get(k).isin(*values)
    first = lambda *ks: F.coalesce(*map(get, ks))
    said = lambda k: F.concat(F.lit(f"{k}:"), get(k))
    area_way = F.lower(get("area:highway"))
    rules = [
        ("park_boundary", get("tourism") == "theme_park", F.lit("theme_park")),
        ("ride_track", get("roller_coaster") == "track", F.coalesce(get("roller_coaster:track"), F.lit("coaster"))),
        ("ride_support", get("roller_coaster") == "support", F.lit("support")),
        ("ride_attachment", (get("man_made") == "ride_attachment") | has("ride_attachment"), F.coalesce(get("ride_attachment"), F.lit("ride-attachment"))),
        ("building", get("roller_coaster") == "station", F.lit("coaster_station")),
        ("building", has("building"), get("building")),
        ("attraction", has("attraction"), get("attraction")),
        ("vegetation", get("barrier") == "hedge", F.lit("hedge")),
        ("vegetation", among("natural", TREES), get("natural")),
        ("vegetation", among("landuse", PLANTED), get("landuse")),
        ("vegetation", among("landcover", COVERED), get("landcover")),
        ("terrain_detail", among("natural", ROCKS), get("natural")),
        ("terrain_detail", among("geological", OUTCROPS), get("geological")),
        ("path", area_way.isin(*PEDESTRIAN_AREAS), F.concat(F.lit("area:"), area_way)),
        ("road", has("area:highway"), F.concat(F.lit("area:"), area_way)),
        ("path", among("highway", PEDESTRIAN_WAYS), get("highway")),
        ("road", has("highway"), get("highway")),
        ("water", (get("natural") == "water") | has("water") | has("waterway") | (get("leisure") == "swimming_pool"), first("water", "waterway", "natural", "leisure")),
        ("rail", has("railway"), get("railway")),
        ("barrier", has("barrier"), get("barrier")),
        ("surface", has("landuse", "landcover", "natural", "leisure"), first("landuse", "landcover", "natural", "leisure")),
        ("structure", has("man_made"), get("man_made")),
        ("amenity", has("amenity"), get("amenity")),
        ("amenity", has("shop"), said("shop")),
        ("detail", has("entrance", "door"), F.coalesce(said("entrance"), said("door"))),
        ("detail", has("historic"), said("historic")),
        ("detail", has("information"), said("information")),
        ("detail", has("playground"), said("playground")),
        ("detail", has("public_transport"), said("public_transport")),
        ("amenity", has("tourism"), said("tourism")),
    ]
    out = F.lit(None).cast("struct<kind:string,subtype:string>")
    for name, rule, subtype in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("kind"), subtype.alias("subtype"))).otherwise(out)
    return out


def kind(tags: Column) -> Column:
    return classified(tags)["kind"]


def is_area(tags: Column, closed: Column) -> Column:
    """A closed way with area=yes, a theme park or another tag of areas; area=no rules it out."""
    named = F.coalesce(tags["area"] == "yes", F.lit(False)) | F.coalesce(tags["tourism"] == "theme_park", F.lit(False))
    return F.coalesce(closed, F.lit(False)) & (F.coalesce(tags["area"], F.lit("")) != "no") & (named | F.coalesce(*(tag(tags, k) for k in AREA_TAGS)).isNotNull())


def path_role(tags: Column, kind: Column | None = None) -> Column:
    """Queue, then service, then guest."""
    low = lambda k: F.coalesce(F.lower(tag(tags, k)), F.lit(""))
    way = F.coalesce(F.nullif(low("highway"), F.lit("")), low("area:highway"))
    queue = _listed(tags["queue"]) | _listed(tags["queue:line"])
    for k in ("footway", "attraction", "amenity"):
        queue = queue | F.coalesce(tags[k] == "queue", F.lit(False))
    queue = queue | (way == "queue") | ((low("access") == "customers") & low("name").rlike("queue|entrance line"))
    closed = low("access").isin(*CLOSED_ACCESS) | low("foot").isin("private", "no") | low("motor_vehicle").isin("private", "no")
    service = way.isin("service", "track") | (low("service") != "") | _listed(tags["backstage"]) | _listed(tags["staff"]) | _listed(tags["staff_only"])
    road = F.lit(False) if kind is None else F.coalesce(kind == "road", F.lit(False)) & ~way.isin("pedestrian", "living_street")
    return F.when(queue, "queue").when(closed | service | road, "service").otherwise("guest")


def bridge(tags: Column) -> Column:
    """A bridge tag that is not no, or a bridge by man_made or as a via ferrata."""
    value = F.lower(tag(tags, "bridge"))
    return F.coalesce(value != "no", F.lit(False)) | F.coalesce(tags["man_made"] == "bridge", F.lit(False)) | F.coalesce(tags["highway"] == "via_ferrata", F.lit(False))


def tunnel(tags: Column) -> Column:
    """A tunnel tag that is not denied, or a location under the ground."""
    return F.coalesce(~F.lower(tag(tags, "tunnel")).isin("no", "false", "0"), F.lit(False)) | F.coalesce(F.lower(tags["location"]) == "underground", F.lit(False))


def colour(text: Column) -> Column:
    """[#]rgb, [#]rrggbb, rgb(r, g, b) and names as struct<r,g,b>; null for others."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[_-]+", " ")
    named = F.coalesce(F.create_map(*(F.lit(x) for p in COLOUR_NAMES.items() for x in p))[t], t)
    hexed = F.regexp_replace(F.regexp_replace(named, "^#", ""), "^([0-9a-f])([0-9a-f])([0-9a-f])$", "$1$1$2$2$3$3")
    byte = lambda i: F.conv(F.substring(hexed, 2 * i - 1, 2), 16, 10).cast("int")
    part = lambda i: F.regexp_extract(t, r"^rgb\s*\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$", i).try_cast("int")
    rgb = lambda f: F.struct(*(f(i).alias(c) for i, c in enumerate("rgb", 1)))
    return F.when(hexed.rlike("^[0-9a-f]{6}$"), rgb(byte)).when(part(1).isNotNull() & (F.greatest(part(1), part(2), part(3)) <= 255), rgb(part))


def block_spec(text: Column) -> Column:
    """'name[k=v,...]' as struct<name, states>."""
    states = F.regexp_extract(text, r"\[(.*)\]$", 1)
    return F.struct(F.regexp_extract(text, r"^([^\[]+)", 1).alias("name"), F.when(states != "", F.str_to_map(states, F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>")).alias("states"))


def attributes(tag: Column) -> Column:
    """The attributes of an XML tag, names in lower case; the last of equals counts."""
    pattern = r'([\w:-]+)\s*=\s*"([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(F.lower(tag), F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(tag, F.lit(pattern), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q.k == p.k))
    return F.map_from_entries(last)
