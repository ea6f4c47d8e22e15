"""Tag cascades, colours, block specifications, drawings and archives."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import kinds
from fieldloom.operators import relations
from fieldloom.sources import drawings


@pytest.mark.parametrize(
    ("tags", "kind"),
    [
        ({"tourism": "theme_park", "building": "yes"}, "park_boundary"), ({"roller_coaster": "track", "railway": "x"}, "ride_track"), ({"roller_coaster": "station"}, "building"), ({"barrier": "hedge"}, "vegetation"),
        ({"barrier": "fence"}, "barrier"), ({"natural": "cliff"}, "terrain_detail"), ({"natural": "beach"}, "surface"), ({"highway": "bridleway"}, "path"), ({"highway": "service"}, "road"), ({"leisure": "swimming_pool"}, "water"), ({"x": "y"}, None), ({}, None),
    ],
)
def test_kind(spark, tags, kind):
    rows = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert rows.select(kinds.kind(F.col("tags")).alias("k")).first().k == kind


def test_colours(spark):
    rows = spark.createDataFrame([("#F00",), ("#0a0B0c",), ("rgb(1, 2, 255)",), ("rgb(1,2,256)",), ("Grey",), ("nothing",), (None,)], "t string")
    got = [tuple(r.c) if r.c else None for r in rows.select(kinds.colour(F.col("t")).alias("c")).collect()]
    assert got == [(255, 0, 0), (10, 11, 12), (1, 2, 255), None, (128, 128, 128), None, None]


def test_block_spec_and_attributes(spark):
    rows = spark.createDataFrame([("oak[axis=x,lit=true]", '<line X1="3" y1="4" x1="5"/>'), ("stone", "<a/>")], "b string, t string")
    got = rows.select(kinds.block_spec(F.col("b")).alias("b"), kinds.attributes(F.col("t")).alias("a")).collect()
    assert got[0].b.name == "oak" and got[0].b.states == {"axis": "x", "lit": "true"} and got[1].b.states == {}
    assert got[0].a == {"x1": "5", "y1": "4"} and got[1].a == {}


def test_roles_and_structures(spark):
    rows = spark.createDataFrame([({"name": "Main queue"},), ({"access": "customers", "name": "Main queue"},), ({"access": "private"},), ({"bridge": "viaduct", "tunnel": "no"},), ({"location": "underground"},)], "t map<string,string>")
    got = rows.select(kinds.path_role(F.col("t")).alias("r"), kinds.bridge(F.col("t")).alias("b"), kinds.tunnel(F.col("t")).alias("u")).collect()
    assert [r.r for r in got] == ["guest", "queue", "service", "guest", "guest"] and [r.b for r in got] == [False, False, False, True, False] and [r.u for r in got] == [False, False, False, False, True]


def test_subtypes_and_areas(spark):
    tags = [{"highway": "track"}, {"highway": "crossing"}, {"area:highway": "Footway"}, {"shop": "gift"}, {"natural": "", "amenity": "toilets"}, {"tourism": "hotel"}]
    rows = spark.createDataFrame([(t,) for t in tags], "t map<string,string>")
    got = [tuple(r.c) for r in rows.select(kinds.classified(F.col("t")).alias("c")).collect()]
    assert got == [("road", "track"), ("road", "crossing"), ("path", "area:footway"), ("amenity", "shop:gift"), ("amenity", "toilets"), ("amenity", "tourism:hotel")]
    areas = [r.a for r in rows.select(kinds.is_area(F.col("t"), F.lit(True)).alias("a")).collect()]
    assert areas == [False, False, True, False, True, False]


def test_relations_empty(spark):
    none = spark.createDataFrame([], "id long, type string, min_x double, min_z double, max_x double, max_z double, base double, confidence double")
    assert relations.inferred(none).count() == 0


def test_prominent_maxima(spark):
    cells = [(x, z, 5.0 if (x, z) != (4, 4) else 9.0) for x in range(9) for z in range(9)]
    got = relations.prominent_maxima(spark.createDataFrame(cells, "x long, z long, h double"), "h", 2.0).collect()
    assert [(r.x, r.z, r.prominence) for r in got] == [(4, 4, 4.0)]


def test_svg(spark):
    svg = '<svg><polygon points="0,0 4,0 4,3.5"/><line x1="1" y1="2" x2="-3" y2="4" stroke="red"/></svg>'
    got = drawings.svg_shapes(spark.createDataFrame([(1, svg), (2, None), (3, "")], "id int, svg string"), "id", "svg").orderBy("closed").collect()
    assert [(r.id, r.closed, [tuple(p) for p in r.points]) for r in got] == [(1, False, [(1.0, 2.0), (-3.0, 4.0)]), (1, True, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.5)])]


def test_recognised_and_page_lines(spark):
    words = [(1, 1, 1, 1, 1, 2, "B", 20, 5, 10, 10, 90.0), (1, 1, 1, 1, 1, 1, "A", 5, 6, 10, 10, 80.0), (1, 1, 1, 1, 1, 3, "noise", 40, 5, 9, 9, 10.0)]
    got = drawings.recognised_lines(spark.createDataFrame(words, "id int, page int, block int, par int, line int, word int, text string, left int, top int, width int, height int, conf double"), "id").collect()
    assert [(r.text, r.x_min, r.x_max, r.y_max, r.confidence) for r in got] == [("A B", 5, 30, 16, 0.9)]
    xml = '<line xMin="1" yMin="2" xMax="3.5" yMax="4"><word a="b">Site</word><word>plan</word></line>'
    got = drawings.page_lines(spark.createDataFrame([(1, xml)], "id int, xml string"), "id", "xml").collect()
    assert [(r.text, r.x_max) for r in got] == [("Site plan", 3.5)]


def test_dxf(spark):
    body = "\n".join(["0", "SECTION", "2", "ENTITIES", "0", "LINE", "8", "walls", "10", "1", "20", "2", "11", "3", "21", "4", "0", "TEXT", "8", "notes", "10", "5", "20", "6", "1", "Hall", "0", "LWPOLYLINE", "8", "roof", "70", "1", "10", "0", "20", "0", "10", "2", "20", "0", "10", "2", "20", "2", "0", "ENDSEC", "0", "EOF"])
    got = drawings.dxf(spark.createDataFrame([(1, body), (2, None)], "id int, content string"), "id", "content").orderBy("seq").collect()
    assert [(r.entity, r.layer, r.text, r.closed, len(r.points)) for r in got] == [("LINE", "walls", None, False, 2), ("TEXT", "notes", "Hall", False, 1), ("LWPOLYLINE", "roof", None, True, 3)]


def test_archives():
    def packed(*names):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return raw.getvalue()

    assert list(drawings.archive_members(packed("a/b.txt", "c.txt"))) == [("a/b.txt", b"x"), ("c.txt", b"x")]
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError, match="unsafe"):
            list(drawings.archive_members(packed(bad)))
