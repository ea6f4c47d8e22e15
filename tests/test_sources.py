"""Readers, sinks, paged sources, authority and streaming on small inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.operators import authority, features
from fieldloom.sources import paged, readers, sinks
from fieldloom.streaming import events


def test_map_snapshot(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lat": 51.0, "lon": 0.5, "tags": {"entrance": "main"}}, {"type": "way", "id": 2, "geometry": [{"lat": 51.2, "lon": 0.1}, {"lat": 50.9, "lon": 0.7}]}, {"type": "relation", "id": 3, "members": [{"type": "way", "ref": 2, "role": "outer", "geometry": [{"lat": 52.0, "lon": 0.3}]}]}]
    (tmp_path / "m.json").write_text(json.dumps({"version": 0.6, "elements": elements}, indent=1))
    rows = readers.map_snapshot(spark, str(tmp_path / "m.json"))
    assert [r.id for r in rows.orderBy("seq").collect()] == [1, 2, 3]
    b = readers.snapshot_bounds(rows).first()
    assert [round(x, 4) for x in b] == [50.8999, 0.0999, 52.0001, 0.7001]


def test_geojson(spark, tmp_path):
    shapes = [("Point", [1, 2]), ("LineString", [[1, 2], [3, 4]]), ("Polygon", [[[0, 0], [1, 0], [1, 1]]]), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]])]
    whole = {"type": "FeatureCollection", "source": {"name": "s"}, "features": [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"id": k, "width": "3"}} for k, c in shapes]}
    (tmp_path / "g.json").write_text(json.dumps(whole))
    rows = readers.geojson(spark, str(tmp_path / "g.json"))
    got = {r.id: r.v for r in rows.select("id", readers.vertices(F.col("shape"), F.col("coordinates")).alias("v")).collect()}
    assert got["Point"] == [[[[1.0, 2.0]]]] and got["LineString"] == [[[[1.0, 2.0], [3.0, 4.0]]]] and len(got["MultiPolygon"]) == 2
    (tmp_path / "bad.json").write_text(json.dumps({"type": "Feature"}))
    with pytest.raises(PySparkException):
        readers.geojson(spark, str(tmp_path / "bad.json")).collect()


def test_manifest(spark, tmp_path):
    docs = [{"id": "a", "applicationReference": "1", "role": "plan", "worldEligible": True}, {"id": "a", "applicationReference": "2", "role": "plan"}, {"id": "b", "role": "plan"}]
    (tmp_path / "m.json").write_text(json.dumps({"schemaVersion": 1, "id": "m", "parkId": "p", "documents": docs}))
    found = readers.manifest_problems(readers.manifest(spark, str(tmp_path / "m.json"))).collect()
    assert sorted(tuple(r) for r in found) == [("missing field", "b"), ("no basis", "a"), ("repeated id", "a")]


def test_point_list_and_csv(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"crs": "EPSG:27700", "points": [[1, 2, 3, 6, 40], [4, 5]]}))
    assert [tuple(r) for r in readers.point_list(spark, str(tmp_path / "p.json")).orderBy("seq").collect()] == [(0, 1.0, 2.0, 3.0, 6, 40), (1, 4.0, 5.0, None, None, None)]
    (tmp_path / "t.csv").write_text('"Site Name",Height (m)\n"A ""big"" one",3\n,\n')
    got = readers.delimited(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["sitename", "heightm"] and [tuple(r) for r in got.collect()] == [('A "big" one', "3")]


def test_feature_lines(spark, tmp_path):
    lines = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"height": 3.0, "confidence": c}} for c in (0.9, 0.5, None, -1)]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert readers.feature_lines(spark, str(tmp_path / "f.jsonl")).count() == 3


def test_limits(spark):
    rows = spark.range(5)
    assert readers.within_limit(rows, 5, "rows") is rows
    with pytest.raises(ValueError, match="more than 4 rows"):
        readers.within_limit(rows, 4, "rows")


def test_paged_source(spark):
    def fetch(page):
        return [(page * 2 + i, f"r{page}") for i in range(2)], page < 6

    kind = paged.source("numbered", "id int, name string", fetch, most_pages=20, lanes=3)
    got = sorted(r.id for r in paged.read(spark, kind).collect())
    assert set(range(14)) <= set(got) and len(got) == len(set(got))
    assert paged.with_retries(iter([1]).__next__) == 1
    with pytest.raises(OSError):
        paged.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), retries=1, first_wait=0.0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'b "x"', None), (1, "a|c", 5)], "n int, name string, v int")
    made = rows.select("n", sinks.feature(F.col("name"), F.lit("Point"), F.lit("[1,2]"), F.struct("n", "v")).alias("feature"))
    sinks.write_features(made, str(tmp_path / "out"), ["n"])
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {g["id"] for g in got} == {'b "x"', "a|c"} and all(g["geometry"]["coordinates"] == [1, 2] for g in got)
    assert sorted(r.value for r in sinks.compact(rows).collect()) == ['{"n":1,"name":"a|c","v":5}', '{"n":2,"name":"b \\"x\\""}']
    assert rows.select(sinks.markdown_line(F.col("name"), F.col("v")).alias("l")).orderBy("l").first().l == "| a\\|c | 5 |"


def test_authority_order(spark):
    rows = spark.createDataFrame([(True, True, True, "x", "water"), (False, True, True, "x", "water"), (None, None, True, "x", "water"), (False, False, True, None, "path"), (False, False, False, None, "water"), (False, False, None, None, "path")], "e boolean, d boolean, p boolean, o string, k string")
    got = [r.v for r in rows.select(authority.disposition(*(F.col(c) for c in "edpok")).alias("v")).collect()]
    assert got == ["excluded", "map-derived", "outlier:x", "planning", "independent", "not-planning"]


def test_construction_fence(spark):
    rows = spark.createDataFrame([("fence", "fence", "temporary works", None, "Dark red"), ("fence", None, "permanent", None, "red"), ("x construction-fence", None, None, None, None), (None, "fence", None, True, "#f00"), (None, None, None, None, None)], "s string, b string, t string, f boolean, c string")
    assert [r.v for r in rows.select(authority.construction_fence(*(F.col(c) for c in "sbtfc")).alias("v")).collect()] == [True, False, True, True, False]


def test_wrapped(spark):
    rows = spark.createDataFrame([("a bb ccc",), ("abcdefghij",), ("",), (None,), ("a b c d e f g h i j",)], "t string")
    got = [r.w for r in rows.select(features.wrapped(F.col("t"), 4, 2).alias("w")).collect()]
    assert got[0] == ["a bb", "ccc"] and got[1][0] == "abcd" and got[1][1].endswith("…") and got[3] is None and len(got[4]) == 2


def test_streams(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    stream = lambda: events.event_stream(spark, str(tmp_path / "in"), source.schema)
    assert run(events.first_of_each(stream(), late="3650 days"), "firsts", "append").count() == source.count()
    assert run(events.tumbling(stream(), late="3650 days"), "tumbles", "complete").agg(F.sum("n")).first()[0] == source.count()
    assert run(events.sessions(stream(), late="3650 days"), "sessions", "complete").agg(F.sum("n")).first()[0] == source.count()
    state = run(events.breaker(stream().withColumn("bad", F.col("event_type") == "error"), "user_id", "bad"), "breaker", "update")
    assert state.count() >= source.select("user_id").distinct().count()
