"""Point clouds: every format, bounds in the scan, ranges, skipping and unreadable files."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan, StringContains

from fieldloom.sources import clouds

SCALE, SHIFT = (0.01, 0.02, 0.001), (1000.0, 2000.0, -5.0)


def _written(path, kind, points, version=(1, 2), extra=0, compressed=False, cut=0):
    """A file of points (X, Y, Z, intensity, return, returns, class, gps, r, g, b) by the format's published layout."""
    size = clouds.LEAST_BYTES[kind] + extra
    body = b""
    for X, Y, Z, intensity, nth, of, group, gps, *rgb in points:
        if kind < 6:
            row = struct.pack("<iiiHBBbBH", X, Y, Z, intensity, nth | of << 3, group | 0xA0, 0, 0, 1) + (struct.pack("<d", gps) if kind in (1, 3) else b"") + (struct.pack("<3H", *rgb) if kind in (2, 3) else b"")
        else:
            row = struct.pack("<iiiHBBBBhHd", X, Y, Z, intensity, nth | of << 4, 0, group, 0, 0, 1, gps) + (struct.pack("<3H", *rgb) if kind > 6 else b"") + (b"\0\0" if kind == 8 else b"")
        assert len(row) == clouds.LEAST_BYTES[kind]
        body += row + b"\xff" * extra
    head = bytearray(375)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, *version)
    struct.pack_into("<HI", head, 94, 375, 400)
    struct.pack_into("<BHI", head, 104, kind | (0x80 if compressed else 0), size, 0 if version >= (1, 4) else len(points))
    place = [[p[i] * SCALE[i] + SHIFT[i] for p in points] or [0.0] for i in range(3)]
    struct.pack_into("<12d", head, 131, *SCALE, *SHIFT, *(v for axis in place for v in (max(axis), min(axis))))
    if version >= (1, 4):
        struct.pack_into("<Q", head, 247, len(points))
    path.write_bytes((bytes(head) + b"\0" * 25 + body)[: len(head) + 25 + len(body) - cut])


def _points(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(-5000, 5000), rng.randrange(-5000, 5000), rng.randrange(-900, 900), rng.randrange(65536), rng.randrange(1, 6), 5, rng.randrange(19), rng.random(), *(rng.randrange(65536) for _ in range(3))) for _ in range(n)]


def _xy(p):
    return p[0] * SCALE[0] + SHIFT[0], p[1] * SCALE[1] + SHIFT[1]


@pytest.mark.parametrize("kind", sorted(clouds.FORMATS))
def test_formats(spark, tmp_path, kind):
    points = _points(50)
    _written(tmp_path / "a.las", kind, points, (1, 4) if kind >= 6 else (1, 2), extra=kind % 3)
    got = clouds.read(spark, str(tmp_path), records=20).orderBy("position").collect()
    assert [r.position for r in got] == list(range(50)) and {(r.file, r.range) for r in got} == {("a.las", i) for i in range(3)}
    for r, p in zip(got, points):
        assert (r.x, r.y) == _xy(p) and r.z == p[2] * SCALE[2] + SHIFT[2]
        assert (r.intensity, r.return_number, r.returns, r.classification) == p[3:7]
        assert r.gps_time == (p[7] if kind in (1, 3, 6, 7, 8) else None)
        assert (r.r, r.g, r.b) == (p[8:] if kind in (2, 3, 7, 8) else (None, None, None))


def test_bounds_are_tested_before_fields_are_decoded(tmp_path, monkeypatch):
    near, far = _points(3000), [(p[0] - 10**6, *p[1:]) for p in _points(100, 2)]
    _written(tmp_path / "near.las", 3, near)
    _written(tmp_path / "far.las", 3, far)
    reader = clouds.CloudReader(str(tmp_path), clouds.SCHEMA, 1000)
    assert len(reader.partitions()) == 4
    other = StringContains(("file",), "near")
    assert list(reader.pushFilters([GreaterThanOrEqual(("x",), 1010), LessThan(("y",), 1990.0), IsNotNull(("x",)), other])) == [other]
    ranges = reader.partitions()
    assert [r.path.rsplit("/", 1)[-1] for r in ranges] == ["near.las"] * 3
    decoded = []
    inner = clouds._field
    monkeypatch.setattr(clouds, "_field", lambda records, *a: decoded.append(len(records)) or inner(records, *a))
    batches = [b for r in ranges for b in reader.read(r)]
    want = [p for p in near if _xy(p)[0] >= 1010 and _xy(p)[1] < 1990]
    fields = len(clouds.SCHEMA) - 3
    assert sum(b.num_rows for b in batches) == len(want) and sum(decoded) == fields * len(want)


def test_filters_reach_the_scan_and_skipping_counts_what_is_left(spark, tmp_path):
    points = _points(500) + _points(20) * 2
    _written(tmp_path / "a.las", 1, points)
    _written(tmp_path / "b.las", 6, points[::-1], (1, 4))
    _written(tmp_path / "far.las", 0, [(p[0] + 10**6, *p[1:]) for p in points])
    found = clouds.within(clouds.read(spark, str(tmp_path), records=64), (990, 1020), (1950.5, 2030))
    assert {r.file for r in found.select("file").distinct().collect()} == {"a.las", "b.las"}
    assert found.rdd.getNumPartitions() == 2 * -(-540 // 64)
    got = {}
    for r in clouds.sampled(found, 3).orderBy("file", "position").collect():
        got.setdefault(r.file, []).append(r.position)
    for name, rows in (("a.las", points), ("b.las", points[::-1])):
        left = [i for i, p in enumerate(rows) if 990 <= _xy(p)[0] <= 1020 and 1950.5 <= _xy(p)[1] <= 2030]
        assert got[name] == left[::3]
    few = clouds.read(spark, str(tmp_path), columns=["x", "classification"])
    assert few.columns == ["x", "classification"] and few.count() == 3 * 540
    assert clouds.within(clouds.read(spark, str(tmp_path)), (0, 1), (0, 1)).count() == 0


def test_unreadable_files_raise(tmp_path):
    points = _points(5)
    for name, options in {"compressed": {"compressed": True}, "records": {"cut": 1}}.items():
        _written(tmp_path / f"{name}.las", 0, points, **options)
        with pytest.raises(ValueError, match="compressed|shorter"):
            clouds.CloudReader(str(tmp_path / f"{name}.las"), clouds.SCHEMA, 10).partitions()
    _written(tmp_path / "none.las", 0, [])
    (tmp_path / "text.las").write_text("x" * 400)
    for name in ("none", "text"):
        with pytest.raises(ValueError, match="no point"):
            clouds.CloudReader(str(tmp_path / f"{name}.las"), clouds.SCHEMA, 10).partitions()
    (tmp_path / "empty").mkdir()
    assert clouds.CloudReader(str(tmp_path / "empty"), clouds.SCHEMA, 10).partitions() == []
    with pytest.raises(FileNotFoundError):
        clouds.CloudReader(str(tmp_path / "absent"), clouds.SCHEMA, 10).partitions()
