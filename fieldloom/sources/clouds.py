"""A batch data source over point clouds in LAS files (point formats 0 to 3 and 6 to 8).

The driver reads headers only and plans one partition for a range of records; executors read their own byte range, in pieces of bounded size. Filters
on x and y are pushed down: files whose bounds lie outside are not planned, and records outside are dropped by their two coordinates, before any other
field of them is decoded. `columns` prunes fields.

Defined results: a file without records, a truncated one, a compressed one (LAZ) and one of another format raise; an empty folder gives no rows; equal points stay.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: Fixed values of the format: offsets of fields in the header, and where the fields of each point format lie.
SIGNATURE, HEADER_BYTES = b"LASF", 375
HEADER = {"version": "<24xBB", "data": "<96xI", "format": "<104xBH", "count": "<107xI", "scale": "<131x3d", "shift": "<155x3d", "bounds": "<179x6d", "long_count": "<247xQ"}
OLD = {"returns": ("u1", 14), "classification": ("u1", 15)}
NEW = {"returns": ("u1", 14), "classification": ("u1", 16), "gps_time": ("<f8", 22)}
RGB = lambda at: {c: ("<u2", at + 2 * i) for i, c in enumerate(("r", "g", "b"))}
COMMON = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "intensity": ("<u2", 12)}
FORMATS = {0: OLD, 1: {**OLD, "gps_time": ("<f8", 20)}, 2: {**OLD, **RGB(20)}, 3: {**OLD, "gps_time": ("<f8", 20), **RGB(28)}, 6: NEW, 7: {**NEW, **RGB(30)}, 8: {**NEW, **RGB(30)}}
LEAST_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}
#: Columns and their types; fields that a format lacks are null.
SCHEMA = StructType([
    StructField("file", StringType()), StructField("range", IntegerType()), StructField("position", LongType()),
    *(StructField(c, DoubleType()) for c in ("x", "y", "z")), *(StructField(c, IntegerType()) for c in ("intensity", "return_number", "returns", "classification")),
    StructField("gps_time", DoubleType()), *(StructField(c, IntegerType()) for c in ("r", "g", "b")),
])
ARROW = {DoubleType(): pa.float64(), IntegerType(): pa.int32(), LongType(): pa.int64(), StringType(): pa.string()}
RECORDS, PIECE = 1 << 20, 1 << 16


@dataclass
class Cloud:
    """What a header says."""

    data: int
    format: int
    size: int
    count: int
    scale: tuple[float, ...]
    shift: tuple[float, ...]
    bounds: dict[str, tuple[float, float]]


@dataclass
class Range(InputPartition):
    path: str
    number: int
    first: int
    count: int
    cloud: Cloud


def header(name: str, head: bytes) -> Cloud:
    """The header's fields; formats that can't be read raise."""
    if head[:4] != SIGNATURE or len(head) < 227:
        raise ValueError(f"{name} is no point cloud")
    at = {k: struct.unpack_from(f, head) for k, f in HEADER.items() if struct.calcsize(f) <= len(head)}
    kind, size = at["format"]
    if kind & 0x80:
        raise ValueError(f"{name} is compressed")
    if kind not in FORMATS or size < LEAST_BYTES[kind]:
        raise ValueError(f"{name} has point format {kind} with {size} bytes a record")
    count = at["count"][0]
    if at["version"] >= (1, 4) and "long_count" in at:
        count = at["long_count"][0] or count
    if count == 0:
        raise ValueError(f"{name} has no point records")
    b = at["bounds"]
    return Cloud(at["data"][0], kind, size, count, at["scale"], at["shift"], {"x": (b[1], b[0]), "y": (b[3], b[2])})


def layout(cloud: Cloud) -> np.dtype:
    fields = COMMON | FORMATS[cloud.format]
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": cloud.size})


def _place(records: np.ndarray, cloud: Cloud, axis: str) -> np.ndarray:
    i = "xyz".index(axis)
    return records[axis.upper()] * cloud.scale[i] + cloud.shift[i]


def _field(records: np.ndarray, cloud: Cloud, name: str) -> np.ndarray | None:
    """A column of records, null (None) where the format lacks it."""
    if name in ("x", "y", "z"):
        return _place(records, cloud, name)
    new = cloud.format >= 6
    if name == "return_number":
        return records["returns"] & (15 if new else 7)
    if name == "returns":
        return records["returns"] >> 4 if new else records["returns"] >> 3 & 7
    if name == "classification":
        return records[name] if new else records[name] & 0x1F
    return records[name] if name in records.dtype.names else None


class CloudReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, records: int):
        self.path, self.schema, self.records, self.tests = path, schema, records, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of x and y with numbers; Spark applies the others."""
        names = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if getattr(f, "attribute", None) in (("x",), ("y",)):
                if isinstance(f, IsNotNull):
                    continue
                if type(f) in names and isinstance(f.value, (int, float)):
                    self.tests.append((f.attribute[0], names[type(f)], float(f.value)))
                    continue
            yield f

    def _may_hold(self, cloud: Cloud) -> bool:
        """Whether a file's bounds leave room for the filters; bounds are rounded to the scale, so a step more is allowed."""
        for axis, kind, value in self.tests:
            step = abs(cloud.scale["xy".index(axis)])
            low, high = cloud.bounds[axis][0] - step, cloud.bounds[axis][1] + step
            if kind in ("gt", "ge", "eq") and high < value or kind in ("lt", "le", "eq") and low > value:
                return False
        return True

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.extension.lower() in ("las", "laz")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_file(f.path) as stream:
                cloud = header(f.base_name, stream.read(HEADER_BYTES))
            if cloud.data + cloud.count * cloud.size > f.size:
                raise ValueError(f"{f.base_name} is shorter than its header says")
            if self._may_hold(cloud):
                out += [Range(f.path, n, at, min(self.records, cloud.count - at), cloud) for n, at in enumerate(range(0, cloud.count, self.records))]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        cloud, kind, name = partition.cloud, layout(partition.cloud), partition.path.rsplit("/", 1)[-1]
        with store.open_input_file(partition.path) as stream:
            for at in range(partition.first, partition.first + partition.count, PIECE):
                n = min(PIECE, partition.first + partition.count - at)
                stream.seek(cloud.data + at * cloud.size)
                records = np.frombuffer(stream.read(n * cloud.size), kind)
                kept, places = self._inside(records, cloud), np.arange(at, at + n)
                if kept is not None:
                    records, places = records[kept], places[kept]
                if len(records):
                    yield self._batch(records, places, cloud, name, partition.number)

    def _inside(self, records: np.ndarray, cloud: Cloud) -> np.ndarray | None:
        """Which records pass the filters, by their coordinates alone."""
        tests = {"eq": np.equal, "gt": np.greater, "ge": np.greater_equal, "lt": np.less, "le": np.less_equal}
        passed = None
        for axis, kind, value in self.tests:
            here = tests[kind](_place(records, cloud, axis), value)
            passed = here if passed is None else passed & here
        return passed

    def _batch(self, records: np.ndarray, places: np.ndarray, cloud: Cloud, name: str, number: int) -> pa.RecordBatch:
        made = {"file": lambda: np.full(len(records), name), "range": lambda: np.full(len(records), number), "position": lambda: places}
        columns = []
        for f in self.schema.fields:
            values = made[f.name]() if f.name in made else _field(records, cloud, f.name)
            columns.append(pa.nulls(len(records), ARROW[f.dataType]) if values is None else pa.array(values).cast(ARROW[f.dataType]))
        return pa.RecordBatch.from_arrays(columns, names=self.schema.names)


class Clouds(DataSource):
    """Options: path (a file or folder, local or with a scheme), columns (comma-joined; all without it), records (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> StructType:
        asked = self.options.get("columns")
        return StructType([SCHEMA[c.strip()] for c in asked.split(",")]) if asked else SCHEMA

    def reader(self, schema: StructType) -> CloudReader:
        return CloudReader(self.options["path"], schema, int(self.options.get("records", RECORDS)))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, records: int = RECORDS) -> DataFrame:
    """Points of the files; a filter on x and y of the result is pushed into the scan (this turns the session's setting for that on)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Clouds)
    scan = spark.read.format(Clouds.name()).option("path", path).option("records", records)
    return (scan.option("columns", ",".join(columns)) if columns else scan).load()


def within(points: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """Points between bounds, both included."""
    return points.filter(F.col("x").between(*map(float, x)) & F.col("y").between(*map(float, y)))


def sampled(points: DataFrame, skip: int) -> DataFrame:
    """Every skip-th point of each file, from the first on, counted over the points that are left after filters.

    Ranges are counted first, so that each is numbered by itself: no file is sorted as a whole. points needs file, range and position.
    """
    counts = points.groupBy("file", "range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a file has ranges
    firsts = counts.select("file", "range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within_range = F.row_number().over(Window.partitionBy("file", "range").orderBy("position")) - 1
    return points.withColumn("_i", within_range).join(firsts, ["file", "range"]).filter((F.col("_first") + F.col("_i")) % max(1, skip) == 0).select(*points.columns)
