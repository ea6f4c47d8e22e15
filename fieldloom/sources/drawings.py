"""Drawings and their texts after decoding: SVG shapes, recognised words, page words, DXF entities, archives."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY_LIMIT, MEMBER_BYTES, TOTAL_BYTES, ENTITY_LIMIT = 512, 64 << 20, 192 << 20, 50_000


def svg_shapes(files: DataFrame, id: str, svg: str) -> DataFrame:
    """Polygons and lines of SVG texts: (id, seq, closed, points)."""
    number = F.lit(r"-?\d+(?:\.\d+)?")
    closed = files.select(id, F.posexplode(F.regexp_extract_all(svg, F.lit(r'<polygon[^>]*\bpoints="([^"]*)"'), F.lit(1))).alias("seq", "t"), F.lit(True).alias("closed"))
    at = lambda k: F.regexp_extract("tag", rf'\b{k}="([^"]*)"', 1)
    lines = files.select(id, F.posexplode(F.regexp_extract_all(svg, F.lit(r"(<line\b[^>]*>)"), F.lit(1))).alias("seq", "tag"))
    lines = lines.select(id, "seq", F.concat_ws(" ", at("x1"), at("y1"), at("x2"), at("y2")).alias("t"), F.lit(False).alias("closed"))
    numbers = F.transform(F.regexp_extract_all("t", number, F.lit(0)), lambda v: v.cast("double"))
    shapes = closed.select(id, "seq", "t", "closed").union(lines).withColumn("_n", numbers).filter(F.size("_n") >= 4)
    points = F.transform(F.sequence(F.lit(1), F.size("_n") - 1, F.lit(2)), lambda i: F.struct(F.element_at("_n", i).alias("x"), F.element_at("_n", i + 1).alias("z")))
    return shapes.select(id, "seq", "closed", points.alias("points"))


def recognised_lines(words: DataFrame, id: str, least: float = 35.0) -> DataFrame:
    """Recognised words (page, block, par, line, word, text, left, top, width, height, conf) as lines with bounds and confidence."""
    seen = words.filter((F.col("conf") >= least) & (F.trim("text") != ""))
    return seen.groupBy(id, "page", "block", "par", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w.text), " ").alias("text"), F.min("left").alias("x_min"), F.min("top").alias("y_min"),
        F.max(F.col("left") + F.col("width")).alias("x_max"), F.max(F.col("top") + F.col("height")).alias("y_max"), (F.max("conf") / 100).alias("confidence"),
    )


def page_lines(pages: DataFrame, id: str, xml: str) -> DataFrame:
    """<line> elements of page texts with the words in them."""
    lines = pages.select(id, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)(<line\b.*?</line>)"), F.lit(1))).alias("seq", "l"))
    at = lambda k: F.regexp_extract("l", rf'<line[^>]*\b{k}="([^"]*)"', 1).try_cast("double")
    text = F.array_join(F.regexp_extract_all("l", F.lit(r"<word[^>]*>([^<]*)</word>"), F.lit(1)), " ")
    return lines.select(id, "seq", text.alias("text"), at("xMin").alias("x_min"), at("yMin").alias("y_min"), at("xMax").alias("x_max"), at("yMax").alias("y_max"), F.lit(0.995).alias("confidence"))


def dxf_entities(text: str) -> Iterator[tuple[str, str | None, list[tuple[float, float]], str | None, bool]]:
    """(kind, layer, points, text, closed) of the entities of an ASCII drawing; more than the limit is an error."""
    rows = text.splitlines()
    pairs = [(rows[i].strip(), rows[i + 1].strip()) for i in range(0, len(rows) - 1, 2)]
    inside, kind, fields, count = False, None, [], 0

    def made():
        nonlocal count
        if kind in ("LINE", "LWPOLYLINE", "CIRCLE", "TEXT", "MTEXT"):
            count += 1
            if count > ENTITY_LIMIT:
                raise ValueError(f"more than {ENTITY_LIMIT} entities")
            get = lambda code: [v for c, v in fields if c == code]
            xs, ys = [*get("10"), *get("11")], [*get("20"), *get("21")]
            closed = kind == "CIRCLE" or bool(get("70") and int(get("70")[0]) & 1)
            yield kind, next(iter(get("8")), None), [(float(x), float(y)) for x, y in zip(xs, ys)], next(iter(get("1")), None), closed

    for code, value in pairs:
        if code == "0":
            if inside and kind:
                yield from made()
            kind, fields = value, []
            if value == "ENDSEC":
                inside = False
        elif code == "2" and kind == "SECTION":
            inside, kind = value == "ENTITIES", None
        else:
            fields.append((code, value))
    if inside and kind:
        yield from made()


def dxf(files: DataFrame, id: str, content: str) -> DataFrame:
    """Entities of DXF texts, one file at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, body in zip(batch[id], batch[content]):
                found = list(dxf_entities(body or ""))
                if not found:
                    continue
                yield pd.DataFrame({id: [key] * len(found), "seq": range(len(found)), "entity": [f[0] for f in found], "layer": [f[1] for f in found], "points": [[{"x": x, "z": z} for x, z in f[2]] for f in found], "text": [f[3] for f in found], "closed": [f[4] for f in found]})

    kind = files.schema[id].dataType.simpleString()
    return files.select(id, content).mapInPandas(run, f"{id} {kind}, seq int, entity string, layer string, points array<struct<x:double,z:double>>, text string, closed boolean")


def archive_members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Members of a ZIP archive; unsafe paths and sizes beyond the budgets are errors."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        entries, total = archive.infolist(), 0
        if len(entries) > ENTRY_LIMIT:
            raise ValueError(f"more than {ENTRY_LIMIT} entries")
        for e in entries:
            name = posixpath.normpath(e.filename.replace("\\", "/"))
            if name.startswith(("/", "../")) or name == ".." or ":" in name:
                raise ValueError(f"unsafe path {e.filename}")
            if e.is_dir():
                continue
            total += e.file_size
            if e.file_size > MEMBER_BYTES or total > TOTAL_BYTES:
                raise ValueError(f"{e.filename} is beyond the size budget")
            yield name, archive.read(e)
