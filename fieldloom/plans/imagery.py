"""Queries over cross-sections of routes: imagery and routes both from the embeddings' first dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.colour import WHITE, XYZ
from fieldloom.functions.numbers import half_up
from fieldloom.operators import sections
from fieldloom.plans.tables import points

CELL, WIDEST, ASSISTED = 32, 6.0, 0.4
COLOURS = ((0, (70, 140, 60)), (3, (200, 190, 170)), (6, (60, 62, 64)), (8, (124, 118, 119)), (9, (120, 118, 116)))


def _imagery(spark: SparkSession, d: str) -> DataFrame:
    """A pixel for each cell that holds points, coloured by the highest kind in it."""
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long").alias(c)
    top = points(spark, d).groupBy(cell("x"), cell("z")).agg(F.max("kind").alias("m"))

    def band(i: int):
        out = F.lit(float(COLOURS[-1][1][i]))
        for most, colour in reversed(COLOURS):
            out = F.when(F.col("m") <= most, float(colour[i])).otherwise(out)
        return out

    return top.select("x", "z", *(band(i).alias(c) for i, c in enumerate("rgb")))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """A line of two segments from every point."""
    k = F.when(F.col("vec_id") % 2 == 1, 1.5).otherwise(1.0)
    a = [F.col("x") / CELL + 0.37, F.col("z") / CELL + 0.41]
    b = [a[0] + k * 4.0, a[1] + k * 3.0]
    at = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    return points(spark, d).select("vec_id", F.array(at(*a), at(*b), at(b[0] - 3.0, b[1] + 4.0)).alias("line"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.cross_sections(sections.line_samples(_routes(spark, d), "vec_id", "line"), _imagery(spark, d), "vec_id", widest=WIDEST)


def route_cross_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select("vec_id", "segment", "step", half_up(F.col("chainage"), 6).alias("chainage"), "reason", "left", "right", "width", half_up(F.col("contrast"), 6).alias("contrast"), "inside", "r", "g", "b")


def route_width_evidence(spark: SparkSession, d: str) -> DataFrame:
    got = sections.route_widths(_sections(spark, d), "vec_id")
    return got.select("vec_id", "sampled", "valid", half_up(F.col("coverage"), 6).alias("coverage"), "width", "width_low", "width_high", "width_mad", half_up(F.col("contrast"), 6).alias("contrast"), "confidence", "reason")


def route_corridors(spark: SparkSession, d: str) -> DataFrame:
    found = _sections(spark, d)
    quads = sections.corridors(found, sections.route_widths(found, "vec_id", least=ASSISTED), "vec_id")
    corner = [half_up(F.get("ring", i)[a], 4).alias(f"{a}{i + 1}") for i in range(4) for a in ("x", "z")]
    return quads.select("vec_id", "segment", "step", *corner)


QUERIES = {f.__name__: f for f in (route_cross_sections, route_width_evidence, route_corridors)}


def _lab_sql(r: str, g: str, b: str) -> str:
    """A list of L, a and b."""
    linear = [f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END)" for c in (r, g, b)]
    t = ["((" + " + ".join(f"{m}::DOUBLE * {c}" for m, c in zip(row, linear)) + f") / {w}::DOUBLE)" for row, w in zip(XYZ, WHITE)]
    x, y, z = (f"(CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787::DOUBLE * {v} + 16 / 116.0::DOUBLE END)" for v in t)
    return f"[116 * {y} - 16, 500 * ({x} - {y}), 200 * ({y} - {z})]"


_BAND = lambda i: "CASE " + " ".join(f"WHEN m <= {most} THEN {c[i]}.0::DOUBLE" for most, c in COLOURS) + " END"
_FAR = lambda p, q: "sqrt(" + " + ".join(f"({p}[{i}] - {q}[{i}]) * ({p}[{i}] - {q}[{i}])" for i in (1, 2, 3)) + ")"
_UP = lambda e, n: f"floor(({e}) * {10**n} + 0.5) / {10**n}.0"
_GREEN = lambda p: f"({p}g > 55 AND {p}g - ({p}r + {p}b) / 2 > 22)"
_SIDE = "max(CASE WHEN side = {s} THEN {v} END)"
_SECTIONS = f"""
WITH p AS (SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 1000) AS x, floor(CAST(embedding[2] AS DOUBLE) * 1000) AS z, label FROM embeddings),
px AS (SELECT cx, cz, {_BAND(0)} AS r, {_BAND(1)} AS g, {_BAND(2)} AS b FROM (SELECT floor(x / {CELL}) AS cx, floor(z / {CELL}) AS cz, max(label) AS m FROM p GROUP BY 1, 2)),
v AS (SELECT vec_id, x / {CELL} + 0.37::DOUBLE AS ax, z / {CELL} + 0.41::DOUBLE AS az, CASE WHEN vec_id % 2 = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS k FROM p),
v2 AS (SELECT *, ax + k * 4 AS bx, az + k * 3 AS bz FROM v),
e AS (SELECT vec_id, 0 AS segment, ax AS x0, az AS z0, bx AS x1, bz AS z1 FROM v2 UNION ALL SELECT vec_id, 1, bx, bz, bx - 3, bz + 4 FROM v2),
e2 AS (SELECT *, x1 - x0 AS dx, z1 - z0 AS dz, sqrt((x1 - x0) * (x1 - x0) + (z1 - z0) * (z1 - z0)) AS len FROM e),
e3 AS (SELECT *, coalesce(lag(len) OVER (PARTITION BY vec_id ORDER BY segment), 0) AS start, unnest(range(segment, CAST(floor(len / 2) AS BIGINT) + 1)) AS step FROM e2),
s AS (SELECT vec_id, segment, step, start + least(len, step * 2.0::DOUBLE) AS chainage, x0 + dx / len * least(len, step * 2.0::DOUBLE) AS x, z0 + dz / len * least(len, step * 2.0::DOUBLE) AS z, dx / len AS tx, dz / len AS tz FROM e3),
shape AS (SELECT NULL::INT AS k, (a - 1) * 0.75::DOUBLE AS along, (c - 1) * 0.75::DOUBLE / 2 AS off FROM range(3) t(a), range(3) u(c) UNION ALL SELECT k - 4, 0.0::DOUBLE, (k - 4) * 0.75::DOUBLE FROM range(9) t(k)),
m AS (SELECT s.*, k, sign(k) AS side, px.r, px.g, px.b FROM s, shape LEFT JOIN px ON cx = floor(x + tx * along - tz * off) AND cz = floor(z + tz * along + tx * off)),
mid AS (SELECT vec_id, segment, step, count(r) AS n, median(r) AS r, median(g) AS g, median(b) AS b FROM m WHERE k IS NULL GROUP BY ALL),
c AS (SELECT m.*, mid.n, {_GREEN("mid.")} AS leafy, {_lab_sql("mid.r", "mid.g", "mid.b")} AS centre, {_lab_sql("m.r", "m.g", "m.b")} AS own FROM m JOIN mid USING (vec_id, segment, step) WHERE k IS NOT NULL),
c2 AS (SELECT *, CASE WHEN abs(k) = 1 THEN centre ELSE lag(own) OVER (PARTITION BY vec_id, segment, step, side ORDER BY abs(k)) END AS last FROM c),
c3 AS (SELECT *, {_FAR("own", "centre")} AS seed, {_FAR("own", "last")} AS nearby FROM c2),
h AS (SELECT vec_id, segment, step, side, min(abs(k)) FILTER (r IS NULL) AS gap, min(abs(k)) FILTER (seed > 18 AND nearby > 9.9) AS hit, arg_min(greatest(seed, nearby), abs(k)) FILTER (seed > 18 AND nearby > 9.9) AS at_hit, max(greatest(seed, nearby)) AS top FROM c3 WHERE side <> 0 GROUP BY ALL),
f AS (SELECT *, CASE WHEN hit > 1 AND (gap IS NULL OR hit < gap) THEN hit - 1 WHEN hit IS NULL AND gap IS NULL AND top > 18 THEN 4 END AS inner_k, CASE WHEN hit > 1 THEN at_hit ELSE top END AS contrast FROM h),
g AS (SELECT vec_id, segment, step, {_SIDE.format(s=-1, v="inner_k")} AS lk, {_SIDE.format(s=1, v="inner_k")} AS rk, {_SIDE.format(s=-1, v="contrast")} AS lc, {_SIDE.format(s=1, v="contrast")} AS rc FROM f GROUP BY ALL),
t AS (SELECT c.*, lk, rk, lc, rc, CASE WHEN n < 3 THEN 'imagery-gap' WHEN leafy THEN 'canopy-or-vegetation-occlusion' WHEN lk IS NULL OR rk IS NULL THEN 'edge-not-bounded' WHEN (lk + rk) * 0.75 < 0.75 OR (lk + rk) * 0.75 > {WIDEST} THEN 'implausible-width' END AS reason FROM c JOIN g USING (vec_id, segment, step)),
t2 AS (SELECT *, coalesce(reason IS NULL AND k BETWEEN -lk AND rk AND r IS NOT NULL AND NOT {_GREEN("")}, false) AS inside FROM t),
sections AS (SELECT vec_id, segment, step, chainage, x, z, tx, tz, reason, CASE WHEN reason IS NULL THEN lk * 0.75::DOUBLE END AS "left", CASE WHEN reason IS NULL THEN rk * 0.75::DOUBLE END AS "right", CASE WHEN reason IS NULL THEN (lk + rk) * 0.75::DOUBLE END AS width,
  CASE WHEN reason IS NULL THEN (lc + rc) / 2 END AS contrast, count(*) FILTER (inside) AS inside, median(r) FILTER (inside) AS r, median(g) FILTER (inside) AS g, median(b) FILTER (inside) AS b FROM t2 GROUP BY ALL)"""
_C = sections.CONFIDENCE
_ROUTES = f"""{_SECTIONS},
u AS (SELECT vec_id, count(*) AS sampled, count(width) AS valid, quantile_cont(width, 0.5) AS m, quantile_cont(width, 0.1) AS lo, quantile_cont(width, 0.9) AS hi, coalesce(avg(contrast), 0) AS contrast FROM sections GROUP BY 1),
d AS (SELECT vec_id, median(abs(width - m)) AS mad FROM sections JOIN u USING (vec_id) WHERE width IS NOT NULL GROUP BY 1),
y AS (SELECT u.*, mad, valid / sampled AS coverage, {_UP("m", 1)} AS w FROM u LEFT JOIN d USING (vec_id)),
o AS (SELECT *, {_UP(f"{_C['base']} + {_C['coverage']} * coverage + {_C['resolution']} * (1 - 0.9 / 1.4) + {_C['contrast']} * least(contrast / 35, 1) + {_C['consistency']} * CASE WHEN w > 0 THEN greatest(0, 1 - coalesce(mad, 0) / greatest(1, w)) ELSE 0 END + {_C['provenance']}", 3)} AS confidence FROM y),
routes AS (SELECT *, CASE WHEN valid < least(3, greatest(1, ceil(sampled * 0.2))) THEN 'insufficient-visible-cross-sections' WHEN confidence < {sections.ACCEPT_FROM} THEN 'confidence-below-threshold' END AS reason, {_UP("mad", 2)} AS wm FROM o)"""
ORACLE_SQL = {
    "route_cross_sections": f"""{_SECTIONS}
SELECT vec_id, segment, CAST(step AS INT) AS step, {_UP("chainage", 6)} AS chainage, reason, "left", "right", width, {_UP("contrast", 6)} AS contrast, inside, r, g, b FROM sections""",
    "route_width_evidence": f"""{_ROUTES}
SELECT vec_id, sampled, valid, {_UP("coverage", 6)} AS coverage, w AS width, {_UP("lo", 1)} AS width_low, {_UP("hi", 1)} AS width_high, wm AS width_mad, {_UP("contrast", 6)} AS contrast, confidence, reason FROM routes""",
    "route_corridors": f"""{_ROUTES.replace(f'confidence < {sections.ACCEPT_FROM}', f'confidence < {ASSISTED}')},
k AS (SELECT s.*, x + tz * "left" AS lx, z - tx * "left" AS lz, x - tz * "right" AS rx, z + tx * "right" AS rz FROM sections s JOIN routes r USING (vec_id) WHERE r.reason IS NULL AND s.width IS NOT NULL AND abs(s.width - w) <= greatest(1.5, coalesce(wm, 0) * 3, w * 0.4)),
q AS (SELECT *, lag(lx) OVER a AS plx, lag(lz) OVER a AS plz, lag(rx) OVER a AS prx, lag(rz) OVER a AS prz, lag(chainage) OVER a AS before FROM k WINDOW a AS (PARTITION BY vec_id ORDER BY chainage, segment, step))
SELECT vec_id, segment, CAST(step AS INT) AS step, {", ".join(f"{_UP(e, 4)} AS {n}" for e, n in (("plx", "x1"), ("plz", "z1"), ("lx", "x2"), ("lz", "z2"), ("rx", "x3"), ("rz", "z3"), ("prx", "x4"), ("prz", "z4")))} FROM q WHERE chainage - before <= 5""",
}
