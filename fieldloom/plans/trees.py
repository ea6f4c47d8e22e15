"""Queries over trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import half_up
from fieldloom.operators import trees
from fieldloom.plans.made import Made
from fieldloom.plans.tables import read

TRUNK = Made(
    "p_partkey",
    {
        "species": ["Quercus robur", None, "Silver birch", "Fagus", "Salix", "Scots pine", "Cedrus", "Picea"], "genus": [None, "Acer", None], "leaf": [None, "needleleaved", "Broadleaved", "deciduous", None], "form": ["mature", "veteran", "young", "pollarded", None, "damaged", "multi-stem"],
        "height": [12.5, 4.0, None, 19.0, 8.5, 27.25], "crown": [6.0, None, 3.0, 15.5], "dbh": [None, None, None, "0.85", "x"], "dbh_cm": [None, None, "120", "0"], "girth": [None, "2.5", None, None, None], "girth_cm": [None, None, None, "600", None, "1500"],
    },
)
FORM = Made(
    "p_partkey",
    {
        "height": [12.5, 4.0, None, 19.0, 8.5, 27.25], "crown": [6.0, None, 3.0, 15.5, 12.0], "leaf": [None, "needleleaved", "broadleaved"], "species": ["oak", None, "yew", "Tilia"], "asymmetry": [None, 0.3, 0.5, 0.1], "coverage": [None, 120.0, 30.0],
        "stem_count": [*[None] * 6, "3", "1"], "multistem": [*[None] * 8, "yes"], "health": [*[None] * 7, "storm damage", "good"], "pollarded": [*[None] * 10, "TRUE"], "veteran": [*[None] * 9, "yes", "no"], "tree_form": [*[None] * 11, "coppice", "pollard", "young"],
    },
)
LEAN = Made(
    "p_partkey",
    {
        "height": [12.0, 3.0, 25.0, None], "crown": [6.0, 9.5, None], "ox": [0.0, 1.5, -2.0, None], "oz": [0.5, None, -3.0], "asymmetry": [None, 0.3, 0.05, 0.9], "sx": [None, 0.3, 0.0], "sz": [None, 0.4, 0.0, 0.2], "grade": [0.3, 0.05, None, 0.9], "px": [None, 1.0], "pz": [0.0, None, -2.0], "strength": [0.5, 0.01, 3.0],
        "lean": [*[None] * 5, "12", "0.2", "60"], "lean_direction": [None, "90", "200"], "tree:lean_dx": [*[None] * 9, "0.7"],
    },
)
CROWN = Made("p_partkey", {"west": [2.0, None, 0.0, 5.5], "east": [3.0, None, 1.5], "north": [None, 4.0, 2.5], "south": [1.0, None, 6.0, 2.0], "radius": [3.0, None, 0.2], "base": [None, 2.6, 30.0, 1.0], "height": [10.0, 4.0, 22.0]})
LIMB = Made("p_partkey", {"dbh": [0.3, 1.5, None, 4.0, 2.2], "form": ["mature", "veteran", None, "young", "pollarded", "damaged"], "conifer": [True, False], "species": ["oak", "birch", None, "poplar", "Pinus"], "forked": [None, None, "yes", "no", ""], "primary_branch_diameter": [*[None] * 4, "1.2", "9"], "trunk_form": [*[None] * 6, "Multi stem", "ribbed", "unheard"]})


def _rows(spark: SparkSession, d: str, made: Made, *tags: str) -> DataFrame:
    """The made columns, and the map of those that are tags."""
    return read(spark, d, "part").select("p_partkey", made.tags(*tags).alias("tags"), *made.columns())


def trunks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _rows(spark, d, TRUNK, "dbh", "dbh_cm", "girth", "girth_cm")
    rows = rows.select("p_partkey", trees.trunk(c("tags"), c("height"), c("crown"), c("species"), c("genus"), c("leaf"), c("form")).alias("t"), "form")
    return rows.select("p_partkey", "t.*", trees.trunk_profile(c("t.dbh"), c("form")).alias("p")).select("p_partkey", "source", "observed", "dbh", "circumference", "confidence", "p.*")


def tree_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d, FORM, "stem_count", "multistem", "health", "pollarded", "veteran", "tree_form").withColumn("genus", F.lit(None).cast("string"))
    got = trees.with_form(rows, "tags", "height", "crown", "species", "genus", "leaf", "asymmetry", "coverage")
    return got.select("p_partkey", "form", "confidence", "inferred", "stems", "trunk", "branch", "density", "deadwood")


def trunk_leans(spark: SparkSession, d: str) -> DataFrame:
    got = trees.with_lean(_rows(spark, d, LEAN, "lean", "lean_direction", "tree:lean_dx"), "tags", "height", "crown", ("ox", "oz"), "asymmetry", ("sx", "sz", "grade"), ("px", "pz", "strength"))
    return got.select("p_partkey", "source", "observed", "dx", "dz", "shift", "angle", "confidence", half_up(trees.axis_offset(F.col("dx"), F.pmod("p_partkey", F.lit(7)) / 5.0), 4).alias("at"))


def tree_models(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _rows(spark, d, TRUNK, "dbh").select("p_partkey", trees.preset(c("species"), c("genus"), c("leaf"), c("crown"), c("height")).alias("model"), c("height").alias("h"), c("crown").alias("c"))
    rows = rows.withColumn("size", trees.dimensions(F.col("model"), F.col("h"), F.col("c")))
    return rows.select("p_partkey", "model", "size.height", "size.crown", half_up(trees.crown_radius(F.col("model"), F.pmod("p_partkey", F.lit(11)) / 10.0, F.col("size.crown") / 2.0), 4).alias("radius"))


def crown_reaches(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _rows(spark, d, CROWN, "west").withColumnRenamed("base", "low").select("p_partkey", trees.crown_geometry(c("west"), c("east"), c("north"), c("south"), c("radius"), c("low"), F.lit(3.0), c("height")).alias("g"))
    return rows.select("p_partkey", "g.*", half_up(trees.crown_reach(F.pmod("p_partkey", F.lit(63)) / 10.0, F.col("g")), 4).alias("reach"))


def tree_limbs(spark: SparkSession, d: str) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    rows = _rows(spark, d, LIMB, "forked", "primary_branch_diameter", "trunk_form")
    limb = trees.branches(c("dbh"), c("form"), c("conifer"), c("tags"), c("species"), none)
    stem = trees.stem(c("dbh"), c("form"), c("tags"), c("species"), none)
    return rows.select("p_partkey", limb.alias("l"), stem.alias("s")).select("p_partkey", "l.*", F.col("s.form").alias("stem"), "s.stated", "s.bark")


QUERIES = {f.__name__: f for f in (trunks, tree_forms, trunk_leans, tree_models, crown_reaches, tree_limbs)}

_r = lambda x, n=3: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_form = lambda place, default, column="form": f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v[place]}::DOUBLE" for k, v in trees.FORMS.items()) + f" ELSE {default}::DOUBLE END"
ORACLE_SQL = {
    "trunks": f"""
WITH t AS (SELECT *, lower(concat_ws(' ', species, genus)) AS taxon, coalesce(height, 1) AS h, coalesce(crown, 1) AS c FROM (SELECT p_partkey, {TRUNK.sql()} FROM part)),
k AS (SELECT *, CASE WHEN regexp_matches(taxon, 'oak|quercus|chestnut|castanea') THEN 1.18 WHEN regexp_matches(taxon, 'beech|fagus|lime|tilia|sycamore|acer') THEN 1.08 WHEN regexp_matches(taxon, 'birch|betula|poplar|populus') THEN 0.84
 WHEN regexp_matches(taxon, 'willow|salix') THEN 1.12 WHEN regexp_matches(taxon, 'pine|pinus|spruce|picea|fir|abies') OR coalesce(leaf = 'needleleaved', false) THEN 0.9 ELSE 1 END::DOUBLE AS kin FROM t),
s AS (SELECT *, CASE WHEN dbh = '0.85' THEN 'explicit-diameter' WHEN dbh_cm = '120' THEN 'explicit-diameter-cm' WHEN girth = '2.5' THEN 'explicit-circumference' WHEN girth_cm IS NOT NULL THEN 'explicit-circumference-cm' ELSE 'morphology-estimate' END AS source FROM k),
v AS (SELECT p_partkey, form, source, CASE source WHEN 'explicit-diameter' THEN 0.85::DOUBLE WHEN 'explicit-diameter-cm' THEN 1.2::DOUBLE WHEN 'explicit-circumference' THEN 2.5::DOUBLE / pi() WHEN 'explicit-circumference-cm' THEN least(4.0, girth_cm::DOUBLE / 100 / pi())
 ELSE greatest(0.12::DOUBLE, least(2.4::DOUBLE, (0.018::DOUBLE * h + 0.032::DOUBLE * c) * kin * {_form(0, 1)})) END AS size FROM s),
d AS (SELECT *, {_r('size')} AS dbh FROM v), e AS (SELECT *, greatest(0.1::DOUBLE, least(3.0::DOUBLE, dbh)) AS x, {_form(1, 1.1)} AS b FROM d), g AS (SELECT *, greatest(0, least(2, ceil(x / 2 - 0.01))) AS breast FROM e)
SELECT p_partkey, source, source <> 'morphology-estimate' AS observed, dbh, {_r('size * pi()')} AS circumference, CASE WHEN source <> 'morphology-estimate' THEN 0.99::DOUBLE WHEN form IN ('veteran', 'pollarded') THEN 0.5::DOUBLE ELSE 0.42::DOUBLE END AS confidence,
 CAST(breast AS INT) AS breast, CAST(greatest(0, least(3, greatest(breast, ceil(x / 2 * b)))) AS INT) AS base, CAST(greatest(0, least(2, floor(breast * 0.75))) AS INT) AS upper, CAST(greatest(1, least(5, floor(x * b * 1.6::DOUBLE + 0.5))) AS INT) AS roots, CAST(greatest(0, least(2, floor(x / 1.15::DOUBLE))) AS INT) AS limbs FROM g""",
    "tree_forms": f"""
WITH t AS (SELECT *, coalesce(leaf = 'broadleaved', false) OR coalesce(species IN ('oak', 'Tilia'), false) AS broad, crown / greatest(1, height) AS slender FROM (SELECT p_partkey, {FORM.sql()} FROM part)),
p AS (SELECT *, coalesce((pollarded = 'TRUE')::INT, 0)::DOUBLE + 0 AS p1, coalesce((stem_count = '3')::INT, 0)::DOUBLE + 0.9::DOUBLE * coalesce((multistem = 'yes')::INT, 0) AS p2, 0.95::DOUBLE * coalesce((health = 'storm damage')::INT, 0) + 0.12::DOUBLE * coalesce((asymmetry >= 0.28)::INT, 0) AS p3,
 coalesce((veteran = 'yes')::INT, 0) + 0.34::DOUBLE * coalesce((broad AND crown >= 12)::INT, 0) + 0.28::DOUBLE * coalesce((broad AND slender >= 0.85)::INT, 0) + 0.13::DOUBLE * coalesce((asymmetry >= 0.45)::INT, 0) + 0.18::DOUBLE * coalesce((broad AND coverage >= 115)::INT, 0) AS p4,
 0.35::DOUBLE * coalesce((height >= 10)::INT, 0) + 0.25::DOUBLE * coalesce((height >= 15)::INT, 0) + 0.25::DOUBLE * coalesce((crown >= 7)::INT, 0) AS p5, 0.72::DOUBLE * coalesce((height < 6)::INT, 0) + 0.42::DOUBLE * coalesce((height >= 6 AND height < 10)::INT, 0) + 0.38::DOUBLE * coalesce((crown < 4.5)::INT, 0) + 0.18::DOUBLE * coalesce((slender <= 0.38 AND height < 9)::INT, 0) AS p6 FROM t),
b AS (SELECT *, {_r('greatest(p1, p2, p3, p4, p5, p6)', 6)} AS best FROM p),
f AS (SELECT *, CASE WHEN {_r('p1', 6)} = best THEN 'pollarded' WHEN {_r('p2', 6)} = best THEN 'multi-stem' WHEN {_r('p3', 6)} = best THEN 'damaged' WHEN {_r('p4', 6)} = best THEN 'veteran' WHEN {_r('p5', 6)} = best THEN 'mature' ELSE 'young' END AS top,
 CASE tree_form WHEN 'coppice' THEN 'multi-stem' WHEN 'pollard' THEN 'pollarded' WHEN 'young' THEN 'young' END AS stated FROM b),
g AS (SELECT *, CASE WHEN stated IS NOT NULL THEN stated WHEN best < 0.35 THEN CASE WHEN height < 8 THEN 'young' ELSE 'mature' END WHEN top = 'veteran' AND best < 0.62 THEN 'mature' ELSE top END AS form,
 CASE WHEN stated IS NOT NULL THEN 0.98::DOUBLE WHEN best < 0.35 THEN 0.35::DOUBLE WHEN top = 'veteran' AND best < 0.62 THEN greatest(0.48::DOUBLE, p5) ELSE greatest(0.35::DOUBLE, least(0.98::DOUBLE, best)) END AS sure FROM f)
SELECT p_partkey, form, {_r('sure')} AS confidence, stated IS NULL AS inferred, CAST(CASE WHEN stated IS NOT NULL THEN CASE WHEN form = 'multi-stem' THEN greatest(2, coalesce(stem_count::INT, 2)) ELSE 1 END WHEN stem_count = '3' THEN 3 WHEN form = 'multi-stem' THEN 2 ELSE 1 END AS BIGINT) AS stems,
 {_r(f"1 + ({_form(2, 1)} - 1) * sure")} AS trunk, {_form(3, 1)} AS branch, {_form(4, 1)} AS density, {_r(f"{_form(5, 0)} * sure")} AS deadwood FROM g""",
    "trunk_leans": f"""
WITH t AS (SELECT *, coalesce(height, 1) AS h, coalesce(crown, 1) AS c, coalesce(ox, 0) AS x, coalesce(oz, 0) AS z FROM (SELECT p_partkey, {LEAN.sql()} FROM part)),
u AS (SELECT *, sqrt(x * x + z * z) AS o, sqrt(sx * sx + sz * sz) AS sm, sqrt(px * px + pz * pz) AS pm FROM t),
v AS (SELECT *, greatest(0.0, least(1.0, coalesce(asymmetry, o / greatest(0.5, c / 2)))) AS a, coalesce(sm >= 1e-6 AND grade IS NOT NULL, false) AS sk, coalesce(pm >= 1e-6 AND strength IS NOT NULL, false) AS pk FROM u),
w AS (SELECT *, CASE WHEN o >= 0.75 AND a >= 0.08 THEN greatest(0.16::DOUBLE, least(0.42::DOUBLE, 0.16::DOUBLE + a * 0.28::DOUBLE)) ELSE 0 END AS pull, CASE WHEN sk AND grade >= 0.08 THEN least(1.25::DOUBLE, h * 0.035::DOUBLE * least(0.6::DOUBLE, grade)) / sm ELSE 0 END AS down, CASE WHEN pk AND strength > 0.05 THEN least(1.5::DOUBLE, c * 0.06::DOUBLE * least(1.0::DOUBLE, strength)) / pm ELSE 0 END AS push FROM v),
m AS (SELECT *, x * pull - coalesce(sx, 0) * down + coalesce(px, 0) * push AS mx, z * pull - coalesce(sz, 0) * down + coalesce(pz, 0) * push AS mz FROM w), n AS (SELECT *, sqrt(mx * mx + mz * mz) AS raw FROM m),
q AS (SELECT *, least(1.0::DOUBLE, greatest(0.5::DOUBLE, least(2.5::DOUBLE, h * 0.12::DOUBLE)) / nullif(raw, 0)) AS k, least(25.0::DOUBLE, lean::DOUBLE) AS tilt, CASE WHEN tree_lean_dx IS NOT NULL THEN 'explicit-lean-vector' WHEN lean IS NOT NULL AND lean_direction IS NOT NULL THEN 'explicit-lean-angle' WHEN raw < 0.2 THEN 'vertical-default' ELSE 'inferred-structural-evidence' END AS source FROM n),
r AS (SELECT *, CASE source WHEN 'explicit-lean-vector' THEN 0.7::DOUBLE WHEN 'explicit-lean-angle' THEN CASE WHEN tilt < 0.5 THEN 0 ELSE sin(radians(lean_direction::DOUBLE)) * (tan(radians(tilt)) * 10) END WHEN 'vertical-default' THEN 0 ELSE mx * k END AS dx,
 CASE source WHEN 'explicit-lean-vector' THEN 0 WHEN 'explicit-lean-angle' THEN CASE WHEN tilt < 0.5 THEN 0 ELSE -cos(radians(lean_direction::DOUBLE)) * (tan(radians(tilt)) * 10) END WHEN 'vertical-default' THEN 0 ELSE mz * k END AS dz,
 CASE source WHEN 'explicit-lean-vector' THEN 0.7::DOUBLE WHEN 'explicit-lean-angle' THEN CASE WHEN tilt < 0.5 THEN 0 ELSE tan(radians(tilt)) * 10 END WHEN 'vertical-default' THEN 0 ELSE raw * k END AS shift, least(1.0::DOUBLE, (p_partkey % 7) / 5.0::DOUBLE) AS s FROM q)
SELECT p_partkey, source, starts_with(source, 'explicit') AS observed, {_r('dx')} AS dx, {_r('dz')} AS dz, {_r('shift')} AS shift, CASE source WHEN 'explicit-lean-vector' THEN NULL WHEN 'explicit-lean-angle' THEN CASE WHEN tilt < 0.5 THEN 0 ELSE {_r('tilt')} END WHEN 'vertical-default' THEN 0 ELSE {_r('degrees(atan2(shift, h))')} END AS angle,
 CASE source WHEN 'vertical-default' THEN 1 WHEN 'inferred-structural-evidence' THEN {_r('greatest(0.35::DOUBLE, least(0.78::DOUBLE, 0.42::DOUBLE + a * 0.3::DOUBLE + CASE WHEN sk THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN pk THEN 0.08::DOUBLE ELSE 0 END))')} ELSE 0.98::DOUBLE END AS confidence, {_r(f"{_r('dx')} * (s * s * (3 - 2 * s))", 4)} AS at FROM r""",
    "tree_models": f"""
WITH t AS (SELECT *, lower(concat_ws(' ', species, genus)) AS taxon FROM (SELECT p_partkey, {TRUNK.sql()} FROM part)),
m AS (SELECT *, CASE WHEN taxon LIKE '%salix%' THEN 'willow' WHEN taxon LIKE '%birch%' THEN 'birch' WHEN taxon LIKE '%fagus%' THEN 'beech' WHEN taxon LIKE '%cedrus%' THEN 'cedar' WHEN taxon LIKE '%pine%' THEN 'pine' WHEN taxon LIKE '%picea%' OR leaf = 'needleleaved' THEN 'spruce'
 WHEN taxon LIKE '%quercus%' AND (coalesce(height >= 18, false) OR coalesce(crown >= 14, false)) THEN 'ancient-oak' ELSE 'broadleaf-oak' END AS model FROM t),
h AS (SELECT *, greatest(3, least(45, floor(coalesce(height, 10) + 0.5))) AS tall FROM m), c AS (SELECT *, greatest(3, least(22, floor(coalesce(crown, tall * CASE model {' '.join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, (_, w) in trees.PRESETS.items())} END) + 0.5))) AS wide, (p_partkey % 11) / 10.0::DOUBLE AS u FROM h)
SELECT p_partkey, model, CAST(tall AS BIGINT) AS height, CAST(wide AS BIGINT) AS crown, {_r('''wide / 2.0::DOUBLE * CASE model WHEN 'spruce' THEN 0.22::DOUBLE + (1 - u) * 0.78::DOUBLE WHEN 'pine' THEN 0.28::DOUBLE + sin(pi() * u) * 0.72::DOUBLE WHEN 'cedar' THEN 0.4::DOUBLE + sin(pi() * u) * 0.6::DOUBLE WHEN 'beech' THEN greatest(0.34::DOUBLE, sin(pi() * (0.08::DOUBLE + u * 0.84::DOUBLE)))
 WHEN 'birch' THEN greatest(0.28::DOUBLE, sin(pi() * (0.1::DOUBLE + u * 0.82::DOUBLE))) WHEN 'willow' THEN 0.48::DOUBLE + sin(pi() * u) * 0.52::DOUBLE WHEN 'ancient-oak' THEN 0.56::DOUBLE + sin(pi() * u) * 0.44::DOUBLE ELSE 0.42::DOUBLE + sin(pi() * u) * 0.58::DOUBLE END''', 4)} AS radius FROM c""",
    "crown_reaches": f"""
WITH t AS (SELECT *, greatest(0.5::DOUBLE, coalesce(radius, 0.5::DOUBLE)) AS f FROM (SELECT p_partkey, {CROWN.sql()} FROM part)),
s AS (SELECT *, CASE WHEN west > 0 THEN west ELSE f END AS w, CASE WHEN east > 0 THEN east ELSE f END AS e, CASE WHEN north > 0 THEN north ELSE f END AS n, CASE WHEN south > 0 THEN south ELSE f END AS o FROM t),
g AS (SELECT p_partkey, greatest(0.5, (w + e) / 2) AS radius_x, greatest(0.5, (n + o) / 2) AS radius_z, (e - w) / 2 AS offset_x, (o - n) / 2 AS offset_z, CASE WHEN base IS NULL THEN 3.0::DOUBLE ELSE greatest(2.0, least(greatest(2.0, height - 2), floor(base + 0.5))) END AS base, (p_partkey % 63) / 10.0::DOUBLE AS angle FROM s),
q AS (SELECT *, pow(cos(angle) / radius_x, 2) + pow(sin(angle) / radius_z, 2) AS a, -2 * (cos(angle) * offset_x / pow(radius_x, 2) + sin(angle) * offset_z / pow(radius_z, 2)) AS b, pow(offset_x / radius_x, 2) + pow(offset_z / radius_z, 2) - 1 AS c FROM g)
SELECT p_partkey, radius_x, radius_z, offset_x, offset_z, base, {_r('greatest(0.5, (-b + sqrt(greatest(0, b * b - 4 * a * c))) / (2 * a))', 4)} AS reach FROM q""",
    "tree_limbs": f"""
WITH t AS (SELECT *, greatest(0.08::DOUBLE, least(4.5::DOUBLE, coalesce(dbh, 0.3::DOUBLE))) AS x FROM (SELECT p_partkey, {LIMB.sql()} FROM part)),
d AS (SELECT *, greatest(0.06::DOUBLE, least(greatest(0.08::DOUBLE, x * 0.62::DOUBLE), coalesce(primary_branch_diameter::DOUBLE, x * 0.38::DOUBLE * CASE species WHEN 'oak' THEN 1.08::DOUBLE WHEN 'poplar' THEN 0.96::DOUBLE WHEN 'birch' THEN 0.78::DOUBLE WHEN 'Pinus' THEN 0.72::DOUBLE ELSE 0.9::DOUBLE END * CASE form WHEN 'veteran' THEN 1.2::DOUBLE WHEN 'pollarded' THEN 1.12::DOUBLE WHEN 'young' THEN 0.72::DOUBLE WHEN 'damaged' THEN 0.88::DOUBLE ELSE 1 END))) AS diameter,
 CASE forked WHEN 'yes' THEN true WHEN 'no' THEN false ELSE coalesce(form IN ('pollarded', 'veteran'), false) END AS fork, CASE WHEN conifer THEN 0.5::DOUBLE ELSE 0.56::DOUBLE END AS s, CASE WHEN conifer THEN 0.42::DOUBLE ELSE 0.48::DOUBLE END AS h FROM t)
SELECT p_partkey, {_r('diameter')} AS diameter, {", ".join(f"CAST(least({', '.join(f'CASE WHEN {y} < 0.72 THEN 0 WHEN {y} < 1.65 THEN 1 WHEN {y} < 2.75 THEN 2 ELSE 3 END' for y in ys)}) AS INT) AS {n}" for n, ys in (("primary", ["diameter"]), ("secondary", ["diameter", "diameter * s"]), ("tertiary", ["diameter", "diameter * s", "diameter * s * h"])))}, fork AS forked,
 CAST(greatest(0, least(2, floor(x * CASE WHEN fork THEN 0.48::DOUBLE ELSE 0.34::DOUBLE END / 2 + 0.5))) AS INT) AS crotch, primary_branch_diameter IS NOT NULL OR coalesce(forked IN ('yes', 'no'), false) AS observed,
 CASE trunk_form WHEN 'Multi stem' THEN 'split' WHEN 'ribbed' THEN 'fluted' ELSE CASE WHEN coalesce(form IN ('veteran', 'damaged', 'pollarded'), false) AND x >= 0.75 THEN 'irregular' WHEN x >= 1.15 THEN 'elliptical' ELSE 'round' END END AS stem, coalesce(trunk_form IN ('Multi stem', 'ribbed'), false) AS stated,
 CASE WHEN species = 'birch' THEN 'pale-peeling' WHEN species IN ('oak', 'Pinus') THEN 'deep-fissured' WHEN form IN ('veteran', 'damaged') THEN 'weathered' ELSE 'mixed-bark' END AS bark FROM d""",
}
