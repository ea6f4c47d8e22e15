"""Trees: trunk, form, lean, branches, model and crown from tags, sizes and reconstructed crowns, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.kinds import tag
from fieldloom.functions.numbers import clamp, half_up, number_or_null
from fieldloom.functions.text import cascade

#: Tag families of a measured trunk with the factor to metres of diameter; families are asked in order.
TRUNK_TAGS = (
    ("explicit-diameter", ("diameter", "tree:diameter", "dbh", "tree:dbh", "tpmap:dbh_m"), 1.0),
    ("explicit-diameter-cm", ("diameter_cm", "dbh_cm", "tree:dbh_cm", "tpmap:dbh_cm"), 0.01),
    ("explicit-circumference", ("circumference", "tree:circumference", "girth", "tree:girth", "tpmap:circumference_m"), 1 / math.pi),
    ("explicit-circumference-cm", ("circumference_cm", "girth_cm", "tree:girth_cm", "tpmap:circumference_cm"), 0.01 / math.pi),
)
#: Factors of species on the trunk, in order.
SPECIES = ((r"oak|quercus|chestnut|castanea", 1.18), (r"beech|fagus|lime|tilia|sycamore|acer", 1.08), (r"birch|betula|poplar|populus", 0.84), (r"willow|salix", 1.12), (r"pine|pinus|spruce|picea|fir|abies", 0.9))
#: Fixed values of the forms, in order of priority: trunk estimate, buttress, trunk, branch, density, deadwood.
FORMS = {
    "pollarded": (1.22, 1.45, 1.35, 0.72, 0.76, 0.04), "multi-stem": (0.92, 1.25, 0.9, 0.95, 0.95, 0.03), "damaged": (1.08, 1.2, 1.1, 0.88, 0.68, 0.18),
    "veteran": (1.38, 1.65, 1.65, 1.18, 0.82, 0.11), "mature": (1.0, 1.1, 1.0, 1.0, 1.0, 0.02), "young": (0.62, 1.1, 0.68, 0.78, 0.9, 0.0),
}
EXPLICIT_FORMS = [("pollarded", "pollard"), ("multi-stem", "multi[- ]?stem|coppice"), ("damaged", "damag|broken|split|declin|hollow|cavity"), ("veteran", "veteran|ancient"), ("young", "young|juvenile|sapling"), ("mature", "mature")]
BROADLEAF = r"oak|beech|birch|ash|maple|sycamore|willow|lime|alder|poplar|quercus|fagus|betula|fraxinus|acer|salix|tilia|alnus|populus"
#: Fixed values of the models: crown shape, crown width to height, and the words of their taxa in order of the questions.
PRESETS = {
    "broadleaf-oak": ("irregular-round", 0.58), "ancient-oak": ("wide-irregular", 0.78), "beech": ("oval", 0.52), "birch": ("light-oval", 0.38), "willow": ("weeping", 0.66),
    "spruce": ("conical", 0.38), "pine": ("open-conifer", 0.42), "cedar": ("tiered-wide", 0.58),
}
TAXA = [("willow", "willow|salix"), ("birch", "birch|betula"), ("beech", "beech|fagus"), ("cedar", "cedar|cedrus"), ("pine", "pine|pinus"), ("spruce", "spruce|picea|fir|abies|conifer|cypress|larch")]
#: Fixed values of crown profiles: least share of the radius, and the share that follows the profile's curve.
ROUNDED = {"open-conifer": (0.28, 0.72), "tiered-wide": (0.40, 0.60), "weeping": (0.48, 0.52), "wide-irregular": (0.56, 0.44)}
OVAL = {"oval": (0.34, 0.08, 0.84), "light-oval": (0.28, 0.10, 0.82)}
BARK = [("pale-peeling", "birch|betula"), ("smooth", "beech|fagus"), ("deep-fissured", "pine|pinus|spruce|picea|oak|quercus|chestnut|castanea")]
LIMB_SPECIES = ((r"oak|quercus|chestnut|castanea|beech|fagus", 1.08), (r"willow|salix|poplar|populus", 0.96), (r"birch|betula", 0.78), (r"pine|pinus|spruce|picea|cedar|cedrus", 0.72))
STEM_FORMS = [("split", "multi|split|fork"), ("fluted", "flut|rib"), ("elliptical", "oval|ellip"), ("irregular", "irregular|veteran|gnarl"), ("round", "round|single")]
CLAMPED = 0.12, 2.4


def _first_number(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(number_or_null(tags[k]) for k in keys))


def _of(form: Column, place: int, default: float = 1.0) -> Column:
    out = F.lit(default)
    for name, values in FORMS.items():
        out = F.when(form == name, values[place]).otherwise(out)
    return out


def _said(*values: Column) -> Column:
    return F.lower(F.concat_ws(" ", *values))


def species_factor(species: Column, genus: Column, leaf: Column) -> Column:
    said = _said(species, genus)
    out = F.when(F.coalesce(F.lower(leaf).rlike("needle|conifer"), F.lit(False)), 0.9).otherwise(1.0)
    for pattern, factor in reversed(SPECIES):
        out = F.when(said.rlike(pattern), factor).otherwise(out)
    return out


def trunk(tags: Column, height: Column, crown: Column, species: Column, genus: Column, leaf: Column, form: Column) -> Column:
    """struct<source, observed, dbh, circumference, confidence>: a measured trunk, else an estimate from height, crown, species and form."""
    height, crown = (F.greatest(F.lit(1.0), F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))) for x in (height, crown))
    guess = clamp((0.018 * height + 0.032 * crown) * species_factor(species, genus, leaf) * _of(form, 0), *CLAMPED)
    made = lambda source, seen, dbh, sure: F.struct(F.lit(source).alias("source"), F.lit(seen).alias("observed"), half_up(dbh, 3).alias("dbh"), half_up(dbh * math.pi, 3).alias("circumference"), sure.alias("confidence"))
    out = made("morphology-estimate", False, guess, F.when(form.isin("veteran", "pollarded"), 0.5).otherwise(0.42))
    for source, keys, factor in reversed(TRUNK_TAGS):
        value = _first_number(tags, keys)
        out = F.when(value > 0, made(source, True, clamp(value * factor, 0.05, 4.0), F.lit(0.99))).otherwise(out)
    return out


def trunk_profile(dbh: Column, form: Column) -> Column:
    """Radii in blocks: at breast height, at the base, above, of the major limbs, and the reach of the roots."""
    dbh = clamp(F.coalesce(F.nullif(dbh, F.lit(0.0)), F.lit(0.3)), 0.1, 3.0)
    buttress = _of(form, 1, 1.1)
    held = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("int")
    breast = held(F.ceil(dbh / 2 - 0.01), 0, 2)
    return F.struct(
        breast.alias("breast"), held(F.greatest(breast, F.ceil(dbh / 2 * buttress)), 0, 3).alias("base"), held(F.floor(breast * 0.75), 0, 2).alias("upper"),
        held(F.floor(dbh * buttress * 1.6 + 0.5), 1, 5).alias("roots"), held(F.floor(dbh / 1.15), 0, 2).alias("limbs"),
    )


def with_form(rows: DataFrame, tags: str, height: str, crown: str, species: str, genus: str, leaf: str, asymmetry: str, coverage: str) -> DataFrame:
    """Adds form, confidence, inferred, stems, trunk, branch, density and deadwood: a stated form, else the one with most points.

    Missing sizes give no points. Veterans need several signs: below 0.62 points a tree counts as mature.
    """
    said = lambda *ks: _said(*(tag(F.col(tags), k) for k in ks))
    yes = lambda *ks: F.coalesce(*(F.when(F.lower(F.col(tags)[k]).isin("yes", "true", "1"), True) for k in ks), F.lit(False))
    some = lambda rule, n: F.when(F.coalesce(rule, F.lit(False)), n).otherwise(0.0)
    h, c, lopsided, covered = F.col(height), F.col(crown), F.coalesce(F.col(asymmetry), F.lit(0.0)), F.col(coverage)
    leafy = F.coalesce(F.lower(leaf).rlike("broad|deciduous") & ~F.lower(leaf).rlike("needle|conifer"), F.lit(False))
    rows = rows.withColumns({
        "_stems": F.floor(F.coalesce(*(number_or_null(F.col(tags)[k]) for k in ("stem_count", "stems", "tree:stem_count")))),
        "_many": F.coalesce(F.floor(number_or_null(F.col(tags)["stem_count"])), F.lit(0)), "_multi": yes("multi_stem", "multistem"), "_cut": yes("pollarded") | said("management", "form", "tree_form").rlike("pollard"),
        "_hurt": said("health", "condition", "tree_condition", "damage", "deadwood").rlike("dead|dying|storm|broken|split|damag|declin|cavity|hollow"), "_old": yes("veteran", "ancient") | said("age_class", "tree_age", "form").rlike("veteran|ancient"),
        "_stated": cascade(said("structural_form", "tree_form", "form", "age_class", "tree_age"), EXPLICIT_FORMS), "_broad": leafy | _said(F.col(species), F.col(genus)).rlike(BROADLEAF), "_slender": c / F.greatest(F.lit(1.0), h),
    })
    points = {
        "pollarded": some(F.col("_cut"), 1.0), "multi-stem": some(F.col("_stems") >= 2, 1.0) + some(F.col("_multi"), 0.9), "damaged": some(F.col("_hurt"), 0.95) + some(lopsided >= 0.28, 0.12),
        "veteran": some(F.col("_old"), 1.0) + some(F.col("_broad") & (c >= 12), 0.34) + some(F.col("_broad") & (F.col("_slender") >= 0.85), 0.28) + some(lopsided >= 0.45, 0.13) + some(F.col("_broad") & (covered >= 115), 0.18),
        "mature": some(h >= 10, 0.35) + some(h >= 15, 0.25) + some(c >= 7, 0.25), "young": some(h < 6, 0.72) + some((h >= 6) & (h < 10), 0.42) + some(c < 4.5, 0.38) + some((F.col("_slender") <= 0.38) & (h < 9), 0.18),
    }
    # the most points; of equals the first in FORMS
    rows = rows.withColumns({"_best": F.array_max(F.array(*(F.struct(half_up(points[f], 6).alias("points"), F.lit(-i).alias("at"), F.lit(f).alias("form")) for i, f in enumerate(FORMS)))), "_mature": points["mature"]})
    best, stated = F.col("_best"), F.col("_stated")
    unsure = best["points"] < 0.35
    timid = ~unsure & (best["form"] == "veteran") & (best["points"] < 0.62)
    rows = rows.withColumns({
        "form": F.coalesce(stated, F.when(unsure, F.when(h < 8, "young").otherwise("mature")).when(timid, "mature").otherwise(best["form"])),
        "_sure": F.when(stated.isNotNull(), 0.98).when(unsure, 0.35).when(timid, F.greatest(F.lit(0.48), F.col("_mature"))).otherwise(clamp(best["points"], 0.35, 0.98)),
    })
    form, sure = F.col("form"), F.col("_sure")
    stems = F.when(stated.isNotNull(), F.when(form == "multi-stem", F.greatest(F.lit(2), F.col("_many"))).otherwise(1)).when(F.col("_stems") >= 2, F.col("_stems")).when(form == "multi-stem", 2).otherwise(1)
    return rows.withColumns({
        "confidence": half_up(sure, 3), "inferred": stated.isNull(), "stems": stems.cast("long"), "trunk": half_up(1 + (_of(form, 2) - 1) * sure, 3), "branch": _of(form, 3), "density": _of(form, 4), "deadwood": half_up(_of(form, 5, 0.0) * sure, 3),
    }).drop("_stems", "_many", "_multi", "_cut", "_hurt", "_old", "_stated", "_broad", "_slender", "_best", "_mature", "_sure")


def with_lean(rows: DataFrame, tags: str, height: str, crown: str, offset: tuple[str, str], asymmetry: str, slope: tuple[str, str, str], pressure: tuple[str, str, str]) -> DataFrame:
    """Adds source, observed, dx, dz, shift, angle and confidence of a trunk's top: a stated vector or angle, else from crown offset, slope and open sides.

    slope, pressure: the two parts of a direction, and a grade or a strength.
    """
    number = lambda *ks: F.coalesce(*(number_or_null(F.col(tags)[k]) for k in ks))
    col, zero = F.col, F.lit(0.0)
    known = lambda parts: F.coalesce((F.hypot(parts[0], parts[1]) >= 1e-6) & col(parts[2]).isNotNull(), F.lit(False))
    size = lambda name: F.greatest(F.lit(1.0), F.coalesce(F.nullif(col(name), zero), F.lit(1.0)))
    rows = rows.withColumns({
        "_turn": number("tree:lean_direction", "lean_direction", "tpmap:lean_direction_deg"), "_tilt": clamp(F.abs(number("tree:lean", "lean", "tree:lean_angle", "tpmap:lean_angle_deg")), 0.0, 25.0), "_x": number("tpmap:trunk_lean_dx_m", "tree:lean_dx"), "_z": number("tpmap:trunk_lean_dz_m", "tree:lean_dz"),
        "_h": size(height), "_c": size(crown), "_ox": F.coalesce(col(offset[0]), zero), "_oz": F.coalesce(col(offset[1]), zero), "_sloped": known(slope), "_pressed": known(pressure),
    }).withColumn("_o", F.hypot("_ox", "_oz"))
    rows = rows.withColumn("_uneven", clamp(F.coalesce(col(asymmetry), col("_o") / F.greatest(F.lit(0.5), col("_c") / 2)), 0.0, 1.0))
    grade, strength = F.abs(col(slope[2])), col(pressure[2])
    rows = rows.withColumns({
        "_pull": F.when((col("_o") >= 0.75) & (col("_uneven") >= 0.08), clamp(0.16 + col("_uneven") * 0.28, 0.16, 0.42)).otherwise(0.0),
        "_down": F.when(col("_sloped") & (grade >= 0.08), F.least(F.lit(1.25), col("_h") * 0.035 * clamp(grade, 0.0, 0.6)) / F.hypot(slope[0], slope[1])).otherwise(0.0),
        "_push": F.when(col("_pressed") & (strength > 0.05), F.least(F.lit(1.5), col("_c") * 0.06 * clamp(strength, 0.0, 1.0)) / F.hypot(pressure[0], pressure[1])).otherwise(0.0),
    })
    part = lambda i, o: col(o) * col("_pull") - F.coalesce(col(slope[i]), zero) * col("_down") + F.coalesce(col(pressure[i]), zero) * col("_push")
    rows = rows.withColumns({"_dx": part(0, "_ox"), "_dz": part(1, "_oz")}).withColumn("_raw", F.hypot("_dx", "_dz"))
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.least(F.lit(2.5), col("_h") * 0.12)) / F.nullif(col("_raw"), zero))
    angled = col("_tilt").isNotNull() & col("_turn").isNotNull()
    source = F.when(col("_x").isNotNull() | col("_z").isNotNull(), "explicit-lean-vector").when(angled, "explicit-lean-angle").when(col("_raw") < 0.2, "vertical-default").otherwise("inferred-structural-evidence")
    rows = rows.withColumns({"source": source, "_k": held, "_far": F.when(col("_tilt") < 0.5, 0.0).otherwise(F.tan(F.radians("_tilt")) * 10)})
    by = lambda vector, angle, inferred: F.when(col("source") == "explicit-lean-vector", vector).when(col("source") == "explicit-lean-angle", angle).when(col("source") == "vertical-default", 0.0).otherwise(inferred)
    x, z = F.coalesce(col("_x"), zero), F.coalesce(col("_z"), zero)
    sure = clamp(0.42 + col("_uneven") * 0.3 + F.when(col("_sloped"), 0.08).otherwise(0.0) + F.when(col("_pressed"), 0.08).otherwise(0.0), 0.35, 0.78)
    return rows.withColumns({
        "observed": col("source").startswith("explicit"), "dx": half_up(by(x, F.sin(F.radians("_turn")) * col("_far"), col("_dx") * col("_k")), 3), "dz": half_up(by(z, -F.cos(F.radians("_turn")) * col("_far"), col("_dz") * col("_k")), 3),
        "shift": half_up(by(F.hypot(x, z), col("_far"), col("_raw") * col("_k")), 3), "angle": half_up(by(F.lit(None).cast("double"), F.when(col("_tilt") < 0.5, 0.0).otherwise(col("_tilt")), F.degrees(F.atan2(col("_raw") * col("_k"), col("_h")))), 3),
        "confidence": half_up(F.when(col("source").startswith("explicit"), 0.98).when(col("source") == "vertical-default", 1.0).otherwise(sure), 3),
    }).drop("_turn", "_tilt", "_x", "_z", "_h", "_c", "_ox", "_oz", "_sloped", "_pressed", "_o", "_uneven", "_pull", "_down", "_push", "_dx", "_dz", "_raw", "_k", "_far")


def axis_offset(shift: Column, share: Column) -> Column:
    """How far the trunk's axis is off at a share of its height: none at the base, eased to the top."""
    t = clamp(F.coalesce(share, F.lit(0.0)), 0.0, 1.0)
    return shift * (t * t * (3 - 2 * t))


def stem(dbh: Column, form: Column, tags: Column, species: Column, genus: Column) -> Column:
    """struct<form, stated, bark> of the trunk's section."""
    dbh, taxon = clamp(F.coalesce(F.nullif(dbh, F.lit(0.0)), F.lit(0.3)), 0.08, 4.5), _said(species, genus)
    old = F.coalesce(form.isin("veteran", "damaged", "multi-stem", "pollarded"), F.lit(False))
    stated = cascade(F.regexp_replace(F.lower(F.coalesce(*(tag(tags, k) for k in ("tree:trunk_form", "trunk_form", "tpmap:trunk_form")))), "[_ ]+", "-"), STEM_FORMS)
    guessed = F.when(form == "multi-stem", "split").when(old & (dbh >= 0.75), "irregular").when(taxon.rlike("hornbeam|carpinus|yew|taxus|sweet chestnut|castanea") & (dbh >= 0.55), "fluted").when(dbh >= 1.15, "elliptical").otherwise("round")
    bark = F.coalesce(cascade(taxon, BARK), F.when(form.isin("veteran", "damaged"), "weathered").otherwise("mixed-bark"))
    return F.struct(F.coalesce(stated, guessed).alias("form"), stated.isNotNull().alias("stated"), bark.alias("bark"))


def preset(species: Column, genus: Column, leaf: Column, crown: Column, height: Column) -> Column:
    """The model of a tree by its taxon; oaks that are tall, wide or said to be old are ancient."""
    said = _said(species, genus)
    oak = F.when((height >= 18) | (crown >= 14) | said.rlike("veteran|ancient"), "ancient-oak").otherwise("broadleaf-oak")
    needle = F.coalesce(F.lower(leaf).contains("needle"), F.lit(False))
    return F.coalesce(cascade(said, TAXA), F.when(needle, "spruce"), F.when(said.rlike("oak|quercus"), oak), F.lit("broadleaf-oak"))


def dimensions(name: Column, height: Column, crown: Column) -> Column:
    """struct<height, crown>: whole metres, from 3 to 45 and from 3 to 22; an unknown crown follows the model's width."""
    width = F.lit(0.58)
    for n, (_, ratio) in PRESETS.items():
        width = F.when(name == n, ratio).otherwise(width)
    tall = clamp(F.floor(F.coalesce(F.nullif(height, F.lit(0.0)), F.lit(10.0)) + 0.5), 3, 45)
    return F.struct(tall.cast("long").alias("height"), clamp(F.floor(F.coalesce(F.when(crown > 0, crown), tall * width) + 0.5), 3, 22).cast("long").alias("crown"))


def crown_radius(name: Column, share: Column, radius: Column) -> Column:
    """The crown's radius at a share of its height, by the model's shape."""
    u = clamp(share, 0.0, 1.0)
    curve = F.sin(u * math.pi)
    out = 0.42 + curve * 0.58
    for n, (shape, _) in PRESETS.items():
        if shape == "conical":
            part = 0.22 + (1 - u) * 0.78
        elif shape in OVAL:
            least, begin, span = OVAL[shape]
            part = F.greatest(F.lit(least), F.sin((begin + u * span) * math.pi))
        elif shape in ROUNDED:
            part = ROUNDED[shape][0] + curve * ROUNDED[shape][1]
        else:
            continue
        out = F.when(name == n, part).otherwise(out)
    return radius * out


def crown_geometry(west: Column, east: Column, north: Column, south: Column, radius: Column, base: Column, fallback_base: Column, height: Column) -> Column:
    """struct<radius_x, radius_z, offset_x, offset_z, base>: a crown's ellipse from its reach on four sides; unknown sides have the model's radius."""
    spare = F.greatest(F.lit(0.5), F.coalesce(radius, F.lit(0.5)))
    w, e, n, s = (F.coalesce(F.when(v > 0, v), spare) for v in (west, east, north, south))
    low = F.coalesce(F.when(base.isNotNull(), F.greatest(F.lit(2.0), F.least(F.greatest(F.lit(2.0), height - 2), F.floor(base + 0.5).cast("double")))), fallback_base)
    half = lambda v: F.greatest(F.lit(0.5), v / 2)
    return F.struct(half(w + e).alias("radius_x"), half(n + s).alias("radius_z"), ((e - w) / 2).alias("offset_x"), ((s - n) / 2).alias("offset_z"), low.alias("base"))


def crown_reach(angle: Column, geometry: Column) -> Column:
    """How far an elliptical crown reaches from the trunk in a direction: half a metre at least."""
    rx, rz, ox, oz = (geometry[c] for c in ("radius_x", "radius_z", "offset_x", "offset_z"))
    u, v = F.cos(angle) / rx, F.sin(angle) / rz
    a, half_b, c = u * u + v * v, -(u * ox / rx + v * oz / rz), F.pow(ox / rx, 2) + F.pow(oz / rz, 2) - 1
    return F.greatest(F.lit(0.5), (F.sqrt(F.greatest(F.lit(0.0), half_b * half_b - a * c)) - half_b) / a)


def limb_radius(diameter: Column) -> Column:
    """Blocks of a limb's radius; limbs below a block stay lines."""
    return F.when(diameter < 0.72, 0).when(diameter < 1.65, 1).when(diameter < 2.75, 2).otherwise(3)


def branches(dbh: Column, form: Column, conifer: Column, tags: Column, species: Column, genus: Column) -> Column:
    """struct<diameter, primary, secondary, tertiary, forked, crotch, observed> of the limbs: stated, else from trunk, species and form."""
    dbh, taxon = clamp(F.coalesce(dbh, F.lit(0.3)), 0.08, 4.5), _said(species, genus)
    stated = F.coalesce(*(number_or_null(tags[k]) for k in ("tree:primary_branch_diameter", "primary_branch_diameter", "tpmap:primary_limb_diameter_m")))
    said = F.coalesce(*(tag(tags, k) for k in ("tree:forked", "forked", "tpmap:forked_trunk")))
    fork = F.when(said.isin("1", "yes", "true"), True).when(said.isin("0", "no", "false"), False)
    kin = F.lit(0.90)
    for pattern, scale in reversed(LIMB_SPECIES):
        kin = F.when(taxon.rlike(pattern), scale).otherwise(kin)
    shape = F.when(form == "veteran", 1.20).when(form == "pollarded", 1.12).when(form == "young", 0.72).when(form == "damaged", 0.88).otherwise(1.0)
    diameter = F.greatest(F.lit(0.06), F.least(F.greatest(F.lit(0.08), dbh * 0.62), F.coalesce(stated, dbh * 0.38 * kin * shape)))
    second, third = F.when(conifer, 0.50).otherwise(0.56), F.when(conifer, 0.42).otherwise(0.48)
    forked = F.coalesce(fork, form.isin("multi-stem", "pollarded", "veteran"), F.lit(False))
    primary = limb_radius(diameter)
    secondary = F.least(primary, limb_radius(diameter * second))
    crotch = F.greatest(F.lit(0), F.least(F.lit(2), F.floor(dbh * F.when(forked, 0.48).otherwise(0.34) / 2 + 0.5))).cast("int")
    return F.struct(
        half_up(diameter, 3).alias("diameter"), primary.alias("primary"), secondary.alias("secondary"), F.least(secondary, limb_radius(diameter * second * third)).alias("tertiary"),
        forked.alias("forked"), crotch.alias("crotch"), (stated.isNotNull() | fork.isNotNull()).alias("observed"),
    )
