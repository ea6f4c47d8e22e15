"""Drawings: which views, anchors and shapes may become geometry. Everything else stays evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of drawing titles, of document metadata and of places, and the roles of plans.
PLAN_VIEW = r"(?i)\b(?:site\s+(?:plan|layout)|master\s*plan|general\s+arrangement|(?:existing|proposed|as[- ]?built|record)\s+(?:site\s+)?(?:plan|layout)|plan\s+as\s+(?:existing|proposed)|landscape\s+plan|planting\s+plan|drainage(?:\s+strategy)?\s+plan|earthworks?\s+plan|track\s+(?:plan|layout|alignment)|ride\s+(?:plan|layout)|support\s+(?:plan|layout)|foundation\s+(?:plan|layout)|floor\s+plan|roof\s+plan)\b"
NON_PLAN_VIEW = r"(?i)\b(?:elevations?|sections?|maintenance\s+schedule|schedules?|reports?|statements?|specifications?|legends?|drawing\s+key|key\s+plan|notes?\s+sheet|typical\s+details?|detail\s+sheet)\b"
PLAN_ROLES = ("site-layout", "ride-layout-and-structure", "landscape-and-vegetation", "materials-and-surfaces", "water-and-drainage", "structures-and-earthworks", "as-built-drawing")
POSTCODE = r"(?i)\b(?:GIR\s?0AA|[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"
METADATA = r"(?i)\b(?:drawing\s*(?:no|number)|revision|rev\.?\s*[a-z0-9]+|drawn\s+by|checked\s+by|approved\s+by|client|architect|consultant|copyright|project\s+title|sheet\s+(?:no|number|size)|scale\s*(?:1|@)|telephone|phone|email|www\.|document\s+status)\b"
LOCATIVE = r"(?i)\b(?:existing|proposed|retained|new|track|alignment|building|station|path|walkway|plaza|queue|bridge|boardwalk|tunnel|wall|fence|railing|tree|woodland|hedge|pond|lake|watercourse|channel|drainage|rock|contour|level|support|catwalk|platform|footing|foundation)\b"
STREET = r"(?i)\b(?:road|street|lane|avenue|drive|close|court|house)\b"
LEGEND = r"(?i)\b(?:legend|key)\b|\bindicated\s+(?:thus|as)\b"
THIN = ("path", "bridge", "tunnel", "wall", "fence", "terrain")
SPANS = {"building": 250, "ride_support": 120, "ride_attachment": 400}
CELL = 64.0


def _squeezed(*parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))


def view(title: Column, description: Column, role: Column, page: Column) -> Column:
    """struct<eligible, status, reason>: whether a drawing is a plan, by its title, then its role, then the text of the page."""
    named, role = _squeezed(title, description), F.lower(F.coalesce(F.nullif(role, F.lit("")), F.lit("planning-document")))
    plan = named.rlike(PLAN_VIEW)
    yes = lambda reason: F.struct(F.lit(True).alias("eligible"), F.lit("plan-view").alias("status"), reason.alias("reason"))
    no = lambda reason: F.struct(F.lit(False).alias("eligible"), F.lit("evidence-only").alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(plan, yes(F.lit("document-title-plan-view")))
        .when(role == "elevations-and-sections", no("document-role-elevations-and-sections"))
        .when(named.rlike(NON_PLAN_VIEW), no("document-title-non-plan-view"))
        .when((role == "water-and-drainage") & named.rlike(r"(?i)\bschedule\b"), no("drainage-schedule-not-plan-view"))
        .when(role.isin(*PLAN_ROLES), yes(F.concat(F.lit("document-role-"), role)))
        .when(_squeezed(page).rlike(PLAN_VIEW), yes(F.lit("page-title-plan-view")))
        .otherwise(no("plan-view-not-established"))
    )


def anchor_allowed(text: Column, cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Whether a recognised label may stand for a place: no metadata, legend or address, and in the title margin only with words of places."""
    said = _squeezed(text)
    address = said.rlike(STREET) & said.rlike(r"[,\d]") & (F.char_length(said) > 18)
    margin = F.coalesce((cx > width * 0.78) | (cy > height * 0.88), F.lit(False)) & cx.isNotNull() & cy.isNotNull()
    barred = said.rlike(POSTCODE) | said.rlike(METADATA) | address | said.rlike(LEGEND)
    return F.coalesce((said != "") & ~barred & (~margin | said.rlike(LOCATIVE)), F.lit(False))


def shape_allowed(kind: Column, closed: Column, width: Column, height: Column, area: Column, scale: Column) -> Column:
    """Whether a shape of a size in pixels is plausible for its kind at `scale` metres a pixel."""
    w, h = width * scale, height * scale
    span, fill = F.greatest(w, h), area * scale * scale / F.nullif(w * h, F.lit(0.0))
    named = F.coalesce(kind, F.lit(""))
    too_long = F.lit(False)
    for k, most in SPANS.items():
        too_long = too_long | ((named == k) & (span > most))
    hollow = ((named == "building") & (span > 40) & (fill < 0.012)) | (~named.isin(*THIN) & (span > 300) & (fill < 0.0025))
    return F.coalesce((scale > 0) & (span >= 0.02) & ~too_long & ~(F.coalesce(closed, F.lit(False)) & F.coalesce(hollow, F.lit(False))), F.lit(False))


def glyphs(shapes: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """The shapes that are parts of recognised letters: inside a padded text box and small for it.

    shapes: page, min_x, min_y, max_x, max_y, closed, length; boxes: page, x0, y0, x1, y1, text, confidence. The pair meets in the
    cell of the shape's low corner, so work follows the boxes' area, not shapes times boxes.
    """
    size = F.col("y1") - F.col("y0")
    seen = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.coalesce("confidence", F.lit(1.0)) >= 0.7) & (F.char_length(F.trim("text")) >= 2))
    seen = seen.withColumns({"_pad": F.greatest(F.lit(1.5), F.least(F.lit(4.0), size * 0.18)), "_h": size, "_w": F.col("x1") - F.col("x0")})
    cells = lambda low, high: F.sequence(F.floor((F.col(low) - F.col("_pad")) / CELL), F.floor((F.col(high) + F.col("_pad")) / CELL))
    seen = seen.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1"))).select(page, "_cx", "_cy", "x0", "y0", "x1", "y1", "_pad", "_h", "_w")
    placed = shapes.withColumns({"_cx": F.floor(F.col("min_x") / CELL), "_cy": F.floor(F.col("min_y") / CELL)})
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    inside = (F.col("min_x") >= F.col("x0") - F.col("_pad")) & (F.col("max_x") <= F.col("x1") + F.col("_pad")) & (F.col("min_y") >= F.col("y0") - F.col("_pad")) & (F.col("max_y") <= F.col("y1") + F.col("_pad"))
    small = (h <= F.greatest(F.lit(8.0), F.col("_h") * 1.9)) & (w <= F.greatest(F.lit(12.0), F.col("_h") * 2.8))
    sparse = (h <= F.col("_h") * 2.2) & (w * h / F.greatest(F.lit(1.0), F.col("_w") * F.col("_h")) <= 0.24)
    glyph = inside & F.when(F.col("closed"), small | sparse).otherwise(F.col("length") <= F.greatest(F.lit(12.0), F.col("_h") * 3.2))
    return placed.join(seen, [page, "_cx", "_cy"]).filter(glyph).select(*shapes.columns).distinct()


def merged_anchors(anchors: DataFrame, order: list[str]) -> DataFrame:
    """Anchors of one class, text and place (to a tenth) once: the first by `order`."""
    place = lambda c: F.floor(F.col(c) * 10 + 0.5)
    key = [F.col("page"), F.col("class"), place("cx"), place("cy"), F.lower("text")]
    return anchors.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def spatial_contract(features: DataFrame, bounds: tuple[float, float, float, float], least_span: tuple[float, float], least_counts: dict[str, int], most_fanout: int = 64) -> DataFrame:
    """One row: status, failures and diagnostics of a world's features against the area that it must cover.

    features: kind, min_x, min_z, max_x, max_z, automatic, registered, fanout, label; bounds: min_x, min_z, max_x, max_z of the contract.
    """
    x0, z0, x1, z1 = map(float, bounds)
    c = F.col
    within = F.coalesce((c("min_x") >= x0) & (c("min_z") >= z0) & (c("max_x") <= x1) & (c("max_z") <= z1), F.lit(False))
    envelope = (c("kind") == "ride_track") & c("label").rlike(r"(?i)\b(?:max(?:imum)?\s+dimensions?|envelope|limit of deviation|clearance)\b")
    got = features.agg(
        F.count("*").alias("features"), F.count_if(~within).alias("outside"), F.count_if(c("automatic") & ~F.coalesce(c("registered"), F.lit(False))).alias("unregistered"),
        F.count_if(c("fanout") > most_fanout).alias("fanned_out"), F.count_if(envelope).alias("envelopes"),
        (F.coalesce(F.max("max_x") - F.min("min_x"), F.lit(0.0)) / (x1 - x0 + 1)).alias("ratio_x"), (F.coalesce(F.max("max_z") - F.min("min_z"), F.lit(0.0)) / (z1 - z0 + 1)).alias("ratio_z"),
        *(F.count_if(c("kind") == k).alias(f"n_{k}") for k in least_counts),
    )
    rules = [
        (c("features") == 0, F.lit("no features")), (c("ratio_x") < least_span[0], F.lit("x span")), (c("ratio_z") < least_span[1], F.lit("z span")),
        (c("outside") > 0, F.concat(F.lit("outside: "), c("outside"))), (c("unregistered") > 0, F.concat(F.lit("unregistered: "), c("unregistered"))),
        (c("fanned_out") > 0, F.concat(F.lit("fan-out: "), c("fanned_out"))), (c("envelopes") > 0, F.concat(F.lit("envelopes: "), c("envelopes"))),
        *((c(f"n_{k}") < n, F.concat(F.lit(f"{k}: "), c(f"n_{k}"), F.lit(f" of {n}"))) for k, n in least_counts.items()),
    ]
    failures = F.filter(F.array(*(F.when(rule, said) for rule, said in rules)), lambda x: x.isNotNull())
    return got.withColumn("failures", failures).withColumn("status", F.when(F.size("failures") > 0, "failed").otherwise("passed"))


def enforced(assessment: DataFrame) -> DataFrame:
    """The assessment, or an error where it failed."""
    said = F.concat(F.lit("spatial contract failed: "), F.array_join("failures", "; "))
    return assessment.withColumn("status", F.when(F.col("status") == "failed", F.raise_error(said)).otherwise(F.col("status")))
