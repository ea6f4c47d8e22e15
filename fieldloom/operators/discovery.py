"""Planning discovery: relevance of applications and documents, queues with limits, breakers, shard selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions.text import cascade, clean_html

#: Words of useful documents, of noise, of direct files, the points of a title, and the roles in order.
USEFUL = r"(?i)(?:\bplans?\b|drawing|layout|general arrangement|elevation|section|roof|landscap|planting|tree|arbor|material|finish|surface|hardscape|paving|path|plaza|ride|coaster|track|\bsupport(?:s| structure| layout| detail| foundation)?\b|structure|foundation|footing|drain|water|flood|earthwork|level|topograph|survey|boundary|fence|wall|retaining|bridge|tunnel|lighting|street furniture|utilities|services|as[ -]?built|existing)"
NOISE = r"(?i)(?:application form|planning statement|decision notice|screening opinion|letter of representation|ownership certificate|community infrastructure levy|cil form|consultation response|neighbour letter|site notice|press notice|fee|validation checklist|email|correspondence|committee agenda)"
FILE = r"(?i)\.(?:pdf|tiff?|png|jpe?g|zip|dxf|dwg|ifc)(?:$|[?#])"
DIRECT = r"(?i)(?:AttachmentShowServlet|ViewDocument|DownloadFile|download|attachment|viewfile|image)"
DOCUMENT_RULES = (
    (r"(?i)approved|decision|condition|as[ -]?built|existing", 25), (r"(?i)general arrangement|site plan|layout|elevation|section", 20), (r"(?i)ride|coaster|track|\bsupport(?:s| structure| layout| detail| foundation)?\b", 20),
)
NOISE_POINTS = -80
ROLES = (
    ("as-built-drawing", r"(?i)as[ -]?built|record drawing|completion plan"),
    ("ride-layout-and-structure", r"(?i)ride|coaster|track|\bsupport(?:s| structure| layout| detail| foundation)?\b|foundation|footing"),
    ("site-layout", r"(?i)site.*(?:plan|layout)|masterplan|general arrangement|proposed layout"),
    ("elevations-and-sections", r"(?i)elevation|section|roof|level"),
    ("landscape-and-vegetation", r"(?i)landscap|planting|tree|arbor|hedge|ecolog"),
    ("materials-and-surfaces", r"(?i)material|finish|surface|paving|path|plaza|hardscape"),
    ("water-and-drainage", r"(?i)water|drain|flood|pond|lake"),
    ("structures-and-earthworks", r"(?i)wall|fence|barrier|bridge|tunnel|earthwork|retaining"),
)
#: Categories of a proposal with their points, reasons that exclude an application with the points that they take, the states that cost
#: a little, and the points of names and of the site.
CATEGORIES = (
    ("ride", r"(?i)roller[ -]?coaster|\bride\b|attraction|amusement|queue(?:line)?|station building|zip[ -]?wire|tethered balloon|climbing wall|play equipment", 240),
    ("building", r"(?i)\bbuilding\b|hotel|lodge|restaurant|caf[eé]|extension|roof|kiosk|cabin|portal|entrance|toilet|shop|office|warehouse|\bstructure\b|modular unit|container|stage|tent", 140),
    ("site-layout", r"(?i)landscap|\bpaths?\b|footway|access|car park|parking|plaza|paving|surfacing|hardstand|ground[ -]?work|infrastructure|earthwork|master[ -]?plan|site plan|area plan", 120),
    ("vegetation-water", r"(?i)\btrees?\b|planting|\bgardens?\b|woodland|water|drain|flood|\blake\b|\bpond\b|\bdam\b|ecolog|habitat", 100),
    ("boundary-structure", r"(?i)\bfenc|\bwalls?\b|barrier|bridge|tunnel|railing|balustrade|gate|retaining", 90),
    ("heritage", r"(?i)listed building|heritage|restoration|conservation|historic", 90),
    ("detail", r"(?i)\bsign|advertisement|artwork|sculpture|theming|lighting|floodlight", 70),
    ("condition", r"(?i)discharg(?:e|ing).*condition|\bconditions?\b.*(?:application|permission)|variation of (?:a )?conditions?|non[ -]?material amendment|reserved matters", 60),
    ("structural-works", r"(?i)construction|erection|demolition|alterations?|development|external works|refurbish|redevelop|reposition|relocat|install(?:ation)?|replacement", 60),
)
EXCLUSIONS = (
    ("consultation-copy", r"(?i)^consultation from\b|consultation .*in connection with an application", -1000),
    ("telecommunications", r"(?i)telecommunications?|antenna|monopole|radio equipment|mobile network|microwave dish|cell site", -180),
    ("screening-only", r"(?i)screening opinion request", -120),
)
STATES, STATE_POINTS = r"(?i)withdrawn|refused|invalid|demolish(?:ed|ion)?|superseded", -8
PHRASE_POINTS, WORD_POINTS, TOKEN_POINTS = 40, 20, 4
SITE_POINTS = {"primary": 100, "secondary": 25, "none": -200}
SHORTEST_TOKEN, SHORTEST_NAME = 4, 5

def document_class(title: Column, url: Column) -> Column:
    """struct<role, score, relevant> of a document by its title and address."""
    text = F.trim(F.regexp_replace(F.concat_ws(" ", title, F.try_url_decode(url)), r"\s+", " "))
    score = F.when(text.rlike(USEFUL) | F.coalesce(url.rlike(FILE), F.lit(False)), 45).otherwise(5) + sum((F.when(text.rlike(p), n).otherwise(0) for p, n in (*DOCUMENT_RULES, (NOISE, NOISE_POINTS))), F.lit(0))
    return F.struct(cascade(text, list(ROLES), "planning-document").alias("role"), score.alias("score"), (score >= 30).alias("relevant"))


def direct_link(url: Column) -> Column:
    """Whether an address names a document's file or a portal's way of sending one."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return path.rlike(FILE) | path.rlike(DIRECT)


def ranked_documents(links: DataFrame, page: str, url: str, text: str) -> DataFrame:
    """Direct links of each page with their class and place: the best score first, then by address; equal addresses once."""
    first = links.filter(direct_link(F.col(url))).groupBy(page, url).agg(F.min_by(text, "pos").alias(text))
    scored = first.withColumn("_c", document_class(F.col(text), F.col(url))).select(page, url, "_c.*")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), url)))


def application_class(rows: DataFrame, terms: Column, park: Column, identity: Column) -> DataFrame:
    """Applications with score, relevant, site_match, categories and excluded_reason.

    rows has reference, address, location, proposal, description, status, decision (texts) and discovery_score; columns that are missing count as empty. terms
    (array) are the search terms of the authority, the first of which names the site as `park` and `identity` (array) do; each row may have its own.
    Categories and exclusions read the proposal (or the description), secondary names the address (or the location), all else every field.
    """
    said = lambda c: F.coalesce(clean_html(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit("")
    first = lambda a, b: F.coalesce(F.nullif(F.col(f"_said.{a}"), F.lit("")), F.col(f"_said.{b}"))
    fields = ("reference", "address", "proposal", "description", "status", "decision", "location")
    low = lambda xs, least: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda t: F.lower(F.coalesce(clean_html(t), F.lit("")))), lambda t: F.char_length(t) >= least)
    met = rows.withColumns({"_said": F.struct(*(F.lower(said(c)).alias(c) for c in fields)), "_terms": low(terms, 1), "_site": low(F.concat(F.array(park, F.get(terms, 0)), F.coalesce(identity, F.array().cast("array<string>"))), SHORTEST_NAME)})
    met = met.withColumns({
        "_all": F.concat_ws(" ", *(F.nullif(F.col(f"_said.{c}"), F.lit("")) for c in fields if c != "location")), "_proposal": first("proposal", "description"), "_place": first("address", "location"),
        "_near": F.array_except(low(F.slice(terms, 2, 1 << 20), SHORTEST_NAME), F.col("_site")),
    })
    tokens = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda x: (F.char_length(x) >= SHORTEST_TOKEN) & F.col("_all").contains(x))) * TOKEN_POINTS
    named = F.aggregate("_terms", F.lit(0), lambda n, t: n + F.when(F.col("_all").contains(t), F.when(t.contains(" "), PHRASE_POINTS).otherwise(WORD_POINTS)).otherwise(0) + tokens(t))
    site = F.when(F.exists("_site", lambda t: F.col("_all").contains(t)), "primary").when(F.exists("_near", lambda t: F.col("_place").contains(t)), "secondary").otherwise("none")
    kinds = F.filter(F.array(*(F.when(F.col("_proposal").rlike(p), F.lit(c)) for c, p, _ in CATEGORIES)), lambda x: x.isNotNull())
    met = met.withColumns({"_named": named, "site_match": site, "categories": kinds})
    points = sum((F.when(F.col("_proposal").rlike(p), n).otherwise(0) for _, p, n in (*CATEGORIES, *EXCLUSIONS)), F.when(F.col("_all").rlike(STATES), STATE_POINTS).otherwise(0))
    points = points + F.col("_named") + F.element_at(F.create_map(*(F.lit(x) for pair in SITE_POINTS.items() for x in pair)), F.col("site_match"))
    known = (F.col("site_match") == "primary") | ((F.col("site_match") == "secondary") & F.array_contains("categories", "ride"))
    reason = F.when(~known, "outside-park-identity").when(F.size("categories") == 0, "no-geometry-category")
    for name, pattern, _ in reversed(EXCLUSIONS):
        reason = F.when(F.col("_proposal").rlike(pattern), name).otherwise(reason)
    found = F.coalesce(F.col("discovery_score"), F.lit(0)) if "discovery_score" in rows.columns else F.lit(0)
    met = met.withColumns({"score": points + found, "excluded_reason": reason})
    return met.withColumn("relevant", F.col("excluded_reason").isNull()).drop("_said", "_terms", "_site", "_near", "_all", "_proposal", "_place", "_named")

def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """http(s) addresses of listed hosts without a way up in the path."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:?#]+)", 1))
    return F.coalesce(host.isin(*hosts) & ~url.contains(".."), F.lit(False))


def queue(documents: DataFrame, per_application: int, order: list[Column], limit: int) -> DataFrame:
    """The first documents of each application, in order of the applications, up to the limit, with position.

    The limit is the feature (a crawl's budget): the ordered head is taken without sorting all rows into one task.
    """
    best = documents.withColumn("_n", F.row_number().over(Window.partitionBy("application").orderBy(*order))).filter(F.col("_n") <= per_application).drop("_n")
    head = best.orderBy(F.desc("application_score"), "application", *order).limit(limit)
    return head.withColumn("position", F.row_number().over(Window.orderBy(F.desc("application_score"), "application", *order)) - 1)


def breaker_states(outcomes: DataFrame, host: str, order: list[str], failed: str, limit: int = 2) -> DataFrame:
    """Whether each request finds its host's breaker open: `limit` failures since the last success before it."""
    by = Window.partitionBy(host).orderBy(*order)
    runs = outcomes.withColumn("_won", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy(host, F.coalesce("_won", F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("is_open", F.coalesce(F.sum(F.when(F.col(failed), 1).otherwise(0)).over(before) >= limit, F.lit(False))).drop("_won")


def complete_attempt(artifacts: DataFrame, shards: int) -> DataFrame:
    """Artifacts of the newest attempt that has every shard exactly once."""
    whole = artifacts.groupBy("attempt").agg(F.countDistinct("shard").alias("d"), F.count("*").alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high"))
    good = whole.filter((F.col("d") == shards) & (F.col("n") == shards) & (F.col("low") == 0) & (F.col("high") == shards - 1)).agg(F.max("attempt").alias("attempt"))
    return artifacts.join(good, "attempt", "left_semi")
