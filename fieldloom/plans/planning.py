"""Queries over planning discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import discovery
from fieldloom.plans.tables import read

TERMS = ("Park", "Blue Lake", "Harbour Gardens")
SITE, KNOWN_AS = "Lagoon World", ("The Old Mill",)
PROPOSALS = ("Erection of a rollercoaster & station building", "Consultation from the neighbouring borough", "", "Antenna on the hotel roof", "New paths,\n planting and a pond", "Screening opinion request: lodge", "Discharge of planning condition 4", "Change of use", "Listed building: repair of the ride")
PLACES = ("Blue Lake Road", "harbour gardens", "Lagoon  World", "1 High Street", "", "The Old Mill, Lane End")
DECISIONS = ("granted", "Refused", "pending")

TITLES = ("Site plan", "Decision notice", "Neighbour letter", "Track layout", "Roof and wall finishes", "Email about a tree", "Pond, as-built", "Fees")


def _title() -> Column:
    return F.get(F.array(*map(F.lit, TITLES)), F.pmod(F.col("page_id"), F.lit(len(TITLES))).cast("int"))


def document_ranking(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", discovery.document_class(_title(), F.col("url")).alias("c")).select("page_id", "c.*")


def document_links(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(F.lit("/plans/a.pdf"), F.lit("/ViewDocument"), F.lit("/about"), F.lit("/b.DWG"))
    pages = read(spark, d, "pages").select(F.pmod(F.col("page_id"), F.lit(97)).alias("page"), F.col("page_id").alias("pos"), F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.get(ends, F.pmod(F.col("page_id"), F.lit(4)).cast("int")), F.lit("?t="), F.pmod(F.col("page_id"), F.lit(11))).alias("url"), _title().alias("title"))
    return discovery.ranked_documents(pages, "page", "url", "title")


def _pick(values: tuple[str, ...], over: int = 1) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(F.col("page_id") / over), F.lit(len(values))).cast("int"))


def application_ranking(spark: SparkSession, d: str) -> DataFrame:
    names = lambda xs: F.array(*map(F.lit, xs))
    rows = read(spark, d, "pages").select("page_id", F.col("url").alias("reference"), _pick(PLACES, 2).alias("address"), _pick(PROPOSALS).alias("proposal"), F.col("html").alias("description"), _pick(DECISIONS, 5).alias("decision"), F.pmod(F.col("page_id"), F.lit(50)).cast("int").alias("discovery_score"))
    got = discovery.application_class(rows, names(TERMS), F.lit(SITE), names(KNOWN_AS))
    return got.select("page_id", "score", "relevant", "site_match", F.array_join("categories", ",").alias("categories"), "excluded_reason")

def allowed_hosts(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return read(spark, d, "pages").select("page_id", discovery.host_allowed(F.concat(F.when(F.col("page_id") % 2 == 0, "https://docs.example.org").otherwise(F.concat(F.lit("https://"), host)), F.lit("/a")), ("docs.example.org", "www.example.com")).alias("allowed"))


def document_queue(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "orders").select(F.col("o_custkey").alias("application"), F.pmod(F.col("o_custkey") * 7, F.lit(101)).alias("application_score"), F.col("o_orderkey").alias("document"), F.col("o_totalprice").alias("score"))
    return discovery.queue(docs, 2, [F.desc("score"), F.asc("document")], 160).select("position", "application", "document")


def breaker_replay(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "events").withColumn("failed", F.pmod(F.col("event_id"), F.lit(3)) != 0)
    return discovery.breaker_states(seen, "user_id", ["ts", "event_id"], "failed").select("event_id", "is_open")


def shard_artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select((F.col("n_nationkey") / 5).cast("int").alias("attempt"), F.pmod(F.col("n_nationkey"), F.lit(5)).cast("int").alias("shard"), "n_name").filter("not (attempt = 4 and shard = 2)")
    return discovery.complete_attempt(rows, 5)


QUERIES = {f.__name__: f for f in (document_ranking, document_links, application_ranking, allowed_hosts, document_queue, breaker_replay, shard_artifacts)}
_AT = f"list_extract([{', '.join(repr(x) for x in TITLES)}], page_id % {len(TITLES)} + 1)"


def _class_sql(title: str, url: str) -> str:
    """Role, score and relevance of a title and an address."""
    roles = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in discovery.ROLES)
    points = " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {n} ELSE 0 END" for p, n in (*discovery.DOCUMENT_RULES, (discovery.NOISE, discovery.NOISE_POINTS)))
    score = f"CASE WHEN regexp_matches(t, '{discovery.USEFUL}') OR regexp_matches({url}, '{discovery.FILE}') THEN 45 ELSE 5 END + {points}"
    return f"SELECT *, CASE {roles} ELSE 'planning-document' END AS role, CAST({score} AS INT) AS score, ({score}) >= 30 AS relevant FROM (SELECT *, trim(regexp_replace({title} || ' ' || url_decode({url}), '\\s+', ' ', 'g')) AS t FROM {{src}})"


_SITE = [x.lower() for x in (SITE, TERMS[0], *KNOWN_AS) if len(x) >= discovery.SHORTEST_NAME]
_NEAR = [x.lower() for x in TERMS[1:] if len(x) >= discovery.SHORTEST_NAME and x.lower() not in _SITE]
_TOKENS = [x for t in TERMS for x in t.lower().split() if len(x) >= discovery.SHORTEST_TOKEN]
_WORTH = [*((t.lower(), discovery.PHRASE_POINTS if " " in t else discovery.WORD_POINTS) for t in TERMS), *((x, discovery.TOKEN_POINTS) for x in _TOKENS)]
_A = " + ".join([*(f"CASE WHEN contains(said, '{x}') THEN {n} ELSE 0 END" for x, n in _WORTH), *(f"CASE WHEN regexp_matches(proposal, '{p}') THEN {n} ELSE 0 END" for _, p, n in (*discovery.CATEGORIES, *discovery.EXCLUSIONS))])
_NAMES = ", ".join(f"CASE WHEN regexp_matches(proposal, '{p}') THEN '{c}' END" for c, p, _ in discovery.CATEGORIES)
_REASON = " ".join(f"WHEN regexp_matches(proposal, '{p}') THEN '{c}'" for c, p, _ in discovery.EXCLUSIONS)


def _sql_list(values: tuple[str, ...], over: int = 1) -> str:
    return f"list_extract([{', '.join(chr(39) + x + chr(39) for x in values)}], page_id // {over} % {len(values)} + 1)"


def _clean_sql(text: str) -> str:
    """Text of markup: without scripts, styles, comments and tags, entities decoded."""
    out = f"regexp_replace({text}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{value}')"
    return f"lower(trim(regexp_replace({out}, '\\s+', ' ', 'g')))"


ORACLE_SQL = {
    "document_ranking": f"SELECT page_id, role, score, relevant FROM ({_class_sql(_AT, 'url').format(src='pages')})",
    "document_links": f"""
WITH l AS (SELECT page_id % 97 AS page, page_id AS pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || list_extract(['/plans/a.pdf', '/ViewDocument', '/about', '/b.DWG'], page_id % 4 + 1) || '?t=' || page_id % 11 AS url, {_AT} AS title FROM pages),
u AS (SELECT page, url, arg_min(title, pos) AS title FROM l WHERE NOT contains(url, '/about') GROUP BY 1, 2)
SELECT page, url, role, score, relevant, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, url) AS INT) AS place FROM ({_class_sql('title', 'url').format(src='u')})""",
    "application_ranking": f"""
WITH c AS (SELECT page_id, {_clean_sql("url")} AS reference, {_clean_sql(_sql_list(PLACES, 2))} AS address, {_clean_sql(_sql_list(PROPOSALS))} AS proposal, {_clean_sql("html")} AS description, {_clean_sql(_sql_list(DECISIONS, 5))} AS decision FROM pages),
s AS (SELECT page_id, concat_ws(' ', nullif(reference, ''), nullif(address, ''), nullif(proposal, ''), nullif(description, ''), nullif(decision, '')) AS said, address, CASE WHEN proposal = '' THEN description ELSE proposal END AS proposal FROM c),
k AS (SELECT *, CASE WHEN {' OR '.join(f"contains(said, '{x}')" for x in _SITE)} THEN 'primary' WHEN {' OR '.join(f"contains(address, '{x}')" for x in _NEAR)} THEN 'secondary' ELSE 'none' END AS site_match, concat_ws(',', {_NAMES}) AS categories FROM s),
r AS (SELECT *, CASE {_REASON} WHEN NOT (site_match = 'primary' OR site_match = 'secondary' AND contains(categories, 'ride')) THEN 'outside-park-identity' WHEN categories = '' THEN 'no-geometry-category' END AS excluded_reason FROM k)
SELECT page_id, CAST({_A} + CASE WHEN regexp_matches(said, '{discovery.STATES}') THEN {discovery.STATE_POINTS} ELSE 0 END + CASE site_match {' '.join(f"WHEN '{x}' THEN {n}" for x, n in discovery.SITE_POINTS.items())} END + page_id % 50 AS INT) AS score,
  excluded_reason IS NULL AS relevant, site_match, categories, excluded_reason FROM r""",
    "allowed_hosts": "SELECT page_id, page_id % 2 = 0 OR lower(regexp_extract(url, '^https?://([^/]+)', 1)) IN ('docs.example.org', 'www.example.com') AS allowed FROM pages",
    "document_queue": "WITH b AS (SELECT o_custkey AS application, o_custkey * 7 % 101 AS s, o_orderkey AS document, o_totalprice AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2) SELECT CAST(row_number() OVER (ORDER BY s DESC, application, p DESC, document) - 1 AS INT) AS position, application, document FROM b QUALIFY position < 160",
    "breaker_replay": """
WITH e AS (SELECT *, event_id % 3 <> 0 AS failed FROM events), r AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS won FROM e)
SELECT event_id, coalesce(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, won ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 2, false) AS is_open FROM r""",
    "shard_artifacts": "SELECT CAST(n_nationkey // 5 AS INT) AS attempt, CAST(n_nationkey % 5 AS INT) AS shard, n_name FROM nation WHERE n_nationkey // 5 = 3",
}
