"""Queries over column expressions: coercion, geometry, hashing, colour, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import colour, geometry, hashing, numbers, text
from fieldloom.plans.tables import points, read

KINDS = [("ring_part", r"(?i)ring"), ("widget_part", r"(?i)widget"), ("bolt_part", r"(?i)bolt"), ("gear_part", r"(?i)^(hot|cold) gear"), ("small_gear", r"(?i)gear")]
DOCUMENT_POINTS = [(r"(?i)(?:^|[ \n])the(?:[ .,]|$)", 20), (r"(?i)license", 25), (r"\|", -15), (r"!!", -40), (r"(?i)(?:^|[ \n])und(?:[ .,]|$)", 10)]
PROTOTYPES = [("asphalt", 60, 60, 64), ("brick", 150, 80, 65), ("grass", 90, 130, 60), ("gravel", 150, 145, 135), ("sand", 210, 200, 160)]
PICKS = [("stone", 5), ("gravel", 3), ("dirt", 2)]


def rounding(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice") - 30000
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.half_up(v, 1).alias("r1"), numbers.half_up(-F.col("l_quantity") / 4).alias("r0"),
        numbers.clamp(v, -5000, 5000).alias("held"), numbers.half_up(numbers.ratio(F.col("l_tax"), F.col("l_discount")), 3).alias("tax_ratio"),
        numbers.half_up(numbers.grade_percent(F.col("l_discount"), F.col("l_quantity")), 4).alias("grade"),
    )


def coercions(spark: SparkSession, d: str) -> DataFrame:
    tag = F.element_at(F.split("p_type", " "), 1)
    return read(spark, d, "part").select(
        "p_partkey", numbers.number_or_null(F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))).alias("n"),
        numbers.parse_length(F.concat(F.lit("ca. "), F.col("p_size"), F.lit(",5 m, or 7,2"))).alias("length_m"),
        numbers.parse_bytes(F.concat("p_size", F.get(F.array(*map(F.lit, (".5 kb", ".5KiB", "", " MiB", " parsec"))), F.pmod(F.col("p_partkey"), F.lit(5)).cast("int")))).alias("size_bytes"),
        numbers.first_present(F.when(F.col("p_size") > 25, ""), F.when(F.col("p_size") > 10, F.col("p_brand")), F.lit("none")).alias("first"),
        numbers.truthy_unless_denied(F.when(F.col("p_size") % 2 == 0, "no").otherwise(tag)).alias("not_denied"),
        numbers.truthy_if_listed(F.when(F.col("p_size") % 2 == 0, "yes").otherwise(tag)).alias("listed"),
        text.slug(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"),
    )


def projection(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("x") / 1000.0, F.col("z") / 2000.0 + 51.0
    x, z = geometry.project_x(lon, 0.5, 51.0), geometry.project_z(lat, 51.0)
    return points(spark, d).select(
        "vec_id", numbers.half_up(x, 3).alias("east_m"), numbers.half_up(z, 3).alias("south_m"),
        numbers.half_up(geometry.unproject_lon(x, 0.5, 51.0), 6).alias("lon"), numbers.half_up(geometry.unproject_lat(z, 51.0), 6).alias("lat"),
        numbers.half_up(geometry.haversine_km(lat, lon, F.lit(51.0), F.lit(0.5)), 4).alias("km"),
    )


def quadkeys(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("x") / 20.0, F.col("z") / 20.0
    tiles = points(spark, d).select("vec_id", geometry.tile_x(lon, 9).alias("tx"), geometry.tile_y(lat, 9).alias("ty"))
    return tiles.select("vec_id", "tx", "ty", geometry.quadkey(F.col("tx"), F.col("ty"), 9).alias("quadkey"))


def cell_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = hashing.cell_hash(F.col("x"), F.col("z"), 7)
    return points(spark, d).select("vec_id", h.alias("hash"), hashing.weighted_pick(h, PICKS).alias("block"), hashing.identity(F.col("x").cast("string"), F.col("z").cast("string"), size=20).alias("id"))


def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    seen = points(spark, d).select("vec_id", *(F.pmod(F.floor(F.col("embedding")[i].cast("double") * 1000), F.lit(256)).cast("int").alias(c) for i, c in enumerate("rgb")))
    own = colour.lab(*rgb)
    ranked = [F.struct(numbers.half_up(colour.difference(own, colour.lab(*(F.lit(v) for v in p[1:]))), 4).alias("delta"), F.lit(p[0]).alias("name")) for p in PROTOTYPES]
    best = seen.withColumn("best", F.array_min(F.array(*ranked)))
    return best.select("vec_id", "r", "g", "b", F.col("best.name").alias("prototype"), (colour.excess_green(*rgb) > 22).alias("green"))


def classification(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.cascade(F.col("p_name"), KINDS, "other").alias("kind"))


def document_scores(spark: SparkSession, d: str) -> DataFrame:
    points_of = text.score(F.col("text"), DOCUMENT_POINTS)
    return read(spark, d, "documents").select("doc_id", points_of.cast("int").alias("score"), (points_of >= 30).alias("relevant"))


TARGETS = ("a.html", "../up/b.html", "/root?x=1", "//host.example/p", "https://other.example/q", "?page=2", "./c/./d", "mailto:x@y.z", "#top", "")


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """The pages' own links, and one more of every form, in either kind of quotes."""
    more = F.array_join(F.array(*(F.lit(f"<a class=x href={q}{t}{q}>" if t != "a.html" else f"<A HREF = {q}{t}{q}>") for t, q in zip(TARGETS, "'\"" * 5))), " ")
    links = read(spark, d, "pages").select("page_id", "url", F.posexplode(text.link_targets(F.concat("html", more))).alias("pos", "target"))
    return links.select("page_id", "pos", text.absolute_url(F.col("url"), F.col("target")).alias("link"))


def table_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a portal's table, in rows with one and with two pairs."""
    html = F.concat(F.lit("<table><tr><th>Reference:</th><td>"), F.col("page_id").cast("string"), F.lit("/FUL</td></tr><tr><td>Status -</td> <td><b>Open</b></td><td>Site address</td><td>"), "url", F.lit("</td></tr><TR><td>reference</td><td>late</td><td></td><td>odd</td></TR></table>"))
    fields = text.table_fields(html)
    return read(spark, d, "pages").select("page_id", fields["reference"].alias("reference"), fields["status"].alias("status"), fields["site address"].alias("address"), F.size(fields).alias("n"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    clean = text.clean_html(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.char_length(clean).alias("n_chars"), F.md5(clean).alias("digest"), text.media_type(F.col("html"), F.col("url")).alias("media_type"))


def scale_texts(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("Scale 1:"), F.col("p_size") * 25, F.lit(" @A1, detail 1/"), F.col("p_size") * 5, F.lit(" and 1:99999"))
    return read(spark, d, "part").select("p_partkey", F.array_join(text.scale_denominators(note).cast("array<string>"), ",").alias("scales"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    fields = F.json_object_keys("props")
    return read(spark, d, "events").select("event_id", F.coalesce(F.size(fields), F.lit(0)).alias("n_fields"), text.iso_date(F.date_format("ts", "dd/MM/yyyy")).alias("day"))


QUERIES = {f.__name__: f for f in (rounding, coercions, projection, quadkeys, cell_hashes, nearest_prototype, classification, document_scores, html_links, table_fields, html_text, scale_texts, event_properties)}

_PTS = "(SELECT vec_id, CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) AS z, label AS kind, embedding FROM embeddings)"


def _imul(a: str, b: int) -> str:
    return f"((((({a}) & 65535)*{b}) + ((((({a})>>16) & 65535)*{b} & 65535) << 16)) & 4294967295)"


def _hash_sql() -> str:
    h = f"(({_imul('x', hashing.CELL_X)} + {_imul('z', hashing.CELL_Z)} + 7) & 4294967295)"
    return f"SELECT vec_id, x, z, xor(h2, h2 >> 16) AS hash FROM (SELECT *, {_imul('xor(h1, h1 >> 13)', hashing.FINISH)} AS h2 FROM (SELECT *, {h} AS h1 FROM {_PTS}))"


def _lab_sql() -> str:
    lin = lambda c: f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92 ELSE pow(({c}/255.0::DOUBLE+0.055)/1.055, 2.4) END"
    xyz = ", ".join(f"({' + '.join(f'{m}*l{c}' for m, c in zip(row, 'rgb'))})/{w} AS t{n}" for n, row, w in zip("xyz", colour.XYZ, colour.WHITE))
    f = lambda n: f"CASE WHEN t{n} > 0.008856 THEN cbrt(t{n}) ELSE 7.787*t{n} + 16.0/116 END AS f{n}"
    return f"SELECT *, 116*fy-16 AS cl, 500*(fx-fy) AS ca, 200*(fy-fz) AS cb FROM (SELECT *, {', '.join(f(n) for n in 'xyz')} FROM (SELECT *, {xyz} FROM (SELECT *, {', '.join(f'{lin(c)} AS l{c}' for c in 'rgb')} FROM {{src}})))"


_CASE = " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{n}'" for n, p in KINDS)
_SCORE = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for p, n in DOCUMENT_POINTS)
_PROTO = ", ".join(f"('{n}', {r}, {g}, {b})" for n, r, g, b in PROTOTYPES)

ORACLE_SQL = {
    "rounding": """
SELECT l_orderkey, l_linenumber, floor((l_extendedprice - 30000) * 10 + 0.5) / 10 AS r1, floor(-l_quantity / 4 + 0.5) AS r0,
       greatest(least(l_extendedprice - 30000, 5000.0), -5000.0) AS held,
       floor((CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_tax / l_discount END) * 1000 + 0.5) / 1000 AS tax_ratio,
       floor((CASE WHEN l_quantity = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (l_discount / l_quantity) END) * 10000 + 0.5) / 10000 AS grade
FROM lineitem""",
    "coercions": """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS n, p_size + 0.5::DOUBLE AS length_m,
       CASE p_partkey % 5 WHEN 0 THEN CAST(ceil((p_size + 0.5) * 1024) AS BIGINT) WHEN 1 THEN CAST(ceil((p_size + 0.5) * 1024) AS BIGINT) WHEN 2 THEN p_size WHEN 3 THEN p_size * 1048576 END AS size_bytes,
       CASE WHEN p_size > 10 THEN p_brand ELSE 'none' END AS first,
       p_size % 2 <> 0 AS not_denied, p_size % 2 = 0 AS listed,
       regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM part""",
    "projection": f"""
SELECT vec_id, floor(px * 1000 + 0.5) / 1000 AS east_m, floor(pz * 1000 + 0.5) / 1000 AS south_m,
       floor(lon * 1000000 + 0.5) / 1000000 AS lon, floor(lat * 1000000 + 0.5) / 1000000 AS lat,
       floor(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(51.0::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.0::DOUBLE)) * pow(sin(radians(0.5::DOUBLE - lon) / 2), 2)))) * 10000 + 0.5) / 10000 AS km
FROM (SELECT *, (lon - 0.5) * (pi() / 180 * 6378137 * cos(radians(51.0::DOUBLE))) AS px, -(lat - 51) * (pi() / 180 * 6378137) AS pz
      FROM (SELECT vec_id, x / 1000.0::DOUBLE AS lon, z / 2000.0::DOUBLE + 51 AS lat FROM {_PTS}))""",
    "quadkeys": f"""
WITH t AS (SELECT vec_id, CAST(greatest(0, least(511, floor((x / 20.0::DOUBLE + 180) / 360 * 512))) AS INT) AS tx,
       CAST(greatest(0, least(511, floor((1 - ln(tan(radians(greatest(-85.05112878::DOUBLE, least(85.05112878::DOUBLE, z / 20.0::DOUBLE)))) + 1 / cos(radians(greatest(-85.05112878::DOUBLE, least(85.05112878::DOUBLE, z / 20.0::DOUBLE))))) / pi()) / 2 * 512))) AS INT) AS ty FROM {_PTS})
SELECT vec_id, tx, ty, array_to_string([CAST(((tx >> (8 - b)) & 1) + 2 * ((ty >> (8 - b)) & 1) AS VARCHAR) FOR b IN range(0, 9)], '') AS quadkey FROM t""",
    "cell_hashes": f"""
SELECT vec_id, hash, CASE WHEN hash % 10 < 5 THEN 'stone' WHEN hash % 10 < 8 THEN 'gravel' ELSE 'dirt' END AS block,
       substr(sha256(encode(CAST(x AS VARCHAR)) || '\\x00'::BLOB || encode(CAST(z AS VARCHAR))), 1, 20) AS id FROM ({_hash_sql()})""",
    "nearest_prototype": f"""
WITH src AS (SELECT vec_id, ((CAST(floor(CAST(embedding[1] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS r, ((CAST(floor(CAST(embedding[2] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS g, ((CAST(floor(CAST(embedding[3] AS DOUBLE)*1000) AS BIGINT) % 256) + 256) % 256 AS b FROM embeddings),
own AS ({_lab_sql().format(src='src')}),
proto AS ({_lab_sql().format(src=f"(SELECT * FROM (VALUES {_PROTO}) AS v(name, r, g, b))")})
SELECT own.vec_id, CAST(own.r AS INT) AS r, CAST(own.g AS INT) AS g, CAST(own.b AS INT) AS b,
       arg_min(proto.name, (floor(sqrt(pow(own.cl - proto.cl, 2) + pow(own.ca - proto.ca, 2) + pow(own.cb - proto.cb, 2)) * 10000 + 0.5), proto.name)) AS prototype,
       any_value(2 * own.g - own.r - own.b > 22) AS green
FROM own, proto GROUP BY own.vec_id, own.r, own.g, own.b""",
    "classification": f"SELECT p_partkey, CASE {_CASE} ELSE 'other' END AS kind FROM part",
    "document_scores": f"SELECT doc_id, CAST({_SCORE} AS INT) AS score, ({_SCORE}) >= 30 AS relevant FROM documents",
    "html_links": r"""
WITH own AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS page, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref="([^"]*)"', 1) AS x FROM pages),
found AS (SELECT page_id, host, page, unnest(x) AS target, generate_subscripts(x, 1) AS n FROM own),
kept AS (SELECT page_id, host, page, target, min(n) AS n FROM found WHERE NOT regexp_matches(target, '(?i)^(mailto:|tel:|#|javascript:)') AND target <> '' GROUP BY ALL),
folders AS (SELECT *, regexp_replace(page, '[^/]*$', '') AS folder FROM own),
made AS (
 SELECT page_id, 1000000 AS n, host || folder || 'a.html' AS link FROM folders UNION ALL SELECT page_id, 1000001, host || regexp_replace(regexp_replace(folder, '/$', ''), '[^/]+$', '') || CASE WHEN folder = '/' THEN '/' ELSE '' END || 'up/b.html' FROM folders
 UNION ALL SELECT page_id, 1000002, host || '/root?x=1' FROM folders UNION ALL SELECT page_id, 1000003, regexp_extract(host, '^https?:') || '//host.example/p' FROM folders UNION ALL SELECT page_id, 1000004, 'https://other.example/q' FROM folders
 UNION ALL SELECT page_id, 1000005, host || page || '?page=2' FROM folders UNION ALL SELECT page_id, 1000006, host || folder || 'c/d' FROM folders),
every AS (SELECT page_id, n, CASE WHEN regexp_matches(target, '(?i)^https?://') THEN target WHEN starts_with(target, '/') THEN host || target ELSE host || regexp_replace(page, '[^/]*$', '') || target END AS link FROM kept UNION ALL SELECT * FROM made)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS pos, link FROM every""",
    "table_fields": "SELECT page_id, page_id || '/FUL' AS reference, 'Open' AS status, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS address, CAST(3 AS INT) AS n FROM pages",
    "html_text": r"""
WITH a AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages),
b AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
SELECT page_id, CAST(length(t) AS INT) AS n_chars, md5(t) AS digest,
       CASE WHEN starts_with(html, '%PDF') THEN 'application/pdf' WHEN starts_with(html, 'PK') THEN 'application/zip' WHEN regexp_matches(html, '(?i)^\s*(<!doctype html|<html)') THEN 'text/html'
            WHEN regexp_matches(html, '^\s*<\?xml|^\s*<svg') THEN 'image/svg+xml' WHEN regexp_matches(html, '^\s*[\[{]') THEN 'application/json' WHEN ends_with(lower(url), '.csv') THEN 'text/csv' ELSE 'application/octet-stream' END AS media_type FROM b""",
    "scale_texts": "SELECT p_partkey, array_to_string(list_filter([p_size * 25, p_size * 5], lambda v: v BETWEEN 50 AND 25000), ',') AS scales FROM part",
    "event_properties": "SELECT event_id, CAST(coalesce(len(json_keys(props)), 0) AS INT) AS n_fields, strftime(ts, '%Y-%m-%d') AS day FROM events",
}
