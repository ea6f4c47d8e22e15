"""HTML, identifiers, dates, scale texts and ordered cascades as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cascade(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern that is found."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def decoded(text: Column) -> Column:
    """The named entities that planning portals use; the ampersand first, as twice-encoded text is common there."""
    for name, value in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.regexp_replace(text, f"(?i){name}", value)
    return text


def clean_html(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; named entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def link_targets(html: Column) -> Column:
    """Targets of links in page order, in either kind of quotes, without mail, phone, fragment and script links; the first of equals stays."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?href\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    found = F.transform(found, lambda x: F.trim(decoded(F.substring(x, F.lit(2), F.char_length(x) - 2))))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"(?i)^(mailto:|tel:|#|javascript:)") & (x != "")))


def absolute_url(base: Column, target: Column) -> Column:
    """The address of a link seen on a page: relative ones start from the page's folder, and steps up are taken."""
    scheme, host = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    page = F.regexp_extract(base, r"^https?://[^/?#]+([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_replace(page, "[^/]*$", ""), F.lit("")), F.lit("/"))
    whole = F.when(target.startswith("/"), target).when(target.startswith("?"), F.concat(F.coalesce(F.nullif(page, F.lit("")), F.lit("/")), target)).otherwise(F.concat(folder, target))
    path, rest = F.regexp_extract(whole, r"^([^?#]*)", 1), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1)
    steps = F.aggregate(
        F.slice(F.split(path, "/", -1), 2, 1 << 20), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    flat = F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(steps, "/"), F.when(F.size(steps) > 0, tail).otherwise(""))).otherwise(path)
    return F.when(target.rlike("(?i)^https?://"), target).when(target.startswith("//"), F.concat(scheme, target)).otherwise(F.concat(host, flat, rest))


def table_fields(html: Column) -> Column:
    """Labels and values of table rows whose cells alternate, as a map; the first of equal labels counts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.filter(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), clean_html), lambda x: x != ""))
    label = lambda x: F.lower(F.regexp_replace(x, r"\s*[:\-]\s*$", ""))
    pairs = F.flatten(F.transform(cells, lambda c: F.filter(F.transform(c, lambda x, i: F.struct(label(x).alias("key"), F.get(c, i + 1).alias("value"), i.alias("i"))), lambda p: (p.i % 2 == 0) & p["value"].isNotNull() & (p["key"] != ""))))
    first = F.filter(pairs, lambda p, k: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == k + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def iso_date(text: Column, keep: bool = True) -> Column:
    """The first d/m/yyyy or d-m-yyyy of a text as yyyy-mm-dd, else a date in another known form; others stay as they are, or are null without `keep`."""
    pattern = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
    part = lambda i: F.regexp_extract(text, pattern, i)
    found = F.when(part(1) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
    known = F.coalesce(*(F.date_format(F.try_to_timestamp(F.trim(text), F.lit(f)), "yyyy-MM-dd") for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "d MMMM yyyy", "d MMM yyyy")))
    return F.coalesce(found, known, text) if keep else F.coalesce(found, known)


def scale_denominators(text: Column) -> Column:
    """Denominators of the scales 1:N in a text that lie between 50 and 25000."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b1\s*[:/]\s*(\d{2,5})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.filter(found, lambda x: x.between(50, 25000))


def media_type(head: Column, name: Column) -> Column:
    """From leading characters, else from the file name's end."""
    return (
        F.when(head.startswith("%PDF"), "application/pdf").when(head.startswith("PK"), "application/zip")
        .when(head.rlike(r"(?i)^\s*(<!doctype html|<html)"), "text/html").when(head.rlike(r"^\s*<\?xml|^\s*<svg"), "image/svg+xml")
        .when(head.rlike(r"^\s*[\[{]"), "application/json").when(F.lower(name).endswith(".csv"), "text/csv").otherwise("application/octet-stream")
    )


def score(text: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the points of all patterns that are found."""
    return sum((F.when(text.rlike(p), n).otherwise(0) for p, n in rules), F.lit(0))
