"""Merkle manifest of a table: leaves, subroots, a root, and an inclusion proof for each row.

Each tree (one for each source) orders its leaves by id. A node's parent is found by dividing its
place by the fanout; a slot pivot spreads the children of a parent into `fanout` columns by
conditional aggregates. The columns put together are hashed to the parent's digest; those before and
those after a child's own slot are its siblings. Levels are built upwards until every tree has one
node, then the siblings are handed down from the root, one join of parents with their own path for each level; only
rows of parents move there, a sixteenth of the rows below. The roots of the trees are the leaves of one more tree.

Places come without a window over a whole tree: rows are sorted into ranges, written with the range and
place in it, and the ranges' counts (one row for each range and tree in it) give the place of each range's first row.

Defined results: a null id comes before all others, rows with the same id are ordered by leaf; null sources form one tree, the
first; a null column enters the hash as `-`, an empty text as `0:`; an empty table gives an empty result. Extra columns don't
enter a leaf and are not returned by proofs(); the columns of a leaf must be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm._tables import Scratch, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' UTF-8 bytes, put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two rows give the same bytes; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row's columns, in their order."""
    return digest(*map(field, columns.values()))


def placed(rows: DataFrame, tree: str, order: list[str], tables: Scratch) -> DataFrame:
    """Adds n (rows of the tree) and place (from 0, by `order`), both long."""
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = tables.saved(ranged).withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy(tree, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)  # a row for each range that holds rows of the tree
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.saved(counts.select(tree, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(whole).alias("n")))
    met = ranged.alias("r").join(starts.alias("s"), F.expr(f"r._range = s._range and r.{tree} <=> s.{tree}"))
    return met.select(*(F.col(f"r.{c}") for c in rows.columns), "n", (F.col("_at") + F.col("_start")).alias("place"))


def pivot(nodes: DataFrame, tree: str, carried: list[str], fanout: int) -> DataFrame:
    """One row for each parent: its tree, n of its children's level, place, children c0, c1, ... (structs of digest and `carried`) and its own digest.

    The only node of a tree is carried on as it is.
    """
    slot = F.pmod("place", F.lit(fanout))
    child = F.struct("digest", *carried)
    spread = nodes.groupBy(tree, "n", F.expr(f"place div {fanout}").alias("parent")).agg(*(F.first(F.when(slot == i, child), ignorenulls=True).alias(f"c{i}") for i in range(fanout)))
    whole = digest(*(F.coalesce(F.col(f"c{i}.digest"), F.lit("")) for i in range(fanout)))
    return spread.withColumn("digest", F.when(F.col("n") > 1, whole).otherwise(F.col("c0.digest"))).withColumnRenamed("parent", "place")


def children(parents: DataFrame, tree: str, carried: list[str], fanout: int) -> DataFrame:
    """The children of parents that have their path: each with its own path, its siblings' digests first, and with the subroot of its parent."""
    of = lambda i: F.coalesce(F.col(f"c{i}.digest"), F.lit(""))
    side = lambda slots: F.concat(*map(of, slots)) if slots else F.lit("")

    def child(i: int) -> Column:
        step = F.struct(side(range(i)).alias("left"), side(range(i + 1, fanout)).alias("right"))
        path = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        return F.when(F.col(f"c{i}").isNotNull(), F.struct(F.col(f"c{i}").alias("node"), (F.col("place") * fanout + i).alias("place"), path.alias("path")))

    each = parents.select(tree, "subroot", F.explode(F.array_compact(F.array(*map(child, range(fanout))))).alias("k"))
    return each.select(tree, F.col("k.place").alias("place"), F.col("k.node.digest").alias("digest"), *(F.col(f"k.node.{c}").alias(c) for c in carried), F.col("k.path").alias("path"), "subroot")


def raised(nodes: DataFrame, tree: str, carried: list[str], tables: Scratch, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """From placed nodes (tree, n, place, digest, carried): the parents of each level from the bottom up, and the root (tree, digest) of each tree."""
    levels = []
    while True:
        levels.append(tables.saved(pivot(nodes, tree, [] if levels else carried, fanout)))
        nodes = levels[-1].select(tree, F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "place", "digest")
        if nodes.filter("n > 1").isEmpty():
            return levels, nodes.select(tree, "digest")


def handed_down(levels: list[DataFrame], above: DataFrame, tree: str, carried: list[str], tables: Scratch, fanout: int = FANOUT) -> DataFrame:
    """Every lowest node (tree, place, digest, carried, path, subroot): its siblings from its own level up, then the path that `above` (tree, path, subroot) gives its tree."""
    known = above.withColumn("place", F.lit(0).cast("long"))
    for parents in reversed(levels):
        known = known.select(F.col(tree).alias("_tree"), F.col("place").alias("_place"), "path", "subroot")
        met = parents.join(known, F.expr(f"place = _place and {tree} <=> _tree"))
        known = children(met, tree, carried if parents is levels[0] else [], fanout)
        if parents is not levels[0]:
            known = tables.saved(known)
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda at, step: digest(step.getField("left"), at, step.getField("right")))


def proof(path: Column) -> Column:
    """All siblings of a path, from the bottom up and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.getField("left"), s.getField("right"))), "")


def proofs(docs: DataFrame, columns: dict[str, Column], tree: Column, id: str = "doc_id", carried: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, tree, leaf, subroot, root, path, carried) of every row; path: siblings from the leaf to the root of the manifest.

    carried: further columns of docs that come along, such as the leaf of another version of the row.
    """
    carried = carried or {}
    tables = Scratch(docs.sparkSession)
    leaves = tables.saved(docs.select(F.col(id).alias("id"), tree.cast("string").alias("tree"), leaf(columns).alias("digest"), *(c.alias(k) for k, c in carried.items())))
    nodes = placed(leaves, "tree", ["id", "digest"], tables)
    levels, subroots = raised(nodes, "tree", ["id", *carried], tables, fanout)
    tables.discard(but=tuple(levels))
    trees = placed(subroots.withColumn("all", F.lit(0)), "all", ["tree"], tables)
    above, roots = raised(trees, "all", ["tree"], tables, fanout)
    root = (roots.first() or [None, None])[1]
    start = roots.select("all", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = handed_down(above, start, "all", ["tree"], tables, fanout)
    below = handed_down(levels, tables.saved(above.select("tree", "path", F.col("digest").alias("subroot"))), "tree", ["id", *carried], tables, fanout)
    return below.select("id", "tree", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *carried)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in COLUMNS}
    lowered = leaf(columns | {"text": F.translate("text", UPPER, LOWER)})
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    found = proofs(docs, columns, F.col("source"), carried={"other": tampered}).withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
#: CRC-32 bit by bit; levels as a recursion over places; the fold as a recursion over levels.
ORACLE_SQL = {
    "op11_merkle_manifest": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CAST(doc_id AS VARCHAR) AS digits FROM documents),
crc(row_id, digits, i, c) AS (
  SELECT row_id, digits, 0, 4294967295::BIGINT FROM docs WHERE digits IS NOT NULL
  UNION ALL
  SELECT row_id, digits, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(digits[i // 9 + 1])::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc WHERE i < 9 * len(digits)),
touched AS (SELECT row_id FROM crc WHERE i = 9 * len(digits) AND xor(c, 4294967295::BIGINT) % 5 = 0),
parts AS (
  SELECT row_id, doc_id, source, text, low,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(len(digits), ':', digits) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(len(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head FROM docs),
leaves AS (
  SELECT row_id, doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(head, CASE WHEN low IS NULL THEN '-' ELSE concat(strlen(low), ':', low) END)) AS low_leaf FROM parts),
ranked AS (
  SELECT l.*, t.row_id IS NOT NULL AS tampered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves l LEFT JOIN touched t USING (row_id)),
nodes(level, source, n, place, digest) AS (
  SELECT 0, source, n, place, leaf FROM ranked
  UNION ALL
  SELECT level + 1, source, (n + 15) // 16, place // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY level, source, n, place // 16),
subroots AS (SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, n, place, digest) AS (
  SELECT 0, n, place, subroot FROM subroots
  UNION ALL
  SELECT level + 1, (n + 15) // 16, place // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, n, place // 16),
steps AS (
  SELECT r.row_id, k.level, coalesce(string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place < k.at), '') AS before, coalesce(string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place > k.at), '') AS after
  FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT l AS level, r.place // CAST(pow(16, l) AS BIGINT) AS at FROM range(0, s.height) x(l)) k
  JOIN nodes o ON o.source IS NOT DISTINCT FROM r.source AND o.level = k.level AND o.place // 16 = k.at // 16 GROUP BY r.row_id, k.level
  UNION ALL
  SELECT r.row_id, s.height + k.level, coalesce(string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place < k.at), ''), coalesce(string_agg(o.digest, '' ORDER BY o.place) FILTER (o.place > k.at), '')
  FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT l AS level, s.place // CAST(pow(16, l) AS BIGINT) AS at FROM range(0, (SELECT max(level) FROM tops)) x(l)) k
  JOIN tops o ON o.level = k.level AND o.place // 16 = k.at // 16 GROUP BY r.row_id, s.height, k.level),
proofs AS (SELECT row_id, sha256(string_agg(concat(before, after), '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY row_id),
folds(row_id, level, digest) AS (
  SELECT row_id, 0, CASE WHEN tampered THEN low_leaf ELSE leaf END FROM ranked
  UNION ALL
  SELECT f.row_id, f.level + 1, sha256(concat(s.before, f.digest, s.after)) FROM folds f JOIN steps s ON f.row_id = s.row_id AND f.level = s.level),
last AS (SELECT row_id, arg_max(digest, level) AS folded_root FROM folds GROUP BY row_id),
top AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source JOIN last USING (row_id) LEFT JOIN proofs USING (row_id), top
"""
}
