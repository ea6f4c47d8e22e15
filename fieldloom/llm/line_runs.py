"""Line dedup: later copies of repeated runs of lines go. DataFrame operations only.

Lines of all documents form sequences of line ids, and suffixes are ordered by (id, row, line).

Prefix doubling: the class of a suffix at length 2h is the pair of its class at h and that of the
suffix h lines on. A class is named by its first member; classes of one member never grow and
leave, so rounds go on until no two suffixes agree (log2 of the longest repeated run).

Longest common prefixes: the intervals of the suffix array are the classes with two members or
more. Going back through the lengths 2**j from the longest, each class splits by the class at
2**j of what follows it. A suffix that is not the first of its part goes into the part; the first
ones stay and stand for their parts at the shorter steps, with a copy as witness in the part. So every
suffix ends at the longest prefix that also starts earlier, with two rows for each suffix at most.

Runs that also start earlier, are at least `min_run` lines long and not the tail of a longer one
are the maximal repeated runs; the lines they cover are deleted.

Every step is a combining aggregation and a join that Spark can split, so a line may recur any
number of times; only rows of (row key, line number, class) are shuffled, and the texts once.

Defined results: a null text has no lines and stays null; lines are what stands between line feeds
(an empty text has one empty line); rows equal in id and text are one document and get equal
results; null ids come first; runs may overlap themselves, as in a line repeated many times. Other
columns pass through; new columns (NEW) replace input columns so named; an empty table gives an
empty result. Line ids are 128-bit hashes of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm._tables import release, row_key, saved, table

NEW = ("kept", "n_lines", "n_removed", "n_runs")
MIN_RUN = 2
_ROW = ("id", "row_a", "row_b")
_PLACE = (*_ROW, "i")


def _lines(column: str) -> Column:
    return F.split(F.col(column), "\n", -1)


def _classes(state: DataFrame, key: list[str]) -> DataFrame:
    """The first member of each class of `key` with two members or more; written, as Spark splits only joins that read plain shuffles.

    Joins are by merging: there are many rounds, and the driver would have to build what they broadcast.
    """
    return saved(state.groupBy(*key).agg(F.min(F.struct(*_PLACE)).alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")).hint("merge")


def _named(state: DataFrame, key: list[str]) -> DataFrame:
    """state with the classes of `key` named by their first members; suffixes alone in their class go."""
    return state.join(_classes(state, key), key).select(*_PLACE, F.col("leader").alias("name"))


def doubled(docs: DataFrame, text: str, id: str) -> list[DataFrame]:
    """For j = 0, 1, ...: the suffixes (_PLACE) whose class at length 2**j has two members, with the class's name."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), *row_key(id, text), F.posexplode(_lines(text)).alias("i", "line"))
    # rows equal in id and text count once
    lines = saved(rows.select(*_PLACE, F.xxhash64("line").alias("key_a"), F.xxhash64(F.lit(1), "line").alias("key_b")).distinct())
    levels = [saved(_named(lines, ["key_a", "key_b"]))]
    along = Window.partitionBy(*_ROW).orderBy("i")
    while not levels[-1].isEmpty():
        step = 1 << (len(levels) - 1)
        far = F.max(F.struct("i", "name")).over(along.rangeBetween(step, step))
        pairs = levels[-1].withColumn("far", far).filter("far is not null").select(*_PLACE, "name", F.col("far.name").alias("next"))
        levels.append(saved(_named(pairs, ["name", "next"])))
        release(docs)
    return levels[:-1]


def longest_earlier(levels: list[DataFrame], min_run: int) -> DataFrame | None:
    """(_PLACE, size): the longest prefix of each suffix that starts earlier too, where it has `min_run` lines or more."""
    least = (min_run).bit_length() - 1
    parts: DataFrame | None = None  # (_PLACE, size, node, witness): members of classes of `size` lines, and the classes' names
    for j in reversed(range(len(levels))):
        level, step, grown = levels[j], 1 << j, []
        if parts is not None:
            after = level.select(*_ROW, F.col("i").alias("at"), F.col("name").alias("next"))
            met = parts.withColumn("at", F.col("i") + F.col("size")).join(after.hint("merge"), [*_ROW, "at"], "left").drop("at")
            leaders = _classes(met.filter("next is not null"), ["size", "node", "next"])
            met = met.join(leaders, ["size", "node", "next"], "left")
            place = F.struct(*_PLACE)
            moved = met.filter(F.col("leader") != place).select(*_PLACE, (F.col("size") + step).alias("size"), F.col("leader").alias("node"), "witness")
            stays = met.filter(F.col("leader").isNull() | (F.col("leader") == place)).select(*_PLACE, "size", "node", "witness")
            copies = met.filter(F.col("leader") == place).select(*_PLACE, (F.col("size") + step).alias("size"), F.col("leader").alias("node"), F.lit(True).alias("witness"))
            grown = [moved, stays, copies]
        if j >= least:
            # from no common line to 2**j of them: suffixes that have got further already are out
            fresh = level if parts is None else level.join(parts.filter("not witness").select(*_PLACE), list(_PLACE), "left_anti")
            leader = F.col("name") == F.struct(*_PLACE)
            grown.append(fresh.select(*_PLACE, F.lit(step).alias("size"), F.col("name").alias("node"), leader.alias("witness")))
        if grown:
            parts = grown[0]
            for more in grown[1:]:
                parts = parts.union(more)
            parts = saved(parts)
            release(levels[j])
    return None if parts is None else parts.filter(~F.col("witness") & (F.col("size") >= min_run)).select(*_PLACE, "size")


def repeated_runs(docs: DataFrame, text: str = "text", id: str = "doc_id", min_run: int = MIN_RUN) -> DataFrame:
    """(row_a, row_b, n_runs, gone): for rows that lose lines, the number of maximal repeated runs and the stretches [start, stop) they cover."""
    longest = longest_earlier(doubled(docs, text, id), min_run)
    if longest is None:
        return docs.sparkSession.createDataFrame([], "row_a long, row_b long, n_runs long, gone array<struct<start:int,stop:int>>")
    along = Window.partitionBy(*_ROW).orderBy("i")
    stop = F.col("i") + F.col("size")
    before = F.max(stop).over(along.rowsBetween(Window.unboundedPreceding, -1))
    seen = longest.select(*_ROW, "i", stop.alias("stop"), before.alias("reached"))
    seen = seen.withColumns({"head": F.coalesce(F.col("stop") > F.col("reached"), F.lit(True)), "apart": F.coalesce(F.col("i") > F.col("reached"), F.lit(True)).cast("int")})
    seen = seen.withColumn("part", F.sum("apart").over(along))
    parts = seen.groupBy(*_ROW, "part").agg(F.min("i").cast("int").alias("start"), F.max("stop").cast("int").alias("stop"), F.count_if("head").alias("heads"))
    return parts.groupBy("row_a", "row_b").agg(F.sum("heads").alias("n_runs"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", min_run: int = MIN_RUN) -> DataFrame:
    """Every row with kept (the text left), n_lines, n_removed and n_runs (maximal repeated runs of which lines go)."""
    docs = docs.drop(*NEW)
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("_doc"), F.col(text).alias("_text"), *row_key(id, text))
    met = keyed.join(repeated_runs(docs, text, id, min_run), ["row_a", "row_b"], "left")
    lines = _lines("_text")
    # what is kept lies between the stretches that go: cut by slices, so work is linear in the lines
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g.stop))
    ends = F.concat(F.transform("gone", lambda g: g.start), F.array(F.size(lines)))
    pieces = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda k: F.slice(lines, k.a + 1, k.b - k.a))
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    removed = F.aggregate("gone", F.lit(0), lambda n, g: n + g.stop - g.start)
    return met.select(
        *(F.col("_doc").getField(c).alias(c) for c in names), kept.alias("kept"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
    )


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed", "n_runs", F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op4_line_runs": op4_line_runs}
ORACLE_SQL = {
    "op4_line_runs": """
WITH RECURSIVE docs AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM docs WHERE text IS NOT NULL),
pairs AS (SELECT a.doc_id, a.i, first_value((a.doc_id, a.i)) OVER w AS leader, count(*) OVER (PARTITION BY a.line, b.line) AS n
          FROM line a JOIN line b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WINDOW w AS (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.i)),
run AS (SELECT doc_id, i, leader, CAST(2 AS BIGINT) AS size FROM pairs WHERE n > 1
        UNION ALL
        SELECT doc_id, i, leader, size FROM (
            SELECT r.doc_id, r.i, r.size + 1 AS size, first_value((r.doc_id, r.i)) OVER (PARTITION BY r.leader, line ORDER BY r.doc_id, r.i) AS leader, count(*) OVER (PARTITION BY r.leader, line) AS n
            FROM run r JOIN line ON line.doc_id = r.doc_id AND line.i = r.i + r.size) WHERE n > 1),
longest AS (SELECT doc_id, i, max(size) AS size FROM run WHERE leader <> (doc_id, i) GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM longest),
listed AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
heads AS (SELECT a.doc_id, count(*) AS n_runs FROM longest a LEFT JOIN longest b ON a.doc_id = b.doc_id AND b.i = a.i - 1 WHERE b.size IS NULL OR b.size <= a.size GROUP BY a.doc_id)
SELECT documents.doc_id,
       CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       sha256(coalesce(array_to_string([string_split(text, chr(10))[k] FOR k IN range(1, len(string_split(text, chr(10))) + 1) IF NOT list_contains(coalesce(gone, []), k)], chr(10)), '')) AS kept_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN heads USING (doc_id)
"""
}
