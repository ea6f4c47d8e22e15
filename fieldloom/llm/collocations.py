"""Phrase collocations from a weighted de Bruijn graph.

Texts fall into pieces, pieces into words. The graph's edges are the longest word runs (n words), its nodes the runs of
n - 1 words that edges overlap in. Every word position of a piece gives the longest run that starts there: an edge, or near the end of the piece a
shorter run, which corrects the flow of the node it is. One aggregation counts the edges; the count of a node is the sum of its outgoing edges
and its corrections, the count of a shorter run again the flow of the nodes that it begins. Counts therefore cascade from
length n down to single words, each step a combining aggregation, and no shorter run is ever counted in the texts.

Edges and nodes of `least` or more occurrences form the graph that candidates come from. Where a node has one edge in and one
out, both with its own count, all its occurrences lie in the same surroundings: such unary paths are compacted by list
ranking over the edges to one row with its words and its one count. Edges and inner nodes of a path are read off its row; nodes between paths keep
their own counts.

Results are exact: words are compared as texts, ratios in decimals of 38 digits (counts up to 10**15). Defined results:
a null text is empty, a null language is `und`; rows that are equal count each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm import _text as t
from fieldloom.llm._tables import Scratch, table
from fieldloom.operators import chains

UNKNOWN = "und"
SLICE_BYTES = 6 << 20
STEP = 1 << 20
ROWS = 1 << 16
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[*b".,;:!?", *range(10, 14)]] = True
BETWEEN = PIECE_ENDS.copy()
BETWEEN[[9, 32]] = True
SCALE = 1_000_000


def counted(buf: np.ndarray, at: np.ndarray, langs: pa.Array, longest: int) -> Iterator[tuple[pa.Table, pa.Array]]:
    """The longest run within its piece from each word on, as word numbers w0, w1, ... (null beyond its end), counted per lang number in stretches of STEP words; and the words."""
    raw = t.LOWER[buf]
    start, end, word_at = t.words(raw, at, ~BETWEEN)
    if not len(start):
        return
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)), pa.py_buffer(raw[~BETWEEN[raw]]))
    piece = np.cumsum(PIECE_ENDS[raw], dtype=np.int32)[start] + np.repeat(np.arange(len(at) - 1), np.diff(word_at)) * (len(raw) + 1)
    of = np.repeat(langs.indices.to_numpy(), np.diff(word_at))
    for low in range(0, len(start), STEP):
        high = min(low + STEP, len(start))
        known = words.slice(low, min(high + longest, len(start)) - low).dictionary_encode()
        ids, here = known.indices.to_numpy(), piece[low : low + len(known)]
        columns, n = [of[low:high]], high - low
        for k in range(longest):
            room, inside, of_word = max(0, min(n, len(ids) - k)), np.zeros(n, bool), np.zeros(n, np.int32)
            inside[:room], of_word[:room] = here[k : k + room] == here[:room], ids[k : k + room]
            columns.append(pa.array(of_word, mask=~inside))
        names = ["lang", *(f"w{k}" for k in range(longest))]
        yield pa.table(columns, names=names).group_by(names, use_threads=False).aggregate([([], "count_all")]), known.dictionary


def runs(found: pa.Table, words: pa.Array, langs: pa.Array) -> pa.Table:
    """(node, last, n): runs as texts, the language and a tab before them; an edge is a node and its last word, a shorter run has no last."""
    taken = lambda c, of: of.take(found.column(c).combine_chunks())
    parts = [taken(c, words) for c in found.column_names if c[0] == "w"]
    node = pc.binary_join_element_wise(*parts[:-1], " ", null_handling="skip")
    return pa.table([pc.binary_join_element_wise(taken("lang", langs), node, "\t"), parts[-1], found.column("count_all")], names=["node", "last", "n"])


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))


def hot_nodes(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, parts: int = 200) -> list[str]:
    """The nodes, language and tab before them, with so many different edges that they would crowd one of `parts` partitions; at most 4 * parts.

    It decides only how rows are dealt, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, "text", SLICE_BYTES):
            langs = t.column(batch, "lang").dictionary_encode()
            for found, words in counted(*t.utf8(t.column(batch, "text")), langs, longest):
                edges = found.filter(found.column(f"w{longest - 1}").is_valid())
                node = [c for c in found.column_names if c[0] == "w"][:-1]
                many = edges.group_by(["lang", *node], use_threads=False).aggregate([([], "count_all")])
                many = many.filter(pc.greater_equal(pc.multiply(many.column("count_all"), 4 * parts), len(edges)))
                names = pc.binary_join_element_wise(*(words.take(many.column(c).combine_chunks()) for c in node), " ")
                names = pc.binary_join_element_wise(langs.dictionary.take(many.column("lang").combine_chunks()), names, "\t")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array([None], names.type)]), pa.array([*many.column("count_all").to_pylist(), len(edges)], pa.int64())], names=["node", "n"])

    seen = _source(docs, text, lang).mapInArrow(run, "node string, n long").groupBy("node").agg(F.sum("n").alias("n"))
    seen = Scratch(docs.sparkSession).saved(seen)
    total = seen.filter("node is null").agg(F.sum("n")).first()[0] or 0
    return [r["node"] for r in seen.filter(F.col("node").isNotNull() & (F.col("n") * (4 * parts) >= total)).select("node").collect()]


def edges(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, hot: list[str] | None = None) -> DataFrame:
    """(node, last, n): the graph's edges and the corrections of shorter runs, counted within stretches of texts, as runs() gives them; with hot nodes, also whether a row is one's."""
    hot = hot or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in t.slices(batches, "text", SLICE_BYTES):
            langs = t.column(batch, "lang").dictionary_encode()
            for found, words in counted(*t.utf8(t.column(batch, "text")), langs, longest):
                # rows of a node follow each other, as shuffled blocks of like rows are smaller
                found = found.sort_by([(c, "ascending") for c in found.column_names[:longest]])
                for low in range(0, len(found), ROWS):
                    rows = runs(found.slice(low, ROWS), words, langs.dictionary)
                    yield from (rows.append_column("hot", pc.is_in(rows.column("node"), pa.array(hot, pa.string()))) if hot else rows).to_batches()

    return _source(docs, text, lang).mapInArrow(run, "node string, last string, n long" + ", hot boolean" * bool(hot))


def counts(found: DataFrame, longest: int = 3, least: int = 10, parts: int = 200) -> DataFrame:
    """(lang, run, size, n): every single word, and every longer run of `least` occurrences or more, from the flow of the graph.

    One shuffle by node brings a node's edges and corrections together, so that edges and nodes are counted in the same tasks; the edges of a hot node
    are dealt to `parts` salts, whose sums meet in the next, small step.
    Node and language are one column, as every byte of a row counts here.
    """
    keys = ["node"]
    if "hot" in found.columns:
        found, keys = found.withColumn("salt", F.when(F.col("hot"), 1 + F.pmod(F.hash("last"), F.lit(parts))).otherwise(0)).drop("hot"), ["node", "salt"]
    # the run itself, and for an edge its node, to which it flows
    none = F.lit(None).cast("string")
    each = found.repartition(*keys).select(*keys, "n", F.explode(F.when(F.col("last").isNull(), F.array(none)).otherwise(F.array(none, "last"))).alias("end"))
    summed = each.groupBy(*keys, "end").agg(F.sum("n").alias("n")).filter(F.col("end").isNull() | (F.col("n") >= least))
    run = F.substring_index("node", "\t", -1)
    length = F.when(F.col("end").isNull(), F.length("run") - F.length(F.replace("run", F.lit(" "), F.lit(""))) + 1).otherwise(longest)
    found = summed.withColumn("run", run).select(
        F.expr("substring(node, 1, length(node) - length(run) - 1)").alias("lang"), F.concat_ws(" ", "run", "end").alias("run"), length.cast("int").alias("size"), "n",
        (F.col("salt") > 0 if len(keys) > 1 else F.lit(False)).alias("part"),
    )
    for size in reversed(range(1, longest - 1)):
        flow, itself = F.struct(F.substring_index("run", " ", size).alias("run"), F.lit(size).alias("size")), F.struct("run", "size")
        given = F.when(F.col("size") != size + 1, F.array(itself)).when(F.col("part") | (F.col("n") >= least), F.array(flow, itself)).otherwise(F.array(flow))
        found = found.select("lang", F.explode(given).alias("x"), "n").groupBy("lang", "x.run", "x.size").agg(F.sum("n").alias("n")).withColumn("part", F.lit(False))
    return found.filter((F.col("n") >= least) | (F.col("size") == 1)).select("lang", "run", "size", "n")


def compacted(known: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, words, n): the unary paths of the graph, every edge in one of them; n is the count of each of its edges and inner nodes.

    known: (lang, run, size, n) as counts() gives them.
    """
    tail, head = F.substring_index("run", " ", longest - 1), F.substring_index("run", " ", 1 - longest)
    graph = known.filter(F.col("size") == longest).select("lang", "run", "n", tail.alias("tail"), head.alias("head"))
    nodes = known.filter(F.col("size") == longest - 1).select("lang", F.col("run").alias("node"), F.col("n").alias("own"))
    side = lambda end: graph.groupBy("lang", F.col(end).alias("node")).agg(F.count("*").alias(f"{end}s"), F.min("n").alias(f"{end}_n"), F.min("run").alias(f"{end}_run"))
    unary = side("head").join(side("tail"), ["lang", "node"]).join(nodes, ["lang", "node"])
    unary = unary.filter("heads = 1 and tails = 1 and head_n = own and tail_n = own")  # by head: the edge that comes in
    key = lambda run: F.concat_ws("\t", "lang", run)  # noqa: E731  no run holds a tab
    before = unary.select(key("tail_run").alias("node"), key("head_run").alias("before"))
    links = graph.select(key("run").alias("node"), "lang", "run", "n").join(before, "node", "left")
    tables = Scratch(known.sparkSession)
    links = tables.saved(links)
    placed = links.join(chains.ranked(links), "node")
    last = F.when(F.col("place") == 0, F.split("run", " ")).otherwise(F.array(F.substring_index("run", " ", -1)))
    paths = placed.groupBy("lang", "head").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", last.alias("words")))), lambda x: x.words)).alias("words"), F.min("n").alias("n"))
    return paths.select("lang", "words", "n")


def expanded(paths: DataFrame, known: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, run, size, n) of all runs of 2 words or more: edges and inner nodes from their path, the rest from their own count."""
    windows = lambda first, last, size: F.transform(F.sequence(F.lit(first), last), lambda i: F.struct(F.array_join(F.slice("words", i, size), " ").alias("run"), F.lit(size).alias("size")))
    inner = longest - 1
    within = F.when(F.size("words") > longest, windows(2, F.size("words") - inner, inner)).otherwise(F.array().cast("array<struct<run: string, size: int>>"))
    read = paths.select("lang", "n", F.explode(F.concat(windows(1, F.size("words") - inner, longest), within)).alias("x")).select("lang", "x.run", "x.size", "n")
    rest = known.filter((F.col("size") > 1) & (F.col("size") < longest)).join(read, ["lang", "run"], "left_anti")
    return read.unionByName(rest.select("lang", "run", "size", "n"))


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, limit: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `limit` best phrases of 2 to `longest` words of each language.

    A phrase's score is a * a / (l * r) in millionths, for the cut into two parts that gives the least; phrases go that lie inside a
    longer one which has `share` percent of their occurrences or more.
    """
    if longest < 3:
        raise ValueError("a de Bruijn graph of phrases needs runs of 3 words or more")
    tables = Scratch(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_nodes(docs, text, lang, longest, parts)
    every = tables.saved(counts(edges(docs, text, lang, longest, hot), longest, least, parts))
    total = every.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    known = tables.saved(every.filter(F.col("n") >= least))
    phrases = tables.saved(expanded(compacted(known, longest), known, longest))
    # what lies inside a longer phrase that is as good as always around it
    words, size = F.split("run", " "), F.col("size")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    around = phrases.filter("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("run"), F.col("n").alias("around")).groupBy("lang", "run").agg(F.max("around").alias("around"))
    alone = phrases.join(around, ["lang", "run"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < share * F.col("n")))
    cuts = alone.select("lang", "run", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(run, ' ', k)"), "rest": F.expr("substring_index(run, ' ', k - size)")})
    part = lambda name, count: known.select("lang", F.col("run").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * (_a * _a) div (_l * _r)")
    scored = cuts.withColumns({f"_{c}": x for c, x in exact.items()}).withColumn("score", score)
    best = scored.groupBy("lang", "run").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", F.col("run").alias("phrase"), "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # tasks keep their first `limit` before they send
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {"op13_collocations": op13_collocations}
ORACLE_SQL = {
    "op13_collocations": r"""
WITH pieces AS (
  SELECT lang, piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, piece, row_number() OVER () AS piece_id FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
words AS (SELECT lang, piece_id, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, 1 AS size, w[i] AS run FROM words
  UNION ALL SELECT lang, 2, concat(w[i], ' ', w[i + 1]) FROM words WHERE i < len(w)
  UNION ALL SELECT lang, 3, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) FROM words WHERE i < len(w) - 1),
f AS (SELECT lang, size, run, count(*) AS n FROM grams GROUP BY lang, size, run),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, run, n AS a, string_split(run, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
around AS (
  SELECT lang, run, max(a) AS a FROM (
    SELECT lang, concat(w[1], ' ', w[2]) AS run, a FROM candidates WHERE size = 3 UNION ALL SELECT lang, concat(w[2], ' ', w[3]), a FROM candidates WHERE size = 3) GROUP BY lang, run),
alone AS (SELECT c.* FROM candidates c LEFT JOIN around o ON c.lang = o.lang AND c.run = o.run AND c.size = 2 WHERE o.a IS NULL OR 100 * o.a < 50 * c.a),
cuts AS (
  SELECT lang, run, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM alone
  UNION ALL SELECT lang, run, a, 2, concat(w[1], ' ', w[2]), w[3] FROM alone WHERE size = 3),
scored AS (
  SELECT c.lang, c.run, c.k, c.a, x.n AS l, y.n AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.first = x.run JOIN f y ON c.lang = y.lang AND c.rest = y.run),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, run ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, run) AS rank FROM best)
SELECT lang, rank, run AS phrase, a, l, r, t.n, score FROM placed JOIN totals t USING (lang) WHERE rank <= 2000
"""
}
