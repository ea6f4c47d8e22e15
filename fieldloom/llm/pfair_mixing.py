"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks. In every stretch of slots each source has a target weight; its
i-th block in the stretch is released at floor((i-1)/weight) and due at ceil(i/weight), and the
released block with the earliest deadline gets the slot. One resource is thus shared so that
every source is less than one block from its exact share at any time. When a source runs out,
the others share its weight from the next slot on: a new stretch begins. No row is left out.

Weights are rounded to multiples of 1/period, 2**-40 unless a shorter period is asked for, so that
the rounding adds up to less than a millionth of a block in a million slots. A stretch ends
within its first period then: the driver schedules every block once (rows / block_rows entries,
about half a million for 15 million rows), or one period where that is shorter, and every row looks up the slot of its block. Block numbers need no sort of a
whole source: rows are dealt to parts by a hash, counts of the parts give first numbers, and the
number within a part is a row number over a small group.

Defined results: null sources form one source; rows repeated with equal ids follow each other in
any order; beyond MAX_SOURCES sources, those with a given weight and then the largest have blocks of their
own, and the others share the blocks of GROUPS hash groups: a group has the sum of its sources' weights, and within
it rows go by deadline (row number / weight), so block and offset are the group's; a source without a given weight gets the least one given; ties of deadlines go to the
source that comes first by name; an empty table gives an empty result. Other columns pass
through; new columns (NEW) replace input columns so named.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm._tables import packed, table

NEW = ("block", "slot", "offset")
PARTS = 256
PERIOD = 1 << 40
CHUNK = 1024
BLOCK_ROWS = 32
MAX_SOURCES = 512
GROUPS = 128
_NONE = "\x00none"
_GROUP = "\x00group"


def quanta(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of a period, at least 1 each, by largest remainders."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: period * Fraction(w) / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: max(spare, 0)]:
        out[s] += 1
    while spare < 0:  # the least shares were raised to 1: the largest give it back
        s = max(out, key=lambda s: (out[s], s))
        given = min(-spare, max(1, out[s] // 2))
        out[s] -= given
        spare += given
    return out


def schedule_period(shares: dict[str, int], period: int, blocks: dict[str, int]) -> tuple[dict[str, list[int]], int]:
    """The slots that each source gets, by earliest deadline first among released blocks, and their number: one period, or until a source has all its blocks."""
    waiting = [(0, s, 1) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in shares}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * period // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        if i == blocks[s]:
            return out, slot + 1
        if i < shares[s]:
            heapq.heappush(waiting, (i * period // shares[s], s, i + 1))
    return out, period


def stretches(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[tuple[str, int, int, int, int, int, list[int]]]:
    """(source, first block, block after the last, first slot, share, period, slots in a period) of each source in each stretch."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        size = max(period, 2 * len(left))
        shares = quanta({s: weights[s] for s in left}, size)
        slots, end = schedule_period(shares, size, left)
        if end == size:
            # the stretch ends behind the last block of the source that is through first
            end = min((n - 1) // shares[s] * size + slots[s][(n - 1) % shares[s]] + 1 for s, n in left.items())
        for s in sorted(left):
            got = end // size * shares[s] + sum(x < end % size for x in slots[s])
            if got:
                out.append((s, done[s], done[s] + got, start, shares[s], size, slots[s]))
            done[s] += got
            left[s] -= got
        left = {s: n for s, n in left.items() if n}
        start += end
    return out


def slots_of(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[tuple[str, int, list[int]]]:
    """(source, chunk, slots of the CHUNK blocks from chunk * CHUNK on)."""
    of: dict[str, array] = {}
    for s, a, b, start, share, size, slots in stretches(blocks, weights, period):
        of.setdefault(s, array("q")).extend(start + i // share * size + slots[i % share] for i in range(b - a))
    return [(s, k // CHUNK, x[k : k + CHUNK].tolist()) for s, x in of.items() for k in range(0, len(x), CHUNK)]


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, source: str = "source", id: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """Every row with its block (of its source), slot (of the block in the mix) and offset (in the block).

    weights: target weight of each source; without them, the count of rows to the power `temperature`.
    """
    docs = docs.drop(*NEW)
    names = docs.columns
    keyed = docs.withColumns({"_source": F.coalesce(F.col(source).cast("string"), F.lit(_NONE)), "_tie": F.xxhash64(id)})
    keyed = keyed.withColumn("_part", F.pmod(F.xxhash64(F.lit(3), *(c for c in (id, "text") if c in names)), F.lit(PARTS)).cast("int"))
    counts = keyed.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    sources = counts.groupBy("_source").agg(F.sum("_n").alias("n"))
    given = {_NONE if k is None else k: float(w) for k, w in (weights or {}).items()}
    if given:
        asked = docs.sparkSession.createDataFrame(list(given.items()), "_source string, w double")
        sources = sources.join(F.broadcast(asked), "_source", "left")
        sources = sources.select("_source", "n", F.coalesce("w", F.lit(min(given.values()))).alias("w"), F.col("w").isNotNull().alias("named"))
    else:
        sources = sources.select("_source", "n", F.pow("n", F.lit(float(temperature))).alias("w"), F.lit(False).alias("named"))
    first = sources.orderBy(F.desc("named"), F.desc("n"), "_source").limit(MAX_SOURCES + 1).collect()
    grouped = len(first) > MAX_SOURCES
    if grouped:
        alone = first[: MAX_SOURCES - GROUPS]
        own = docs.sparkSession.createDataFrame([(r["_source"],) for r in alone], "_source string")
        small = sources.join(F.broadcast(own), "_source", "left_anti").withColumn("_group", F.concat(F.lit(_GROUP), F.pmod(F.xxhash64(F.lit(5), "_source"), F.lit(GROUPS)).cast("string")))
        groups = small.groupBy("_group").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.col("n") / F.col("w")).alias("end")).collect()
        totals = {r["_source"]: r["n"] for r in alone} | {r["_group"]: r["n"] for r in groups}
        target = {r["_source"]: r["w"] for r in alone} | {r["_group"]: r["w"] for r in groups}
    else:
        totals, target = {r["_source"]: r["n"] for r in first}, {r["_source"]: r["w"] for r in first}
    plan = slots_of({s: -(-n // block_rows) for s, n in totals.items()}, target, period)
    plan = docs.sparkSession.createDataFrame(plan, "_source string, _chunk long, _slots array<long>")
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a source at most
    firsts = counts.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_tie", id))
    ranked = keyed.withColumn("_row", within).join(firsts, ["_source", "_part"]).withColumn("_row", F.col("_row") + F.col("_first") - 1)
    if grouped:
        ranked = _in_groups(ranked, small, max(r["end"] for r in groups))
    ranked = ranked.withColumns({"block": F.expr(f"_row div {block_rows}"), "offset": F.pmod("_row", F.lit(block_rows)).cast("int")})
    met = ranked.alias("r").join(F.broadcast(plan).alias("p"), F.expr(f"r._source = p._source and r.block div {CHUNK} = p._chunk"))
    slot = F.expr(f"element_at(_slots, cast(block % {CHUNK} as int) + 1)")
    return met.select(*(F.col(f"r.{c}") for c in names), "block", slot.alias("slot"), "offset")


def _in_groups(ranked: DataFrame, small: DataFrame, end: float) -> DataFrame:
    """Rows of small sources get their group as source and their row number in it, by deadline (row / target of the source)."""
    joined = ranked.join(small.select("_source", "_group", "w"), "_source", "left")
    due = (F.col("_row") + 0.5) / F.col("w")
    joined = joined.withColumns({"_due": due, "_range": F.when(F.col("_group").isNotNull(), F.floor(due / F.lit(float(end)) * PARTS).cast("int"))})
    apart, together = joined.filter("_group is null"), joined.filter("_group is not null")
    counts = together.groupBy("_group", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # PARTS + 1 rows a group at most
    firsts = counts.select("_group", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_group", "_range").orderBy("_due", F.xxhash64("_source"), "_source", "_row"))
    together = together.withColumn("_nth", within).join(firsts, ["_group", "_range"])
    together = together.withColumns({"_source": F.col("_group"), "_row": (F.col("_before") + F.col("_nth") - 1).cast("long")})
    return apart.select(*ranked.columns).unionByName(together.select(*ranked.columns))


def mixed(docs: DataFrame, block_rows: int = BLOCK_ROWS, name: str = "mix", **options) -> DataFrame:
    """All rows in their own columns, in the order of the mix within and across partitions, with their place in it (name, which replaces a column so named)."""
    docs = docs.drop(name)
    source, id = options.pop("source", "source"), options.pop("id", "doc_id")
    inner, own = packed(docs.withColumns({"_source_in": F.col(source), "_id_in": F.col(id), "_text_in": F.xxhash64("text") if "text" in docs.columns else F.lit(0)}), "_source_in", "_id_in", "_text_in")
    found = scheduled(inner.withColumnRenamed("_text_in", "text"), block_rows=block_rows, source="_source_in", id="_id_in", **options)
    place = (F.col("slot") * block_rows + F.col("offset")).alias(name)
    return found.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset").select(*own[: len(docs.columns)], place)


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))).drop("text")


QUERIES = {"op8_pfair_mixing": op8_pfair_mixing}
ORACLE_SQL: dict[str, str] = {}
