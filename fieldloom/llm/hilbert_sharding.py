"""Sharding along a Hilbert curve, in DataFrame operations only.

Several metadata dimensions are quantised to a few bits each, rows are ordered by their
index on the Hilbert curve through that grid, and the order is cut into runs, one a
shard. Rows close on the curve are close in every dimension, so each shard covers a
compact box and minimum/maximum statistics prune files in several dimensions at once.

Exact positions need no global sort. The grid has a bounded number of cells; each cell is
split by a hash into `SUBCELLS` parts, so that a hot cell is no single group. Counts of
rows and bytes per part (at most cells x SUBCELLS of them) give each part's first
position by prefix sums, within the cell and over the cells; the position within the
part is a row number over that small group.

Defined results: nulls sort lowest in a dimension; a null text has no bytes; equal rows
get neighbouring positions, in any order among themselves; ties on the curve follow a
hash of the id, then the id, then a hash of the text; an empty table gives an empty
result; other columns pass through, new names (NEW) replace input columns so named.
Laws of the cut: "rows" (counts at most one apart), "bytes" (a shard ends at the row in
which its equal share of all bytes ends, so shards differ by less than two rows' bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm._tables import table

SUBCELLS = 64
BITS = 3
ORDER_RANGE = 1 << 15
NEW = ("hilbert", "position", "shard", "slot")


def _rotate_right(word: int, by: int, n: int) -> int:
    by %= n
    return ((word >> by) | (word << (n - by))) & ((1 << n) - 1)


def _tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """For each of the 2**n sub-cubes in curve order: its entry point and direction; and the inverse Gray code."""
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0 if i == 0 else gray(2 * ((i - 1) // 2)) for i in range(1 << n)]
    direction = [0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % n for i in range(1 << n)]
    inverse = [0] * (1 << n)
    for i in range(1 << n):
        inverse[gray(i)] = i
    return entry, direction, inverse


def hilbert_index(dimensions: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a point with coordinates of `bits` bits each.

    Level by level from the highest bit, a state (entry point, direction) turns the
    sub-cube that holds the point into the next digit; lookups have 2**dimensions entries.
    """
    n = len(dimensions)
    entry, direction, inverse = _tables(n)
    array = lambda values: F.array(*map(F.lit, values))
    rotations = array([_rotate_right(w, d, n) for d in range(n) for w in range(1 << n)])
    at = lambda table, i: F.element_at(table, i + 1)

    def step(state: Column, label: Column) -> Column:
        digit = at(array(inverse), at(rotations, ((state.d + 1) % n) * (1 << n) + label.bitwiseXOR(state.e)))
        # rotating left by k is rotating right by n - k
        turned = at(rotations, ((2 * n - state.d - 1) % n) * (1 << n) + at(array(entry), digit))
        return F.struct(
            (state.h * (1 << n) + digit).alias("h"),
            state.e.bitwiseXOR(turned).alias("e"),
            ((state.d + at(array(direction), digit) + 1) % n).cast("int").alias("d"),
        )

    labels = [sum((F.shiftright(x.cast("int"), b).bitwiseAND(F.lit(1)) * (1 << j) for j, x in enumerate(dimensions)), F.lit(0)) for b in reversed(range(bits))]
    zero = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*labels), zero, step, lambda state: state.h)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes plus one for the end of the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def order_code(column: Column) -> Column:
    """A string's first seven bytes as a number in the same order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def scaled(column: str, low, high, bits: int) -> Column:
    """column's place between low and high, in 2**bits equal parts; null is 0."""
    if low is None:
        return F.lit(0)
    width = F.lit((int(high) - int(low)) // (1 << bits) + 1)
    return F.coalesce(F.floor((F.col(column) - F.lit(int(low))) / width), F.lit(0)).cast("int")


def with_cells(docs: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Adds `hilbert`; each dimension is a column of long values, quantised over its range in the whole table."""
    named = {f"_dim{i}": c.cast("long") for i, c in enumerate(dimensions.values())}
    ranges = docs.select(*(c.alias(k) for k, c in named.items())).agg(*(f(k).alias(f"{k}_{f.__name__}") for k in named for f in (F.min, F.max))).first()
    docs = docs.withColumns(named)
    return docs.withColumn("hilbert", hilbert_index([scaled(k, ranges[f"{k}_min"], ranges[f"{k}_max"], bits) for k in named], bits)).drop(*named)


def metadata(id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> dict[str, Column]:
    """The dimensions of documents: age (by id), size class, source and language."""
    size = text_bytes(text)
    return {
        "id": F.col(id),
        "size_class": 2 * F.length(F.bin(size)) + (F.substring(F.bin(size), 2, 1) == "1").cast("int"),
        "source": order_code(F.col(source)),
        "lang": order_code(F.col(lang)),
    }


def sharded(docs: DataFrame, shards: int = 8, law: str = "rows", bits: int = BITS, dimensions: dict[str, Column] | None = None, id: str = "doc_id", text: str = "text", size: Column | None = None, order: str | None = None) -> DataFrame:
    """Every row with its place on the curve (hilbert), position in the whole order, shard and slot in the shard.

    order: a column of whole numbers that decides the slots of a shard's rows; without it they follow the position.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    keep = [c for c in docs.columns if c not in NEW]
    docs = docs.select(*keep)
    size = text_bytes(text) if size is None else size
    placed = with_cells(docs, dimensions or metadata(id, text), bits)
    placed = placed.withColumns({"_size": size, "_tie": F.xxhash64(id), "_text": F.xxhash64(text)})
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_tie", "_text"), F.lit(SUBCELLS)).cast("int"))
    counts = placed.groupBy("hilbert", "_part").agg(F.count("*").alias("n"), F.sum("_size").alias("b"))
    cells = counts.groupBy("hilbert").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    over_cells = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)  # bounded: 2**(bits * dimensions) rows
    cells = cells.select("hilbert", *(F.coalesce(F.sum(c).over(over_cells), F.lit(0)).alias(f"cell_{c}") for c in "nb"))
    over_parts = Window.partitionBy("hilbert").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("hilbert", "_part", *(F.coalesce(F.sum(c).over(over_parts), F.lit(0)).alias(f"part_{c}") for c in "nb")).join(cells, "hilbert")
    firsts = firsts.select("hilbert", "_part", *((F.col(f"part_{c}") + F.col(f"cell_{c}")).alias(f"_first_{c}") for c in "nb"))
    total = counts.agg(F.sum("n"), F.sum("b")).first()
    n, b = (int(x or 1) for x in total)
    in_part = Window.partitionBy("hilbert", "_part").orderBy("_tie", id, "_text")
    ranked = placed.withColumns({"_row": F.row_number().over(in_part), "_run": F.sum("_size").over(in_part.rowsBetween(Window.unboundedPreceding, -1))})
    ranked = ranked.join(firsts, ["hilbert", "_part"]).withColumn("position", F.col("_first_n") + F.col("_row") - 1)
    if law == "rows":
        ranked = ranked.withColumn("shard", F.expr(f"position * {shards} div {n}").cast("int"))
        if order is None:
            return ranked.withColumn("slot", F.col("position") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).select(*keep, *NEW)
    else:
        ranked = ranked.withColumn("shard", F.expr(f"cast((_first_b + coalesce(_run, 0)) * {shards} div {b} as int)"))
        if order is None:
            starts = ranked.groupBy("shard").agg(F.min("position").alias("_start"))
            return ranked.join(F.broadcast(starts), "shard").withColumn("slot", F.col("position") - F.col("_start")).select(*keep, *NEW)
    return _slotted(ranked, order, id).select(*keep, *NEW)


def _slotted(placed: DataFrame, order: str, id: str) -> DataFrame:
    """Adds the slot in the shard by `order` (null first): counts of ranges of ORDER_RANGE give first slots, so no task sorts a shard."""
    placed = placed.withColumn("_range", F.coalesce(F.floor(F.col(order) / ORDER_RANGE), F.lit(-1)).cast("long"))
    counts = placed.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("shard", "_range").orderBy(order, "_tie", id, "_text"))
    return placed.withColumn("_nth", within).join(firsts, ["shard", "_range"]).withColumn("slot", F.col("_first") + F.col("_nth") - 1)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumns({"size": text_bytes(), "text_crc32": F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))})
    placed = sharded(docs, 8, "rows", size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op1_hilbert_sharding": op1_hilbert_sharding}
ORACLE_SQL: dict[str, str] = {}
