"""A logarithmic family of sparse suffix arrays.

The suffixes of a batch that start at anchors (see _anchors), in the order of a fingerprint of their
first elements, are the batch's suffix array: suffixes that agree that far stand next to each
other, in one array as between arrays. A new batch is merge-scanned against every level, which
yields the suffixes that two places share; then it joins the family as the lowest level, and
as long as two levels are of equal size they merge into the next. So a suffix is rewritten
once for each doubling of the family, and a scan meets a logarithmic number of levels.

Levels are tables in the shared folder: a later run can go on adding batches to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._tables import discard, release, saved, saved_at


class SuffixLevels:
    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame, str]] = []  # batches held, table (core, n), path; the largest first

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (core: the fingerprint of each sampled suffix); returns the cores that it shares with a level or has twice."""
        array, path = saved_at(batch.groupBy("core").agg(F.count("*").alias("n")).sortWithinPartitions("core"))
        found = array.filter("n > 1").select("core")
        for _, level, _ in self.levels:
            found = found.union(array.join(level.select("core"), "core").select("core"))
        found = saved(found.distinct())
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, other, old = self.levels.pop()
            merged, new = saved_at(array.union(other).groupBy("core").agg(F.sum("n").alias("n")).sortWithinPartitions("core"))
            for gone in (path, old):
                discard(batch.sparkSession, gone)
            array, path, size = merged, new, 2 * size
        self.levels.append((size, array, path))
        release(batch)
        return found
