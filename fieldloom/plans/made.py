"""Columns picked from short lists by a key, for queries over rules that the test tables hold no values for; as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = str | float | int | bool | None


def literal(value: Value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)


class Made:
    """values[(key // step) % len(values)] for each name; every name has a step of its own, so that the lists mix."""

    def __init__(self, key: str, lists: dict[str, list[Value]]):
        self.key, self.lists = key, lists
        self.steps = {name: 1 + 2 * k for k, name in enumerate(lists)}

    def column(self, name: str) -> Column:
        values = self.lists[name]
        kind = next((type(v) for v in values if v is not None), str)
        ddl = {str: "string", float: "double", int: "bigint", bool: "boolean"}[kind]
        at = F.pmod(F.floor(F.col(self.key) / self.steps[name]), F.lit(len(values))).cast("int")
        return F.get(F.array(*(F.lit(v).cast(ddl) for v in values)), at)

    def columns(self) -> list[Column]:
        return [self.column(n).alias(n.replace(":", "_")) for n in self.lists]

    def tags(self, *names: str) -> Column:
        """A map of the names (all by default) to the values that are there."""
        return F.map_filter(F.create_map(*(x for n in names or self.lists for x in (F.lit(n), self.column(n)))), lambda k, v: v.isNotNull())

    def sql(self) -> str:
        return ", ".join(f"list_extract([{', '.join(map(literal, v))}], ({self.key} // {self.steps[n]}) % {len(v)} + 1) AS \"{n.replace(':', '_')}\"" for n, v in self.lists.items())
