"""Registry of runnable queries and their oracle SQL.

Every entry names its output columns and types once; the Spark result and the
oracle SQL are both projected onto that list, so the two sides compare cleanly.
Dates are compared as text and decimals as doubles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.bridge import Bridge, cte

_SPARK = {"l": "bigint", "s": "string", "d": "double", "b": "boolean"}
_DUCK = {"l": "BIGINT", "s": "VARCHAR", "d": "DOUBLE", "b": "BOOLEAN"}


@dataclass(frozen=True)
class Entry:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Bridge], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Bridge(spark, sf_dir))
        return df.select(*[F.col(c).cast(_SPARK[t]).alias(c) for c, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"CAST({c} AS {_DUCK[t]}) AS {c}" for c, t in self.columns)
        return f"SELECT {cols} FROM ({cte(self.sql)}) AS q"


ENTRIES: dict[str, Entry] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(bridge)`` under ``name``; ``columns`` is ``col:type`` words."""
    parsed = tuple(tuple(word.split(":")) for word in columns.split())

    def add(build):
        if name in ENTRIES:
            raise KeyError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, parsed, build, sql)
        return build

    return add


def exact_div(num: str, den: str, places: int) -> str:
    """Oracle text: integers ``num/den`` rounded half away from zero, as a decimal."""
    scaled = f"(2 * abs({num}) * {10 ** places} + abs({den})) // (2 * abs({den}))"
    signed = f"CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -({scaled}) ELSE ({scaled}) END"
    unit = f"CAST({10 ** -places:.{places}f} AS DECIMAL({places + 1},{places}))"
    return f"(CAST({signed} AS DECIMAL({37 - places},0)) * {unit})"


def huge(value: str, places: int) -> str:
    """Oracle text: a decimal expression as an integer with ``places`` digits."""
    return f"CAST(({value}) * {10 ** places} AS HUGEINT)"
