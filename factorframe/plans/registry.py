"""Query registry: one Spark callable, its SQL twin and the output contract of both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.plans.testbed import Tables
from factorframe.session import split_large_methods

# Output contract per column: an int is a double rounded to that many places; the rest are plain types.
SPARK_TYPES = {"int": "bigint", "str": "string", "date": "date", "bool": "boolean"}
SQL_TYPES = {"int": "BIGINT", "str": "VARCHAR", "date": "DATE", "bool": "BOOLEAN"}


def rounded(value: Column, digits: int) -> Column:
    """F.round of a double, by plain arithmetic wherever the number is far from a tie of its decimals and small enough to be exact.

    F.round writes every number out as decimal text, which costs more than most factors.
    """
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < float(1 << 40)) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / 10.0**digits).otherwise(F.round(value, digits))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: dict[str, object]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        split_large_methods(spark)
        df = self.build(Tables(spark, sf_dir))
        out = []
        for name, kind in self.columns.items():
            if isinstance(kind, int):
                out.append((rounded(F.col(name).cast("double"), kind) + F.lit(0.0)).alias(name))
            else:
                out.append(F.col(name).cast(SPARK_TYPES[kind]).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns.items():
            if isinstance(kind, int):
                out.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
            else:
                out.append(f"CAST({name} AS {SQL_TYPES[kind]}) AS {name}")
        return f"SELECT {', '.join(out)} FROM ({self.sql}) final_result"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: dict[str, object], sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, columns, sql)
        return build

    return register
