"""Registration of queries: name, survey items, Spark callable, check SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base_sql import with_base
from .tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None, extra: str = "", bare: bool = False):
    """``bare`` SQL stands alone; otherwise the domain tables are prepended."""
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        text = None if sql is None else (sql if bare else with_base(sql, extra))
        REGISTRY[name] = Query(name, ids, build, text)
        return build
    return register


def plain(df: DataFrame) -> DataFrame:
    """Comparable types: DECIMAL as double, string arrays as one text, timestamps as text."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, " | ")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def callable_for(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(q.build(Tables(spark, sf_dir)))
    run.__name__ = q.name
    return run
