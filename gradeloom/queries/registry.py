"""Registry behind ``__spark_entry__``: a query, and the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradeloom.queries.feed import FEED_SQL, Feed


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Feed], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``build(feed)``; ``uses`` names the feed relations the SQL reads."""

    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        text = None
        if sql is not None:
            ctes = [f"{n} AS ({FEED_SQL[n].strip()})" for n in uses.split()]
            text = f"WITH {', '.join(ctes)} SELECT * FROM ({sql.strip()})" if ctes else sql.strip()
        REGISTRY[name] = Query(name, build, text)
        return build

    return wrap


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: REGISTRY[name].build(Feed(spark, sf_dir))
