"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: DuckDB's groups (grp, n) dealt one by one: bins with these multiples of their load compared.
DEALT = """, o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp NULLS FIRST) AS i FROM g),
one AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS grp, 0::BIGINT AS bin, {zeros}::BIGINT[] AS load UNION ALL
  SELECT i, grp, bin, list_transform(load, lambda x, k: x + CASE WHEN k = bin THEN n ELSE 0 END) FROM (
    SELECT o.i, o.grp, o.n, load, list_position(list_transform(load, lambda x, k: x * {times}[k]), list_min(list_transform(load, lambda x, k: x * {times}[k])))::BIGINT AS bin FROM one JOIN o ON o.i = one.i + 1))"""


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the decorated query; `views` are definitions that the SQL stands on."""

        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = (f"WITH {views} " if views else "") + sql
            return query

        return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded to what two engines agree on; 0 has no sign."""
    fix: Callable[[str], Column] = lambda c: F.round(c, places) + F.lit(0.0)
    return df.select(*(fix(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def drawn_sql(name: str, rows: str, keys: str, seed: int, by: str, sums: dict[str, str]) -> str:
    """CTEs that end in `name` (keys, rep, by, sums): replicates of `rows`, as bootstrap.resampled draws them."""
    k, text, part = (f"{keys}, ", f" || '-' || {keys}", f"PARTITION BY {keys} ") if keys else ("", "", "")
    given = f", {by}" if by else ""
    first, again = (", ".join(f"{f(n)} AS {n}" for n in sums) for f in (sums.get, "sum({})".format))
    return f"""{name}_s AS (SELECT {k}coalesce(group_id, '') AS grp{given}, {first} FROM {rows} GROUP BY ALL),
{name}_g AS (SELECT {k}grp, row_number() OVER ({part}ORDER BY grp) - 1 AS g, count(*) OVER ({part}) AS n_groups FROM (SELECT DISTINCT {k}grp FROM {name}_s)),
{name}_p AS (SELECT {k}rep, CAST('0x' || substr(md5('{seed}'{text} || '-' || rep || '-' || g), 1, 12) AS BIGINT) % n_groups AS g FROM {name}_g, range(200) t(rep)),
{name}_o AS (SELECT s.*, g FROM {name}_s s JOIN {name}_g USING ({k}grp)),
{name} AS (SELECT {k}rep{given}, {again} FROM {name}_p JOIN {name}_o USING ({k}g) GROUP BY ALL)"""
