"""Registry of named queries: a builder and, where SQL can say it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertrail.session import tune

Builder = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
#: Bytes of text that one part of a spread table holds.
PART_BYTES = 8 << 20


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._parts = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table of texts dealt out by ``key``: its files may hold fewer row groups than there are tasks, and what is made of each
        row is large. What is made of a row stays beside it, so grouping by the key moves nothing again; the number of parts
        follows from the bytes of the texts, so no task holds more of them however large the table is."""
        table = getattr(self, name)
        if name not in self._parts:
            size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            self._parts[name] = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
        return table.repartition(self._parts[name], key)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a builder; ``uses`` names the shared CTEs its SQL twin reads."""
    def register(build: Builder) -> Builder:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = expand_fix(with_ctes(sql, uses))
        return build
    return register


def expand_fix(sql: str) -> str:
    """Write ``fix(x, d)`` out as rounding with exact ties going up (see scalars.fix)."""
    while (start := sql.find("fix(")) >= 0:
        depth, comma, at = 1, -1, start + 4
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[at], 0)
            comma = at if sql[at] == "," and depth == 1 else comma
            at += 1
        if comma < 0:
            raise ValueError(f"fix() needs a number of digits: {sql[start:at]}")
        sql = f"{sql[:start]}round(({sql[start + 4:comma]}) + 1e-9::DOUBLE,{sql[comma + 1:at]}{sql[at:]}"
    return sql


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def with_ctes(sql: str, uses: tuple[str, ...]) -> str:
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        body, needs = CTES[name]
        for need in needs:
            visit(need)
        ordered.setdefault(name, body)

    for name in uses:
        visit(name)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS ({body})" for name, body in ordered.items())
    stripped = sql.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{stripped[len('WITH RECURSIVE'):]}"
    if stripped.upper().startswith("WITH"):
        return f"WITH RECURSIVE {head},\n{stripped[len('WITH'):]}"
    return f"WITH RECURSIVE {head}\n{stripped}"


def similarity_cte(name: str, pairs: str, *needs: str) -> None:
    """CTE ``name`` (a, b, ratio): the matching-blocks ratio of the distinct text pairs (a, b) that ``pairs`` selects. The
    longest common run, earliest in a and then in b, is taken out; what is left of it and right of it is compared again."""
    cte(f"{name}_pairs", f"SELECT DISTINCT a, b FROM ({pairs})", *needs)
    cte(f"{name}_parts", f"""
      SELECT a AS a0, b AS b0, a, b, 0::BIGINT AS matched FROM {name}_pairs
      UNION ALL SELECT a0, b0, part.a, part.b, part.matched FROM (
        SELECT a0, b0, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1), 'matched': n}},
                               {{'a': substr(a, i + n), 'b': substr(b, j + n), 'matched': 0}}]) AS part
        FROM (SELECT a0, b0, a, b, best.n AS n, -best.i AS i, -best.j AS j FROM (
          SELECT *, list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(b) + 1), lambda j:
            {{'n': len(list_filter(range(1, least(len(a) - i, len(b) - j) + 2), lambda k: substr(a, i, k) = substr(b, j, k))),
              'i': -i, 'j': -j}})))) AS best
          FROM {name}_parts WHERE len(a) > 0 AND len(b) > 0)) WHERE n > 0)""", f"{name}_pairs")
    cte(name, f"SELECT a0 AS a, b0 AS b, 2.0::DOUBLE * sum(matched) / (len(a0) + len(b0)) AS ratio FROM {name}_parts GROUP BY a0, b0",
        f"{name}_parts")


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Builder):
        return lambda spark, folder: build(Tables(tune(spark), folder))
    return {name: bind(build) for name, build in QUERIES.items()}
