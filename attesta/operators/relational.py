"""Relational building blocks: conjunctive filters, latest rows, paging, roll-ups, copy-on-write mutation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of each severity in listings; anything else comes last.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def where_all(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    """Rows that meet every condition given; absent ones don't restrict."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def contains_any(term: str, *columns: str) -> Column:
    """Substring search over columns, ignoring case; the term is literal text."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(term.lower())) for c in columns])


def tenant_or_global(column: str, tenant: object) -> Column:
    """Rows of the tenant or of none; with no tenant only the latter."""
    own = F.col(column).isNull()
    return own if tenant is None else own | (F.col(column) == tenant)


def latest_ties(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key all rows with the greatest ``at`` (ties stay), by one aggregate and a join on keys and value."""
    last = df.groupBy(*keys).agg(F.max(at).alias(at))
    return df.join(last, [*keys, at], "left_semi")


def latest_one(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key one row: the greatest by ``order``. Aggregates before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def severity_rank(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return reduce(lambda chain, s: chain.when(column == s[1], s[0]), list(enumerate(SEVERITIES, 1))[1:], F.when(column == SEVERITIES[0], 1)).otherwise(len(SEVERITIES) + 1)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; the order has to end in a unique column."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int) -> DataFrame:
    """total and total_pages (at least 1)."""
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long"))


def share_of_total(counts: DataFrame, column: str, name: str) -> DataFrame:
    """Percent of the column's sum; the sum is one row."""
    return counts.crossJoin(counts.agg(F.sum(column).alias("__all"))).withColumn(name, F.round(100 * F.col(column) / F.col("__all"), 6)).drop("__all")


def patched(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the non-null values of ``patch`` (unique by keys) in place of its own."""
    names = {c: f"__new_{c}" for c in patch.columns if c not in keys}
    joined = base.join(patch.select(*keys, *[F.col(c).alias(n) for c, n in names.items()]), keys, "left")
    return joined.select(*[F.coalesce(F.col(names[c]), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def replaced_by_latest(log: DataFrame, keys: list[str], version: list[str], deleted: str) -> DataFrame:
    """Current rows of an append-only log with tombstones: the latest row of each key, unless it is one."""
    return latest_one(log, keys, version).where(~F.col(deleted)).drop(deleted)
