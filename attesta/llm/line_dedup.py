"""Site-relative line frequency: drop lines that stand on too large a share of their host's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.session import cut

#: A line is boilerplate when it stands on more than this share of its host's pages, and on this many pages at least.
BOILERPLATE_RATIO = 0.02
LEAST_PAGES = 5
#: Up to this many boilerplate lines (16 bytes each and their hosts' names) are broadcast; more are joined by host.
BROADCAST_LINES = 100_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per boilerplate line of a host: host, key (128-bit hash of the line), n_pages, host_pages.

    A line counts once per page. Pages without text count towards their host's total;
    blank lines are never boilerplate; a null host is a host of its own.
    """
    own = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = own.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.trim("line") != "")
    seen = lines.select("host", _key(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n_pages"))
    frequent = seen.where(F.col("n_pages") >= least_pages)
    joined = frequent.alias("f").join(totals.alias("t"), F.col("f.host").eqNullSafe(F.col("t.host")))
    return joined.where(F.col("n_pages") / F.col("host_pages") > ratio).select("f.host", "key", "n_pages", "host_pages")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, plus n_lines and n_dropped (longs).

    The order of the remaining lines is kept. A null text stays null with 0 lines; an
    empty text has one blank line, which stays. Repeated rows are pages of their own.
    Other columns pass through; columns already named n_lines or n_dropped are replaced.

    Counting shuffles one 16-byte key per distinct line, host and map task. The lines
    found are at most (lines per page / ratio) for a host; they are broadcast when
    there are few, else joined by host, where adaptive execution splits a hot host.
    """
    found = cut(boilerplate_lines(pages, host, text, ratio, least_pages))
    mark = "__"
    while any(c.startswith(mark) for c in pages.columns):  # names of its own, whatever the columns are called
        mark += "_"
    host_, keys, lines, left = (mark + c for c in ("host", "keys", "lines", "kept"))
    per_host = found.groupBy(F.col("host").alias(host_)).agg(F.collect_list("key").alias(keys))
    if found.count() <= BROADCAST_LINES:
        per_host = F.broadcast(per_host)
    rows = pages.drop(*[c for c in ("n_lines", "n_dropped") if c in pages.columns])
    columns = [F.col(c) for c in rows.columns]
    joined = rows.join(per_host, F.col(host).eqNullSafe(F.col(host_)), "left").withColumn(lines, F.split(text, "\n"))
    kept = F.when(F.col(keys).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(keys), _key(x))))
    joined = joined.withColumn(left, kept)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return joined.withColumn(text, F.array_join(left, "\n")).select(*columns, size(lines).alias("n_lines"), (size(lines) - size(left)).alias("n_dropped"))
