"""Keyset pages of published rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipfold.functions.text import base64url, from_base64url
from clipfold.operators.automata import numbered

SIZE, VERSION = 12, "v1"


def page_size(limit: int | None) -> int:
    """12 by default and at most; nonsense counts as the default."""
    return SIZE if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0 else min(limit, SIZE)


def cursor(at: Column, key: Column) -> Column:
    """An opaque cursor of a row's time (ISO text) and id."""
    return base64url(F.concat_ws("\n", F.lit(VERSION), at, key.cast("string")))


def cursor_parts(code: Column) -> Column:
    """(at, key) of a cursor, null if it is malformed or of another version."""
    good = code.rlike("^[A-Za-z0-9_-]{8,512}$") & (F.pmod(F.length(code), F.lit(4)) != 1)
    parts = F.split(F.when(good, from_base64url(code)), "\n")
    return F.when((F.size(parts) == 3) & (parts[0] == VERSION), F.struct(parts[1].alias("at"), parts[2].alias("key")))


def page(rows: DataFrame, at: str, key: str, limit: int | None = None, after: str | None = None) -> DataFrame:
    """A page, newest first, each row with the cursor behind it; ``has_more`` tells whether a next page exists.

    ``at`` is ISO text, which sorts as time does. A malformed cursor, or one of
    no existing row, gives an empty page. It reads one row more than it
    returns, through a top-k and not a sort of the table.
    """
    n = page_size(limit)
    if after is not None:
        place = cursor_parts(F.lit(after))
        exists = rows.filter((F.col(at) == place["at"]) & (F.col(key).cast("string") == place["key"])).select(F.col(at).alias("_at"), F.col(key).alias("_key")).limit(1)
        rows = rows.join(F.broadcast(exists), (F.col(at) < F.col("_at")) | ((F.col(at) == F.col("_at")) & (F.col(key) < F.col("_key")))).drop("_at", "_key")
    top = rows.orderBy(F.desc(at), F.desc(key)).limit(n + 1)
    numbered = top.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(at), F.desc(key))))  # n + 1 rows at most
    total = F.max("_n").over(Window.partitionBy(F.lit(1)))
    return numbered.withColumn("has_more", total > n).filter(F.col("_n") <= n).withColumn("cursor", cursor(F.col(at), F.col(key))).drop("_n")


def by_slug(rows: DataFrame, slug: str) -> DataFrame:
    """At most two rows of a slug: two mean that it isn't unique."""
    return rows.filter(F.col("slug") == slug).limit(2)


def order_violations(rows: DataFrame, at: str, key: str, place: str, parts: int = 0) -> DataFrame:
    """Rows, in the order of ``place``, that don't come strictly after the one before them.

    Rows are compared within ranges of ``place`` (``parts`` of them; 0: as many
    as shuffles have); where two ranges meet, the last row of the earlier one
    comes from a table of a row for each range.
    """
    ranges = numbered(rows, [place], parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.struct(F.col(at).alias("a"), F.col(key).alias("k"))
    last = ranges.groupBy("_part").agg(F.max_by(own, place).alias("_l"))
    seams = last.select("_part", F.lag("_l").over(Window.orderBy("_part")).alias("_seam"))  # a row for each range
    before = F.coalesce(F.lag(own).over(Window.partitionBy("_part").orderBy(place)), F.col("_seam"))
    out = ranges.join(F.broadcast(seams), "_part").withColumn("_b", before)
    return out.filter(F.col("_b.a").isNotNull() & (own >= F.col("_b"))).drop("_b", "_seam", "_part")


def empty_like(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.createDataFrame([], rows.schema)
