"""Tables of jobs, users and logs: lists, counts, and changes as new tables. Rules of the service (quotas, permissions, states) aren't part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows delivered twice count once."""
    return rows.dropDuplicates(keys)


def newest(rows: DataFrame, by: str, limit: int = 50, offset: int = 0, most: int = 100, tie: str | None = None) -> DataFrame:
    """A page of the newest rows: at most `most` of them. A limit on a sort is a top-k: no partition sends more than it."""
    order = [F.desc(by), *([tie] if tie else [])]
    return rows.orderBy(*order).offset(offset).limit(min(limit, most)) if offset else rows.orderBy(*order).limit(min(limit, most))


def counts(rows: DataFrame, by: str, domain: list[str]) -> DataFrame:
    """(by, n): numbers of rows by value, 0 for values of the domain that don't occur; others appear if they occur."""
    known = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{by} string")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col(by).isNotNull()).join(F.broadcast(known), by, "full").select(by, F.coalesce("n", F.lit(0)).alias("n"))  # a domain has a handful of values


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, to the nearest."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000).cast("bigint")


def with_defaults(keys: DataFrame, rows: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Keys with their rows, or with defaults where there is none (get or create)."""
    joined = keys.join(rows, on, "left")
    return joined.select(on, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def upserted(rows: DataFrame, changes: DataFrame, on: str, update: list[str]) -> DataFrame:
    """Rows with changes merged in: where the key is there the columns of `update` take the new value, else the change is a new row."""
    c = changes.select(on, *[F.col(x).alias(f"_{x}") for x in changes.columns if x != on], F.lit(True).alias("_changed"))
    joined = rows.withColumn("_there", F.lit(True)).join(c, on, "full")
    cols = []
    for name in rows.columns:
        if name == on:
            cols.append(F.col(on))
        elif f"_{name}" in c.columns:
            new = F.col("_changed").isNotNull() & (F.lit(name in update) | F.col("_there").isNull())
            cols.append(F.when(new, F.col(f"_{name}")).otherwise(F.col(name)).alias(name))
        else:
            cols.append(F.col(name))
    return joined.select(*cols)


def added(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with new ones appended; missing columns are null."""
    return rows.unionByName(new, allowMissingColumns=True)


def keyed(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a new random key each. Write them before use: a key is drawn anew whenever the plan runs."""
    return rows.withColumn(key, F.uuid())


def stamped(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns set to the time of the query, without a zone, in UTC."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return rows.withColumns({c: now for c in columns})


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with values set where a condition holds; rows for which it is null stay."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def deleted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows without those of the keys."""
    return rows.join(keys, on, "left_anti")


def migrated(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Rows with columns added that they lack, filled with a value: name to (type, value). Existing ones get the value where they are null."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)).cast(t) if k in rows.columns else F.lit(v).cast(t) for k, (t, v) in columns.items()})


def listed_segments(text: Column, known: list[str]) -> tuple[Column, Column]:
    """(parts, unknown) of a comma-separated list: trimmed, without empty ones; unknown: those that aren't known, sorted."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return parts, F.array_sort(F.array_except(parts, F.array(*[F.lit(k) for k in known])))
