"""Payload columns: JSON texts as variants, read by path, with malformed ones kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_payloads(rows: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows with the payload as a variant, rows whose payload is no JSON, as they came). A null payload is none of both."""
    parsed = rows.filter(F.col(column).isNotNull()).withColumn("parsed_", F.try_parse_json(column))
    good = parsed.filter("parsed_ is not null").withColumn(column, F.col("parsed_")).drop("parsed_")
    return good, parsed.filter("parsed_ is null").drop("parsed_")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order (unique in a key): an upsert that keeps the last save. The order is found first, so only that row's payload moves to a join."""
    last = rows.groupBy(*keys).agg(F.max(order).alias(order))
    return rows.join(last, [*keys, order], "left_semi")


def listed(snapshots: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Snapshots in order, at most limit of them; a limit below one is refused."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    ordered = snapshots.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def canonical_digest(payload):
    """A digest of a variant's JSON: keys sorted, no spaces, so texts that differ in these only are equal."""
    return F.sha2(F.to_json(payload), 256)
