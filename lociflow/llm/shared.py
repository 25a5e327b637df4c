"""Helpers that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.sources.places import delete, shared_path, shared_root  # noqa: F401

#: Folders written inside each open ``scratch`` of this thread, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratches", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written inside; what was to be kept goes to the ``scratch`` around it, if there is one."""
    outer = _OPEN.get()
    token = _OPEN.set((*outer, own := []))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            delete(spark, path)


def scratch_path(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A fresh folder name below the shared root, to be deleted at the end of the open ``scratch``, or of the one around it if ``keep`` is set."""
    path, held = shared_path(spark, what), _OPEN.get()
    held = held[:-1] if keep else held
    if held:
        held[-1].append(path)
    return path


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage at files that outlive any executor. Within ``scratch`` they go at its
    end, or with ``keep`` at the end of the one around it.
    """
    path = scratch_path(df.sparkSession, what, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row even where ``use`` needs it in a lambda for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def not_broadcast(df: DataFrame) -> DataFrame:
    """``df`` marked for a sort-merge join.

    Spark judges a table by the file it comes from: keys exploded from a small one, or rows that are packed
    well, look small enough to be sent through the driver when they are not.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, row_bytes: Column, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its rows, at ``row_bytes`` each, take at most ``limit`` bytes; else for a sort-merge join."""
    size = df.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else not_broadcast(df)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, or a longer name that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``size`` bytes of ``column`` each, at least one row."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def crc32_sql(value: str | None = None) -> str:
    """DuckDB text for an unsigned crc32: without ``value`` the tables a WITH RECURSIVE list needs first, with it the expression."""
    if value is None:
        return """crc_k(k, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM crc_k WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY k) AS crc_t FROM crc_k WHERE i = 8)"""
    each = f"list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || hex(encode({value}))[2 * i + 1 : 2 * i + 2])::bigint)"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295::bigint, {each}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295) FROM crc_table)"
