"""What the training-data operators share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import discard, read, table  # noqa: F401

#: A-Z to a-z in UTF-8 bytes; other bytes stay.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Rows that a function of texts gets at once, so that a worker holds few copies of them.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def fold(id_column: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def placed(rows: DataFrame, group: Column, order: list[Column]) -> tuple[DataFrame, int, list[DataFrame]]:
    """rows with _g (the group as text; null and empty text differ, null comes first), _at (the row's place in its group, from 0, by `order`)
    and _n (the group's rows); the largest group's rows; and the tables written. Rows are dealt to ranges of group and order; only the
    ranges' counts meet."""
    key = F.when(group.isNull(), "").otherwise(F.concat(F.lit("v"), group.cast("string")))
    keyed = rows.withColumn("_g", key)
    ranged = keyed.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    dealt = table(ranged.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "placed")
    counts = dealt.groupBy("_g", "_part").agg(F.count("*").alias("_c"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("_g")  # a row for each range of a group
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = table(counts.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias("_n")), "placed-starts")
    found = dealt.join(starts, ["_g", "_part"]).withColumn("_at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")
    return found, starts.agg(F.max("_n")).first()[0] or 0, [dealt, starts]


#: Tables of up to so many rows (of at most about 64 bytes, or a host's few paths) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """df (a written table), to be broadcast if its size is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: crc32 in DuckDB: the table as a common table expression `crc`, and the value of an integer column, from a query that reads it beside.
CRC_SQL = (
    """eight AS (
  SELECT n, list_reduce(list_prepend(n::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n)
), crc AS (SELECT list(c ORDER BY n) AS t FROM eight)""",
    "xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({}::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)",
)


def schema_with(df: DataFrame, *more: str) -> StructType:
    """df's schema and further columns, each given as `name type`."""
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields])
    for column in more:
        name, kind = column.rsplit(" ", 1)
        schema = schema.add(name, StructType.fromDDL(f"x {kind}").fields[0].dataType)
    return schema


def bounded(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes if they are larger."""
    conf, name, size = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    if not 0 < int(conf.get(size).rstrip("b")) <= BATCH_BYTES:
        conf.set(size, str(BATCH_BYTES))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType, holds: str | None = None, gather: int = 0, brief: bool = False) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows, which bounds what tasks hold inside and outside the JVM. (The session's
    spark.sql.execution.arrow.maxRecordsPerBatch is lowered to that if it is larger.) holds: the kind of thing that run keeps by
    once(); all that earlier queries kept in the worker goes, and freed memory returns to the system before and after. gather:
    joins batches of short rows until they have so many. brief: for many short tasks, which look for unused memory only where
    something held goes."""
    bounded(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not release(holds) and not brief:
            trim()
        yield from run(gathered(batches, gather))
        if not brief:
            trim()

    return df.mapInArrow(whole, schema)


def arrow_rows(df: DataFrame, schema: StructType, per_partition: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], holds: str | None = None, gather: int = 0) -> DataFrame:
    """in_arrow with state built once a task: per_partition() returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = per_partition()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return in_arrow(df, run, schema, holds, gather)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else held
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def grouped(df: DataFrame, by: list[str], run: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: StructType, then: list[str] = (), nulls_last: bool = False, parts: int = 200, direct: bool = False) -> DataFrame:
    """run over (value, rows) for each value of the column `by`: its rows as tuples of all columns, that one first, ordered by `then`.
    A group's rows, packed blocks of a bounded number, are in one task's memory at once. parts: the number of tasks; as packed
    rows take long for their size, it isn't left to their bytes. direct: the value itself, modulo parts, names the task."""
    (key,) = by
    order = [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in then]
    rows = df.select(key, *[c for c in df.columns if c != key])
    dealt = rows.repartitionById(parts, F.pmod(F.col(key), F.lit(parts)).cast("int")) if direct else rows.repartition(parts, key)
    sorted_ = dealt.sortWithinPartitions(key, *order)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        value, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and row[0] != value:
                    yield value, rows
                    rows = []
                value = row[0]
                rows.append(row)
        if rows:
            yield value, rows

    return in_arrow(sorted_, lambda batches: run(groups(batches)), schema, brief=True)


def packed(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def squeezed(x: np.ndarray) -> bytes:
    """Compressed 64-bit integers, or 32-bit ones where all are so small, byte plane by byte plane."""
    kind = "<i4" if not len(x) or (x.max() < 2**31 and x.min() >= -(2**31)) else "<i8"
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), int(kind[2])).T).tobytes()
    return bytes([int(kind[2])]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(f"<i{width}").ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _held() -> dict:
    """What this Python process keeps between tasks: {kind: (key, thing)}."""
    return sys.modules.setdefault("_colloquy_held", types.ModuleType("_colloquy_held")).__dict__.setdefault("held", {})


def release(but: str | None = None) -> bool:
    """Lets go of all that is held but one kind; whether there was anything."""
    gone = [k for k in _held() if k != but]
    for kind in gone:
        del _held()[kind]
    if gone:
        trim()
    return bool(gone)


def trim() -> None:
    """Hands freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def once(kind: str, key, make: Callable):
    """make(), called once in this Python process for the key; a worker's later tasks use it again. Nothing else is kept beside it."""
    if len(_held()) > (kind in _held()):
        release(kind)
    if kind not in _held() or _held()[kind][0] != key:
        _held().pop(kind, None)
        _held()[kind] = key, make()
    return _held()[kind][1]


#: Keys of more characters are worked out each time: they seldom come again and would fill the memory.
LONG = 64


class Remembering(dict):
    """A dictionary that works out missing entries and keeps those met lately, of at most twice so many bytes. Long keys aren't kept."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def __missing__(self, key):
        if (found := self.old.pop(key, None)) is None:
            found = self.work_out(key)
            if len(key) > LONG:
                return found
        self[key] = found
        self.held += sys.getsizeof(key) + sys.getsizeof(found) + 100
        return found

    def age(self) -> None:
        """To be called between texts."""
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
