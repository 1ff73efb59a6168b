"""Per-key order statistics where a few keys hold most rows (problem 4).

Rows are first combined map-side: every input partition keeps a bounded hash
table of distinct (key, value) pairs, which spills its pairs when it is full, so
only compact distinct pairs are exchanged. They are range-partitioned by (key,
value), so that a hot key spreads over as many partitions as its share needs, and
equal pairs of several input partitions meet there and merge. Each sorted
partition then answers all keys that lie wholly inside it; only the first and
last key of a partition can reach into a neighbour, so two counts per partition
settle the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.runtime import checkpointed


# Pairs, and bytes of them, that a hash table holds before it spills.
TABLE_ROWS, TABLE_BYTES = 200_000, 64 << 20
# Pairs of a range partition, about.
RANGE_ROWS = 1_000_000


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of the batches, as far as a bounded hash table can tell."""
    held: list[pa.Table] = []
    rows = size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= TABLE_ROWS or size >= TABLE_BYTES:
            table = pa.concat_tables(held).group_by(batch.schema.names).aggregate([])
            held, rows, size = [table], table.num_rows, table.nbytes
            # a table that hardly shrinks spills
            if rows >= TABLE_ROWS // 2 or size >= TABLE_BYTES // 2:
                yield from table.to_batches(max_chunksize=10_000)
                held, rows, size = [], 0, 0
    if held:
        yield from pa.concat_tables(held).group_by(held[0].schema.names).aggregate([]).to_batches(max_chunksize=10_000)


def _runs(keys: list[pa.Array]) -> np.ndarray:
    """Start positions of the runs of equal key tuples, and the end."""
    n = len(keys[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for k in keys:
        if n > 1:
            change[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(change), n)


def _head(columns: list[pa.Array], at: int) -> tuple:
    return tuple(c[at].as_py() for c in columns)


class _Run:
    """A key's run of values that goes on over several batches."""

    def __init__(self, head: tuple, want: int | None):
        self.head, self.want, self.seen = head, want, 0
        self.parts: list[pa.Array] = []
        self.found: str | None = None

    def add(self, values: pa.Array) -> None:
        if self.want is None:
            self.parts.append(values)  # ends inside this partition, so it is no longer than one
        elif 0 <= self.want - self.seen < len(values):
            self.found = values[self.want - self.seen].as_py()
        self.seen += len(values)

    def answer(self) -> str | None:
        at = (self.seen + 1) // 2 - 1
        for part in self.parts:
            if at < len(part):
                return part[at].as_py()
            at -= len(part)
        return self.found


def lower_medians(rows: DataFrame, keys: list[str], value: str, out: str = "mid_value", partitions: int | None = None) -> DataFrame:
    """(keys..., out): of each key's n distinct values the (n + 1) div 2-th.

    Values are non-null strings in byte order (which is code point order); rows
    with a null key or value are left out; repeats count once; an empty table
    gives an empty result. Other columns are ignored. No key is ever gathered
    in one task: a task streams over one range partition of distinct pairs, of
    which there are as many as the rows ask for (``RANGE_ROWS`` each, about).
    """
    spark = rows.sparkSession
    cond = F.col(value).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    slim = rows.where(cond).select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).cast("string").alias("_v"))
    # the count reads no column and is an upper bound of the pairs
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // RANGE_ROWS))
    order = [*keys, "_v"]
    pairs = slim.mapInArrow(combine, ", ".join(f"`{k}` string" for k in order))
    # equal pairs lie in one range, so they merge there without another exchange
    ranged = pairs.repartitionByRange(n, *order).distinct().withColumn("_part", F.spark_partition_id())
    # a reliable checkpoint keeps the ranges as partitions and their order, without another shuffle
    ranged = checkpointed(ranged.sortWithinPartitions(*order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, head, many = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column("_part"), *(batch.column(k) for k in keys)]
            at = _runs(cols)
            if (begin := _head(cols, 0)) != head:
                first = first or (head and (head, many))
                head, many = begin, 0
            many += int(at[1])
            if len(at) > 2:
                first = first or (head, many)
                head, many = _head(cols, int(at[-2])), int(at[-1] - at[-2])
        found = [x for x in (first, head and (head, many)) if x]
        if found:
            columns = [pa.array([h[i] for h, _ in found], pa.int32() if i == 0 else pa.string()) for i in range(len(keys) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c in found], pa.int64())], names=["_part", *keys, "_c"])

    # at most two rows per range partition: bounded by the number of partitions
    spans = ranged.mapInArrow(ends, "_part int, " + ", ".join(f"`{k}` string" for k in keys) + ", _c long")
    edge: dict[tuple, list[tuple[int, int]]] = {}
    for r in spans.collect():
        edge.setdefault(tuple(r[k] for k in keys), []).append((r["_part"], r["_c"]))
    # (partition, key) -> index inside the partition of the wanted value, or -1
    pick: dict[tuple, int] = {}
    for key, parts in edge.items():
        want = (sum(c for _, c in parts) + 1) // 2 - 1
        for part, c in sorted(parts):
            pick[(part, *key)] = want if 0 <= want < c else -1
            want -= c
    chosen = spark.sparkContext.broadcast(pick)
    names = [*keys, out]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        done: list[tuple] = []

        def close() -> None:
            if run is not None and (found := run.answer()) is not None:
                done.append((*run.head[1:], found))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols, values = [batch.column("_part"), *(batch.column(k) for k in keys)], batch.column("_v")
            at = _runs(cols)
            # the first and the last run may go on in other batches; those between are whole
            for i in sorted({0, len(at) - 2}):
                if run is None or run.head != (head := _head(cols, int(at[i]))):
                    close()
                    head = _head(cols, int(at[i]))
                    run = _Run(head, chosen.value.get(head))
                run.add(values.slice(int(at[i]), int(at[i + 1] - at[i])))
            inner = at[1:-1]
            if len(inner) > 1:
                take = pa.array(inner[:-1] + (np.diff(inner) + 1) // 2 - 1)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in cols[1:]), values.take(take)], names=names)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(len(names))], names=names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(len(names))], names=names)

    return ranged.mapInArrow(choose, ", ".join(f"`{k}` string" for k in names))


def hot_key_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n_rows, share): how much of a table each key holds.

    Plain algebraic aggregates, combined map-side. Null keys form a key of
    their own; an empty table gives an empty result.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n_rows") / F.col("_total")).drop("_total")
