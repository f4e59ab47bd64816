"""Long recordings in blocks: pieces of bounded size that tasks transform alone, and sums over the pieces of a recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a block.
BLOCK = 1 << 15


def sample_blocks(df: DataFrame, by: list[str], place: str, values: list[str], halo: int = 0, block: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by..., keep..., block, ks, one array per value): samples placed 0, 1, 2 ... in blocks, each with `halo` samples of its neighbours on either side.

    A recording of any length is as many rows as it has blocks; `keep` are columns that are the same in a whole recording.
    """
    size = block or BLOCK
    own = F.floor(F.col(place) / size).cast("bigint")
    if halo:
        first, last = F.floor((F.col(place) - halo) / size), F.floor((F.col(place) + halo) / size)
        own = F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("bigint"), last.cast("bigint")))
    placed = df.select(*by, *keep, own.alias("block"), F.col(place).cast("bigint").alias("_p"), *[F.col(v).cast("double").alias(v) for v in values])
    found = placed.groupBy(*by, *keep, "block").agg(F.array_sort(F.collect_list(F.struct("_p", *values))).alias("_all"), F.max((F.col("_p") >= F.col("block") * size) & (F.col("_p") < (F.col("block") + 1) * size)).alias("_own"))
    return found.where("_own").select(*by, *keep, "block", F.col("_all._p").alias("ks"), *[F.col(f"_all.{v}").alias(v) for v in values])


def array_of(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """A row's array, NaN for NULL."""
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False).astype(np.float64)


def array_sums(df: DataFrame, by: list[str], at: list[str], finish: Callable[[list, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """What finish(key, sums) gives for the sums of the binary column `sums` (doubles, of one length for a key) over each key (by..., at...).

    A key's arrays stream through one task, which holds a single one of them.
    """
    keys = [*by, *at]
    names = [x.split(" ")[0].strip("`") for x in schema.split(", ")]
    kinds = dict(df.dtypes)
    typed = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *([schema] if schema else [])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, types = None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            out = list(finish(now, total))
            if out:
                columns = [pa.array([k] * len(out), t) for k, t in zip(now, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(list(c)) for c in zip(*out, strict=True))], names=[*keys, *names])

        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            for key, raw in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), batch.column("sums").to_pylist(), strict=True):
                more = np.frombuffer(raw)
                if key == now:
                    total = total + more
                else:
                    if now is not None:
                        yield from given()
                    now, total = key, more
        if now is not None:
            yield from given()

    return df.select(*keys, "sums").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, typed)
