"""Slices that arrive as a stream: running statistics, and chunks that are folded as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tessavox.operators import stats


def running_statistics(vox: DataFrame, *groups: str) -> DataFrame:
    """The statistics of all that has come so far; sums are the state, one row for each group."""
    return stats.statistics(vox, *groups)


def windowed_statistics(events: DataFrame, time: str, length: str, late: str, *groups: str, v: str = "v") -> DataFrame:
    """Statistics of windows of event time; rows later than the watermark are dropped."""
    mean, std = stats.mean_std(F.col("n"), F.col("sx"), F.col("sx2"))
    sums = events.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), *groups).agg(*stats.accumulators(v))
    return sums.select("window", *groups, "n", mean.alias("mean"), std.alias("std"), "min", "max")


def into_blocks(vox: DataFrame, path: str, checkpoint: str, block: int = 64) -> StreamingQuery:
    """Appends arriving voxels to Parquet folders of z blocks, each batch once."""
    rows = vox.withColumn("bz", F.expr(f"z DIV {block}"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("bz").outputMode("append").trigger(availableNow=True).start()


def blended(chunks: DataFrame, depth: int, size: int, band: int = 64) -> DataFrame:
    """z, y, x, v of chunks (z0, z, y, x, v) that arrive in the order of their starts: ``stitch.blended`` of a stream.

    For each band of rows the state holds what a later chunk can still change, the part of the volume from the newest chunk's start
    on; what lies before it leaves at once, and all of it with the last chunk of a volume of this depth. Rows of a chunk may come in
    several batches as long as no later chunk has come in their band; rows that come after one are left out.

    Chunks follow each other without gaps, so a chunk only changes, or ends, blocks of ``size`` slices that it or the chunk before it
    can reach. Each such block of a band is a group of its own and gets a row for each chunk that tells its start: a task holds a
    few chunks of a band, however many come in one batch.
    """
    last = max(0, depth - size)
    kinds = np.dtype([("z", "i8"), ("y", "i8"), ("x", "i8"), ("v", "f8")])

    def fold(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, data = state.get if state.exists else (-1, b"")
        held = pd.DataFrame(np.frombuffer(data, kinds)).set_index(["z", "y", "x"])["v"]
        rows = pd.concat(list(batches))
        out = []
        for z0, chunk in rows.groupby("z0", sort=True):
            if z0 < newest:
                continue
            chunk = chunk[~chunk["told_"]]
            if z0 > newest:
                done = held.index.get_level_values("z") < z0
                out.append(held[done])
                held, newest = held[~done], int(z0)
            if chunk.empty:
                continue
            now = chunk.set_index(["z", "y", "x"])["v"]
            if held.empty:
                held = now
                continue
            both = held.index.intersection(now.index)
            now.loc[both] = (held.loc[both] + now.loc[both]) / 2
            held = pd.concat([held.drop(both), now])
        if newest >= last:
            out.append(held)
            held = held.iloc[:0]
        left = held.reset_index()
        packed = np.zeros(len(left), kinds)
        for c in "zyxv":
            packed[c] = left[c]
        state.update((newest, packed.tobytes()))
        yield pd.concat(out).reset_index() if out else pd.DataFrame(np.zeros(0, kinds))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pandas()
            yield pa.RecordBatch.from_pandas(rows.assign(block_=rows["z"] // size, told_=False), kind, preserve_index=False)
            starts = rows[["band_", "z0"]].drop_duplicates()
            reached = [(band_, z0, block) for band_, z0 in starts.itertuples(index=False) for block in range(max(0, z0 - size) // size, (z0 + size - 1) // size + 1)]
            if reached:
                told = pd.DataFrame(reached, columns=["band_", "z0", "block_"]).assign(z=-1, y=-1, x=-1, v=0.0, told_=True)
                yield pa.RecordBatch.from_pandas(told, kind, preserve_index=False)

    columns = ["band_", "z0", "z", "y", "x"]
    kind = pa.schema([*((c, pa.int64()) for c in columns), ("v", pa.float64()), ("block_", pa.int64()), ("told_", pa.bool_())])
    plain = chunks.select(F.expr(f"CAST(y DIV {band} AS BIGINT)").alias("band_"), F.col("z0").cast("long").alias("z0"), *[F.col(c).cast("long").alias(c) for c in "zyx"], F.col("v").cast("double").alias("v"))
    groups = plain.mapInArrow(dealt, ", ".join([*(f"{c} long" for c in columns), "v double, block_ long, told_ boolean"])).groupBy("band_", "block_")
    return groups.applyInPandasWithState(fold, "z long, y long, x long, v double", "newest long, tail binary", "append", "NoTimeout")
