"""Groups of voxels as rows of arrays: what needs a whole slice or patch at once gets it from the JVM, many groups in one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Work = Callable[..., list[tuple]]


def gathered(rows: DataFrame, keys: list[Column], columns: list[str]) -> DataFrame:
    """k0_, k1_, ... and cells_: one row for each group, in no order inside; a group's size bounds a row."""
    named = [k.alias(f"k{i}_") for i, k in enumerate(keys)]
    return rows.groupBy(*named).agg(F.collect_list(F.struct(*columns)).alias("cells_"))


def worked(rows: DataFrame, keys: list[Column], columns: list[str], work: Work, schema: str) -> DataFrame:
    """Rows that work(*keys, *arrays of the columns) gives for each group."""
    return worked_together(rows, keys, columns, lambda groups: (row for g in groups for row in work(*g)), schema)


def worked_together(rows: DataFrame, keys: list[Column], columns: list[str], work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that work(groups) gives for the groups of a batch, each a tuple of its keys and the arrays of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        kinds = [_KINDS[f.split(" ")[1]] for f in schema.split(", ")]

        def groups(b: pa.RecordBatch) -> Iterator[tuple]:
            at = zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True)
            for i, key in enumerate(at):
                cells = b.columns[-1][i].values
                yield (*key, *[np.asarray(cells.field(j)) for j in range(len(columns))])

        for b in batches:
            out = list(work(groups(b)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return gathered(rows, keys, columns).mapInArrow(run, schema)


#: Pixels of the slices that are worked on together.
STACK = 1 << 22
_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def kind(rows: DataFrame, column: str) -> str:
    """The type of a key column by the name that schemas here use."""
    return {"bigint": "long"}.get(name := dict(rows.dtypes)[column], name)


def grid(y: np.ndarray, x: np.ndarray, v: np.ndarray, dtype: str = "float64", shape: tuple[int, int] | None = None) -> np.ndarray:
    """A slice with zeros where it has no voxel."""
    out = np.zeros(shape or (int(y.max()) + 1, int(x.max()) + 1), dtype)
    out[y, x] = v.astype(dtype)
    return out


def stacks(groups: Iterator[tuple], keys: int) -> Iterator[list[tuple]]:
    """Key, truth and prediction masks of slices of one size, about STACK pixels at a time; groups: keys, y, x, gt, pr."""
    held: dict[tuple[int, int], list[tuple]] = {}
    for g in groups:
        y, x, gt, pr = g[keys:]
        a, b = grid(y, x, gt > 0, "bool"), grid(y, x, pr > 0, "bool")
        held.setdefault(a.shape, []).append((g[:keys], a, b))
        if len(held[a.shape]) * a.size >= STACK:
            yield held.pop(a.shape)
    yield from held.values()
