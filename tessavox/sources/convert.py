"""Tasks of conversion: pairs of input and output, each to one or several kinds of output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessavox.functions import intensity
from tessavox.operators import resample
from tessavox.sources import volumes

#: Fixed value: names of output kinds in configurations, several spellings each.
KINDS = {
    "zarr": "zarr",
    "ome-zarr": "ome-zarr",
    "ome_zarr": "ome-zarr",
    "single-tiff": "single-tiff",
    "single-tif": "single-tiff",
    "single-nii": "single-nii",
    "scroll-tiff": "scroll-tiff",
    "scroll-tif": "scroll-tiff",
    "scroll-nii": "scroll-nii",
}


def pairs(inputs: list[str], outputs: list[str]) -> list[tuple[str, str]]:
    """One of the sides may be single and is repeated; else both must be as long."""
    if len(inputs) == 1:
        inputs = inputs * len(outputs)
    if len(outputs) == 1:
        outputs = outputs * len(inputs)
    if len(inputs) != len(outputs):
        raise ValueError(f"{len(inputs)} inputs and {len(outputs)} outputs")
    return list(zip(inputs, outputs, strict=True))


def options_of(registry: dict[str, dict], output: dict, kind: str) -> dict:
    """Options of write() from a configuration: the registry's defaults for the kind, then the output's own entry for it."""
    given = {**registry.get(kind, {}), **output.get(kind, {})}
    chunk = given.get("chunk_size", 128)
    out = {
        "chunk": tuple(chunk) if not isinstance(chunk, int) else (chunk,) * 3,
        "levels": given.get("n_level", given.get("levels", 5)),
        "factor": given.get("resize_factor", output.get("resize_factor", 2)),
        "axis": given.get("axis", 0),
    }
    return {k: v for k, v in out.items() if k in USED[kind]}


#: Which options matter for a kind.
USED = {"zarr": ("chunk",), "ome-zarr": ("chunk", "levels", "factor"), "scroll-tiff": ("axis",), "scroll-nii": ("axis",), "single-tiff": (), "single-nii": ()}


def write(vox: DataFrame, kind: str, folder: str, shape: tuple[int, int, int], name: str = "volume", dtype: str = "float32", chunk: tuple[int, int, int] = (128, 128, 128), levels: int = 3, factor: int = 2, axis: int = 0) -> int:
    """Writes one kind of output; the number of files."""
    kind = KINDS[kind.lower()]
    if kind == "zarr":
        out = volumes.write_zarr(vox, f"{folder}/{name}.zarr", shape, chunk, dtype)
    elif kind == "ome-zarr":
        out = volumes.write_ome_zarr(vox, f"{folder}/{name}.ome.zarr", shape, chunk, levels, factor, dtype)
    elif kind.startswith("single"):
        out = volumes.write_single(vox, folder, shape, name, ".tif" if kind.endswith("tiff") else ".nii.gz", dtype)
    else:
        cut = resample.resliced(vox, shape, axis, name)
        rows = cut.select(F.col("slice").alias("z"), F.col("row").alias("y"), F.col("col").alias("x"), "v")
        suffix = ".tif" if kind.endswith("tiff") else ".nii.gz"
        out = volumes.write_slices(rows, f"{folder}/{name}.{kind}", f"{name}_{'zyx'[axis % 3]}", suffix, dtype)
    return out.count()


def run(spark: SparkSession, task: dict, registry: dict[str, dict] | None = None) -> dict[str, int]:
    """task: inputs, outputs, kinds, and options that override the registry's entry for a kind. Resizing is refused for
    single and scroll outputs; clip bounds low and high apply before writing."""
    done: dict[str, int] = {}
    for source, target in pairs(task["inputs"], task["outputs"]):
        vox = volumes.read_volume(spark, source)
        if "low" in task or "high" in task:
            vox = vox.withColumn("v", intensity.clip(F.col("v"), task.get("low"), task.get("high")))
        shape = volumes.shape_of(spark, source)
        for kind in task["kinds"]:
            options = {**(registry or {}).get(kind, {}), **task.get("options", {})}
            new = tuple(options.pop("shape", shape))
            if new != shape and KINDS[kind.lower()].split("-")[0] in ("single", "scroll"):
                raise ValueError(f"{kind} output can't be resized")
            out = resample.nearest(vox, shape, new) if new != shape else vox
            done[f"{target}:{kind}"] = write(out, kind, target, new, **options)
    return done
