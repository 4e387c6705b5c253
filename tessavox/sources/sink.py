"""The writing side of ``volume_files``: rows of slices (z, height, width, data, and perhaps name) to files that appear all or not at all.

Layouts: ``slices`` (a file for each slice: ``{name}_{z:05d}{suffix}``, or the row's own name) on any file system that Arrow reaches, and
``single`` (one uncompressed NIfTI or TIFF file of a known shape) where files can be written in places, that is on mounted ones: every
task writes its slices where they belong, so nothing is gathered. Files are made in a folder of the job and moved when all tasks are
done; tasks that fail or run twice leave nothing behind.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessavox.sources import codecs
from tessavox.sources.places import opened

#: Threads that move the finished files.
THREADS = 16


@dataclass
class Done(WriterCommitMessage):
    """What a task has written: files below the job's folder with their names, or slices of the single file."""

    files: list[tuple[str, str]] = field(default_factory=list)
    slices: list[int] = field(default_factory=list)


class SliceWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.layout, self.suffix = options.get("layout", "slices"), options.get("suffix", ".tif")
        self.name, self.kind = options.get("name", "volume"), np.dtype(options.get("dtype", "float32"))
        self.shape = tuple(int(n) for n in options["shape"].split(",")) if "shape" in options else None
        missing = {"z", "height", "width", "data"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows of slices need the columns {sorted(missing)}")
        self.named = "name" in schema.fieldNames()
        self.job = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        if self.layout == "single":
            self._begin()
        elif self.layout != "slices":
            raise ValueError(f"no layout {self.layout!r}")

    def _begin(self) -> None:
        if self.shape is None or self.suffix not in (".nii", ".tif", ".tiff"):
            raise ValueError("a single file needs the option shape (depth,height,width) and the suffix .nii, .tif or .tiff")
        system, at = opened(self.job)
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("a single file is written in places, which this file system can't do; write slices")
        if self._page and self.shape[0] * self._page >= 1 << 32:
            raise ValueError("a TIFF file can't hold this volume; write slices or NIfTI")
        os.makedirs(at)
        with open(self._single(at), "wb") as f:
            codecs.Pages(f, self.shape, self.kind.name, self.suffix)
            f.truncate(self._place(self.shape[0]))

    def _single(self, folder: str) -> str:
        return f"{folder}/{self.name}{self.suffix}"

    @property
    def _page(self) -> int:
        """Bytes of a page of a TIFF file, 0 for NIfTI."""
        return len(codecs._tiff_page(8, self.shape[1:], self.kind, bytes(self._bytes), False)) if self.suffix.startswith(".tif") else 0

    @property
    def _bytes(self) -> int:
        return self.shape[1] * self.shape[2] * self.kind.itemsize

    def _place(self, z: int) -> int:
        return 8 + z * self._page if self._page else len(codecs._nifti_first(self.shape, self.kind)) + z * self._bytes

    def _encoded(self, z: int, data: bytes) -> bytes:
        return codecs._tiff_page(self._place(z), self.shape[1:], self.kind, data, z == self.shape[0] - 1) if self._page else data

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        done, own = Done(), f"{self.job}/{uuid.uuid4().hex}"
        system, at = opened(own)
        if self.layout == "slices":
            system.create_dir(at)
        for b in iterator:
            names = b.column("name").to_pylist() if self.named else [None] * b.num_rows
            for i, (z, h, w) in enumerate(zip(*[b.column(c).to_pylist() for c in ("z", "height", "width")], strict=True)):
                page = np.asarray(b.column("data")[i].values).reshape(h, w).astype(self.kind)
                if self.layout == "single":
                    if not (0 <= z < self.shape[0] and (h, w) == self.shape[1:]):
                        raise ValueError(f"slice {z} of {h} x {w} doesn't fit in {self.shape}")
                    with open(self._single(opened(self.job)[1]), "r+b") as f:
                        f.seek(self._place(z))
                        f.write(self._encoded(z, page.astype(self.kind.newbyteorder("<")).tobytes()))
                    done.slices.append(z)
                else:
                    name = names[i] or f"{self.name}_{z:05d}{self.suffix}"
                    kind = ".nii.gz" if name.endswith(".nii.gz") else os.path.splitext(name)[1].lower()
                    with system.open_output_stream(f"{at}/{name}", compression=None) as f:
                        f.write(codecs.encode(page[None], kind))
                    done.files.append((f"{own}/{name}", name))
        return done

    def commit(self, messages: list[Done | None]) -> None:
        system, to = opened(self.path)
        moves = [(opened(a)[1], f"{to}/{name}") for m in messages if m for a, name in m.files]
        if len({b for _, b in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("several slices have one name")
        if self.layout == "single":
            folder = opened(self.job)[1]
            written = {z for m in messages if m for z in m.slices}
            with open(self._single(folder), "r+b") as f:
                for z in range(self.shape[0]) if self._page else ():
                    if z not in written:  # an empty page
                        f.seek(self._place(z))
                        f.write(self._encoded(z, bytes(self._bytes)))
            moves = [(self._single(folder), self._single(to))]
        if self.overwrite and system.get_file_info(to).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(to)):
                if old.is_file and not re.search(r"/[_.][^/]*$", old.path):
                    system.delete_file(old.path)

        def move(m: tuple[str, str]) -> None:
            if system.get_file_info(m[1]).is_file:  # not every file system replaces it
                system.delete_file(m[1])
            system.move(*m)

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(move, moves))
        self.abort(messages)

    def abort(self, messages: list[Done | None]) -> None:
        system, at = opened(self.job)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
        above = at.rpartition("/")[0]
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)
