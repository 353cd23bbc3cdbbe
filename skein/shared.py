"""Tables in the shared folder, read from Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names for S3 stand for the same store."""
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    return fs.FileSystem.from_uri(uri)


def parquet_batches(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a folder of Parquet files, so many at a time, in the same order for every reader."""
    system, at = file_system(uri)
    found = system.get_file_info(fs.FileSelector(at))
    for x in sorted(found, key=lambda x: x.path):
        if x.is_file and not x.base_name.startswith((".", "_")):
            with system.open_input_file(x.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows)
