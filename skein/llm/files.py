"""Files in the shared folder, opened from Python workers by URI."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs

from ..shared import file_system


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return file_system(uri)


def write_once(folder: str, name: str, parts) -> str:
    """Writes byte parts to a new file of the folder; the URI of the finished file.

    Each attempt of a task writes a file of its own, moved to its final name
    when complete, so a reader never meets half a file and attempts never clash.
    """
    system, at = opened(folder)
    system.create_dir(at, recursive=True)
    final = f"{name}-{uuid.uuid4().hex[:12]}"
    with system.open_output_stream(f"{at}/.{final}.part", compression=None) as out:
        for p in parts:
            out.write(p)
    system.move(f"{at}/.{final}.part", f"{at}/{final}")
    return f"{folder}/{final}"


def read_at(uri: str):
    """A seekable input of the file."""
    system, at = opened(uri)
    return system.open_input_file(at)


def folder_files(uri: str) -> list[str]:
    """URIs of the finished files of a folder, by name."""
    system, at = opened(uri)
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f"{uri}/{os.path.basename(x.path)}" for x in found if x.is_file and not x.base_name.startswith((".", "_")))
