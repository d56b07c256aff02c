"""Files as Python data sources see them: folders, footers and an atomic publish, on any file system that pyarrow opens."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import PurePosixPath

import pyarrow.fs as pafs


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def data_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, of those that a pattern (``*``, ``?``, ``[...]``, ``**``) matches, or of those below a folder, in the order of their names.

    Hidden ones are left out; folders of partitions, with a =, are none.
    """
    if found := re.search(r"[*?\[]", path):
        top = path[: found.start()].rpartition("/")[0]
        pattern = store(top)[1].rstrip("/") + path[len(top) :]
        return [(p, n) for p, n in data_files(top or "/", suffix) if PurePosixPath(p).full_match(pattern)]
    fs, base = store(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(base, info.size)]
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    shown = [f for f in found if f.type == pafs.FileType.File and not re.search(r"/[._][^/=]*(?:/|$)", f.path[len(base) :])]
    return sorted((f.path, f.size) for f in shown if f.path.endswith(suffix))


def publish(path: str, content: bytes) -> bool:
    """Make a file of this content all at once, or return False where there is one already.

    On local and mounted file systems by a hard link, on HDFS by a rename, which both fail where the name is taken. Object stores have
    neither, and raise.
    """
    fs, target = store(path)
    staged = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
    fs.create_dir(os.path.dirname(target), recursive=True)
    if fs.type_name not in ("local", "hdfs"):
        raise NotImplementedError(f"no atomic publish on {fs.type_name}")
    with fs.open_output_stream(staged) as f:
        f.write(content)
    try:
        if fs.type_name == "local":
            os.link(staged, target)
        elif fs.get_file_info(target).type != pafs.FileType.NotFound:
            return False
        else:
            fs.move(staged, target)
        return True
    except OSError:
        if fs.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        return False
    finally:
        if fs.get_file_info(staged).type != pafs.FileType.NotFound:
            fs.delete_file(staged)
