"""Files that a task opens itself: plain paths, or what pyarrow can reach."""

from __future__ import annotations

import hashlib
import os


def open_stream(path: str):
    """A file of the listing as a stream: plain files, or what pyarrow can open."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return open("/" + (rest if scheme == "file" else path).lstrip("/"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def open_output(path: str):
    """A file to be written by a task; its folder is made if it is missing."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        plain = "/" + (rest if scheme == "file" else path).lstrip("/")
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        return open(plain, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def located(path: str):
    """The pyarrow file system of a path of the listing, and the path inside it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file" or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else path).strip("/")
    return fs.FileSystem.from_uri(path)


def folder_entries(system, folder: str) -> list:
    """Files and folders right inside ``folder``, hidden ones left out."""
    from pyarrow import fs

    return [e for e in system.get_file_info(fs.FileSelector(folder)) if not e.base_name.startswith((".", "_"))]


def file_digest(system, path: str) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, read in pieces."""
    digest, size = hashlib.sha256(), 0
    with system.open_input_stream(path) as stream:
        while piece := stream.read(4 << 20):
            digest.update(piece)
            size += len(piece)
    return size, digest.hexdigest()
