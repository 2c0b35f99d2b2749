"""Files in the shared folder, reached by its URI, for operators whose output is files."""

from __future__ import annotations

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (a plain path is local) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = located(uri)
    system.create_dir(path, recursive=True)


def open_output(uri: str):
    system, path = located(uri)
    return system.open_output_stream(path, compression=None)  # names do not decide


def open_input(uri: str):
    """A file to seek in and read."""
    system, path = located(uri)
    return system.open_input_file(path)
