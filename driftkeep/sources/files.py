"""Files of any store, opened from Python tasks."""

from __future__ import annotations


def open_file(path: str, mode: str = "rb"):
    """A file of a local path, a file: URI, or any store that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if mode == "wb" else store.open_input_file(inner)
