"""Files opened by tasks themselves, for reads of a range and writes of one file, in any store that Arrow knows by its address."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark gives it, and the path within; raises ``pyarrow.ArrowInvalid`` for a kind of address that Arrow does not know."""
    local = re.match(r"(?:file:(?://(?=/))?)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(quote(path, safe="/:@?&=%"))


def opens(path: str) -> bool:
    """Whether tasks can open files below a path themselves."""
    try:
        store_of(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def put(path: str, content: bytes) -> None:
    """Writes a file, in place of one that is there."""
    store, inner = store_of(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(content)
