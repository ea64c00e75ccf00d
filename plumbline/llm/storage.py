"""Files in the shared folder, from Python, with commits by renaming."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow.fs as pafs

from plumbline.tables import located


@contextmanager
def committed(folder: str, name: str):
    """An output stream under a temporary name that takes its own name at the end.

    A task that is lost leaves a file with a leading dot, which nobody reads. One
    that runs again makes the same bytes, so a file that already stands under the
    name with the same size is left alone: no reader ever finds the name gone.
    """
    fs, base = located(folder)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        yield out
    final = f"{base}/{name}"
    if not isinstance(fs, pafs.LocalFileSystem):
        before = fs.get_file_info(final)
        if before.type != pafs.FileType.NotFound:
            if before.size == fs.get_file_info(temporary).size:
                fs.delete_file(temporary)
                return
            fs.delete_file(final)
    fs.move(temporary, final)


def listing(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(name, bytes) of the committed files of a folder, in the order of their names."""
    fs, base = located(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith("."))


#: What reading a file that is torn, or not quite there yet, may raise.
INPUT_ERRORS = (OSError, ValueError, EOFError, struct.error, zlib.error, zipfile.BadZipFile)


def retried(action: Callable, attempts: int):
    """The action's result; it is tried again after an input error, up to ``attempts`` times in all."""
    for attempt in range(attempts):
        try:
            return action()
        except INPUT_ERRORS:
            if attempt == attempts - 1:
                raise
    raise AssertionError
