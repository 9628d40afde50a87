"""Files read from any place inside a task: heads, hashes, and byte ranges that hold whole lines.

A range owns the lines that start in it. Its place in the file is a multiple of the code unit, so UTF-16 is cut like
any other text, and every line is decoded by the one task that owns it, a block at a time.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from functools import cache
from urllib.parse import unquote

import numpy as np

from feedloom.functions.csvtext import cell_pattern
from feedloom.functions.encoding import BOM, CP1252_BYTES, CP1252_CHARS

RANGE_BYTES = 8 << 20  # an even number: ranges begin at whole code units
BLOCK_BYTES = 1 << 20  # read at once
CODECS = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "windows-1252": "latin-1"}
UNITS = {"utf-16le": "<u2", "utf-16be": ">u2"}
CP1252 = str.maketrans(CP1252_BYTES, CP1252_CHARS)
LF, CR = 10, 13


def locate(path: str):
    """(file system, name) of a path as Spark's listing gives it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(unquote(path))


def size_of(path: str) -> int | None:
    """Bytes of a file; null if there is none."""
    from pyarrow import fs

    system, name = locate(path)
    found = system.get_file_info(name)
    return found.size if found.type == fs.FileType.File else None


def head_of(path: str, size: int) -> bytes:
    system, name = locate(path)
    with system.open_input_file(name) as file:
        return file.read(size)


def sha256_of(path: str) -> str | None:
    """Hash of a file of any size, a block at a time; null if there is none."""
    system, name = locate(path)
    digest = hashlib.sha256()
    try:
        with system.open_input_file(name) as file:
            while block := file.read(BLOCK_BYTES):
                digest.update(block)
    except FileNotFoundError:
        return None
    return digest.hexdigest()


class RangedText:
    """A text file whose lines can be read from any place. Lines end at `\\n`, `\\r\\n` or `\\r` and keep their end."""

    def __init__(self, file, encoding: str):
        self.file, self.size, self.encoding = file, file.size(), encoding
        self.unit = np.dtype(UNITS.get(encoding, "u1"))

    def _read(self, start: int, stop: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(stop, self.size) - start))

    def line_start(self, start: int, stop: int) -> int | None:
        """The first place in [start, stop) at which a line starts; null if there is none."""
        if start == 0:
            return 0 if self.size and stop > 0 else None
        width = self.unit.itemsize
        at, stop = start - width, min(stop, self.size)
        while at + width < stop:
            found, units = self._starts(at, min(at + BLOCK_BYTES, stop))
            if len(found):
                return at + (int(found[0]) + 1) * width
            if units < 2:
                return None
            at += (units - 1) * width  # the last unit is looked at again, as the one before
        return None

    def _starts(self, at: int, stop: int) -> tuple[np.ndarray, int]:
        """(units behind which a line starts, units) of the bytes from `at` to `stop`."""
        raw = self._read(at, stop)
        units = np.frombuffer(raw, dtype=self.unit, count=len(raw) // self.unit.itemsize)
        before, here = units[:-1], units[1:]
        return np.flatnonzero((before == LF) | ((before == CR) & (here != LF))), len(units)

    def _last_start(self, at: int, stop: int) -> int | None:
        """The last place in (at, stop) at which a line starts; null if there is none."""
        found, _ = self._starts(at, stop)
        return at + (int(found[-1]) + 1) * self.unit.itemsize if len(found) else None

    def lines(self, first: int, stop: int | None = None) -> Iterator[str]:
        """The lines that start in [first, stop), `first` being the start of one; to the end of the file without `stop`.

        A block ends with the last line that ends in it, so no more is read than the lines asked for need.
        """
        at, stop = first, self.size if stop is None else min(stop, self.size)
        while at < stop:
            step = min(at + BLOCK_BYTES, stop)
            following = self._last_start(at, step) if step < stop else None
            if following is None:
                following = self.line_start(step, self.size)
            following = self.size if following is None else following
            text = self._read(at, following).decode(CODECS[self.encoding], errors="replace")
            if at == 0:
                text = text.removeprefix(BOM)
            if self.encoding == "windows-1252":
                text = text.translate(CP1252)
            yield from io.StringIO(text, newline="")
            at = following


@cache
def _record(delimiter: str) -> re.Pattern:
    cell = cell_pattern(delimiter, "\\Z")
    return re.compile(f"{cell}(?:{re.escape(delimiter)}{cell})*+\\Z")


def stays_open(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open behind a line that begins inside of one, or not.

    A line that begins inside a quoted cell is like one with a quote before it.
    """
    if '"' not in line:
        return inside
    body = line.rstrip("\r\n")
    return _record(delimiter).match(f'"{body}' if inside else body) is None


def transition(lines: Iterator[str], delimiter: str) -> tuple[bool, bool, int, int]:
    """What a stretch of lines does to a reader that comes to it outside of quotes, and to one inside.

    (open behind it if come to outside, the same inside, records that start in it if come to outside, the same inside)
    """
    state, started = [False, True], [0, 0]
    for line in lines:
        for k in (0, 1):
            started[k] += not state[k]
        if '"' in line:
            outside = stays_open(line, False, delimiter) if not all(state) else None
            within = stays_open(line, True, delimiter) if any(state) else None
            state = [within if open_now else outside for open_now in state]
    return (*state, *started)


def records_from(lines: Iterator[str], inside: bool, delimiter: str) -> Iterator[str]:
    """`lines` behind the end of a record that was begun before them."""
    while inside:
        line = next(lines, None)
        if line is None:
            return
        inside = stays_open(line, True, delimiter)
    yield from lines
