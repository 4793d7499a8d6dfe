"""Arrow strings as flat code-point arrays, and back.

A batch of texts is one ``uint32`` array of code points and one ``int64`` array of
``n + 1`` offsets.  Null texts have length 0; callers keep the validity themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts of a string column and each text's offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    buffers = col.buffers()
    at = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if col.null_count:
        # a null slot may still span bytes
        size = np.where(np.asarray(col.is_valid()), np.diff(at), 0)
        if int(size.sum()) != len(raw):
            keep = np.repeat(np.asarray(col.is_valid()), np.diff(at))
            raw = raw[keep]
        at = np.concatenate([[0], np.cumsum(size)])
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(n)]
        return from_strings(rows)
    if len(cps) == len(raw):
        return cps, at
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, lead[at]


def from_strings(rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The same for Python strings."""
    rows = [r or "" for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32), offs


def text_of(cps: np.ndarray) -> str:
    return cps.astype(np.uint32, copy=False).tobytes().decode("utf-32-le", "replace")


def to_arrow(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string column from code points; rows where ``valid`` is false are null."""
    data = text_of(cps).encode("utf-8")
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])[offs]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.array(valid).buffers()[1]
    if ends[-1] < 2**31 - 1:
        return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data), mask)
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(ends), pa.py_buffer(data), mask)


def kept(keep: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Offsets after only the code points of the mask ``keep`` are left."""
    return np.concatenate([[0], np.cumsum(keep)])[offs]
