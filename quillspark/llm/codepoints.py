"""Arrow string columns as flat numpy arrays of code points or bytes, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and the byte offsets of the rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def char_index(data: np.ndarray) -> np.ndarray:
    """For each byte offset, and one past the end, the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def to_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array and the offsets of the rows in it; nulls are empty."""
    data, offsets = raw_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, char_index(data)[offsets]


def from_codes(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Large-string column of the rows of a flat code-point array."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at[offsets].tobytes()), pa.py_buffer(data))


def pieces(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The substrings of a byte array between consecutive bounds, without copying them."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 24):
    """Cut a batch so that each part holds at most ``most`` bytes of ``column``, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > most:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)
