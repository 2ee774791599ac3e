"""Arrow text as numpy code-point arrays, and back, without a Python call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string())


def to_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets of the rows; a null is an empty row."""
    column = _string(column)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def to_codes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all rows and the n + 1 offsets of the rows; a null is an empty row."""
    raw, at = to_bytes(column)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) != lead[-1]:  # bytes that are no UTF-8 at all: decode row by row
        rows = [raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.frombuffer(b"".join(rows), np.uint32), np.cumsum([0, *(len(r) // 4 for r in rows)])
    return codes, lead[at]


def to_arrow(codes: np.ndarray, at: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The reverse of :func:`to_codes`; rows where ``null`` is true come out null."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[at].astype(np.int64)
    bits = None
    if null is not None and null.any():
        bits = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    whole = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    return whole.cast(pa.string())


def row_of(at: np.ndarray) -> np.ndarray:
    """For each element the number of its row."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def select(codes: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the elements where ``keep`` is true, with the offsets that follow."""
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(((2 * seed + 1) * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base % 2**64
    while done < n:
        k = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + k] = out[:k] * np.uint64(step)
        done, step = done + k, step * step % 2**64
    return out[:n]


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum (modulo 2 ** 64 for unsigned values) of each row's elements; 0 for an empty row."""
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
        return c[at[1:]] - c[at[:-1]]


def row_hash(codes: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit polynomial hash of each row as int64; two seeds make 128 bits."""
    base = (0x2545F4914F6CDD1D + 2 * seed * 0x9E3779B97F4A7C15) % 2**64 | 1
    n = int(np.diff(at).max(initial=0))
    pos = np.arange(len(codes)) - np.repeat(at[:-1], np.diff(at))
    with np.errstate(over="ignore"):
        h = segment_sum(mix(codes, seed) * powers(base, n)[pos], at)
        h = mix(h ^ mix(np.diff(at), seed + 7), seed + 3)
    return h.view(np.int64)
