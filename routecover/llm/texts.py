"""Small helpers shared by the text operators: columns of Arrow batches, CRC-32 of joined pieces."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame

POLYNOMIAL = 0xEDB88320


def give_back() -> None:
    """Give freed memory back to the system: a Python worker serves many stages, and shares an executor with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``docs`` has (names are compared without regard to case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The values of a string column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reversed."""
    out, bit = 0, 1 << 31
    while True:
        if a & bit:
            out ^= b
            if not a & (bit - 1):
                return out
        bit >>= 1
        b = (b >> 1) ^ POLYNOMIAL if b & 1 else b >> 1


_POWERS = [1 << 30]
for _ in range(66):
    _POWERS.append(_times(_POWERS[-1], _POWERS[-1]))


def crc_joined(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings joined, from their own CRC-32 and the second one's length."""
    shift, power, bits = 1 << 31, 3, n_bytes
    while bits:
        if bits & 1:
            shift = _times(_POWERS[power], shift)
        bits >>= 1
        power += 1
    return _times(shift, first) ^ second
