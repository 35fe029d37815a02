"""Byte functions over BINARY columns, as native expressions.

``reverse`` and friends turn BINARY into STRING, so numbers are read from hex
pairs. Offsets count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at(content: Column | str, offset: Column | int, n: Column | int) -> Column:
    """n bytes from offset on (fewer at the end)."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(col(content), offset.cast("int") + 1, (F.lit(n) if isinstance(n, int) else n.cast("int")))


def le(content: Column | str, offset: Column | int, n: int) -> Column:
    """The little-endian number of n bytes (at most 7) at offset; null where there are fewer."""
    h = F.hex(at(content, offset, n))
    swapped = F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.when(F.length(h) == 2 * n, F.conv(swapped, 16, 10).cast("long"))


def be(content: Column | str, offset: Column | int, n: int) -> Column:
    """The big-endian number of n bytes (at most 7) at offset; null where there are fewer."""
    h = F.hex(at(content, offset, n))
    return F.when(F.length(h) == 2 * n, F.conv(h, 16, 10).cast("long"))


def starts_with(content: Column | str, offset: Column | int, literal: bytes) -> Column:
    return at(content, offset, len(literal)) == F.lit(bytearray(literal))


def latin1(content: Column | str) -> Column:
    """The bytes as text of as many characters, for regexes."""
    return F.decode(col(content), "ISO-8859-1")


def reversed_bytes(gram: Column | str) -> Column:
    """BINARY with its bytes in reverse order."""
    h = F.hex(col(gram))
    pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.length(h), 1) - 1), lambda i: F.substring(h, (F.length(h) - 1 - 2 * i).cast("int"), F.lit(2)))
    return F.when(F.length(h) == 0, col(gram)).otherwise(F.unhex(F.array_join(pairs, "")))


def byte_slices(batches, column: str, limit: int = 1_000_000):
    """Slices of Arrow batches of about limit bytes in a column at most (a longer value comes alone), as what is made of them may be many times that. At the end the worker's freed memory goes back."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    released()


def released() -> None:
    """Hands a worker's freed memory back to the system, as workers wait for their next task with all they ever took."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def stretches(data, starts, lengths):
    """An Arrow array of the bytes of data (numpy) from each of starts on, lengths many."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])
