"""Decoded-byte cells: one 32-bit number for each position of a decoded stream.

A cell is a literal, a byte that was inferred or reconstructed with a
confidence, a marker of a discontinuity, or the co-index of an unknown byte;
equal co-indices are the same unknown byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 32768
LITERAL = 0xFFE00000
INFERRED = 0xFF800000
RECONSTRUCTED = 0xFF000000
DISCONTINUITY = 0xFC000000
CONFIDENCE_SHIFT = 16
CONFIDENCE_LEVELS = 62

#: least value of the 8 bits above the byte, and the class from there on
CLASSES = [(224, "Literal"), (64, "InferredLit"), (63, "UserSupplied"), (48, "Reconstructed"), (20, "Guessed"), (1, "WildGuess"), (0, "Unknown")]


def literal(b: int) -> int:
    return LITERAL | b


def reconstructed(b: int, confidence: int) -> int:
    return RECONSTRUCTED | min(confidence, CONFIDENCE_LEVELS) << CONFIDENCE_SHIFT | b


def is_known(cells: np.ndarray) -> np.ndarray:
    return cells >= RECONSTRUCTED


def is_marker(cells: np.ndarray) -> np.ndarray:
    return (cells & 0xFE000000) == DISCONTINUITY


def is_unknown(cells: np.ndarray) -> np.ndarray:
    return cells < DISCONTINUITY


def pack(cells) -> bytes:
    return np.asarray(cells, dtype="<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data or b"", dtype="<u4")


def plain_text(cells: np.ndarray, unknown: int = 0x3F) -> bytes:
    """The bytes, unknown ones as a mark; markers take no room."""
    kept = cells[~is_marker(cells)]
    return np.where(is_known(kept), kept & 0xFF, unknown).astype(np.uint8).tobytes()


def cell_class(cell: Column) -> Column:
    """The class of a cell (LONG): Literal, InferredLit, ..., Unknown, or Discontinuity."""
    level = F.shiftright(cell, 16).bitwiseAND(255)
    out = F.lit("Unknown")
    for least, name in reversed(CLASSES):
        out = F.when(level >= least, F.lit(name)).otherwise(out)
    return F.when(cell >= RECONSTRUCTED, out).when(cell.bitwiseAND(0xFE000000) == DISCONTINUITY, "Discontinuity").otherwise("Unknown")


def cell_byte(cell: Column) -> Column:
    """The byte of a known cell, else null."""
    return F.when(cell >= RECONSTRUCTED, cell.bitwiseAND(255).cast("int"))
