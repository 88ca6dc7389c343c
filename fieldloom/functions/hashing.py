"""Digests of supports and the generator that deals units to parts."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the 64-bit generator splitmix64.
GAMMA = 0x9E3779B97F4A7C15
FIRST_FACTOR = 0xBF58476D1CE4E5B9
SECOND_FACTOR = 0x94D049BB133111EB


def nth_draw(ordinal: np.ndarray, seed: int) -> np.ndarray:
    """The draw of each zero-based ordinal: the state after i steps is seed + i * gamma."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (1 << 64) - 1) + (ordinal.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST_FACTOR)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND_FACTOR)
        return z ^ (z >> np.uint64(31))


def draw_hex(ordinal: Column, seed: int) -> Column:
    """The draw as 16 hexadecimal digits, whose order is that of the unsigned number."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return pd.Series([f"{x:016x}" for x in nth_draw(values.to_numpy(), seed)])

    return convert(ordinal)


class SupportDigest:
    """SHA-256 of a support, fed with one column of it after another."""

    def __init__(self, n_nodes: int):
        self._sha = hashlib.sha256(struct.pack("<q", n_nodes))

    def cells(self, types: Iterable[int], sizes: Iterable[int], nodes: Iterable[int]) -> SupportDigest:
        """Types, then offsets from 0, then the nodes of all cells, in cell order."""
        self._sha.update(np.asarray(list(types), dtype="<u1").tobytes())
        self._sha.update(np.concatenate([[0], np.cumsum(np.asarray(list(sizes), dtype="<i8"))]).astype("<i8").tobytes())
        self._sha.update(np.asarray(list(nodes), dtype="<i8").tobytes())
        return self

    def axis(self, coordinates: Iterable[float]) -> SupportDigest:
        self._sha.update(np.asarray(list(coordinates), dtype="<f8").tobytes())
        return self

    def hexdigest(self) -> str:
        return self._sha.hexdigest()


def support_digest(kind: str, n_nodes: int, types=(), nodes=(), coordinates=()) -> str:
    """Digest from in-memory values; ``nodes`` is a list of lists."""
    digest = SupportDigest(n_nodes)
    if kind == "mesh":
        digest.cells(types, [len(n) for n in nodes], [x for n in nodes for x in n])
    elif kind == "axis":
        digest.axis(coordinates)
    return digest.hexdigest()
