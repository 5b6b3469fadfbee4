"""Bloom filters over 64-bit hashes, cut into slices that are built in parallel, each in a task of its own.

A slice is chosen by a hash's high bits and holds ``bits`` bits, ``PROBES`` of which a hash sets. A map task sends a slice
the distinct hashes that it has seen once, and those seen by more than one owner, so a hot hash costs a row's eight bytes
for each task and slices stay even. The total size has a bound: beyond it a filter says yes more often, which costs work
after it but no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import mix64

PROBES = 3
#: Bits for each hash that is expected, and bytes of hashes that a slice gets from the input, about.
BITS_EACH = 10
SLICE_HASHES = 500_000


@dataclass(frozen=True)
class Shape:
    """Number of slices and bits of each."""

    slices: int
    bits: int

    @classmethod
    def of(cls, expected: int, most_bytes: int) -> Shape:
        """For a number of hashes, within a size."""
        slices = expected // SLICE_HASHES + 1
        bits = min(expected * BITS_EACH, most_bytes * 8) // slices
        return cls(slices, max(64, bits // 8 * 8))

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.slices)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Bits of each hash within its slice, one row for each probe."""
        return np.stack([(mix64(h + np.uint64(k + 1)) % np.uint64(self.bits)).astype(np.int64) for k in range(PROBES)])


def sent(shape: Shape, once: np.ndarray, more: np.ndarray) -> pd.DataFrame:
    """Rows (slice, once, more) of distinct hashes seen by one owner, and by more than one, of a map task."""
    rows: dict[int, list[bytes]] = {}
    for k, h in enumerate((once, more)):
        at = shape.slice_of(h)
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        for s, a, b in zip(own, first, [*first[1:], len(h)], strict=False):
            rows.setdefault(int(s), [b"", b""])[k] = h[order[a:b]].tobytes()
    return pd.DataFrame([(s, a, b) for s, (a, b) in rows.items()], columns=["slice", "once", "more"])


SENT = "slice long, once binary, more binary"


def twice_seen(shape: Shape):
    """A slice's two filters, of which the one for hashes seen twice or more is kept: (slice, bits)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(shape.bits, dtype=bool), np.zeros(shape.bits, dtype=bool)
        for a, b in zip(rows["once"], rows["more"], strict=True):
            places = shape.places(np.frombuffer(a, dtype=np.uint64))
            twice[places[:, once[places].all(0)]] = True
            once[places] = True
            places = shape.places(np.frombuffer(b, dtype=np.uint64))
            once[places] = twice[places] = True
        return pd.DataFrame({"slice": [int(rows["slice"].iloc[0])], "bits": [np.packbits(twice).tobytes()]})

    return work


class Filter:
    """All slices of a filter in one array, for probing."""

    def __init__(self, shape: Shape, slices: Iterator[tuple[int, bytes]]) -> None:
        self.shape, self.bytes = shape, np.zeros(shape.slices * shape.bits // 8, dtype=np.uint8)
        size = shape.bits // 8
        for s, b in slices:
            self.bytes[s * size : (s + 1) * size] = np.frombuffer(b, dtype=np.uint8)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], dtype=np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.shape.slice_of(h) * self.shape.bits
        out = np.ones(len(h), dtype=bool)
        for places in self.shape.places(h):
            own = at + places
            out &= (self.bytes[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1 == 1
        return out


def gathered(shape: Shape, slices: DataFrame) -> Filter:
    """The filter on the driver: at most the bytes that its shape allows."""
    return Filter(shape, ((r["slice"], bytes(r["bits"])) for r in slices.toLocalIterator()))
