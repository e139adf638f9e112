"""Which hashes occur in several documents: counts over a whole corpus, kept in bit maps of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, release_memory, staged

#: Bits of each map: 16 MB at any input size.
MAP_BITS = 27
#: Larger maps come to the driver file by file, so that it doesn't hold them several times.
AT_ONCE_BITS = 28
Sets = Callable[[list], Iterable[np.ndarray]]


def _bits(h: np.ndarray, map_bits: int) -> list[np.ndarray]:
    """The three bits of a hash in a map. All are in the block that its top 20 bits name, and so in the part of one bucket; they are chosen by
    the next 18 bits, in large blocks by a mixture of all 38, as three choices out of 18 bits would be much the same."""
    width = map_bits - 20
    block = (h >> np.uint64(44)) << np.uint64(width)
    if width > 7:
        mixed = (h >> np.uint64(26)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return [(block | ((mixed >> np.uint64(64 - k * width)) & np.uint64((1 << width) - 1))).astype(np.int64) for k in (1, 2, 3)]
    return [(block | ((h >> np.uint64(64 - end)) & np.uint64((1 << width) - 1))).astype(np.int64) for end in (20 + width, 20 + 2 * width, 38)]


def contains(bitmap: np.ndarray, h: np.ndarray, map_bits: int = MAP_BITS) -> np.ndarray:
    """0 or 1 for each hash: whether the map's bits for it are set."""
    found = np.ones(len(h), np.uint8)
    for i in _bits(h, map_bits):
        found &= bitmap[i >> 3] >> (7 - (i & 7)).astype(np.uint8)
    return found


def _count(bits: int, sets: Sets, gathered: int = 0):
    """For each batch and bucket (the hash's top ``bits``): the next 32 bits of the hashes that occur, and in how many documents (255 at most).
    Batches are put together until they have ``gathered`` hashes."""

    def counted(found: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]) >> np.uint64(32 - bits), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        low, n = keys.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        edges = np.append(cuts, len(keys))
        return pd.DataFrame({
            "bucket": bucket[cuts], "low": [low[a:b].tobytes() for a, b in zip(edges, edges[1:])], "n": [n[a:b].tobytes() for a, b in zip(edges, edges[1:])],
        })

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        for rows in batches:
            found += sets(rows["text"].tolist())
            if sum(map(len, found)) >= gathered:
                yield counted(found)
                found = []
        if found:
            yield counted(found)
        release_memory()

    return of


def _maps(bits: int, map_bits: int, frequent: int, often_bits: int):
    """The part of both bit maps that belongs to one bucket."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["low"]])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["n"]]).astype(np.int64)
        order = np.argsort(low)
        low, n = low[order], n[order]
        cuts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        low, n = low[cuts], np.add.reduceat(n, cuts)
        bucket = int(rows["bucket"].iloc[0])
        h = (np.uint64(bucket << 32) | low.astype(np.uint64)) << np.uint64(32 - bits)
        out = []
        for least, size in ((2, map_bits), (frequent, often_bits)):
            part = np.zeros(1 << (size - bits), np.uint8)
            for i in _bits(h[n >= least], size):
                part[i - (bucket << (size - bits))] = 1
            out.append(np.packbits(part).tobytes())
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "twice": out[:1], "often": out[1:]})

    return of


def frequency_maps(
    docs: DataFrame, sets: Sets, frequent: int = 64, map_bits: int = MAP_BITS, often_bits: int | None = None, size: int | None = None, share: int = 2 << 20, gathered: int = 0
) -> tuple[bytearray, bytearray]:
    """Two bit maps over hashes (``contains``): set where a member of ``sets`` occurs in two documents or more, and in ``frequent`` or more.

    All members of all documents' sets are counted, in buckets by hash that grow in number with the input. The maps' size is fixed. Where
    many hashes share a bit, more of them seem frequent than are: users of the maps must give right results all the same. often_bits: of the
    second map, if not as many. size: the texts' bytes, if known. share: of these for each bucket. Each batch of rows, or so many as have
    ``gathered`` hashes, sends a row to each bucket: with a larger share and more gathered, these rows grow slower with the input.
    """
    often_bits = often_bits or map_bits
    if size is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(max(int(size / share).bit_length(), 6), 20)
    parts = docs.select("text").mapInPandas(_count(bits, sets, gathered), "bucket long, low binary, n binary")
    grouped = parts.groupBy("bucket").applyInPandas(_maps(bits, map_bits, frequent, often_bits), "bucket long, twice binary, often binary")
    if map_bits <= AT_ONCE_BITS:
        with batches_of(docs.sparkSession, 2_000):
            found = iter(grouped.collect())
    else:
        found = staged(grouped, "maps", 2_000).toLocalIterator()
    whole = bytearray(1 << (map_bits - 3)), bytearray(1 << (often_bits - 3))
    for bucket, *both in found:
        for target, part in zip(whole, both):
            target[bucket * len(part) : (bucket + 1) * len(part)] = part
    return whole
