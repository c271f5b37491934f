"""Asking buckets whether hashes occur elsewhere.

Blocks of documents send the sorted distinct hashes of what they hold to buckets, each of which
has a range of the hashes, and get back one bit per hash: whether another block sent it too. What
only one block has then need not be moved any further.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Of each hash, so many leading bytes are sent; a chance agreement only costs work.
HASH_BYTES = 6

ASKED = "block bigint, bucket bigint, hashes binary"
ANSWERED = "block bigint, bucket bigint, shared binary"


def bucket_bounds(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted names; buckets are equal ranges of the hash."""
    width = (1 << 64) // buckets + 1
    return np.searchsorted(names, np.array([min(n * width, (1 << 64) - 1) for n in range(buckets)], np.uint64))


def binary(values: list) -> pa.Array:
    return pa.array([v if isinstance(v, bytes) else v.tobytes() for v in values], pa.binary())


def ask(block: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket that gets some of the sorted hashes."""
    edges = np.append(bucket_bounds(hashes, buckets), len(hashes))
    short = (hashes >> np.uint64(64 - 8 * HASH_BYTES)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    full = np.flatnonzero(np.diff(edges))
    return pa.table(
        {
            "block": pa.array([block] * len(full), pa.int64()),
            "bucket": pa.array(full, pa.int64()),
            "hashes": binary([short[edges[b] : edges[b + 1]] for b in full]),
        }
    )


def answer(table: pa.Table) -> pa.Table:
    """For each block's hashes, whether another block has them."""
    blobs = table["hashes"].to_pylist()
    counts = np.array([len(b) // HASH_BYTES for b in blobs])
    wide = np.zeros((counts.sum(), 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, HASH_BYTES)
    hashes = wide.view(np.uint64).ravel()
    block = np.repeat(np.arange(len(blobs)), counts)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    again = np.diff(ordered, prepend=ordered[:1] + np.uint64(1)) == 0
    # two names of one block may share a short hash; that only sends more segments
    again |= np.append(again[1:], False)
    shared = np.empty(len(hashes), bool)
    shared[order] = again
    ends = np.cumsum(counts)
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "shared": binary([np.packbits(shared[e - c : e]) for c, e in zip(counts, ends)]),
        }
    )


def answers_for(hashes: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """The flags of the sorted hashes from a block's answers."""
    edges = np.append(bucket_bounds(hashes, buckets), len(hashes))
    shared = np.zeros(len(hashes), bool)
    for bucket, bits in zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist()):
        count = edges[bucket + 1] - edges[bucket]
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)
        shared[edges[bucket] : edges[bucket + 1]] = flags
    return shared
