"""Numbers and byte strings packed by destination, so that a shuffle moves few compressed rows instead of many small ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "shard int, blob binary"


def pack(shards: np.ndarray, columns: list[np.ndarray], texts: list[bytes] | None = None) -> pa.RecordBatch:
    """One row per shard that occurs, with its entries of every column (and of ``texts``, whose lengths go along)."""
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=1).compress
    order = np.argsort(shards, kind="stable")
    sorted_ = shards[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, dtype=np.int64)
    columns = [c[order] for c in columns]
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        parts = [np.array([b - a], dtype="<u4").tobytes(), *[c[a:b].tobytes() for c in columns]]
        if texts is not None:
            own = [texts[i] for i in order[a:b].tolist()]
            parts += [np.array([len(t) for t in own], dtype="<u4").tobytes(), *own]
        rows.append(squeeze(b"".join(parts)))
    return pa.RecordBatch.from_arrays(
        [pa.array(sorted_[starts].astype(np.int32)), pa.array(rows, type=pa.binary())], names=["shard", "blob"]
    )


def unpack(blob: bytes, kinds: list[str], texts: bool = False) -> list:
    """The columns of a blob, and with ``texts`` the list of byte strings."""
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, dtype="<u4", count=1)[0]), 4, []
    for kind in [*kinds, "<u4"] if texts else kinds:
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    if texts:
        ends = at + np.cumsum(out.pop().astype(np.int64))
        begins = [at, *ends[:-1].tolist()]
        out.append([raw[a:b] for a, b in zip(begins, ends.tolist())])
    return out


def by_shard(batches) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each shard, from rows sorted by shard."""
    current, held = None, []
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
            if shard != current and held:
                yield current, held
                held = []
            current = shard
            held.append(blob)
    if held:
        yield current, held
