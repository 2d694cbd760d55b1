"""Exchange of hashed keys between tasks as packed arrays.

A mapper packs its (key, owner...) entries by range of the key's hash, Spark shuffles
the packs, and one group per range compares all entries of equal key. A pack costs
a few bytes an entry beyond the entry itself. A key that one mapper met often goes out
once (or twice) from there, so that no range grows with the most frequent key; entries whose
outcome the mapper knows go to ranges of their owner's hash. What a range finds out goes
back to the owners as packs too, one for each range of owners.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm.kernels import mix

PACK_SCHEMA = "bucket int, pack binary, known binary"
#: What ranges of keys tell about the owners of entries: packed places, by range of owners.
PLACES_SCHEMA = "near int, places binary"
_PLACE = np.dtype([("owner", np.int64), ("pos", np.int64)])
#: Entries that a mapper gathers before it packs them.
GATHER = 1 << 20


def encode(entries: np.ndarray) -> bytes:
    """Byte planes of each field; those of sorted keys and of small numbers compress well."""
    if not len(entries):
        return b""
    return b"".join(np.ascontiguousarray(entries[f]).view(np.uint8).reshape(len(entries), -1).T.tobytes() for f in entries.dtype.names)


def decode(pack: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(pack) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for f in dtype.names:
        width = dtype[f].itemsize
        planes = np.frombuffer(pack, np.uint8, n * width, at).reshape(width, n)
        out[f] = np.ascontiguousarray(planes.T).view(dtype[f]).reshape(n)
        at += n * width
    return out


def read_packs(table: pa.Table, column: str, dtype: np.dtype) -> np.ndarray:
    """All entries in a column of packs, in order of their first two fields."""
    entries = np.concatenate([np.empty(0, dtype), *(decode(x.as_py(), dtype) for x in table.column(column) if x.is_valid)])
    return entries[np.lexsort([entries[f] for f in reversed(dtype.names[:2])])]


class Packer:
    """Gathers entries of a structured dtype whose first field is `key`, and makes packs of them.

    local: called with the entries in order of their first two fields; returns (entries to send, entries whose outcome is known here).
    """

    def __init__(self, dtype: np.dtype, buckets: int, local: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.order = dtype.names[:2]
        self.dtype, self.buckets, self.local, self.parts, self.size = dtype, buckets, local, [], 0

    def add(self, **fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = np.empty(len(fields["key"]), self.dtype)
        for name, values in fields.items():
            part[name] = values
        self.parts.append(part)
        self.size += len(part)
        if self.size >= GATHER:
            yield from self.flush()

    def _by_bucket(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Entries are in order of key, so each bucket is one slice.
        width = (1 << 64) // self.buckets + 1
        cuts = np.searchsorted(entries["key"], np.array([b * width for b in range(1, self.buckets)], np.uint64))
        return entries, np.concatenate(([0], cuts, [len(entries)]))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        entries = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        entries = entries[np.lexsort([entries[x] for x in reversed(self.order)])]
        send, known = self.local(entries)
        known = known.copy()
        known["key"] = mix(known[self.order[1]].astype(np.uint64))
        known = known[np.argsort(known["key"], kind="stable")]
        (send, cut), (known, known_cut) = self._by_bucket(send), self._by_bucket(known)
        some = [b for b in range(self.buckets) if cut[b] < cut[b + 1] or known_cut[b] < known_cut[b + 1]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.array([encode(send[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
                pa.array([encode(known[known_cut[b] : known_cut[b + 1]]) for b in some], pa.binary()),
            ],
            names=["bucket", "pack", "known"],
        )


def groups_of(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in sorted keys, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def lists_by(owner: np.ndarray, values: np.ndarray, kind: pa.DataType, names: list[str]) -> pa.Table:
    """A row for each owner, with the list of its values."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    cut = groups_of(owner)
    heads = owner[cut[:-1]] if len(owner) else owner
    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))
    return pa.table([pa.array(heads, pa.int64()), lists], names=names)


def placed(owner: np.ndarray, pos: np.ndarray, ranges: int) -> pa.Table:
    """The places of owners packed by range of the owner's hash: as many rows as ranges at most, however many owners."""
    owner = owner.astype(np.int64)
    near = ((mix(owner.view(np.uint64)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((pos, owner, near))
    entries = np.empty(len(owner), _PLACE)
    entries["owner"], entries["pos"], near = owner[order], pos[order], near[order]
    cut = groups_of(near)
    packs = [encode(entries[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table([pa.array(near[cut[:-1]] if len(near) else near, pa.int32()), pa.array(packs, pa.binary())], names=["near", "places"])


def places_of(packs: DataFrame, owner: str) -> DataFrame:
    """(owner, pos): a row for each owner in the packs of placed(), with all its places in order."""

    def unpack(table: pa.Table) -> pa.Table:
        entries = read_packs(table, "places", _PLACE)
        return lists_by(entries["owner"], entries["pos"], pa.int64(), [owner, "pos"])

    return packs.groupBy("near").applyInArrow(unpack, f"{owner} long, pos array<long>")


def compare(packs: DataFrame, dtype: np.dtype, outcome: Callable[[np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """outcome(entries in order of their first two fields, known entries) for each range of keys."""
    return packs.groupBy("bucket").applyInArrow(lambda t: outcome(read_packs(t, "pack", dtype), read_packs(t, "known", dtype)), schema)
