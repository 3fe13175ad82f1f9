"""Sorted hash arrays in the shared folder, memory-mapped by workers.

Workers emit partial tables as blobs, one row per (batch, shard); a shuffle by shard brings the blobs
of a shard to one task, which sorts, reduces and writes it as .npy files. Shards are ranges of the
64-bit key, so that sorted lookups touch each shard once and read it in order. Keys are mixed hashes
(or are mixed here), so shards are even whatever the data; repeated keys are combined before the
shuffle. The number of shards follows the size of the input (``common.shards_for``), and a shard's blobs are combined as
they come, so a task's memory has a bound. The blobs number tasks times shards; past some 10 TB of input a second
level of shards would be due.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trim, work_dir

BLOB = "shard int, kind string, n long, data binary"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, n: int, dtypes: list[str]) -> list[np.ndarray]:
    out, at = [], 0
    for t in dtypes:
        size = np.dtype(t).itemsize * n
        out.append(np.frombuffer(data, t, n, at))
        at += size
    return out


def blobs(kind: str, keys: np.ndarray, values: list[np.ndarray], shards: int):
    """Rows (shard, kind, n, data) of sorted ``keys`` and their values."""
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = int(cuts[s]), int(cuts[s + 1])
        yield s, kind, hi - lo, pack([keys[lo:hi], *(v[lo:hi] for v in values)])


def rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
        ["shard", "kind", "n", "data"],
    )


def _fs(uri: str):
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return None, parsed.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save(uri: str, name: str, array: np.ndarray) -> None:
    """Write an array under its final name only when whole: retried tasks are harmless."""
    buf = io.BytesIO()
    np.save(buf, array)
    put(uri, f"{name}.npy", buf.getbuffer())


def put(uri: str, name: str, data) -> None:
    store, path = _fs(uri)
    final, tmp = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
    if store is None:
        os.makedirs(path, exist_ok=True)
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, final)
    else:
        store.create_dir(path, recursive=True)
        with store.open_output_stream(tmp) as f:
            f.write(data)
        store.move(tmp, final)


def load(uri: str, name: str) -> np.ndarray:
    """Memory-mapped where the shared folder is mounted, else read through its file system."""
    store, path = _fs(uri)
    if store is None:
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    with store.open_input_file(f"{path}/{name}.npy") as f:
        return np.load(io.BytesIO(f.read()))


def _reduce(reduce_shard):
    """One partition holds one shard: its blobs go, as they come, to ``reduce_shard(shard, iterator of (kind, n, data))``."""

    def rows(batches):
        for batch in batches:
            for shard, kind, n, data in zip(*(batch.column(i) for i in range(4))):
                yield shard.as_py(), kind.as_py(), n.as_py(), data.as_py()

    def run(batches):
        every = rows(batches)
        first = next(every, None)
        if first is not None:
            shard = first[0]
            yield shard, reduce_shard(shard, (r[1:] for r in chain((first,), every)))
            trim()

    return run


def build(parts: DataFrame, shards: int, reduce_shard) -> list[dict]:
    """Bring blobs together by shard and let ``reduce_shard`` write it; its small dicts, one a shard, are the result."""
    reduce = _reduce(reduce_shard)

    def run(batches):
        out = [json.dumps(stats | {"shard": shard}) for shard, stats in reduce(batches)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["stats"])

    moved = parts.repartitionById(shards, F.col("shard"))
    found = {s["shard"]: s for s in (json.loads(r.stats) for r in moved.mapInArrow(run, "stats string").collect())}
    return [found.get(s, {"shard": s}) for s in range(shards)]


def build_on(parts: DataFrame, shards: int, reduce_shard, what: str) -> tuple[list[dict], DataFrame]:
    """As ``build``, where ``reduce_shard`` returns (dict, blobs for a next table); these are the second result."""
    reduce = _reduce(reduce_shard)

    def run(batches):
        for shard, (stats, out) in reduce(batches):
            yield rows_to_batch([(shard, "stats", 0, json.dumps(stats | {"shard": shard}).encode())])
            for row in out:
                yield rows_to_batch([row])

    written = materialize(parts.repartitionById(shards, F.col("shard")).mapInArrow(run, BLOB), what)
    found = {s["shard"]: s for s in (json.loads(bytes(r.data)) for r in written.where("kind = 'stats'").select("data").collect())}
    return [found.get(s, {"shard": s}) for s in range(shards)], written.where("kind <> 'stats'")


def gather(rows, combine, limit: int = 1 << 20):
    """Combine tuples of equally long arrays as they come, so that what is held is bounded by the distinct keys."""
    parts, n, held = [], 0, 0
    for part in rows:
        parts.append(part)
        n += len(part[0])
        if n > max(limit, 2 * held):
            parts = [combine(*(np.concatenate(x) for x in zip(*parts)))]
            n = held = len(parts[0][0])
    return combine(*(np.concatenate(x) for x in zip(*parts))) if parts else None


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def thirty_two(keys: np.ndarray, counts: np.ndarray):
    """(keys, counts as u4) parts whose sums are the counts: what passes 32 bits is sent in several."""
    while len(keys):
        yield keys, np.minimum(counts, 0xFFFFFFFF).astype("u4")
        more = counts > 0xFFFFFFFF
        keys, counts = keys[more], counts[more] - 0xFFFFFFFF


class Sorted:
    """Lookup over shards of sorted keys; ``present`` lists the shards that exist."""

    def __init__(self, uri: str, name: str, shards: int, present: list[int], values: list[str] = ()):
        self.uri, self.name, self.shards, self.values = uri, name, shards, list(values)
        self.present, self.open = set(present), {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def arrays(self, shard: int):
        if shard not in self.open:
            self.open[shard] = [load(self.uri, f"{self.name}{v}-{shard:05d}") for v in ["", *self.values]]
        return self.open[shard]

    def lookup(self, keys: np.ndarray):
        """For sorted ``keys``: (found mask, position within the shard, shard, value arrays)."""
        found = np.zeros(len(keys), bool)
        outs = None
        position = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if int(s) not in self.present:
                continue
            lo, hi = int(cuts[s]), int(cuts[s + 1])
            own, *vals = self.arrays(int(s))
            at = np.searchsorted(own, keys[lo:hi])
            at[at == len(own)] = 0
            hit = own[at] == keys[lo:hi]
            found[lo:hi] = hit
            position[lo:hi] = at
            if outs is None:
                outs = [np.zeros(len(keys), v.dtype) for v in vals]
            for o, v in zip(outs, vals):
                o[lo:hi][hit] = v[at[hit]]
        return found, position, outs if outs is not None else [np.zeros(len(keys), np.int64) for _ in self.values]

    def find(self, keys: np.ndarray, checks: np.ndarray):
        """Of a store sorted by key and a second hash, its first value array: (found mask, last value) of sorted ``keys``."""
        found, out = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if int(s) in self.present:
                own, check, value = self.arrays(int(s))
                todo = np.arange(int(cuts[s]), int(cuts[s + 1]))
                at = np.searchsorted(own, keys[todo])
                while len(todo):
                    same = at < len(own)
                    same[same] = own[at[same]] == keys[todo[same]]
                    todo, at = todo[same], at[same]
                    hit = check[at] == checks[todo]
                    found[todo[hit]], out[todo[hit]] = True, value[at[hit]]
                    todo, at = todo[~hit], at[~hit] + 1
        return found, out

    def ranges(self, keys: np.ndarray):
        """For sorted distinct ``keys`` of a store with repeated keys: (index of the key, value arrays) of every entry."""
        owners, outs = [np.empty(0, np.int64)], [[np.empty(0, np.int64)] for _ in self.values]
        cuts = np.searchsorted(shard_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if int(s) not in self.present:
                continue
            lo, hi = int(cuts[s]), int(cuts[s + 1])
            own, *vals = self.arrays(int(s))
            a, b = np.searchsorted(own, keys[lo:hi], "left"), np.searchsorted(own, keys[lo:hi], "right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owners.append(np.repeat(np.arange(lo, hi), n))
            for o, v in zip(outs, vals):
                o.append(np.asarray(v[at]))
        return np.concatenate(owners), [np.concatenate(o) for o in outs]


#: bits of ``monotonically_increasing_id`` that count rows within a partition
ROW_BITS = 33


class Rows:
    """Lookup of row numbers made by ``monotonically_increasing_id``: a file of sorted numbers for each partition that made them.

    A task reads rows of few partitions, so it opens few files, and rows with texts need no shuffle to be picked.
    """

    def __init__(self, ids: DataFrame, what: str):
        """``ids`` has row and further long columns, the values; rows don't repeat."""
        self.uri, self.values, self.open = work_dir(ids.sparkSession, what), [c for c in ids.columns if c != "row"], {}
        uri, names = self.uri, ["row", *self.values]

        def run(key, table):
            part, order = key[0].as_py(), np.argsort(table["row"].to_numpy())
            for name in names:
                save(uri, f"{name}-{part}", table[name].to_numpy()[order])
            return pa.table({"part": pa.array([part], pa.int64())})

        grouped = ids.select(F.shiftright("row", ROW_BITS).alias("part"), *names).groupBy("part")
        self.present = {r.part for r in grouped.applyInArrow(run, "part long").collect()}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def find(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found mask, values of the found) of ``rows`` in any order."""
        found, outs = np.zeros(len(rows), bool), [np.zeros(len(rows), np.int64) for _ in self.values]
        parts = rows >> ROW_BITS
        for part in np.unique(parts).tolist():
            if part not in self.present:
                continue
            if part not in self.open:
                self.open = {part: [load(self.uri, f"{name}-{part}") for name in ("row", *self.values)]}
            own, *values = self.open[part]
            here = np.flatnonzero(parts == part)
            at = np.minimum(np.searchsorted(own, rows[here]), len(own) - 1)
            hit = own[at] == rows[here]
            found[here[hit]] = True
            for out, v in zip(outs, values):
                out[here[hit]] = v[at[hit]]
        return found, [out[found] for out in outs]


def pick(rows: DataFrame, ids: DataFrame, what: str) -> DataFrame:
    """Rows of ``rows`` (row and any columns) whose number is in ``ids`` (row); nothing of ``rows`` is shuffled."""
    store, names = Rows(ids.select("row"), what), rows.columns

    def run(batches):
        for batch in batches:
            found, _ = store.find(batch.column(names.index("row")).to_numpy())
            if found.any():
                yield batch.filter(pa.array(found))
        trim()

    return rows.mapInArrow(run, rows.schema)
