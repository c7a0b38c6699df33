"""Sorted hash arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import io
import json
import os
import resource
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FETCHED_SHARDS = 8
_open = resource.getrlimit(resource.RLIMIT_NOFILE)[0]
# of a process; each holds a descriptor, and there may be 65,530 maps in all
MAPPED_FILES = min(8_192, _open // 2) if _open > 0 else 8_192
ALIGN = 64


def shard_of(key: str, bits: int):
    """The shard of a signed 64-bit key: its highest bits, so shards follow one another in key order."""
    return F.shiftright(key, 64 - bits).cast("int") if bits else F.lit(0)


def bits_for(rows: int, rows_per_shard: int = 500_000) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows / rows_per_shard)))))


def save(folder: str, name: str, shard: int, table: np.ndarray, piece: object) -> None:
    """One piece of a shard. It is written under another name first: a task that runs again, or twice, leaves the same
    whole file.
    """
    if not len(table):
        return
    file, url = f"{name}~{shard}~{piece}.npy", urlparse(folder)
    if url.scheme in ("", "file"):
        path = unquote(url.path)
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, table)
        os.replace(part, f"{path}/{file}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    part = f"{path}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        np.save(out, table)
    store.move(part, f"{path}/{file}")


def _store(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    url = urlparse(folder)
    return (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(folder)


class Pack:
    """All arrays a task makes, of many shards and names, in one file: what is mapped grows with the tasks, not with the shards.

    Arrays follow one another as they come, and what lies where stands at the end. As with ``save``, the file gets its name when
    it is whole; a task that runs again leaves the same one.
    """

    def __init__(self, folder: str, name: str):
        self.store, path = _store(folder)
        self.part, self.file = f"{path}/.{uuid.uuid4().hex}", f"{path}/{name}.pack"
        self.store.create_dir(path)
        self.out, self.at, self.index = self.store.open_output_stream(self.part), 0, []

    def _write(self, data) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, shard: int, table: np.ndarray) -> None:
        """One piece of a shard."""
        if len(table):
            self._write(b"\0" * (-self.at % ALIGN))
            self.index.append([name, int(shard), np.lib.format.dtype_to_descr(table.dtype), len(table), self.at])
            self._write(np.ascontiguousarray(table).view(np.uint8).data)

    def close(self) -> None:
        index = json.dumps(self.index).encode()
        self._write(index)
        self._write(len(index).to_bytes(8, "little"))
        self.out.close()
        self.store.move(self.part, self.file)


@lru_cache(maxsize=65_536)
def _index(folder: str, file: str) -> list[tuple[str, int, np.dtype, int, int]]:
    """What lies where in a pack."""
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{file}") as src:
        end = src.size() - 8
        size = int.from_bytes(src.read_at(8, end), "little")
        index = json.loads(src.read_at(size, end - size))
    kind = lambda descr: np.dtype([tuple(f) for f in descr] if isinstance(descr, list) else descr)
    return [(name, shard, kind(descr), rows, at) for name, shard, descr, rows, at in index]


def _listed(folder: str) -> dict[tuple[str, int], list[tuple]]:
    """Where all pieces are, by name and shard: a file of their own, or kind, rows and place in a pack."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = unquote(url.path)
        names = os.listdir(path) if os.path.isdir(path) else []
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    out: dict[tuple[str, int], list[tuple]] = {}
    for file in sorted(names):
        if file.endswith(".npy"):
            name, shard, _ = file.split("~")
            out.setdefault((name, int(shard)), []).append((file,))
        elif file.endswith(".pack"):
            for name, shard, *place in _index(folder, file):
                out.setdefault((name, shard), []).append((file, *place))
    return out


@lru_cache(maxsize=MAPPED_FILES)
def _mapped(file: str) -> np.ndarray:
    """A file as it is mapped for all look-ups of a process, so that these together hold no more descriptors than it may have."""
    return np.asarray(np.load(file, mmap_mode="r") if file.endswith(".npy") else np.memmap(file, np.uint8, "r"))


def write_shards(df: DataFrame, folder: str, name: str, build) -> DataFrame:
    """``df``, whose partitions are sorted by ``__shard``, passed through; on the way ``build(columns)`` makes of each
    shard's columns the sorted arrays to keep, by name ending.

    A task holds one shard at a time; the number of shards grows with the rows. A shard of which two tasks have a part
    gets a piece from each.
    """
    columns = [c for c in df.columns if c != "__shard"]

    def write(batches):
        shard, held = None, []

        def flush():
            if held:
                whole = {c: np.concatenate([h[c] for h in held]) for c in columns}
                tables = build(whole)
                for ending, table in tables.items():
                    keys = tables[""] if ending == "-values" else table  # of one piece with the keys they stand beside
                    if len(table):
                        save(folder, name + ending, shard, table, int((keys["key"] if keys.dtype.names else keys)[0]))

        for batch in batches:
            of = batch["__shard"].to_numpy()
            cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if of[a] != shard:
                    flush()
                    shard, held = of[a], []
                part = batch.slice(int(a), int(b - a))
                held.append({c: part[c].to_numpy() for c in columns})
            yield batch
        flush()

    return df.mapInArrow(write, df.schema)


def by_key(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All columns as one array in the order of ``key``, its first field."""
    layout = np.dtype([("key", "i8"), *((c, v.dtype) for c, v in columns.items() if c != "key")])
    out = np.empty(len(columns["key"]), dtype=layout)
    order = np.argsort(columns["key"])
    for c, v in columns.items():
        out[c] = v[order]
    return {"": out}


class Arrays:
    """Look-ups in the shards of one name; files are mapped when first needed."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits, self.maps, self.columns = folder, name, bits, {}, {}
        url = urlparse(folder)
        self.local = unquote(url.path) if url.scheme in ("", "file") else None
        self.files = {shard: places for (own, shard), places in _listed(folder).items() if own == name}

    def _pieces(self, shard: int) -> list[np.ndarray]:
        if self.local:
            return [self._part(*place) for place in self.files.get(shard, [])]
        if shard not in self.maps:
            while len(self.maps) >= FETCHED_SHARDS:
                self.maps.pop(next(iter(self.maps)))
            self.maps[shard] = [self._fetched(*place) for place in self.files.get(shard, [])]
        return self.maps[shard]

    def _part(self, file: str, kind: np.dtype | None = None, rows: int = 0, at: int = 0) -> np.ndarray:
        whole = _mapped(f"{self.local}/{file}")
        return whole if kind is None else whole[at : at + rows * kind.itemsize].view(kind)

    def _fetched(self, file: str, kind: np.dtype | None = None, rows: int = 0, at: int = 0) -> np.ndarray:
        """A piece from a store that cannot be mapped, read into memory; only a few shards are held at a time."""
        store, path = _store(self.folder)
        with store.open_input_file(f"{path}/{file}") as src:
            return np.load(io.BytesIO(src.read())) if kind is None else np.frombuffer(src.read_at(rows * kind.itemsize, at), kind)

    def find(self, keys: np.ndarray, fields: list[str], default: float = 0) -> list[np.ndarray]:
        """The values of ``fields`` for sorted distinct keys, ``default`` where there is none; "" is 1 for a key that is there.

        Arrays of keys alone have their fields beside them, under the name ending in "-values", so that a search reads only keys.
        """
        out = [np.full(len(keys), default, dtype=np.float64) for _ in fields]
        if not len(keys):
            return out
        shards = keys >> np.int64(64 - self.bits) if self.bits else np.zeros(len(keys), dtype=np.int64)
        cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for i, rows in enumerate(self._pieces(int(shards[a]))):
                column = rows["key"] if rows.dtype.names else rows
                at = np.minimum(np.searchsorted(column, keys[a:b]), len(rows) - 1)
                hit = np.flatnonzero(column[at] == keys[a:b])
                if not rows.dtype.names and any(fields):
                    rows = arrays(self.folder, f"{self.name}-values", self.bits)._pieces(int(shards[a]))[i]
                for values, field in zip(out, fields, strict=True):
                    values[a + hit] = rows[field][at[hit]] if field else 1
        return out


    def _keys(self, shard: int, piece: int, rows: np.ndarray) -> np.ndarray:
        """The keys of a piece side by side; beside wide rows a search would else read them from all over the file."""
        if not self.local:
            return np.ascontiguousarray(rows["key"])
        if (shard, piece) not in self.columns:
            self.columns[shard, piece] = np.ascontiguousarray(rows["key"])
        return self.columns[shard, piece]

    def matrix(self, keys: np.ndarray, field: str, width: int, kind: str = "f8") -> np.ndarray:
        """The rows of a field of ``width`` numbers for sorted distinct keys, zeros where there is none."""
        out = np.zeros((len(keys), width), dtype=kind)
        shards = keys >> np.int64(64 - self.bits) if self.bits else np.zeros(len(keys), dtype=np.int64)
        cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(keys)] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for i, rows in enumerate(self._pieces(int(shards[a]))):
                column = self._keys(int(shards[a]), i, rows)
                at = np.minimum(np.searchsorted(column, keys[a:b]), len(rows) - 1)
                hit = np.flatnonzero(column[at] == keys[a:b])
                out[a + hit] = rows[field][at[hit]]
        return out


    def every(self, keys: np.ndarray, field: str, width: int, kind: str = "f8") -> tuple[np.ndarray, np.ndarray]:
        """All rows of a field of ``width`` numbers for sorted distinct keys, in their order, and which key each is of."""
        which, out = [np.zeros(0, dtype=np.int64)], [np.zeros((0, width), dtype=kind)]
        shards = keys >> np.int64(64 - self.bits) if self.bits else np.zeros(len(keys), dtype=np.int64)
        cuts = np.r_[0, np.flatnonzero(shards[1:] != shards[:-1]) + 1, len(keys)] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for i, rows in enumerate(self._pieces(int(shards[a]))):
                column = self._keys(int(shards[a]), i, rows)
                first = np.searchsorted(column, keys[a:b])
                counts = np.searchsorted(column, keys[a:b], "right") - first
                at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
                which.append(a + np.repeat(np.arange(b - a), counts))
                out.append(rows[field][at])
        of = np.concatenate(which)
        order = np.argsort(of, kind="stable")
        return of[order], np.concatenate(out)[order]


@lru_cache(maxsize=32)
def arrays(folder: str, name: str, bits: int) -> Arrays:
    return Arrays(folder, name, bits)


def batch_of(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
