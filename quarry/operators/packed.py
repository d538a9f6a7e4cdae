"""Graphs of long nodes in packed rows, for rounds over all edges that no task holds whole.

Node i is the i-th in order.  A row holds the edges out of the nodes of one part, i % parts, both directions being
stored, so a round reads each row where it lies and shuffles nothing.  What a round finds is stored as rows of a few numbers a
node; tasks read those of all nodes from the shared folder, 8 bytes a node and vector, through pyarrow's filesystems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed edges of a row, about.
PACK = 500_000
EDGES = "part int, x binary, y binary, w binary"


def stored(path: str, *columns: str) -> pa.Table:
    """Columns of a table in the shared folder, read in a task."""
    from pyarrow import fs, parquet

    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path if ":" in path else "file://" + path))
    return parquet.read_table(place, columns=list(columns), filesystem=store)


def runs(path: str, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, first) of all stored edges, a file's row group at a time in memory: the nodes x, their neighbours y, and where those of each begin."""
    from pyarrow import fs, parquet

    store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path if ":" in path else "file://" + path))
    for info in store.get_file_info(fs.FileSelector(place)):
        if info.base_name.startswith(("_", ".")):
            continue
        with store.open_input_file(info.path) as f:
            file = parquet.ParquetFile(f)
            for g in range(file.num_row_groups):
                for b in file.read_row_group(g, ["x", "y"]).to_batches():
                    for i in range(b.num_rows):
                        x, y = (np.frombuffer(b[c][i].as_buffer(), np.int32) for c in "xy")
                        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
                        cuts = np.flatnonzero(np.diff(first // most, prepend=-1))  # whole nodes
                        for j, k in zip(cuts, [*cuts[1:], len(first)], strict=True):
                            yield x[first[j:k]], y[first[j] : first[k] if k < len(first) else len(y)], first[j:k] - first[j]


@lru_cache(maxsize=1)
def ids_of(path: str) -> np.ndarray:
    """The nodes in order."""
    return np.sort(stored(path, "node")["node"].to_numpy())


def ints(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64)


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64)


def put(x: np.ndarray) -> bytes:
    return (x if x.dtype == np.float64 else x.astype(np.int32)).tobytes()


def values(path: str, n: int, column: str) -> np.ndarray:
    """A number for each node from rows (node, column), 0 where there is none."""
    t, out = stored(path, "node", column), np.zeros(n)
    out[ints(t["node"])] = doubles(t[column])
    return out


def followed(paths: list[str], n: int) -> np.ndarray:
    """Where each node has come to by the rows (node, to) of the tables, one after the other."""
    m = np.arange(n)
    for path in paths:
        t, c = stored(path, "node", "to"), np.arange(n)
        c[ints(t["node"])] = ints(t["to"])
        m = c[m]
    return m


def added(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of places (x, y) below n in order, with their summed weights."""
    key = x * n + y
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[first] // n, key[first] % n, np.add.reduceat(w, first) if len(first) else w


def dealt(part: np.ndarray, names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    """A row of packed numbers for each part."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    cuts = list(zip(first, np.r_[first[1:], len(part)][: len(first)], strict=True))
    return pa.record_batch([pa.array(part[first], pa.int32()), *(pa.array([put(c[i:j]) for i, j in cuts], pa.binary()) for c in columns)], ["part", *names])


def batched(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.Table]:
    """The batches as tables of ``most`` rows or a little more."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, x, y, w) of packed rows."""
    for b in batches:
        for i in range(b.num_rows):
            yield (b["part"][i].as_py(), *(np.frombuffer(b[c][i].as_buffer(), np.int32).astype(np.int64) for c in "xy"), np.frombuffer(b["w"][i].as_buffer(), np.float64))


def row(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([columns])


@dataclass
class Graph:
    """Packed rows of a graph, where its nodes lie, their number and that of the parts."""

    rows: DataFrame
    ids: str
    n: int
    parts: int


def collected(rows: DataFrame, n: int) -> DataFrame:
    """One row a part of rows of edges (part, x, y, w), equal edges added."""

    def put_together(t: pa.Table) -> pa.Table:
        x, y, w = added(ints(t["x"]), ints(t["y"]), doubles(t["w"]), n)
        return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "x": [put(x)], "y": [put(y)], "w": [put(w)]})

    return rows.groupBy("part").applyInArrow(put_together, EDGES)


def graph(pairs: DataFrame, cut, place_of, pack: int | None = None) -> Graph:
    """The graph of different pairs (a, b, w) of longs, each once."""
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    ids, n = place_of(nodes), nodes.count()
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-2 * pairs.count() // (pack or PACK)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batched(batches):
            x, y = (np.searchsorted(ids_of(ids), t[c].to_numpy()) for c in "ab")
            w = t["w"].to_numpy()
            yield dealt(np.r_[x, y] % parts, ["x", "y", "w"], np.r_[x, y], np.r_[y, x], np.r_[w, w])

    rows = pairs.select("a", "b", F.col("w").cast("double").alias("w")).mapInArrow(deal, EDGES)
    return Graph(cut(collected(rows, n)), ids, n, parts)


def renamed(g: Graph, rows: DataFrame, path: str, loops: bool) -> DataFrame:
    """Rows of edges between the groups (node, to) stored at ``path``; without ``loops`` what lies in a group is left out."""
    n, parts = g.n, g.parts

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = followed([path], n)
        for _, x, y, w in each(batches):
            x, y = c[x], c[y]
            if not loops:
                out = x != y
                x, y, w = x[out], y[out], w[out]
            x, y, w = added(x, y, w, n)
            yield dealt(x % parts, ["x", "y", "w"], x, y, w)

    return collected(rows.mapInArrow(rename, EDGES), n)


def named(g: Graph, spark, paths: list[str]) -> DataFrame:
    """(node, community): the smallest node of each group that the steps (node, to) at ``paths`` lead to."""
    ids, n, parts = g.ids, g.n, g.parts

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, nodes, least = None, None, None
        for b in batches:
            if m is None:
                m, nodes, least = followed(paths, n), ids_of(ids), np.arange(n)
                least[m[::-1]] = np.arange(n)[::-1]  # the smallest is written last
            for part in b["part"].to_pylist():
                for i in range(part, n, parts * (1 << 20)):
                    own = np.arange(i, min(n, i + parts * (1 << 20)), parts)
                    yield pa.record_batch({"node": nodes[own], "community": nodes[least[m[own]]]})

    return spark.range(0, parts, 1, min(parts, spark.sparkContext.defaultParallelism)).select(F.col("id").alias("part")).mapInArrow(name, "node long, community long")


def size(rows: DataFrame) -> int:
    return (rows.agg(F.sum(F.length("x"))).first()[0] or 0) // 4
