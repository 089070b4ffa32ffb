"""Walks inside tasks: each of a few tasks gets all links as packed integers, walks from its own seeds and streams its rows.

Nothing between the seeds and the rows is shuffled or written. A task holds 8 bytes for each link and the names of
the nodes, so callers take this way up to ``MOST_LINKS`` links and ``MOST_BYTES`` of names, and joins beyond.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.skew import global_rank
from quillgraph.session import cut, cut_watched, partitions

MOST_LINKS, MOST_BYTES = 20_000_000, 1 << 28
#: Rows that a task hands on at once, and links that it grows paths by at once.
ROWS, GROWN = 16_000, 60_000
#: Bytes for what a block of seeds reaches, and nodes of which those with the same seeds are put together.
CELLS, ALIKE = 1 << 26, 4096
#: Heads that meet the tails of a middle node at once.
HEADS = 8
BLOCKS = "ids array<string>, seeds array<string>, depth int"
SENT = "kind int, at bigint, a binary, b binary"
LINKS, NAMES, HASHES, GROUP, SEED, SINK = range(6)

Task = Callable[["Links", dict[int, list[tuple[int, bytes | None]]]], Iterator[dict]]


def named(links: DataFrame) -> tuple[DataFrame, int, int]:
    """((id, code), nodes, bytes of their ids): the nodes of ``links`` (src, dst), numbered from 0 in the order of their ids."""
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    names, seen = cut_watched(global_rank(ids, ["id"], "code").select("id", F.col("code").cast("int").alias("code")), "names", n=F.count(F.lit(1)), bytes=F.sum(F.octet_length("id")))
    return names, int(seen["n"]), int(seen["bytes"])


def coded(links: DataFrame, names: DataFrame) -> DataFrame:
    """(s, t): ``links`` by the codes of their ends."""
    side = lambda a, b: names.select(F.col("id").alias(a), F.col("code").alias(b))
    return links.join(side("src", "s"), "src").join(side("dst", "t"), "dst").select("s", "t")


def groups_of(spark) -> int:
    return max(1, min(partitions(spark), 2 * spark.sparkContext.defaultParallelism))


def _row(kind: int, at: int, a: bytes, b: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["kind", "at", "a", "b"])


def _packed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if x.num_rows:
            s, t = x.column(0).to_numpy(), x.column(1).to_numpy()
            yield _row(LINKS, int(s[0]) << 32 | int(t[0]), s.astype("<i4").tobytes(), t.astype("<i4").tobytes())


def _packed_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if x.num_rows:
            texts = [s.encode() for s in x.column(1).to_pylist()]
            yield _row(NAMES, x.column(0)[0].as_py(), np.array([len(s) for s in texts], "<i4").tobytes(), b"".join(texts))


def _packed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if x.num_rows:
            yield _row(HASHES, x.column(0)[0].as_py(), b"", x.column(1).to_numpy().astype("<i8").tobytes())


class Links:
    """All links of a graph by code: those of node i end at ``end[first[i]:first[i + 1]]``, in order."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, n: int, names: pa.Array | None = None):
        self.begin, self.end, self.n, self.names = begin, end, n, names
        self.first = np.searchsorted(begin, np.arange(n + 1, dtype=begin.dtype)).astype(np.int32)
        self.hashes: np.ndarray | None = None
        self._mark = np.zeros(n, np.int32)

    def step(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, place in ``end``) of each link that begins at one of ``nodes``, in the order of these."""
        size = self.first[nodes + 1] - self.first[nodes]
        which = np.repeat(np.arange(len(nodes), dtype=np.int32), size)
        before = self.first[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int32)
        return which, before[which] + np.arange(len(which), dtype=np.int32)

    def firsts(self, nodes: np.ndarray) -> np.ndarray:
        """Where each of the distinct ``nodes`` comes first."""
        places = np.arange(len(nodes), dtype=np.int32)
        self._mark[nodes[::-1]] = places[::-1]
        return np.flatnonzero(self._mark[nodes] == places)

    def back(self) -> Links:
        order = np.argsort(self.end, kind="stable")
        return Links(self.end[order], self.begin[order], self.n, self.names)

    def paths(self, rows: np.ndarray, sep: str | None) -> pa.Array:
        """Rows of codes as lists of names, or as names with ``sep`` between them."""
        k, width = rows.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), self.names.take(pa.array(rows.ravel())))
        return lists if sep is None else pc.binary_join(lists, sep)


def _received(batches: Iterator[pa.RecordBatch], n: int) -> tuple[Links, dict[int, list[tuple[int, bytes | None]]]]:
    packed: dict[int, list] = {LINKS: [], NAMES: [], HASHES: []}
    rest: dict[int, list] = {GROUP: [], SEED: [], SINK: []}
    for x in batches:
        for kind, at, a, b in zip(*(c.to_pylist() for c in x.columns)):
            if kind in packed:
                packed[kind].append((at, a, b))
            else:
                rest[kind].append((at, a))
    put = lambda k, i: b"".join(r[i] for r in sorted(packed[k], key=lambda r: r[0]))
    begin, end = (np.frombuffer(put(LINKS, i), "<i4") for i in (1, 2))
    packed[LINKS].clear()
    names = None
    if packed[NAMES]:
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(put(NAMES, 1), "<i4"))]).astype(np.int32)
        names = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(put(NAMES, 2)))
    links = Links(begin, end, n, names)
    links.hashes = np.frombuffer(put(HASHES, 2), "<u8")
    return links, {k: sorted(v, key=lambda r: (r[1] or b"", r[0])) for k, v in rest.items()}


def walked(links: DataFrame, names: DataFrame, n: int, own: DataFrame, task: Task, schema: str, groups: int, each: str | None = "id") -> DataFrame:
    """What ``task`` yields, dicts of columns of ``schema``, in each of ``groups`` tasks.

    Each gets all ``links`` (s, t), of the ``names`` (id, code) of the ``n`` nodes the "id", the "hash" of it or nothing as ``each`` says, and
    the rows of ``own`` (g, kind, at, a) of its group; those whose g is null go to all.
    """
    spark = links.sparkSession
    sorted_by = lambda df, *by: df.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    every = sorted_by(links.select("s", "t"), "s", "t").mapInArrow(_packed_links, SENT)
    if each:
        value, pack = (F.col("id"), _packed_names) if each == "id" else (F.xxhash64("id").alias("hash"), _packed_hashes)
        every = every.unionByName(sorted_by(names.select("code", value), "code").mapInArrow(pack, SENT))
    own = own.select("g", "kind", F.col("at").cast("bigint").alias("at"), "a", F.lit(None).cast("binary").alias("b"))
    every = every.unionByName(own.where("g is null").drop("g")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    numbers = spark.range(groups).select(F.col("id").cast("int").alias("g"), F.lit(GROUP).alias("kind"), F.col("id").alias("at"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    sent = every.unionByName(own.where("g is not null")).unionByName(numbers).repartitionById(groups, F.col("g")).select("kind", "at", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in task(*_received(batches, n)):
            yield pa.RecordBatch.from_pydict(columns)

    return sent.mapInArrow(run, schema)


def per_seed(seeds: DataFrame, names: DataFrame, groups: int) -> DataFrame:
    """``seeds`` (seed, id) as rows for :func:`walked`: all of a seed in one group."""
    group = F.pmod(F.xxhash64("seed"), F.lit(groups)).cast("int")
    return seeds.select("seed", "id").distinct().join(names, "id").select(group.alias("g"), F.lit(SEED).alias("kind"), F.col("code").alias("at"), F.encode("seed", "utf-8").alias("a"))


def _by_seed(rows: list[tuple[int, bytes | None]]) -> Iterator[tuple[str, np.ndarray]]:
    at = 0
    while at < len(rows):
        to = at
        while to < len(rows) and rows[to][1] == rows[at][1]:
            to += 1
        yield rows[at][1].decode(), np.array([r[0] for r in rows[at:to]], np.int32)
        at = to


def least_paths(depth: int, sep: str | None) -> Task:
    """Rows (seed, id, depth, path) from one step on. Nodes of a level stand in the order of their paths, so what meets a node first is its least path."""

    def task(links: Links, rest: dict) -> Iterator[dict]:
        for seed, start in _by_seed(rest[SEED]):
            seen = np.zeros(links.n, bool)
            seen[start] = True
            paths = start[:, None]
            for d in range(1, depth + 1):
                which, at = links.step(paths[:, -1])
                to = links.end[at]
                new = np.flatnonzero(~seen[to])
                new = new[links.firsts(to[new])]
                if not len(new):
                    break
                to = to[new]
                seen[to] = True
                paths = np.hstack([paths[which[new]], to[:, None]])
                for i in range(0, len(paths), ROWS):
                    rows = paths[i : i + ROWS]
                    yield {
                        "seed": pa.repeat(seed, len(rows)), "id": links.names.take(pa.array(rows[:, -1])), "depth": pa.repeat(pa.scalar(d, pa.int32()), len(rows)),
                        "path": links.paths(rows, sep),
                    }

    return task


def nearest(depth: int) -> Task:
    """Rows (id, seed, depth) from one step on, as ``BLOCKS``: those of a block of seeds in the order of the ids.

    Nodes that the same seeds reach, such as all beside a hub, come as one row with both lists. A file then holds an id many times
    in succession and few seeds at a time, which takes a small part of the room of rows that come seed by seed.
    """

    def task(links: Links, rest: dict) -> Iterator[dict]:
        seeds = list(_by_seed(rest[SEED]))
        size = max(1, min(1024, CELLS // max(1, links.n)))
        for i in range(0, len(seeds), size):
            block = seeds[i : i + size]
            found = np.zeros((len(block), links.n), np.int8 if depth < 128 else np.int32)
            for seen, (_, level) in zip(found, block):
                seen[level] = -1
                for d in range(1, depth + 1):
                    to = links.end[links.step(level)[1]]
                    to = to[seen[to] == 0]
                    level = to[links.firsts(to)]
                    if not len(level):
                        break
                    seen[level] = d
            texts = pa.array([s for s, _ in block])
            for lo in range(0, links.n, ALIKE):
                part = np.ascontiguousarray(found[:, lo : lo + ALIKE].T)
                for d in range(1, depth + 1):
                    yield from _blocks(links, lo, part == d, texts, d)

    return task


def _blocks(links: Links, lo: int, reached: np.ndarray, seeds: pa.Array, depth: int) -> Iterator[dict]:
    """``reached`` (node from ``lo`` on, seed), with the nodes that have the same seeds put together."""
    some = np.flatnonzero(reached.any(axis=1))
    if not len(some):
        return
    bits = np.packbits(reached[some], axis=1)
    _, one, which, many = np.unique(bits.view(f"V{bits.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    nodes, whose = some[np.argsort(which, kind="stable")] + lo, reached[some[one]]
    ends, ends_of_seeds = np.cumsum(many), np.cumsum(whose.sum(axis=1))
    batch = (ends + ends_of_seeds) // ROWS
    listed = lambda values, to: pa.ListArray.from_arrays(pa.array((to - to[0]).astype(np.int32)), values)
    for at in np.split(np.arange(len(many)), np.flatnonzero(np.diff(batch)) + 1):
        to, to_of_seeds = (np.concatenate([[x[at[0]] - y[at[0]]], x[at]]) for x, y in ((ends, many), (ends_of_seeds, whose.sum(axis=1))))
        yield {
            "ids": listed(links.names.take(pa.array(nodes[to[0] : to[-1]])), to), "seeds": listed(seeds.take(pa.array(np.nonzero(whose[at])[1])), to_of_seeds),
            "depth": pa.repeat(pa.scalar(depth, pa.int32()), len(at)),
        }


def _simple(links: Links, root: int, steps: int, near: np.ndarray) -> Iterator[np.ndarray]:
    """Simple paths of up to ``steps`` links from ``root`` in rows of one length, depth first; those to nodes that are not ``near`` enough to an end are left out."""
    stack = [np.array([[root]], np.int32)]
    while stack:
        paths = stack.pop()
        ends, left = paths[:, -1], steps - paths.shape[1] + 1
        if left:
            most = max(1, int(np.searchsorted(np.cumsum(links.first[ends + 1] - links.first[ends]), GROWN, "right")))
            if most < len(paths):
                stack.append(paths[most:])
                paths = paths[:most]
        yield paths
        if left:
            which, at = links.step(paths[:, -1])
            to = links.end[at]
            some = near[to] < left
            old, to = paths[which[some]], to[some]
            new = (old != to[:, None]).all(axis=1)
            if new.any():
                stack.append(np.hstack([old[new], to[new, None]]))


def simple_paths(depth: int, groups: int, sep: str | None) -> Task:
    """Simple paths from seeds to sinks as ``halves(sep)``: each of a row's heads goes on with each of its tails.

    Paths are cut at their middle node. A task takes its share of the middle nodes, by the number of walks through them, and of the heads
    of the few with the most. A few heads meet all tails at once, so a file holds paths that share both halves near each other.
    """

    def task(links: Links, rest: dict) -> Iterator[dict]:
        me, half, back = rest[GROUP][0][0], (depth + 1) // 2, links.back()
        times, sink = np.bincount([r[0] for r in rest[SEED]], minlength=links.n), np.zeros(links.n)
        sink[[r[0] for r in rest[SINK]]] = 1
        came, goes = [times.astype(float)], [sink]
        for _ in range(half):
            came.append(np.bincount(links.end, weights=came[-1][links.begin], minlength=links.n))
            goes.append(np.bincount(links.begin, weights=goes[-1][links.end], minlength=links.n))
        near = lambda walks: np.where(np.any(np.array(walks) > 0, axis=0), np.argmax(np.array(walks) > 0, axis=0), depth + 1)
        near_start, near_sink = near(came), near(goes)
        work = sum(came[(d + 1) // 2] * goes[d // 2] for d in range(1, depth + 1))
        shared = work > work.sum() / (8 * groups)
        order = np.argsort(-work, kind="stable")
        order = order[work[order] > 0]
        sent = _Halves(links, sep)
        for middle in [*order[shared[order]], *order[~shared[order]][me::groups]]:
            tails: dict[int, list[np.ndarray]] = {}
            for p in _simple(links, middle, depth // 2, near_sink):
                if len(p := p[sink[p[:, -1]] > 0]):
                    tails.setdefault(p.shape[1] - 1, []).append(p[:, 1:])
            held = {j: np.vstack(x) for j, x in tails.items()}
            turn = 0
            for p in _simple(back, middle, half, near_start):
                k = p.shape[1] - 1
                p = np.repeat(p, times[p[:, -1]], axis=0)
                for i in range(0, len(p) if k else 0, HEADS):
                    turn += 1
                    if shared[middle] and turn % groups != me:
                        continue
                    for j in (k - 1, k):
                        if j in held and k + j <= depth:
                            yield from sent.add(p[i : i + HEADS], middle, held[j])
        yield from sent.rest()

    return task


def halves(sep: str | None) -> str:
    kind = "array<string>" if sep is None else "string"
    return f"heads array<struct<start: string, path: {kind}>>, tails array<struct<sink: string, path: {kind}>>, length int"


class _Halves:
    """Collects heads and tails of the same lengths until they are worth a batch."""

    def __init__(self, links: Links, sep: str | None):
        self.links, self.sep, self.mask = links, sep, np.zeros(links.n, np.uint8)
        self.held: dict[tuple[int, int], list[tuple[np.ndarray, int, np.ndarray]]] = {}
        self.size: dict[tuple[int, int], int] = {}

    def add(self, heads: np.ndarray, middle: int, tails: np.ndarray) -> Iterator[dict]:
        """``heads`` lead from ``middle`` back to their starts; at most 8, a bit for each."""
        for i, h in enumerate(heads):
            self.mask[h[1:]] |= np.uint8(1 << i)
        clash = np.bitwise_or.reduce(self.mask[tails], axis=1)
        self.mask[heads.ravel()] = 0
        key = heads.shape[1] - 1, tails.shape[1]
        for c in np.unique(clash):
            fit = heads[(int(c) >> np.arange(len(heads))) & 1 == 0]
            own = tails[clash == c]
            for i in range(0, len(own) if len(fit) else 0, ROWS):
                part = own[i : i + ROWS]
                self.held.setdefault(key, []).append((fit, middle, part))
                self.size[key] = self.size.get(key, 0) + len(fit) + len(part)
                if self.size[key] >= ROWS:
                    yield self.batch(key)

    def batch(self, key: tuple[int, int]) -> dict:
        held, self.size[key] = self.held.pop(key), 0
        heads, tails = np.vstack([h for h, _, _ in held])[:, ::-1], np.vstack([t for _, _, t in held])
        many, many_tails = np.array([len(h) for h, _, _ in held]), np.array([len(t) for _, _, t in held])
        sinks = tails[:, -1] if key[1] else np.repeat([m for _, m, _ in held], many_tails)
        ends = self.links.paths(tails, self.sep)
        if self.sep is not None:
            ends = pc.binary_join_element_wise("", ends, self.sep) if key[1] else ends
        put = lambda lengths, at, name, paths: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.StructArray.from_arrays([self.links.names.take(pa.array(at)), paths], [name, "path"]))
        return {
            "heads": put(many, heads[:, 0], "start", self.links.paths(heads, self.sep)), "tails": put(many_tails, sinks, "sink", ends),
            "length": pa.repeat(pa.scalar(sum(key), pa.int32()), len(held)),
        }

    def rest(self) -> Iterator[dict]:
        for key in list(self.held):
            yield self.batch(key)
