"""Closed trails of calls, found where the functions of a repository lie together.

Calls stay within a repository, so only functions move; trails and what is on them are made in the
task that writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 20_000  # functions of a repository for whose trails one task looks, about; a larger repository goes to several
TOGETHER = 20_000  # functions that are worked on at once, whole repositories, about
MOST = 100_000  # trails or distances that are held at once, about; what is beyond waits
ROWS = 20_000  # rows that are handed on at once
COLUMNS = "start string, cycleLength bigint, trail string, functions string, files string"


def _connected(pairs: DataFrame) -> DataFrame:
    """a, place: the least of the roots that a is connected with by pairs (a, b)."""
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = cut(both.groupBy("a").agg(F.min("b").alias("place")).select("a", F.least("a", "place").alias("place")))
    while True:
        near = both.join(at.select(F.col("a").alias("b"), "place"), "b").groupBy("a").agg(F.min("place").alias("near"))
        at = cut(at.join(near, "a").select("a", F.least("near", "place").alias("place"), (F.col("near") < F.col("place")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("a", "place")
        at = at.select("a", "place")


def _placed(functions: DataFrame, block: int) -> DataFrame:
    """The functions that may be on a closed trail, with their place and in how many blocks it goes.

    A place is a root, or where an id stands under several roots one of all roots that are connected
    so.  Without calls only those rows stay whose id has other rows.
    """
    root, key = F.coalesce("repoRoot", F.lit("")), F.xxhash64("id")  # equal hashes of two ids make a place larger, no more
    f = functions.where("id IS NOT NULL")
    keyed = f.select(key.alias("key"), root.alias("b"))
    ids = keyed.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("last"), F.count(F.lit(1)).alias("n"))
    roots = cut(ids.groupBy("a").agg(F.sum("n").alias("n"), F.max(F.col("a") < F.col("last")).alias("shared"), F.max(F.col("n") > 1).alias("several")))
    calls = F.coalesce(F.size("calls") > 0, F.lit(False))
    if roots.where("several").isEmpty():
        f = f.where(calls)
    else:
        f = f.withColumn("key", key).join(ids.where("n > 1").select("key", "n"), "key", "left").where(calls | F.col("n").isNotNull()).drop("key", "n")
    if roots.where("shared").isEmpty():
        f, sizes = f.where("repoRoot IS NOT NULL").withColumn("place", F.col("repoRoot")), roots.select(F.col("a").alias("place"), "n")
    else:
        at = _connected(keyed.join(ids.where("a < last").select("key", "a"), "key").select("a", "b").where("a <> b"))
        f = f.join(at, root == F.col("a"), "left").withColumn("place", F.coalesce("place", "repoRoot")).drop("a").where("place IS NOT NULL")
        sizes = f.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.select("place", F.ceil(F.col("n") / block).cast("int").alias("blocks")).where("blocks > 1")
    return f.join(F.broadcast(large), "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def call_cycles(functions: DataFrame, hops: int, block: int = BLOCK) -> DataFrame:
    """start, cycleLength (nodes), trail, functions, files of every closed trail of at most ``hops`` calls; an edge is used once at most, nodes may repeat.

    functions: id, name, repoRoot, file, calls; a function calls all others of a called name in its
    root.  Each place's functions are shuffled once.  A place of many goes to several tasks, each of
    which looks from a share of its functions.
    """
    f = _placed(functions.select("id", "name", "repoRoot", "file", "calls"), block)
    f = f.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    f = f.select("place", "block", (F.pmod(F.xxhash64("id"), F.col("blocks")) == F.col("block")).alias("own"), "id", "name", "repoRoot", "file", "calls")
    parts = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            yield from _rows(rows, hops)

    return f.repartition(parts, "place", "block").sortWithinPartitions("place", "block").mapInArrow(run, COLUMNS)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about TOGETHER or more that end where a block ends."""
    held, n, due = [], 0, TOGETHER
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < due:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = pc.and_(pc.equal(t["place"], t["place"][n - 1]), pc.equal(t["block"], t["block"][n - 1]))
        whole = n - pc.sum(last).as_py()
        if whole:
            yield t.slice(0, whole).combine_chunks()
        held, n = t.slice(whole).to_batches(), n - whole
        due = max(TOGETHER, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spread(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs that begin at ``at``: the run and the position of each of their members."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) + np.repeat(at - np.cumsum(counts) + counts, counts)


def _codes(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The position of each value in ``among``, -1 for null."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(*values: pa.Array) -> pa.Array:
    """The distinct non-null values in byte order."""
    v = pc.drop_null(pc.unique(pa.concat_arrays(values)))
    return v.take(pc.sort_indices(v))


def _column(t: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(t[name].chunks)


class Calls:
    """The calls among the functions of a table, without those that nothing leads to or from; nodes are numbered by their ids' order, edges by their nodes'."""

    def __init__(self, t: pa.Table):
        ids, names, roots, calls = (_column(t, c) for c in ("id", "name", "repoRoot", "calls"))
        self.ids = _ranked(ids)
        self.n = len(self.ids)
        node, root = _codes(ids, self.ids), _codes(roots, _ranked(roots))
        caller, called = pc.list_parent_indices(calls).to_numpy(), pc.list_flatten(calls)
        known = _ranked(names, called)
        name, wanted = _codes(names, known), _codes(called, known)
        self.names, self.files = self._labels(node, names), self._labels(node, _column(t, "file"))
        held = (root >= 0) & (name >= 0)
        key, callee = (root * (len(known) + 1) + name)[held], node[held]
        order = np.argsort(key, kind="stable")
        key, callee = key[order], callee[order]
        asked = (root[caller] >= 0) & (wanted >= 0)
        ask = np.unique(np.stack([node[caller[asked]], root[caller[asked]] * (len(known) + 1) + wanted[asked]]), axis=1)
        first = np.searchsorted(key, ask[1], "left")
        rows, at = _spread(first, np.searchsorted(key, ask[1], "right") - first)
        src, dst = ask[0][rows], callee[at]
        edges = np.unique((src * self.n + dst)[src != dst])
        while True:
            src, dst = np.divmod(edges, max(self.n, 1))
            out, into = np.bincount(src, minlength=self.n), np.bincount(dst, minlength=self.n)
            left = edges[(into[src] > 0) & (out[dst] > 0)]
            if len(left) == len(edges):
                break
            edges = left
        self.src, self.dst, self.out, self.into = src, dst, out, into
        self.out_at, self.into_at = np.cumsum(out) - out, np.cumsum(into) - into
        self.callers = src[np.argsort(dst, kind="stable")]
        own = np.zeros(self.n, bool)
        own[node[_column(t, "own").to_numpy(zero_copy_only=False).astype(bool)]] = True
        self.starts = np.flatnonzero(own & (out > 0))

    def _labels(self, node: np.ndarray, values: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The distinct values in order, and of each node the numbers of its own, filled up with -1."""
        among = _ranked(values)
        code = _codes(values, among)
        own = np.unique(np.stack([node[code >= 0], code[code >= 0]]), axis=1)
        n = np.bincount(own[0], minlength=self.n)
        table = np.full((self.n, max(1, n.max(initial=0))), -1)
        table[own[0], np.arange(len(own[0])) - np.repeat(np.cumsum(n) - n, n)] = own[1]
        return among, table

    def ways_back(self, starts: np.ndarray, hops: int) -> tuple[np.ndarray, np.ndarray] | None:
        """start * n + node, sorted, of the nodes from which a start is reached in less than ``hops`` edges over no smaller node, with how many it takes; None if the starts have too many."""
        keys = front = starts * self.n + starts
        far = np.zeros(len(keys), np.int64)
        for h in range(1, hops):
            s, v = np.divmod(front, self.n)
            if len(starts) > 1 and self.into[v].sum() + len(keys) > 10 * MOST:
                return None
            rows, at = _spread(self.into_at[v], self.into[v])
            s, u = s[rows], self.callers[at]
            front = np.unique((s * self.n + u)[u >= s])
            front = front[~_among(front, keys)[1]]
            if not len(front):
                break
            keys, far = np.concatenate([keys, front]), np.concatenate([far, np.full(len(front), h)])
            order = np.argsort(keys, kind="stable")
            keys, far = keys[order], far[order]
        return keys, far

    def closed(self, starts: np.ndarray, hops: int) -> Iterator[np.ndarray]:
        """Matrices of edges, a row for each closed trail whose least edge, its first, is of a start; each other turn of a trail stands for another start."""
        if not len(starts):
            return
        back = self.ways_back(starts, hops)
        if back is None:
            half = len(starts) // 2
            yield from self.closed(starts[:half], hops)
            yield from self.closed(starts[half:], hops)
            return
        keys, far = back
        work = [(_spread(self.out_at[starts], self.out[starts])[1][:, None], False)]
        while work:
            m, seen = work.pop()
            if not seen:
                s, end = self.src[m[:, 0]], self.dst[m[:, -1]]
                at, found = _among(s * self.n + end, keys)
                m = m[found & (far[at] <= hops - m.shape[1])]
                yield m[self.src[m[:, 0]] == self.dst[m[:, -1]]]
            if m.shape[1] == hops or not len(m):
                continue
            end = self.dst[m[:, -1]]
            total = np.cumsum(self.out[end])
            if total[-1] > MOST and len(m) > 1:
                k = max(1, int(np.searchsorted(total, MOST)))
                work.append((m[k:], True))
                m, end = m[:k], end[:k]
            rows, at = _spread(self.out_at[end], self.out[end])
            later = at > m[rows, 0]
            rows, at = rows[later], at[later]
            grown = m[rows]
            new = (grown != at[:, None]).all(axis=1)
            work.append((np.column_stack([grown[new], at[new]]), False))


def _among(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted keys, of which there is one at least, each value would be, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _lists(values: pa.Array, codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The coded values of each row, joined."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(codes))), ",")


def _distinct(labels: tuple[pa.Array, np.ndarray], nodes: np.ndarray) -> pa.Array:
    """The distinct labels of each row's nodes, in order, joined."""
    codes = np.sort(labels[1][nodes].reshape(len(nodes), -1), axis=1)
    first = codes >= 0
    first[:, 1:] &= codes[:, 1:] != codes[:, :-1]
    return _lists(labels[0], codes[first], first.sum(axis=1))


def _turns(g: Calls, m: np.ndarray) -> pa.RecordBatch:
    """The rows of closed trails, one for each edge with which a trail may start."""
    n, h = m.shape
    nodes = g.src[m]
    turn = (np.arange(h)[:, None] + np.arange(h + 1)) % h
    trails = nodes[:, turn].reshape(n * h, h + 1)
    same = pa.array(np.repeat(np.arange(n), h))
    return pa.RecordBatch.from_arrays(
        [
            g.ids.take(pa.array(trails[:, 0])),
            pa.array(np.full(n * h, h + 1, np.int64)),
            _lists(g.ids, trails.ravel(), np.full(n * h, h + 1)),
            _distinct(g.names, nodes).take(same),
            _distinct(g.files, nodes).take(same),
        ],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )


def _rows(t: pa.Table, hops: int) -> Iterator[pa.RecordBatch]:
    g = Calls(t)
    held: dict[int, list[np.ndarray]] = {h: [] for h in range(1, hops + 1)}
    width = max(g.names[1].shape[1], g.files[1].shape[1])
    for m in g.closed(g.starts, hops):
        h = m.shape[1]
        size = max(1, ROWS // (h * width))
        held[h].append(m)
        if sum(map(len, held[h])) >= size:
            m = np.concatenate(held[h])
            for k in range(0, len(m), size):
                yield _turns(g, m[k : k + size])
            held[h] = []
    for ms in held.values():
        if any(map(len, ms)):
            yield _turns(g, np.concatenate(ms))
