"""The layout of whole graphs in Spark's Python workers: numpy over all graphs of some Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Rows that are gathered before the graphs among them are laid out.
ROWS = 1 << 16

#: What a worker says of a graph: laid out, in a cycle, or left to joins since it has too many rows.
FINE, CYCLE, LARGE = 0, 1, 2


def lay_out(batches: Iterator[pa.RecordBatch], most: int, shortened: bool) -> Iterator[pa.RecordBatch]:
    """Rows (dag, task, duration, shorter, upstream, edge), each graph's side by side, to one row for each task.

    These are (dag, task, duration, at, tail, makespan, sooner, state); ``sooner`` is the makespan if a task without slack
    took ``shorter``, only if ``shortened``. A graph of more than ``most`` rows may not fit into memory: it is one row of
    state LARGE. Where a graph has a cycle, a row of state CYCLE stands for all that were laid out with it.
    """
    pending: list[pa.RecordBatch] = []
    rows, wanted, skip = 0, ROWS, False
    for batch in chain(batches, [None]):
        if batch is not None:
            pending.append(batch)
            rows += batch.num_rows
        if not rows or (batch is not None and rows < wanted):
            continue
        table = pa.Table.from_batches(pending)
        graph = _codes(table["dag"])
        # The last graph may go on in the next batch, unless this is the end or it is too large already.
        sizes = np.bincount(graph)
        whole = sizes <= most
        if skip:
            # The first row stands for a large graph that was told before; what else it has is passed over.
            whole[0] = False
        large = ~whole
        large[0] &= not skip
        whole[-1] &= batch is None
        for i in np.flatnonzero(large):
            yield from _marks(table.slice(int(np.searchsorted(graph, i)), 1), LARGE)
        if whole.any():
            yield from _solve(table if whole.all() else table.filter(pa.array(whole[graph])), shortened)
        skip = bool(large[-1]) or (skip and len(sizes) == 1)
        rest = table.slice(table.num_rows - int(sizes[-1]), 1 if skip else None)
        pending, rows = rest.to_batches(), rest.num_rows
        wanted = max(ROWS, 2 * rows)


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """A number for each value of the columns, one below the other, by first appearance."""
    chunks = [x for c in columns for x in c.chunks]
    if pa.types.is_nested(columns[0].type):
        chunks = [pa.array([repr(v) for v in x.to_pylist()], pa.string()) for x in chunks]
    return pa.chunked_array(chunks, chunks[0].type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _marks(table: pa.Table, state: int) -> Iterator[pa.RecordBatch]:
    n, kind = table.num_rows, table.schema.field("duration").type
    kind = kind if pa.types.is_floating(kind) else pa.int64()
    columns = {"dag": table["dag"], "task": table["task"], "duration": table["duration"]}
    columns |= {c: pa.nulls(n, kind) for c in ("at", "tail", "makespan", "sooner")}
    return iter(pa.table(columns | {"state": pa.array([state] * n, pa.int32())}).to_batches())


def _values(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column, 0 for null, and which are there."""
    column = column.combine_chunks()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind), there


def _solve(table: pa.Table, shortened: bool) -> Iterator[pa.RecordBatch]:
    edge = table["edge"].combine_chunks().to_numpy(zero_copy_only=False)
    tasks, edges = table.filter(pa.array(~edge)), table.filter(pa.array(edge))
    if not tasks.num_rows:
        return
    kind = np.float64 if pa.types.is_floating(table.schema.field("duration").type) else np.int64
    least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    graph = _codes(table["dag"])
    names = _codes(tasks["task"], edges["task"], edges["upstream"])
    many, n = int(names.max()) + 1, tasks.num_rows
    key = graph[~edge] * many + names[:n]
    # Rows of one task are one node, which takes the longest of their durations.
    nodes, node = np.unique(key, return_inverse=True)
    of = nodes // many
    duration, there = _values(tasks["duration"], kind)
    if kind is np.int64 and np.bincount(graph[~edge], np.abs(duration.astype(np.float64))).max() >= 2**63:
        raise ArithmeticError("the durations of a graph add up to more than a long holds")
    weight = np.full(len(nodes), least, kind)
    np.maximum.at(weight, node[there], duration[there])
    known = np.zeros(len(nodes), bool)
    known[node[there]] = True

    # Edges by their upper end, those with an end that is no task left out.
    m = edges.num_rows
    ends = []
    for i in (2, 1):
        wanted = graph[edge] * many + names[n + (i - 1) * m : n + i * m]
        at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
        ends.append((at, nodes[at] == wanted))
    (up, a), (down, b) = ends
    up, down = up[a & b], down[a & b]
    by = np.argsort(up, kind="stable")
    up, down = up[by], down[by]
    first = np.searchsorted(up, np.arange(len(nodes) + 1))

    # Forward: each level are the tasks whose last upstream was in the level before.
    at = np.zeros(len(nodes), kind)
    open_ = np.bincount(down, minlength=len(nodes))
    level = np.flatnonzero(open_ == 0)
    levels, out = [], []
    while len(level):
        counts = first[level + 1] - first[level]
        e = np.repeat(first[level] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        levels.append(level)
        out.append(e)
        counted = e[known[up[e]]]
        np.maximum.at(at, down[counted], at[up[counted]] + weight[up[counted]])
        np.subtract.at(open_, down[e], 1)
        level = np.unique(down[e][open_[down[e]] == 0])
    order = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    if len(order) < len(nodes):
        yield from _marks(tasks.slice(0, 1), CYCLE)
        return
    # Backward, by the same levels.
    tail = np.zeros(len(nodes), kind)
    for e in reversed(out):
        e = e[known[down[e]]]
        np.maximum.at(tail, up[e], tail[down[e]] + weight[down[e]])

    graphs = int(graph.max()) + 1
    makespan = np.full(graphs, least, kind)
    ends_ = np.zeros(graphs, bool)
    row = graph[~edge]
    np.maximum.at(makespan, row[there], at[node[there]] + duration[there])
    ends_[row[there]] = True
    columns = {"dag": tasks["dag"], "task": tasks["task"], "duration": tasks["duration"]}
    columns |= {"at": pa.array(at[node]), "tail": pa.array(tail[node]), "makespan": pa.array(makespan[row], mask=~ends_[row])}
    if not shortened:
        columns["sooner"] = pa.nulls(n, pa.from_numpy_dtype(kind))
    else:
        shorter, shorter_there = _values(tasks["shorter"], kind)
        short = np.full(len(nodes), least, kind)
        np.maximum.at(short, node[shorter_there], shorter[shorter_there])
        sooner = _without(of, order, at, weight, tail, known, up, down, least)
        given = short > least
        sooner[given] = np.maximum(sooner[given], (at + np.where(given, short, 0) + tail)[given])
        critical = np.zeros(len(nodes), bool)
        critical[node[there & (makespan[row] - tail[node] - duration == at[node])]] = True
        columns["sooner"] = pa.array(sooner[node], mask=~(critical & (sooner > least))[node])
    columns["state"] = pa.array(np.full(n, FINE, np.int32))
    yield from pa.table(columns).combine_chunks().to_batches()


def _without(of, order, at, weight, tail, known, up, down, least) -> np.ndarray:
    """For each node the longest way through its graph that leaves it out, ``least`` if there is none.

    Put in an order that edges follow, such a way ends before the node, begins behind it, or has an edge that passes over
    it; no edge that passes over it belongs to a way through it on the way there or on. So it is a maximum over
    ranges of the order: doubling steps, as many as the logarithm of a graph's size.
    """
    n = len(order)
    order = order[np.argsort(of[order], kind="stable")]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    of = of[order]
    # A node without a duration ends no way and begins none.
    to, on = np.full(n, least, at.dtype), np.full(n, least, at.dtype)
    k = known[order]
    to[k], on[k] = (at + np.where(known, weight, 0))[order][k], (tail + np.where(known, weight, 0))[order][k]
    longest = int(np.bincount(of).max())
    before, behind, step = to.copy(), on.copy(), 1
    while step < longest:
        same = of[step:] == of[:-step]
        before[step:] = np.where(same, np.maximum(before[step:], before[:-step]), before[step:])
        behind[:-step] = np.where(same, np.maximum(behind[:-step], behind[step:]), behind[:-step])
        step *= 2
    found = np.full(n, least, at.dtype)
    same = of[1:] == of[:-1]
    found[1:][same] = before[:-1][same]
    found[:-1][same] = np.maximum(found[:-1][same], behind[1:][same])
    # Edges over some nodes: two overlapping ranges of a power of two, halved down to single nodes.
    a, b = place[up], place[down]
    over = (b - a > 1) & (to[a] > least) & (on[b] > least)
    a, b = a[over], b[over]
    value, width = to[a] + on[b], np.log2(np.maximum(b - a - 1, 1)).astype(np.int64)
    over = np.full(n, least, at.dtype)
    for w in range(int(width.max(initial=0)), -1, -1):
        x = width == w
        np.maximum.at(over, a[x] + 1, value[x])
        np.maximum.at(over, b[x] - (1 << w), value[x])
        if w:
            half = 1 << (w - 1)
            moved = over.copy()
            moved[half:] = np.maximum(moved[half:], over[:-half])
            over = moved
    found = np.maximum(found, over)
    result = np.empty_like(found)
    result[order] = found
    return result
