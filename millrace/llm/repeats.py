"""Repeated byte strings by common-prefix interval trees.

All strings of ``LENGTH`` bytes that stand in more than one place are found without sorting every suffix. Of the k-grams
in such a string the one with the least hash is its anchor, wherever the string stands. A document's string starts are
so divided into runs with one anchor each, and a run with its bytes is a strip. Equal strings lie in strips of one anchor
and at one place beside it.

Strips that are equal as a whole are one leaf of their anchor's tree, with a count. The different strips of one anchor are
suffixes cut at the anchor: they are sorted by the bytes from it on, and a scan with a stack over the common prefix lengths
gives the tree's intervals. Within an interval the bytes before the anchor, sorted backwards, show where occurrences differ
to the left: there the repeat cannot be extended, and all its occurrences are one maximal group. ``repeat_groups`` gives
these groups with every occurrence. What is removed needs of each strip only the innermost group of each interval, which
``Tree.reaches`` reads off the same intervals without writing out the others' members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import is_empty, map_arrow, materialize, small
from millrace.llm.hashing import mix, power_tables, sums_of

LENGTH = 400
GRAM = 160
#: A passage: a run of bytes covered by repeated strings of the first length (with anchors of the second) that holds so many words.
PASSAGE, PASSAGE_WORDS = (250, 100), 50
#: Different strips of one anchor up to which they are compared in one task; beyond that they are split by the half of the
#: string that lies before or after the anchor, and where even that is shared by more, each string is compared by hash.
CROWD = 4096
#: Documents up to which a list of their ids is broadcast; beyond that ids and texts meet by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes taken at a time; longer documents go in slices that overlap by a string less one byte.
SLICE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _window_sums(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive bytes, the same wherever they stand."""
    sums = sums_of(data)
    return mix((sums[width:] - sums[:-width]) * power_tables(len(sums))[1][: len(sums) - width])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n, have = len(v) - width + 1, 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:n], v[width - have : width - have + n])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, anchor, first, last string start) of each run in the texts data[starts[i]:ends[i]]."""
    room = ends - starts >= length
    starts, ends = starts[room], ends[room]
    if not len(starts):
        return (np.empty(0, dtype=np.int64),) * 4
    hashes = _window_sums(data, gram)
    least = _least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8))
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return hashes[anchor[first]].view(np.int64), anchor[first], at[first], at[last]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches (from, to, rows, their starts, their ends) of about SLICE bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        if offsets[row + 1] - offsets[row] > SLICE:
            for x in range(int(offsets[row]), int(offsets[row + 1]) - length + 1, SLICE):
                y = min(x + SLICE + length - 1, int(offsets[row + 1]))
                yield x, y, np.array([row]), np.array([0]), np.array([y - x])
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        x = int(offsets[row])
        yield x, int(offsets[stop]), np.arange(row, stop), offsets[row:stop] - x, offsets[row + 1 : stop + 1] - x
        row = stop


def strips(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(anchor, id, row, strip, place, before, after) for each run of (id, row, text): the strip is a hash of its bytes,
    ``place`` the anchor's byte, and the run's starts reach from ``before`` to ``after`` bytes before it."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column(2))
            whole = memoryview(data)
            for x, y, rows, starts, ends in _slices(offsets, length):
                key, anchor, first, last = runs_of(data[x:y], starts, ends, length, gram)
                if not len(key):
                    continue
                owner = rows[np.searchsorted(ends, first, side="right")]
                view, digest = whole[x:y], xxhash.xxh3_64_intdigest
                strip = np.array([digest(view[s:e]) for s, e in zip(first.tolist(), (last + length).tolist())], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(strip.view(np.int64)), pa.array(anchor + x - offsets[owner]), pa.array((anchor - first).astype(np.int32)), pa.array((anchor - last).astype(np.int32))],
                    names=["anchor", "id", "row", "strip", "place", "before", "after"],
                )

    return map_arrow(docs.select("id", "row", "text"), run, f"anchor long, id {kind}, row long, strip long, place long, before int, after int")


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of each common-prefix interval at least ``least`` deep; lcp[i] lies between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, d = stack.pop()
            if d >= least:
                yield first, i, d
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    width = max(1, int(sizes.max()))
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), dtype=np.uint8).reshape(len(parts), width), sizes


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring rows."""
    differ = rows[:-1] != rows[1:]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(sizes[:-1], sizes[1:]))


class Tree:
    """The interval tree of the strips of one anchor, given as (bytes before it, bytes from it on)."""

    def __init__(self, before: list[bytes], after: list[bytes], counts: list[int] | None = None):
        self.leaves = [(len(b), len(a), i) for i, (b, a, n) in enumerate(zip(before, after, counts or ())) if n > 1]
        order = sorted(range(len(after)), key=after.__getitem__)
        self.order = np.array(order)
        rows, sizes = _matrix([after[i] for i in order])
        self.lcp = _common(rows, sizes).tolist()
        backwards = [before[i][::-1] for i in order]
        self.left, self.left_sizes = _matrix(backwards)
        rank = np.empty(len(order), dtype=np.int64)
        rank[sorted(range(len(order)), key=backwards.__getitem__)] = np.arange(len(order))
        self.rank = rank

    def nodes(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(members in the order of what stands before them, its common lengths, depth) of each interval."""
        for first, last, depth in intervals(self.lcp, length - int(self.left_sizes.max())):
            members = first + np.argsort(self.rank[first : last + 1])
            yield members, _common(self.left[members], self.left_sizes[members]), depth

    def groups(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes before the anchor, bytes from it on, strips) of each maximal repeat of at least ``length`` bytes.

        Its occurrences differ, or end, both before and after it; all of them are in the group. A strip that stands in
        several places is a group by itself, unless it is a part of others.
        """
        given, whole = set(), set(self.leaves)
        for members, common, depth in self.nodes(length):
            for first, last, back in intervals(common.tolist(), length - depth):
                inside = members[first : last + 1]
                # With all of them in one deeper interval the repeat goes on to the right and is given there.
                if min(self.lcp[inside.min() : inside.max()]) == depth:
                    found = np.sort(self.order[inside])
                    if (back, depth, found.tobytes()) not in given:
                        given.add((back, depth, found.tobytes()))
                        whole.difference_update((back, depth, i) for i in found.tolist())
                        yield back, depth, found
        for back, depth, i in sorted(whole):
            yield back, depth, np.array([i])

    def reaches(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(strip, bytes before, bytes after): the longest repeat in each interval of which the strip is part."""
        for members, common, depth in self.nodes(length):
            near = np.zeros(len(members), dtype=np.int64)
            near[:-1] = common
            near[1:] = np.maximum(near[1:], common)
            for i in np.flatnonzero(near + depth >= length):
                yield int(self.order[members[i]]), int(near[i]), depth


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows sorted by anchor as one dict of lists for each anchor."""
    held: dict | None = None
    for batch in batches:
        rows = batch.to_pydict()
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            part = {k: v[x:y] for k, v in rows.items()}
            if held and held["anchor"][0] == part["anchor"][0]:
                for k, v in part.items():
                    held[k] += v
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def _halves(g: dict) -> tuple[list[bytes], list[bytes]]:
    return [b[:n] for b, n in zip(g["bytes"], g["before"])], [b[n:] for b, n in zip(g["bytes"], g["before"])]


def _by_tree(length: int):
    """Sorted strips to (id, row, s, e): of each that stands in one place, the innermost repeats over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def typed(batches):
            for batch in batches:
                kinds[:] = [batch.schema.field("id").type]
                yield batch

        out: list[list] = [[], [], [], []]

        def full():
            return pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), *(pa.array(c, pa.int64()) for c in out[1:])], names=["id", "row", "s", "e"])

        for g in _grouped(typed(batches)):
            if len(g["bytes"]) < 2:
                continue
            for i, back, on in Tree(*_halves(g)).reaches(length):
                if g["n"][i] == 1:
                    for column, v in zip(out, (g["id"][i], g["row"][i], g["place"][i] - back, g["place"][i] + on)):
                        column.append(v)
            if len(out[0]) > 10_000:
                yield full()
                out = [[], [], [], []]
        if out[0]:
            yield full()

    return run


def _groups_by_tree(length: int):
    """Sorted strips to (at, grp, strip, back, ahead): the maximal groups with the strips that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches):
            out: list[list] = [[], [], [], [], []]
            for back, on, members in Tree(*_halves(g), g["n"]).groups(length):
                names = sorted({g["strip"][i] for i in members})
                group = xxhash.xxh3_64_intdigest(np.array([g["at"][0], back, on, *names], dtype=np.int64).tobytes())
                for strip in names:
                    for column, v in zip(out, (g["at"][0], group - (1 << 63), strip, back, on)):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["at", "grp", "strip", "back", "ahead"])

    return run


def _by_string(length: int):
    """Each string of each strip, by two independent hashes; ``back`` is how far before the anchor it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("bytes")[i].as_py()
                n = len(data) - length + 1
                views = memoryview(data)
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(views[j : j + length]) for j in range(n)]), dtype=np.int64).reshape(-1, 2)
                same = lambda c: batch.column(c).take(pa.array(np.full(n, i)))
                back = batch.column("before")[i].as_py() - np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *map(same, ("anchor", "id", "row", "place", "n", "at", "strip")), pa.array(back)], names=["h1", "h2", "anchor", "id", "row", "place", "n", "at", "strip", "back"])

    return run


def _cut_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, row, text, wanted) to a row for each strip wanted, with its bytes."""
    for batch in batches:
        ids, rows, wanted = batch.column(0), batch.column(1), batch.column(3)
        texts = batch.column(2).cast(pa.large_binary())
        for i in range(batch.num_rows):
            text, want = texts[i].as_py() or b"", wanted[i].as_py()
            same = lambda c: c.take(pa.array(np.full(len(want), i)))
            own = lambda c, kind=pa.int64(): pa.array([w[c] for w in want], kind)
            yield pa.RecordBatch.from_arrays(
                [own("anchor"), same(ids), same(rows), own("place"), own("before", pa.int32()), own("n"), own("anchor"), own("strip"), pa.array([text[w["place"] - w["before"] : w["place"] - w["after"] + w["length"]] for w in want], pa.binary())],
                names=["anchor", "id", "row", "place", "before", "n", "at", "strip", "bytes"],
            )


def _by_half(length: int, gram: int):
    """Strips of crowded anchors under narrower keys.

    Equal strings at one anchor go on, beyond the gram, for length - gram bytes in all: at least half of them before it
    or half of them after it. So each strip is keyed by the half before and by the half after, as far as it has them.
    """
    half = (length - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, take = [], []
            for i, (anchor, before, text) in enumerate(zip(batch.column("anchor").to_pylist(), batch.column("before").to_pylist(), batch.column("bytes").to_pylist())):
                for side, part in enumerate((text[before - half : before] if before >= half else b"", text[before : before + gram + half])):
                    if len(part) == (half, gram + half)[side]:
                        keys.append(xxhash.xxh3_64_intdigest(part, (anchor * 2 + side) % (1 << 64)))
                        take.append(i)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), *rows.columns[1:]], names=rows.schema.names)

    return run


def same_document():
    return F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))


def _with_their(texts: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """The texts (id, row, text) that are named by (_id, _row), or with left_anti those that are not.

    Only ids meet the texts here, by broadcast while they are few enough, so that no other text is dealt out.
    """
    return texts.join(small(named.select("_id", "_row"), BROADCAST_ROWS), same_document(), how)


def _texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _anchored(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Strips whose anchor stands in several places (``same``: all alike), and of the unlike ones the kinds (anchor, strip, n, at)."""
    found = materialize(strips(texts, length, gram))
    keys = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("strip") == F.max("strip")).alias("same")).where("n > 1")
    keys = materialize(keys.select("anchor", "same"))
    met = materialize(found.join(keys, "anchor"))
    kinds = met.where("not same").groupBy("anchor", "strip").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "place", "before", "after")).alias("at"))
    return met, materialize(kinds)


def _sorted_strips(texts: DataFrame, kinds: DataFrame, open_keys: DataFrame, length: int, gram: int, crowd: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The kinds' bytes, sorted by anchor or by a narrower key, with at most ``crowd`` to a key; and those that are still more."""
    cut = f"anchor long, id {kinds.schema['at'].dataType['id'].dataType.simpleString()}, row long, place long, before int, n long, at long, strip long, bytes binary"
    want = F.struct("anchor", "strip", "at.place", "at.before", "at.after", "n", F.lit(length).alias("length"), "crowded")
    asked = kinds.join(open_keys, "anchor").groupBy(F.col("at.id").alias("_id"), F.col("at.row").alias("_row")).agg(F.collect_list(want).alias("wanted"))
    asked = materialize(asked)
    held = _with_their(texts, asked, "left_semi").join(asked, same_document())
    these = lambda crowded: held.select("id", "row", "text", F.filter("wanted", lambda w: w.crowded == F.lit(crowded)).alias("wanted")).where(F.size("wanted") > 0)
    dealt = lambda df: df.repartition("anchor").sortWithinPartitions("anchor")
    out = [dealt(map_arrow(these(False), _cut_strips, cut))]
    if is_empty(open_keys.where("crowded")):
        return out, None
    narrower = _by_half(length, gram)
    halves = materialize(map_arrow(these(True), lambda batches: narrower(_cut_strips(batches)), cut))
    sizes = halves.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("anchor", (F.col("n") > crowd).alias("still")))
    shared = halves.join(sizes, "anchor")
    out.append(dealt(shared.where("not still").drop("still")))
    return out, None if is_empty(sizes.where("still")) else shared.where("still").drop("still")


def _strings(many: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Every string of the strips, and those (anchor, h1, h2) that stand in several under one narrower key."""
    kind = many.schema["id"].dataType.simpleString()
    strings = materialize(map_arrow(many, _by_string(length), f"h1 long, h2 long, anchor long, id {kind}, row long, place long, n long, at long, strip long, back long"))
    return strings, materialize(strings.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("times")).where("times > 1").drop("times"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(id, row, s, e): stretches of bytes, possibly overlapping, that together cover every byte of a repeated string.

    ``row`` is the hash of the text. Null texts are empty. Rows that are equal in id and text repeat each other.
    """
    texts = _texts_of(docs, id_col, text_col)
    met, kinds = _anchored(texts, length, gram)
    # Strips that stand in several places repeat as a whole; the list of their kinds meets them without dealing them out.
    again = small(kinds.where("n > 1").select("anchor", "strip"), BROADCAST_ROWS)
    direct = met.where("same").select("id", "row", "place", "before", "after").union(met.where("not same").join(again, ["anchor", "strip"], "left_semi").select("id", "row", "place", "before", "after"))
    spans = direct.select("id", "row", (F.col("place") - F.col("before")).alias("s"), (F.col("place") - F.col("after") + length).alias("e"))

    open_keys = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("alone")).where("alone > 0")
    open_keys = materialize(open_keys.select("anchor", (F.col("kinds") > crowd).alias("crowded")))
    if is_empty(open_keys):
        return spans
    parts, many = _sorted_strips(texts, kinds, open_keys, length, gram, crowd)
    kind = texts.schema["id"].dataType.simpleString()
    for part in parts:
        spans = spans.union(map_arrow(part, _by_tree(length), f"id {kind}, row long, s long, e long"))
    if many is not None:
        strings, repeated = _strings(many, length)
        hits = strings.where("n = 1").join(small(repeated, BROADCAST_ROWS), ["anchor", "h1", "h2"], "left_semi").select("id", "row", (F.col("place") - F.col("back")).alias("s"))
        spans = spans.union(hits.select("id", "row", "s", (F.col("s") + length).alias("e")))
    return spans


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(grp, length, id, row, start): the maximal repeats around each anchor, with every occurrence of each.

    A repeat is followed as far as the strips of its anchor reach; one that is longer goes on in the groups of the next
    anchors. All of ``grp`` are equal strings of ``length`` bytes, and cannot all be extended by an equal byte within the
    strips. Where half keys are crowded too, groups are strings of the least length, not extended. Null texts are empty;
    rows that are equal in id and text repeat each other. Groups of near copies share members, so their rows can be many
    more than the strips: take ``repeated_spans`` for removal.
    """
    texts = _texts_of(docs, id_col, text_col)
    met, kinds = _anchored(texts, length, gram)
    place = lambda df, back, n: df.select("grp", F.lit(n).cast("long").alias("length") if isinstance(n, int) else n.alias("length"), "id", "row", (F.col("place") - back).alias("start"))
    found = place(met.where("same").withColumn("grp", F.xxhash64("anchor")), F.col("before"), (F.col("before") - F.col("after") + length).cast("long"))
    open_keys = materialize(kinds.groupBy("anchor").agg((F.count("*") > crowd).alias("crowded")))
    if is_empty(open_keys):
        return found
    parts, many = _sorted_strips(texts, kinds, open_keys, length, gram, crowd)
    held = [map_arrow(part, _groups_by_tree(length), "at long, grp long, strip long, back long, ahead long") for part in parts]
    if many is not None:
        strings, repeated = _strings(many, length)
        own = strings.join(small(repeated, BROADCAST_ROWS), ["anchor", "h1", "h2"], "left_semi")
        held.append(own.select("at", F.xxhash64("at", "h1", "h2").alias("grp"), "strip", "back", (length - F.col("back")).alias("ahead")))
    groups = materialize(reduce(DataFrame.union, held).distinct())
    at = groups.withColumnRenamed("at", "anchor").join(met.where("not same").select("anchor", "strip", "id", "row", "place"), ["anchor", "strip"])
    return found.union(place(at, F.col("back"), F.col("back") + F.col("ahead")))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the spans cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _remove(with_text: bool, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, near = batch.column(1).cast(pa.large_binary()), batch.column(2), batch.column(3)
            found: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                text, runs = texts[i].as_py() or b"", _merged(spans[i].as_py())
                kept, at = [], 0
                for s, e in runs:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                passages = sum(len(text[s:e].split()) >= words for s, e in _merged(near[i].as_py()))
                for column, v in zip(found, (len(text), len(text) - len(rest), len(runs), passages, hashlib.sha256(rest).hexdigest(), rest if with_text else None)):
                    column.append(v)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in found[:4]), pa.array(found[4], pa.string()), pa.array(found[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept_sha256", "kept"])

    return run


def _by_document(spans: DataFrame, name: str) -> DataFrame:
    return materialize(spans.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("s", "e")).alias(name)))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, with_text: bool = True, passage: tuple[int, int] = PASSAGE, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, n_passages, kept_sha256, kept binary): each row's text without its repeated bytes.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same document too. Matches
    never cross documents. Null texts are empty; a row for each row. ``kept`` is null if the texts are not asked for.
    ``n_passages`` counts the runs of bytes in shorter repeated strings, of ``passage[0]`` bytes, that hold at least
    ``passage_words`` words: text to look at that is too short to be removed. Only documents that hold such strings can
    hold the longer ones, so only they are searched for those.
    """
    if passage[0] > length:
        raise ValueError("passages are the shorter strings")
    texts = _texts_of(docs, id_col, text_col)
    near = _by_document(repeated_spans(texts, "id", "text", *passage, crowd), "near")
    some = _with_their(texts, near, "left_semi").select("id", "text")
    spans = _by_document(repeated_spans(some, "id", "text", length, gram, crowd), "spans")
    both = near.join(spans.withColumnsRenamed({"_id": "_id2", "_row": "_row2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), "left")
    both = materialize(both.select("_id", "_row", "spans", "near"))
    none = F.lit(None).cast(both.schema["spans"].dataType)
    whole = _with_their(texts, near, "left_anti").select("id", "text", none.alias("spans"), none.alias("near"))
    joined = whole.union(_with_their(texts, near, "left_semi").join(both, same_document()).select("id", "text", "spans", "near"))
    kind = texts.schema["id"].dataType.simpleString()
    return map_arrow(joined, _remove(with_text, passage_words), f"id {kind}, n_bytes long, n_removed long, n_spans long, n_passages long, kept_sha256 string, kept binary")
