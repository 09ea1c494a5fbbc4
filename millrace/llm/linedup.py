"""Line near-duplicates by a segment-partition edit join.

A line within ``threshold`` edits of another keeps at least one of the other's threshold + 1 segments unchanged, at one
of a few places that the two lengths allow. Segments are the index, those substrings are the probes; both are keyed by
segment number, length of the indexed line and content. What meets is first compared by a sketch (the parity of hashed
character pairs, of which an edit moves at most four) and then verified by banded bit-parallel edit distance. Equal lines
are one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import is_empty, map_arrow, materialize, small
from millrace.llm.components import connected_components
from millrace.llm.hashing import hashes_of, sums_of

THRESHOLD = 2
#: The default of ``least``, which leaves no line out; lines of fewer characters are only joined with equal ones.
LEAST_CHARS = 1
#: Lines under one key up to which all are compared; beyond that the key is split by parts of the sketch.
CROWD = 4096
#: A key that its sketch parts do not thin out is compared by pairs of blocks of so many times CROWD rows, a task for each pair.
BLOCK = 16
#: Rows of index and probes compared at a time.
TILE = 512, 2048
#: Lines that met another up to which their list is broadcast to fetch the texts; beyond that the join is by shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters of lines worked on at a time, and names of lines remembered as given out.
CHUNK_CHARS, MEMO = 500_000, 100_000
SKETCH_BITS, PARTS = 60, 10
INDEX, PROBE, LEFT, RIGHT = 1, 2, 4, 8
_ROLE = np.uint64(SKETCH_BITS)


def cuts(n: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of a line's segments; the last ones are a character longer where it does not divide."""
    parts = threshold + 1
    size, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        length = size + (i >= parts - longer)
        out.append((at, length))
        at += length
    return out


def places(n: int, threshold: int) -> list[tuple[int, int, int, int, int]]:
    """(segment, length of the indexed line, start, length, role) of all that a line of n characters looks up or is found by.

    A line of no more characters than the threshold has an empty segment, so all lines of about its length look it up;
    its other segments are left out.
    """
    rows: dict[tuple[int, int, int, int], int] = {}
    for shorter in range(threshold + 1):
        m = n - shorter
        if m < 1:
            break
        for i, (at, length) in enumerate(cuts(m, threshold)):
            if m <= threshold:
                rows[0, m, 0, 0] = PROBE
                break
            low = max(at - i, at + shorter - (threshold - i), 0)
            high = min(at + i, at + shorter + (threshold - i), n - length)
            for p in range(low, high + 1):
                rows[i, m, p, length] = PROBE
    for i, (at, length) in enumerate(cuts(n, threshold)[: 1 if n <= threshold else None]):
        rows[i, n, at, length] = rows.get((i, n, at, length), 0) | INDEX
    return [(*k, role) for k, role in rows.items()]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance by a bit-parallel band of ``most`` diagonals on both sides, given up once it must exceed ``most`` (then most + 1).

    Equal ends are cut off first; only what lies between them is compared. Column j of the band holds the rows j - most
    to j + most of the longer line, a bit each; the band moves down a row with each column. What lies outside counts as
    dearer than it is, which no path of ``most`` edits meets.
    """
    if len(a) < len(b):
        a, b = b, a
    ahead = len(a) - len(b)
    if ahead > most:
        return most + 1
    x, n = 0, len(b)
    while x < n and a[x] == b[x]:
        x += 1
    y = 0
    while y < n - x and a[-1 - y] == b[-1 - y]:
        y += 1
    a, b = a[x : len(a) - y], b[x : len(b) - y]
    if not b:
        return ahead
    # For each character its rows within the band, and the column for which they stand; later columns shift them.
    where: dict[str, tuple[int, int]] = {}
    for i, c in enumerate(a[:most]):
        where[c] = where.get(c, (0, 0))[0] | 1 << i + most, 0
    band = (1 << 2 * most + 1) - 1
    plus, minus = band << most & band, 0
    # Costs are followed along the diagonal that ends in the last cell; they never fall along it.
    score, end = ahead, 1 << most + ahead
    for j, c in enumerate(b):
        if j + most < len(a):
            rows, at = where.get(a[j + most], (0, j))
            where[a[j + most]] = rows >> j - at | 1 << 2 * most, j
        rows, at = where.get(c, (0, j))
        hit = rows >> j - at
        same = ((hit & plus) + plus ^ plus | hit | minus) & band
        if not same & end:
            score += 1
            if score > most:
                return score
        right, left = minus | ~(same | plus) & band, same & plus
        plus, minus = left | ~(same >> 1 | right) & band, same >> 1 & right
    return score


@lru_cache(maxsize=10_000)
def _plan(n: int, threshold: int) -> np.ndarray:
    """Columns (salt of segment and indexed length, start, length, role) of a line's places."""
    return np.array([(m << 8 | i, at, length, role) for i, m, at, length, role in places(n, threshold)], dtype=np.int64).T


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines, one after the other, and where each ends."""
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.cumsum([len(x) for x in lines])


def sketches(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities of hashed character pairs for each line of one character or more."""
    flat = codes.astype(np.uint64)
    pair = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    bit = np.uint64(1) << ((pair >> np.uint64(40)) % np.uint64(SKETCH_BITS))
    bit = np.append(bit, np.uint64(0))
    bit[ends - 1] = 0  # a pair over a line's end
    return np.bitwise_xor.reduceat(bit, np.concatenate([[0], ends[:-1]]))


def _keys(threshold: int, least: int):
    """(key, line, sketch) rows of a batch's different lines; the role stands above the sketch's bits."""

    def keyed(lines: list[str], names: list[int]) -> pa.RecordBatch:
        plans = [_plan(len(x), threshold) for x in lines]
        rows = [p.shape[1] for p in plans]
        salt, at, length, role = np.concatenate(plans, axis=1)
        flat, ends = _codes(lines)
        starts = np.repeat(np.concatenate([[0], ends[:-1]]), rows) + at
        keys = hashes_of(sums_of(flat), starts, length, salt.astype(np.uint64))
        sketch = np.repeat(sketches(flat, ends), rows) | role.astype(np.uint64) << _ROLE
        line_of = np.repeat(np.array(names, dtype=np.uint64), rows)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, line_of, sketch)], names=["key", "line", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What was lately given out is not given out again; a line that still comes twice is one line under its keys.
        seen: set[int] = set()
        lines, names, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= least and line.strip(" \t\n\v\f\r"):
                        name = xxhash.xxh64_intdigest(line.encode(), 42)
                        if name not in seen:
                            seen.add(name)
                            lines.append(line)
                            names.append(name)
                            held += len(line)
                    if held >= CHUNK_CHARS:
                        yield keyed(lines, names)
                        lines, names, held = [], [], 0
                if len(seen) > MEMO:
                    seen.clear()
        if lines:
            yield keyed(lines, names)

    return run


def _finer(key: int, line: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A crowded key split by each two of the sketch's parts: of ten, eight moved bits leave two alike."""
    width = SKETCH_BITS // PARTS
    part = [(sketch >> np.uint64(width * i)) & np.uint64((1 << width) - 1) for i in range(PARTS)]
    for i, j in combinations(range(PARTS), 2):
        base = (int(key) * 0x9E3779B97F4A7C15 + i * PARTS + j) * 0xC2B2AE3D27D4EB4F % (1 << 64)
        mixed = np.uint64(base) + (part[i] << np.uint64(width) | part[j])
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        yield _rows(1, mixed.view(np.int64), line.view(np.int64), sketch.view(np.int64))


def _thins(sketch: np.ndarray) -> bool:
    """Whether splitting these rows by each two of the sketch's parts leaves fewer comparisons than they have as they are."""
    width, met = SKETCH_BITS // PARTS, 0
    part = [(sketch >> np.uint64(width * i)) & np.uint64((1 << width) - 1) for i in range(PARTS)]
    for i, j in combinations(range(PARTS), 2):
        met += int((np.bincount((part[i] << np.uint64(width) | part[j]).astype(np.int64)) ** 2).sum())
    return 2 * met < len(sketch) ** 2


def _rows(kind: int | np.ndarray, key, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(key), pa.array(a), pa.array(b)], names=["kind", "key", "a", "b"])


def _meet(threshold: int, crowd: int | None, finer: bool = True):
    """Rows sorted by key: pairs of lines whose sketches are near (kind 0), or a crowded key's rows, under finer keys
    (kind 1) or, where those would not thin it out or are not wanted, under its own key dealt into blocks (kind 2 and up)."""
    low = np.uint64((1 << SKETCH_BITS) - 1)

    def pairs(line, sketch):
        _, one = np.unique(line, return_index=True)
        role = np.zeros(len(one), dtype=np.uint64)
        np.bitwise_or.at(role, np.searchsorted(line[one], line), sketch >> _ROLE)
        line, sketch = line[one], sketch[one] & low
        having = lambda bits: np.flatnonzero((role & np.uint64(bits)) == bits)
        ways = [(INDEX | LEFT, PROBE | RIGHT), (INDEX | RIGHT, PROBE | LEFT)] if (role & np.uint64(LEFT | RIGHT)).any() else [(INDEX, PROBE)]
        for index, probe in [(having(one), having(other)) for one, other in ways]:
            for x in range(0, len(index), TILE[0]):
                for y in range(0, len(probe), TILE[1]):
                    near = np.bitwise_count(sketch[index[x : x + TILE[0]], None] ^ sketch[None, probe[y : y + TILE[1]]]) <= 4 * threshold
                    i, j = np.nonzero(near)
                    a, b = line[index[x + i]], line[probe[y + j]]
                    other = a != b
                    if other.any():
                        yield np.minimum(a, b)[other].view(np.int64), np.maximum(a, b)[other].view(np.int64)

    def group(key, line, sketch, crowded, thins, n_out):
        if crowded and thins:
            yield from _finer(key, line, sketch)
        elif crowded:
            blocks = 2 + (n_out + np.arange(len(line))) // (BLOCK * crowd)
            yield _rows(blocks, np.full(len(line), key).view(np.int64), line.view(np.int64), sketch.view(np.int64))
        else:
            for a, b in pairs(line, sketch):
                yield _rows(0, np.zeros(len(a), dtype=np.int64), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held, crowded, thins, n_out = None, [], 0, False, False, 0

        def close():
            if n_held > 1 or crowded:
                yield from group(key, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), crowded, thins, n_out)

        for batch in batches:
            k, line, sketch = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            if not len(k):
                continue
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
            ends_of_batch = np.zeros(len(starts), dtype=bool)
            ends_of_batch[[0, -1]] = True
            for g in np.flatnonzero((ends - starts > 1) | ends_of_batch):
                s, e = starts[g], ends[g]
                if k[s] != key:
                    yield from close()
                    key, held, n_held, crowded, n_out = k[s], [], 0, False, 0
                held.append((line[s:e], sketch[s:e]))
                n_held += e - s
                if crowd and n_held > crowd:
                    # One way for all of a key's rows, by the first of them.
                    thins = thins if crowded else finer and _thins(np.concatenate([h[1] for h in held]))
                    crowded = True
                    yield from close()
                    held, n_held, n_out = [(line[:0], sketch[:0])], 0, n_out + n_held
        yield from close()

    return run


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(key, line, sketch) of rows dealt into blocks: under a key for each two blocks of one group, marked by its side.

    A block meets itself without a side. All pairs of a group meet, and no task holds more than two blocks.
    """
    rows = rows.select("key", (F.col("kind") - 2).alias("block"), F.col("a").alias("line"), F.col("b").alias("sketch"))
    last = materialize(rows.groupBy("key").agg(F.max("block").alias("last")))
    each = rows.join(small(last, BROADCAST_ROWS), "key").withColumn("with", F.explode(F.sequence(F.lit(0), "last")))
    side = F.when(F.col("block") < F.col("with"), LEFT).when(F.col("block") > F.col("with"), RIGHT).otherwise(0).cast("long")
    key = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    return each.select(key.alias("key"), "line", F.col("sketch").bitwiseOR(F.shiftleft(side, SKETCH_BITS)).alias("sketch"))


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = pa.array([x != y and edits(x, y, threshold) <= threshold for x, y in zip(a, b)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    return run


def line_name(line: Column) -> Column:
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, no, line) for each line with a word; ``row`` is the hash of the text. Null texts have none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    lines = rows.select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.col("line").rlike("[^ \\t-\\r]"))


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least: int = LEAST_CHARS, crowd: int = CROWD) -> DataFrame:
    """(a, b): names of different lines of at least ``least`` characters within ``threshold`` edits, each pair once."""
    if least < 1:
        raise ValueError("a line has a character at least")
    rows = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), _keys(threshold, least), "key long, line long, sketch long")
    schema = "kind int, key long, a long, b long"
    meet = lambda df, *more: materialize(map_arrow(df.repartition("key").sortWithinPartitions("key"), _meet(threshold, *more), schema))
    met = [meet(rows, crowd)]
    crowded = met[0].where("kind = 1").select("key", F.col("a").alias("line"), F.col("b").alias("sketch"))
    if not is_empty(crowded):
        met.append(meet(crowded, crowd, False))
    for blocks in [m.where("kind > 1") for m in met]:
        if not is_empty(blocks):
            met.append(meet(_block_pairs(blocks), None))
    pairs = reduce(DataFrame.union, [m.where("kind = 0").select("a", "b") for m in met])
    pairs = materialize(pairs.distinct())
    # The texts of the lines that met, from another look at the documents.
    wanted = materialize(pairs.select(F.col("a").alias("short")).union(pairs.select("b")).distinct())
    texts = lines_of(docs, id_col, text_col).select(F.xxhash64("line").alias("short"), "line").where(F.length("line") >= least)
    texts = materialize(texts.join(small(wanted, BROADCAST_ROWS), "short", "left_semi").distinct())
    sides = pairs.join(texts.select(F.col("short").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("short").alias("b"), F.col("line").alias("y")), "b")
    named = sides.select(line_name(F.col("x")).alias("a"), line_name(F.col("y")).alias("b"), "x", "y")
    return materialize(map_arrow(named, _verify(threshold), "a binary, b binary"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, least: int = LEAST_CHARS, crowd: int = CROWD) -> DataFrame:
    """(id, row, no, n_links, class_id, class_no, class_row, first) for each line with a word.

    A class is what is reachable over links; it is named by its first line, of the smallest id, number and text hash. ``first`` is
    true for that line alone, so keeping such lines removes near-duplicates. ``n_links`` counts the different lines that
    the line is linked to; equal lines have equal links. Rows that repeat a document repeat its lines.
    """
    found = lines_of(docs, id_col, text_col).select("id", "row", "no", line_name(F.col("line")).alias("name"))
    found = materialize(found)
    links = line_links(docs, id_col, text_col, threshold, least, crowd)
    degree = links.select(F.col("a").alias("name")).union(links.select("b")).groupBy("name").agg(F.count("*").alias("n_links"))
    roots = connected_components(links).withColumnRenamed("node", "name")
    firsts = found.groupBy("name").agg(F.min(F.struct("id", "no", "row")).alias("at"))
    known = firsts.join(roots, "name", "left").join(degree, "name", "left").select("name", "at", F.coalesce("root", "name").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = materialize(known)
    names = materialize(known.groupBy("root").agg(F.min("at").alias("first")))
    known = materialize(known.join(names, "root").select("name", "n_links", "first"))
    own = F.struct("id", "no", "row")
    return found.join(known, "name").select("id", "row", "no", "n_links", F.col("first.id").alias("class_id"), F.col("first.no").alias("class_no"), F.col("first.row").alias("class_row"), own.eqNullSafe(F.col("first")).alias("first"))


def by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, n_lines, n_links, n_removed, classes): a row for each id, of its lines with a word taken together.

    ``classes`` are the ids that the classes of its lines are named by; a null id is not listed. Ids without such lines have zeros and no classes.
    """
    lines = line_classes(docs, id_col, text_col, **more)
    counts = lines.groupBy("id").agg(F.count("*").alias("n_lines"), F.sum("n_links").alias("n_links"), F.count_if(~F.col("first")).alias("n_removed"), F.array_sort(F.collect_set("class_id")).alias("classes"))
    kind = counts.schema["classes"].dataType.simpleString()
    ids = docs.select(F.col(id_col).alias("_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = ids.join(counts, F.col("_id").eqNullSafe(F.col("id")), "left")
    return joined.select(F.col("_id").alias("id"), zero("n_lines"), zero("n_links"), zero("n_removed"), F.coalesce("classes", F.array().cast(kind)).alias("classes"))
