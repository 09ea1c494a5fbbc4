"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most three bits have a half in which
they differ in at most one, so they agree on one of that half's 32 variants with a single bit left out. The variants
are the keys of an equality join; what meets under a key is verified on the whole fingerprint.

Equal fingerprints are one entry of the index. Under a key only a spanning forest of the links is given out, never all
pairs. A key with more than ``crowd`` fingerprints is split further: the other half is cut in four, of which one part
must be equal, and so on, until the bits that may still differ bound the group's size by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import is_empty, map_arrow, materialize, small
from millrace.llm.components import connected_components

CROWD = 1024
#: With so few bits open a group of different fingerprints is small by itself and is not split any more.
OPEN_BITS = 13
PAIRS = pa.schema([("kind", pa.int8()), ("mask", pa.int64()), ("wild", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
PAIRS_DDL = "kind byte, mask long, wild byte, a long, b long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants() -> list[tuple[int, int]]:
    """(mask, wild bit): a half without one bit, for each bit of the two halves."""
    return [(_signed((0xFFFFFFFF << half) & ~(1 << half + i)), half + i) for half in (0, 32) for i in range(32)]


def finer(mask: int, wild: int) -> list[int]:
    """The mask together with each quarter of the open bits, the wild bit aside; at most three of them differ."""
    bits = [i for i in range(64) if i != wild and not mask >> i & 1]
    cuts = [len(bits) * i // 4 for i in range(5)]
    return [_signed((mask | sum(1 << i for i in bits[x:y])) & (1 << 64) - 1) for x, y in zip(cuts, cuts[1:])]


def open_bits(mask: int) -> int:
    return 64 - (mask & (1 << 64) - 1).bit_count()


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned SimHash of the XXH64 (seed 42) of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    parts = [words[i:] for i in range(width)] if len(words) >= width else None
    grams = map(b" ".join, zip(*parts)) if parts else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, 42) for g in grams]), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, row, fp long): the fingerprint of each row's whole text; ``row`` is the text's hash. A null text has no words, so fingerprint zero.

    Words are runs of bytes other than space and 0x09-0x0D; only A-Z are lower-cased. Rows and ids may repeat or be
    null; each row gives one row. An empty table gives none.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["id", "row", "fp"])

    text = F.col(text_col).cast("string")
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text")), run, f"id {kind.simpleString()}, row long, fp long")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join everything within ``distance``, directly or by way of others: one less than each group's size."""
    rest, a, b = fps, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= distance  # of signed numbers it would count the absolute value's
            found = rest[near]
            if len(found):
                a.append(np.full(len(found), x, dtype=np.int64))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _under_one_key(distance: int, crowd: int):
    """Reads rows sorted by (mask, masked value, fp); gives links (kind 0), or rows under finer masks (kind 1)."""

    def out(kind, mask, wild, a, b):
        n = len(a)
        full = lambda v, t: pa.array(np.full(n, v), t)
        return pa.RecordBatch.from_arrays([full(kind, pa.int8()), full(mask, pa.int64()), full(wild, pa.int8()), pa.array(a), pa.array(b)], schema=PAIRS)

    def group(mask, wild, fps, crowded):
        fps = np.unique(fps)
        if not crowded:
            a, b = forest(fps, distance)
            if len(a):
                yield out(0, mask, wild, a, b)
        else:
            for m in finer(mask, wild):
                yield out(1, m, wild, fps, fps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held, crowded = None, [], 0, False
        for batch in batches:
            mask, wild, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            value = fp & mask
            cut = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            last = len(starts) - 1
            # groups of one row say nothing; the first may go on from before, the last may go on after
            for i in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) % max(last, 1) == 0)):
                s, e = starts[i], ends[i]
                here = (int(mask[s]), int(value[s]))
                if here != key:
                    if n_held > 1 or crowded:
                        yield from group(key[0], held_wild, np.concatenate(held), crowded)
                    key, held, n_held, crowded, held_wild = here, [], 0, False, int(wild[s])
                held.append(fp[s:e])
                n_held += e - s
                if n_held > crowd and open_bits(key[0]) > OPEN_BITS:
                    crowded = True
                    yield from group(key[0], held_wild, np.concatenate(held), True)
                    held, n_held = [fp[:0]], 0
        if n_held > 1 or crowded:
            yield from group(key[0], held_wild, np.concatenate(held), crowded)

    return run


def _split_crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, wilds, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for mask, wild in set(zip(masks.tolist(), wilds.tolist())):
            these = fps[(masks == mask) & (wilds == wild)]
            for m in finer(mask, wild):
                n = len(these)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m)), pa.array(np.full(n, wild), pa.int8()), pa.array(these)], names=["mask", "wild", "fp"])


def links(fps: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between different fingerprints that join all those at ``distance`` (3 or fewer) bits or less.

    ``fps`` has a column fp of different values. The links are a spanning forest under each key: whatever is reachable
    over all pairs within the distance is reachable over them.
    """
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(w).cast("byte").alias("wild")) for m, w in variants()])
    rows = fps.select("fp", F.explode(masks).alias("v")).select("v.mask", "v.wild", "fp")
    # A variant's group is that of two values of a half, so it can only be crowded beside a value that many share.
    side = lambda n, m: F.struct(F.lit(n).alias("side"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("half"))
    halves = fps.select(F.explode(F.array(side(0, 0xFFFFFFFF), side(1, 0xFFFFFFFF << 32))).alias("h")).groupBy("h.side", "h.half").count()
    shared = materialize(halves.where(F.col("count") > crowd // 2).select("side", "half"))
    first = None
    if not is_empty(shared):
        keys = shared.select("side", "half", F.explode(masks).alias("v")).where("(v.wild >= 32) = (side = 1)")
        keys = materialize(keys.select("v.mask", F.col("half").bitwiseAND(F.col("v.mask")).alias("value")).distinct())
        marked = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).join(small(keys.withColumn("crowded", F.lit(True)), 1_000_000), ["mask", "value"], "left")
        marked = materialize(marked.select("mask", "wild", "fp", F.coalesce("crowded", F.lit(False)).alias("crowded")))
        rows = marked.where("not crowded").select("mask", "wild", "fp")
        first = map_arrow(marked.where("crowded").select("mask", "wild", "fp"), _split_crowded, "mask long, wild byte, fp long")
    found = None
    while True:
        keyed = rows if first is None else rows.union(first)
        value: Column = F.col("fp").bitwiseAND(F.col("mask"))
        met = keyed.repartition(F.col("mask"), value).sortWithinPartitions(F.col("mask"), value, F.col("fp"))
        met = materialize(map_arrow(met, _under_one_key(distance, crowd), PAIRS_DDL))
        pairs = met.where("kind = 0").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rows, first = met.where("kind = 1").select("mask", "wild", F.col("a").alias("fp")), None
        if is_empty(rows):
            return found.distinct()


def _named_fingerprints(rows: DataFrame, distance: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of each different fingerprint, and (root, at) of each component: the least (none, id, row) of its rows."""
    at = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    distinct = materialize(rows.groupBy("fp").agg(F.min(at).alias("at")))
    roots = connected_components(links(distinct.select("fp"), distance, crowd))
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "at", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    return placed.select("fp", "root"), materialize(placed.groupBy("root").agg(F.min("at").alias("at")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3, crowd: int = CROWD) -> DataFrame:
    """(id, row, fp long, component_id): the smallest id reachable over fingerprints at ``distance`` bits or less.

    Every row gives one row; equal texts and rows with equal ids share a component by their fingerprint. Null texts
    have fingerprint zero, which links like any other. Null ids are never the component's name unless it has no other.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width))
    placed, firsts = _named_fingerprints(rows, distance, crowd)
    by_fp = materialize(placed.join(firsts.select("root", F.col("at.id").alias("component_id")), "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("id", "row", "fp", "component_id")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3, crowd: int = CROWD) -> DataFrame:
    """The rows of docs, all columns kept, of one document for each component: of the smallest id, then the least text hash.

    Components are told apart by their fingerprints, so those whose smallest ids are equal or all null keep a document
    each. A null id is kept only where the component has no other. Of rows with equal id and text one stays.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, width))
    _, firsts = _named_fingerprints(rows, distance, crowd)
    chosen = materialize(firsts.select(F.col("at.id").alias("_kept_id"), F.col("at.row").alias("_kept_row")))
    met = rows.join(chosen, F.col("id").eqNullSafe(F.col("_kept_id")) & (F.col("row") == F.col("_kept_row")), "left_semi")
    again = met.groupBy("id", "row").count().where("count > 1")
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    kept = docs.join(chosen, F.col(id_col).eqNullSafe(F.col("_kept_id")) & (text_hash == F.col("_kept_row")), "left_semi")
    # Whole rows are only dealt out again where an id does stand there more than once with its text.
    return kept if is_empty(again) else kept.withColumn("_kept_row", text_hash).dropDuplicates([id_col, "_kept_row"]).drop("_kept_row")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs, all columns kept, of one document for each component: that of the smallest id.

    Of several rows with that id one stays, of the least text hash. Components of equal names count as one, and so do
    all that hold only null ids; ``one_of_each_component`` keeps a document of each of those.
    """
    found = near_duplicates(docs, id_col, text_col, **more).where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = materialize(found.groupBy(F.col("id").alias("_kept_id")).agg(F.min("row").alias("_kept_row"), F.count("*").alias("_n")))
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_kept_row"))
    rows = docs.join(chosen, same, "left_semi")
    # Whole rows are only dealt out again where an id does stand there more than once.
    return rows if is_empty(chosen.where("_n > 1")) else rows.dropDuplicates([id_col])
