"""Token-ID output in patched frame-of-reference blocks.

A block of ids is stored as its least id and the differences from it, packed at the width that a given share of them
needs. The rest keep their low bits in place and their high bits in an exception list. An index holds where each block
starts, so that any range of ids is read without unpacking the rest.

Layout of one payload, all little-endian: ``n_ids`` and ``n_blocks`` (u4 each); ``n_blocks`` records of INDEX; the
packed words (u8); the exceptions' places in their blocks (u2 each), then their high bits (u4 each).
Payloads are rows of a Parquet folder, so that Spark commits, retries and reads them on whatever store it can reach.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, shared_dir, small

BLOCK = 256
#: Share of a block's differences that must fit the packed width.
SHARE = 0.9
#: A payload ends with the document in which it reaches so many ids.
CHUNK_IDS = 1 << 16
#: Different words that the library encodes in one call, and words of texts put together at a time.
WORDS, STRETCH = 500, 500_000
#: Bytes of texts, a text at least, whose words are told apart at a time.
STRETCH_BYTES = 8 << 20
#: Words that a worker keeps with their ids, and how many characters they may have.
MEMO, MEMO_CHARS = 400_000, 64
#: Writing tasks up to which the number of ids before each is broadcast; beyond that it joins by shuffle.
BROADCAST_ROWS = 1_000_000
INDEX = np.dtype([("start", "<u4"), ("exceptions", "<u4"), ("least", "<u4"), ("width", "u1")])


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) values under 2**width -> (m, BLOCK * width / 64) words; 64 values fill ``width`` words."""
    m = len(rows)
    lanes = np.ascontiguousarray(rows.reshape(-1, 64).T)
    words = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(m, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    m = len(words)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= lanes[word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(m, -1)


def pack(ids: np.ndarray, share: float = SHARE) -> bytes:
    """Any number of unsigned 32-bit ids, none included, as one payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.uint64)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    index = np.zeros(blocks, dtype=INDEX)
    if not n:
        return np.array([0, 0], dtype="<u4").tobytes()
    least = full.min(axis=1)
    diff = full - least[:, None]
    place = min(BLOCK - 1, int(share * BLOCK))
    typical = np.partition(diff, place, axis=1)[:, place]
    width = np.maximum(1, np.frexp(typical.astype(np.float64))[1]).astype(np.int64)
    index["least"], index["width"] = least, width
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 64))])
    index["start"] = starts[:-1]
    packed = np.empty(starts[-1], dtype="<u8")
    low = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        words = _pack(diff[these] & low[these, None], int(w))
        packed[(starts[these][:, None] + np.arange(words.shape[1])).ravel()] = words.ravel()
    rows, places = np.nonzero(diff > low[:, None])
    high = diff[rows, places] >> width[rows].astype(np.uint64)
    index["exceptions"] = np.searchsorted(rows, np.arange(blocks))
    return b"".join([np.array([n, blocks], dtype="<u4").tobytes(), index.tobytes(), packed.tobytes(), places.astype("<u2").tobytes(), high.astype("<u4").tobytes()])


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload as unsigned 32-bit; only the blocks that hold them are unpacked."""
    n, blocks = map(int, np.frombuffer(payload, "<u4", 2))
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, dtype=np.uint32)
    index = np.frombuffer(payload, INDEX, blocks, 8)
    ends = np.append(index["start"][1:].astype(np.int64), int(index["start"][-1]) + int(index["width"][-1]) * (BLOCK // 64))
    words = np.frombuffer(payload, "<u8", int(ends[-1]), 8 + index.nbytes)
    rest = 8 + index.nbytes + words.nbytes
    n_exceptions = (len(payload) - rest) // 6
    places = np.frombuffer(payload, "<u2", n_exceptions, rest)
    high = np.frombuffer(payload, "<u4", n_exceptions, rest + 2 * n_exceptions)
    first, last = start // BLOCK, -(-stop // BLOCK)
    part = index[first:last]
    out = np.empty((last - first, BLOCK), dtype=np.uint64)
    for w in np.unique(part["width"]):
        these = np.flatnonzero(part["width"] == w)
        at = part["start"][these].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))
        out[these] = _unpack(words[at.ravel()].reshape(len(these), -1), int(w))
    bounds = np.append(index["exceptions"].astype(np.int64), n_exceptions)[first : last + 1]
    rows = np.repeat(np.arange(last - first), np.diff(bounds))
    x = slice(bounds[0], bounds[-1])
    out[rows, places[x]] |= high[x].astype(np.uint64) << part["width"][rows].astype(np.uint64)
    out += part["least"].astype(np.uint64)[:, None]
    return out.ravel()[start - first * BLOCK : stop - first * BLOCK].astype(np.uint32)


# The chain of a file whose ids of a text are those of its words, cut at ASCII white space. The normalizer
# only turns white space into spaces, composes and lower-cases within words, and no piece of the pre-tokenizer holds white space.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file has the chain above, and no added token with white space in it or beside it."""
    first = {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}
    then = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    chain = (spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers")
    added = spec.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in added)
    return chain == (WORD_NORMALIZERS, [first, then]) and plain and not (spec.get("truncation") or spec.get("padding"))


def _gather(ids: np.ndarray, first: np.ndarray, counts: np.ndarray, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some words, one word after the other, and where each word's ids end."""
    sizes = counts[these]
    ends = np.cumsum(sizes)
    at = np.repeat(first[these] - (ends - sizes), sizes)
    at += np.arange(len(at))
    return ids[at], ends


class Encoder:
    """Ids of whole texts by the library's own chain.

    Where the file's chain cuts at ASCII white space, each different word of a stretch of texts is encoded once, many in
    one call, and the texts' ids are put together from their words'; words of earlier stretches are kept with their ids,
    in flat arrays, since an object for each would take ten times the memory. With any other file every text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_at_spaces(json.load(f))
        # The words kept, those lately used first, their ids one after the other, and how many each has.
        self.kept, self.ids, self.counts = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int32)

    def _new(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the words by the library and how many each has, many words in one call."""
        for x in range(0, len(words), WORDS):
            part = words.slice(x, WORDS).to_pylist()
            ends = np.cumsum([len(w) + 1 for w in part])
            found = self.whole.encode(" ".join(part), add_special_tokens=False)
            of = np.searchsorted(ends, np.array([s for s, _ in found.offsets], dtype=np.int64), side="right")
            yield np.array(found.ids, dtype="<u4"), np.bincount(of, minlength=len(part)).astype(np.int32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each word start and how many they are; what is kept follows the words' use."""
        known = pc.index_in(words, value_set=self.kept)
        missing = known.is_null()
        new = words.filter(missing)
        found = list(self._new(new))
        ids = np.concatenate([self.ids, *(i for i, _ in found)])
        counts = np.concatenate([self.counts, *(n for _, n in found)])
        first = np.cumsum(counts, dtype=np.int64) - counts
        n_kept, missing = len(self.kept), missing.to_numpy(zero_copy_only=False)
        at = known.fill_null(0).to_numpy().astype(np.int64)
        at[missing] = n_kept + np.arange(len(new))
        if len(new):
            older = np.ones(n_kept, dtype=bool)
            older[at[~missing]] = False
            short = pc.less_equal(pc.utf8_length(words), MEMO_CHARS).to_numpy(zero_copy_only=False)
            keep = np.concatenate([at[short], np.flatnonzero(older)])[:MEMO]
            self.kept = pa.concat_arrays([self.kept, new]).take(pa.array(keep))
            self.ids, self.counts = _gather(ids, first, counts, keep)[0], counts[keep]
        return ids, first[at], counts[at]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) for stretches of the texts in order; each text's ids end with ``end_id``."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            for t in texts:
                ids = self.whole.encode(t.as_py(), add_special_tokens=False).ids
                yield np.array([*ids, end_id], dtype="<u4"), np.array([len(ids) + 1])
            return
        ends, start = np.cumsum([0, *pc.binary_length(texts).to_pylist()]), 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + STRETCH_BYTES, side="right")) - 1)
            yield from self._stretch(texts.slice(start, stop - start), end_id)
            start = stop

    def _stretch(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ids, first, counts = self._words(coded.dictionary)
        # The end counts as one more word.
        ids, first, counts = np.append(ids, np.uint32(end_id)), np.append(first, len(ids)), np.append(counts, np.int32(1))
        used, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STRETCH, side="right")) - 1)
            cuts = bounds[row : stop + 1] - bounds[row]
            words = np.insert(used[bounds[row] : bounds[stop]], cuts[1:], len(counts) - 1)
            found, ends = _gather(ids, first, counts, words)
            of_texts = ends[cuts[1:] + np.arange(stop - row)]
            yield found, np.diff(of_texts, prepend=0)
            row = stop


def give_back() -> None:
    """Memory that this worker has freed goes back to the system; an idle worker lives on for a while beside later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts in ascending id order, each followed by ``end_id``, into the Parquet folder ``path``.

    A row holds a payload, the ids and lengths of its documents, its shard and where in the shard it starts. Null texts
    are empty: they give the end id alone. Null ids come first; rows with equal ids come in the order of their texts.
    """
    kind = docs.schema[id_col].dataType

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        start, chunk, ids, lengths, parts, held, id_type = 0, 0, [], [], [], 0, None

        def flush():
            columns = [pa.array([shard]), pa.array([chunk]), pa.array([start]), pa.array([held]), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(np.concatenate(parts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "start", "n_ids", "ids", "lengths", "payload"])

        for batch in batches:
            id_type, keys, row = batch.column(0).type, batch.column(0).to_pylist(), 0
            for stream, sizes in enc.encode(batch.column(1), end_id):
                ends, done = np.cumsum(sizes), 0
                while done < len(sizes):
                    # Up to and with the document in which the payload is full.
                    taken = int(ends[done - 1]) if done else 0
                    stop = min(len(sizes), int(np.searchsorted(ends, taken + CHUNK_IDS - held)) + 1)
                    ids += keys[row + done : row + stop]
                    lengths += sizes[done:stop].tolist()
                    parts.append(stream[taken : ends[stop - 1]])
                    held, done = held + int(ends[stop - 1]) - taken, stop
                    if held >= CHUNK_IDS:
                        yield flush()
                        start, chunk, ids, lengths, parts, held = start + held, chunk + 1, [], [], [], 0
                row += len(sizes)
        if ids:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(batches)
        give_back()

    schema = f"shard long, chunk long, start long, n_ids long, ids array<{kind.simpleString()}>, lengths array<long>, payload binary"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    map_arrow(ordered, run, schema).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids binary) of each document of a folder: its ids, and how many ids stand before them."""
    stored = spark.read.parquet(path)
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, starts, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)
            for i in range(batch.num_rows):
                lengths = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                stream = unpack(payloads[i].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                own = [stream[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), shards[i])), batch.column(2)[i].values, pa.array(starts[i] + ends - lengths), pa.array(lengths), pa.array(own, pa.binary())],
                    names=["shard", "id", "local", "n_tokens", "ids"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from unpacked(batches)
        give_back()

    docs = map_arrow(stored.select("shard", "start", "ids", "lengths", "payload"), run, f"shard long, id {kind}, local long, n_tokens long, ids binary")
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row for each shard, that is, for each task that wrote.
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(small(before, BROADCAST_ROWS), "shard").select("id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32): written to the shared folder, then read back from the files."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(spark, path).select("id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

