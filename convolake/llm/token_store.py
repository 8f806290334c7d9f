"""Token-id store: documents' ids as small zstandard frames that share one trained dictionary.

A store is a folder of two Parquet tables, so that it can lie in any store Spark writes to and a
lost executor's task is simply run again:

* ``dictionary``: one row, the dictionary and its SHA-256.
* ``blocks``: rows of up to BLOCK documents in ascending id order: shard, block, ids of the
  documents, offset index of their frames in the payload, token counts, ids before the block in its
  shard, hash of the dictionary, and the payload (one frame a document, little-endian uint32 ids).

Defined results: null texts are empty and hold the end id alone; null document ids come first;
repeated ids keep their rows, in the order of their texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as V
from .common import slices

#: Documents of one block, and bytes of payload after which a block ends.
BLOCK, BLOCK_BYTES = 512, 1 << 20
#: The dictionary is trained on at most this many documents of at most this many characters.
TRAIN_DOCS, TRAIN_CHARS, DICT_BYTES = 1000, 20_000, 32 << 10
#: Bytes of texts that are cut into words together (a longer text is taken alone), and words of one string for the library.
RUN_BYTES, LINES = 8 << 20, 64

_BLOCKS = "shard int, block int, doc_ids array<long>, offsets array<long>, n_tokens array<long>, shard_start array<long>, dict_hash string, payload binary"


class LibraryEncoder:
    """Ids as the tokenizers library gives them; each pre-token goes to the library once and is remembered.

    Texts of ASCII and Latin letters are cut into pre-tokens as arrays of bytes, and of the pre-tokens of a run
    of texts only the different ones become Python strings; other texts, and those with special strings, are
    split one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = V.load(path).special
        self.split, self.known = V.splitter(self.special), V.Memory()
        self.quick = min(self.special, key=len).encode()[:2] if self.special else None
        self.line = self.library.encode("\n", add_special_tokens=False).ids

    def encode(self, texts):
        """The ids of each text (a list, or an Arrow array of strings) as little-endian uint32 bytes, run by run of texts."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(column):
            return
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1)
            yield from self._run(column.buffers()[2], offsets[at : end + 1])
            at = end

    def _run(self, buffer, offsets: np.ndarray):
        size = int(offsets[-1] - offsets[0])
        if not size:
            yield from [b""] * (len(offsets) - 1)
            return
        data, texts = np.frombuffer(buffer, np.uint8, size, int(offsets[0])), offsets - offsets[0]
        odd = np.diff(np.searchsorted(V.not_latin(data), texts))
        if self.quick:
            odd += np.diff(np.searchsorted(_found(data, self.quick), texts))
        odd = np.flatnonzero(odd).tolist()
        apart = {i: self.split(data[texts[i] : texts[i + 1]].tobytes().decode()) for i in odd}
        if odd:
            sizes = np.diff(texts)
            keep = np.ones(len(sizes), dtype=bool)
            keep[odd] = False
            data, sizes = data[np.repeat(keep, sizes)], np.where(keep, sizes, 0)
            texts = np.append(0, np.cumsum(sizes))
        starts = V.word_starts(data, texts)
        cuts = np.append(starts, len(data)).astype(np.int32)
        met = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        known, words = self.known, met.dictionary.to_numpy(zero_copy_only=False).tolist()
        known.make_room(words)
        self._learn([w for w in (dict.fromkeys(chain(words, *apart.values())) if apart else words) if w not in known])
        parts = list(map(known.__getitem__, words))
        flat = np.frombuffer(b"".join(parts), "<u4")
        # the ids of a word lie in flat from begin on; those of all words in their order are gathered at once
        lengths = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        begin = np.cumsum(lengths, dtype=np.int32) - lengths
        codes = met.indices.to_numpy()
        each = lengths[codes]
        done = np.append(0, np.cumsum(each, dtype=np.int64))
        at = np.repeat((begin[codes] - done[:-1]).astype(np.int32), each)
        at += np.arange(len(at), dtype=np.int32)
        ids, ends = flat[at], done[np.searchsorted(starts, texts)].tolist()
        for i, (s, e) in enumerate(zip(ends, ends[1:])):
            yield b"".join(map(known.__getitem__, apart[i])) if i in apart else ids[s:e].tobytes()

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of words; a call of the library has many, one a line, since a call has a price of its own."""
        alone, lines = [], []
        for w in new:
            (alone if len(self.line) != 1 or w in self.special or w[-1].isspace() else lines).append(w)
        runs = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        for run, e in zip(runs, self.library.encode_batch_fast(["\n".join(r) for r in runs], add_special_tokens=False)):
            # no word but white space holds a line's end, so its id parts the words
            ids = np.array(e.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids)).tolist()
            if len(ends) != len(run):
                alone += run
                continue
            raw = ids.tobytes()
            self.known.keep((w, raw[4 * s : 4 * e]) for w, s, e in zip(run, [0, *[e + 1 for e in ends]], ends))
        self.known.keep((w, _bytes(e.ids)) for w, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False)))


def _found(data: np.ndarray, pair: bytes) -> np.ndarray:
    """Where the first two bytes of a special string lie (or its only one)."""
    hit = data[: len(data) - len(pair) + 1] == pair[0]
    return np.flatnonzero(hit & (data[1:] == pair[1]) if len(pair) > 1 else hit)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def train(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary of the ids of a bounded sample (TRAIN_DOCS, TRAIN_CHARS); empty if there is too little.

    Ids are picked first, by a hash; texts are read for these alone.
    """
    usable = docs.where(F.length("text").between(1, TRAIN_CHARS))
    picked = usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    # repeated ids give one text; the picked ids are few by TRAIN_DOCS, so they may be broadcast
    sample = usable.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id")
    encoder = _encoder(path)
    arrays = list(encoder.encode([r.text for r in sample.select("text").collect()]))
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> None:
    """Write the ids of docs, each with end_id appended, in ascending id order."""
    spark = docs.sparkSession
    path = path or V.default_path()
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = train(frame, path)
    digest = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(digest, bytearray(words))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = _encoder(path)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, starts, frames, size = [], [], [], [], 0

        def block():
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype(np.int64)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), one(ids, pa.int64()), one(offsets, pa.int64()), one(counts, pa.int64()), one(starts, pa.int64()), pa.array([digest]), pa.array([b"".join(frames)], pa.binary())],
                names=["shard", "block", "doc_ids", "offsets", "n_tokens", "shard_start", "dict_hash", "payload"],
            )

        for b in batches:
            for doc, ids_ in zip(b.column("id").to_pylist(), encoder.encode(b.column("text"))):
                raw = ids_ + end
                frames.append(squeeze.compress(raw))
                ids.append(doc)
                counts.append(len(raw) // 4)
                starts.append(start)
                start += counts[-1]
                size += len(frames[-1])
                if len(ids) >= BLOCK or size >= BLOCK_BYTES:
                    yield block()
                    number += 1
                    ids, counts, starts, frames, size = [], [], [], [], 0
        if ids:
            yield block()

    dealt.mapInArrow(run, _BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    digest, words = spark.read.parquet(f"{folder}/dictionary").first()
    words = bytes(words)
    if hashlib.sha256(words).hexdigest() != digest:
        raise ValueError("the dictionary doesn't have the hash it is stored under")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    # one row a shard: as many as there were partitions when the store was written
    sums = blocks.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, total = {}, 0
    for shard, n in sorted(sums.collect()):
        before[shard], total = total, total + n

    def run(batches):
        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for b in slices(batches, 8):
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                data, at = r["payload"], r["offsets"]
                raws = [open_.decompress(data[i:j]) for i, j in zip(at, at[1:])]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array([before[r["shard"]] + x for x in r["shard_start"]], pa.int64()), pa.array([len(x) // 4 for x in raws], pa.int64()), pa.array([zlib.crc32(x) for x in raws], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols, names = cols + [pa.array([np.frombuffer(x, "<u4") for x in raws], pa.list_(pa.int64()))], names + ["ids"]
                yield pa.record_batch(cols, names=names)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)
