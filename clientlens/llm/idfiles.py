"""Token ids of documents in compressed binary segments, in ascending order of doc_id.

A segment holds whole documents: a header, an index of its documents, an
alphabet, the model of its ids, a table of blocks and the blocks' payloads by the
context-mixing coder (``mixing``). Blocks have BLOCK_IDS ids wherever documents
end, start from the segment's model, learn from their own ids and carry the crc32
of these; the index carries one of its own.

Layout, little-endian:

    8 bytes  magic
    24 bytes header: documents (u32), blocks (u32), different ids (u32), bytes of the index (u32), ids (u64)
    index    deflated: doc_ids as differences (i64), null flags (u8), ids of each document (u64),
             alphabet as differences (u32), block bytes (u32), block crc32 (u32), model (the rest)
    4 bytes  crc32 of header and index
    payloads one after the other

Documents are brought into order by a range shuffle on (doc_id, hash of the
text, row), so that neither a hot id nor equal rows fill one partition; each
partition writes its segments as rows of one Parquet file in the shared folder
(columns shard, number, first, n_ids, data), which Spark commits as a whole,
whatever executors are lost. ``first`` counts ids within the shard; the ids of
all shards before come from one total per shard.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm import mixing
from clientlens.llm.common import map_batches
from clientlens.llm.packing import WordTokens
from clientlens.session import scratch_path

MAGIC = b"MIXIDS03"
_HEADER = "<IIIIQ"
END_ID = 0
# A segment is closed at the end of the document that brings it to so many ids.
SEGMENT_IDS = mixing.LANES * mixing.BLOCK_IDS
# Texts that are encoded at a time.
GATHERED_BYTES = 16 << 20
_SEGMENTS = "shard int, number int, first long, n_ids long, data binary"


class BrokenSegment(ValueError):
    """A segment that does not agree with its checksums."""


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One segment; ``ids`` are those of all documents one after the other."""
    alphabet, model, numbers = mixing.alphabet_of(ids)
    starts = range(0, len(ids), mixing.BLOCK_IDS)
    payloads = mixing.encode_blocks([numbers[s:s + mixing.BLOCK_IDS] for s in starts], model)
    checks = [zlib.crc32(ids[s:s + mixing.BLOCK_IDS].astype("<u4").tobytes()) for s in starts]
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    index = zlib.compress(b"".join((
        np.diff(known, prepend=known.dtype.type(0)).astype("<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(lengths, "<u8").tobytes(),
        np.diff(alphabet, prepend=np.uint32(0)).astype("<u4").tobytes(),
        np.array([len(p) for p in payloads], "<u4").tobytes(), np.array(checks, "<u4").tobytes(), model.pack())))
    head = struct.pack(_HEADER, len(doc_ids), len(payloads), len(alphabet), len(index), len(ids)) + index
    return b"".join((MAGIC, head, struct.pack("<I", zlib.crc32(head)), *payloads))


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a segment; raises BrokenSegment if a checksum differs."""
    if data[:len(MAGIC)] != MAGIC:
        raise BrokenSegment("not a segment of ids")
    at = len(MAGIC)
    n_docs, n_blocks, n_alphabet, n_index, n_ids = struct.unpack_from(_HEADER, data, at)
    end = at + struct.calcsize(_HEADER) + n_index
    if len(data) < end + 4 or zlib.crc32(data[at:end]) != struct.unpack_from("<I", data, end)[0]:
        raise BrokenSegment("the index is damaged")
    index, place = zlib.decompress(data[at + struct.calcsize(_HEADER):end]), 0

    def column(kind: str, n: int) -> np.ndarray:
        nonlocal place
        found = np.frombuffer(index, kind, n, place)
        place += found.nbytes
        return found

    known, nulls, lengths = np.cumsum(column("<i8", n_docs)), column("u1", n_docs), column("<u8", n_docs).astype(np.int64)
    alphabet = np.cumsum(column("<u4", n_alphabet), dtype=np.uint32)
    sizes, checks = column("<u4", n_blocks), column("<u4", n_blocks)
    model = mixing.Model.unpack(index[place:])
    ends = end + 4 + np.cumsum(sizes, dtype=np.int64)
    if len(data) != (int(ends[-1]) if n_blocks else end + 4):
        raise BrokenSegment("the segment has not its length")
    payloads = [data[e - int(s):e] for e, s in zip(ends.tolist(), sizes, strict=True)]
    block_lengths = [min(mixing.BLOCK_IDS, n_ids - s) for s in range(0, n_ids, mixing.BLOCK_IDS)]
    blocks = [alphabet[b] for b in mixing.decode_blocks(payloads, block_lengths, model)]
    for number, (block, check) in enumerate(zip(blocks, checks.tolist(), strict=True)):
        if zlib.crc32(block.astype("<u4").tobytes()) != check:
            raise BrokenSegment(f"block {number} is damaged")
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    return [None if null else d for d, null in zip(known.tolist(), nulls.tolist(), strict=True)], lengths, ids


@functools.cache
def _words(tokenizer: str) -> WordTokens:
    """The encoder of a file, made once in a worker: it keeps nothing of the texts."""
    return WordTokens(tokenizer)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """Ids and texts of batches, GATHERED_BYTES or more of texts at a time: words that occur again are encoded once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(1).nbytes for b in held) >= GATHERED_BYTES:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[list[int | None], pa.Array]:
    keys, texts = (pa.concat_arrays([b.column(k) for b in batches]) for k in (0, 1))
    return keys.to_pylist(), texts


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode every whole text, with the end id after each, and write the segments; returns their folder.

    A null or empty text is the end id alone. A null doc_id stays null and comes
    first. Repeated rows are written as often as they occur. An empty table
    writes an empty folder of segments. Columns other than doc_id and text are
    not read. Memory holds the ids of one segment, SEGMENT_IDS and one document,
    and those of GATHERED_BYTES of texts and one batch of rows.
    """
    path = path or scratch_path(docs.sparkSession, "token-ids")

    def run(batches) -> Iterable:
        words, shard = _words(tokenizer), TaskContext.get().partitionId()
        number, first, waiting = 0, 0, 0
        held: list[np.ndarray] = []
        lengths: list[int] = []
        keys: list[int | None] = []

        def closed() -> list[list]:
            nonlocal number, first, waiting
            row = [[shard], [number], [first], [waiting], [write_segment(keys, lengths, np.concatenate(held))]]
            number, first, waiting = number + 1, first + waiting, 0
            for x in (held, lengths, keys):
                x.clear()
            return row

        for docs_here, texts in _gathered(batches):
            ids, n_ids = words.encode_column(texts)
            ids = np.insert(ids, np.cumsum(n_ids), end_id)
            ends = np.cumsum(n_ids + 1)
            done = done_ids = 0
            while done < len(docs_here):
                # Up to the document that closes the segment, or all there are.
                upto = min(int(np.searchsorted(ends, done_ids + SEGMENT_IDS - waiting)) + 1, len(docs_here))
                end = int(ends[upto - 1])
                held.append(ids[done_ids:end])
                lengths += (n_ids[done:upto] + 1).tolist()
                keys += docs_here[done:upto]
                waiting += end - done_ids
                done, done_ids = upto, end
                if waiting >= SEGMENT_IDS:
                    yield closed()
        if keys:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    map_batches(ordered, run, _SEGMENTS).write.parquet(path)
    return path


def read_ids(spark: SparkSession, path: str, ids: str = "array") -> DataFrame:
    """One row per document of the segments: doc_id, start (ids of all documents before it), n_tokens,
    and its ids as an array (``ids="array"``) or their crc32 (``ids="crc32"``, column ids_crc32)."""
    checksum = ids == "crc32"
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    # One row per shard: as many as the range shuffle has partitions, whatever the number of documents.
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))

    def run(batches) -> Iterator:
        for batch in batches:
            for number in range(batch.num_rows):
                start = batch.column(0)[number].as_py()
                doc_ids, lengths, found = read_segment(batch.column(1)[number].as_py())
                ends = np.cumsum(lengths)
                starts_here = ends - lengths
                if checksum:
                    data = memoryview(found.astype("<u4").tobytes())
                    last = [zlib.crc32(data[4 * s:4 * e]) for s, e in zip(starts_here.tolist(), ends.tolist())]
                else:
                    last = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), found.astype(np.int32)) \
                        .cast(pa.list_(pa.int32()))
                yield [pa.array(doc_ids, pa.int64()), pa.array(starts_here + start), pa.array(lengths), last]

    placed = segments.join(F.broadcast(starts), "shard").select(F.col("first") + F.col("_before"), "data")
    return map_batches(placed, run, "doc_id long, start long, n_tokens long, "
                       + ("ids_crc32 long" if checksum else "ids array<int>"))
