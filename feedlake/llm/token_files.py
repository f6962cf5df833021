"""Token ids in fixed-width bit-packed files.

Format: a folder with two Parquet tables.  ``blocks`` holds one row per block of at most
``block_ids`` ids: ``shard`` (files in ascending document order), ``block`` (ascending in a
shard), ``start`` (first id's place in the shard), ``n_ids``, ``width`` (bits per id), the bit
packed ``payload`` (least significant bit first) and the documents' parts in it
(``doc_ids``, ``parts``, ``counts``: which part of the document, how many ids).  A block ends
with a document unless that document alone is longer than a block.  ``shards`` holds the place
of each shard's first id in the whole corpus.  A block can be unpacked on its own, and because
the width is fixed, id ``i`` of a block is found at bit ``i * width``.

The width is the least number of bits that hold the vocabulary.  Null texts count as empty and
give the end id only.  Documents with equal ids are written one after the other, in the order
of their texts; null ids come first.  An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, text_slices, worker_state
from feedlake.llm.chunks import ChunkEncoder
from feedlake.llm.vocab import library_encoder, load_tokenizer

BLOCK_IDS = 1 << 16
PLAIN_WIDTHS = {8: "u1", 16: "<u2", 32: "<u4"}
BLOCKS = "shard int, block int, start long, n_ids int, width int, payload binary, first_doc long, last_doc long, doc_ids array<long>, parts array<int>, counts array<int>"


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each (at most 57).  Widths of whole machine words are plain little-endian
    arrays.  Otherwise each id is shifted to its place in a 64-bit word, and the ids that begin in a word
    are added up, as are their ends in the next one: their bits do not meet."""
    if width in PLAIN_WIDTHS:
        return ids.astype(PLAIN_WIDTHS[width]).tobytes()
    if not len(ids):
        return b""
    bit = np.arange(len(ids), dtype=np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    value = ids.astype(np.uint64)
    begin = np.flatnonzero(np.diff(word, prepend=-1))  # an id begins in every word but perhaps the last
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[: len(begin)] = np.add.reduceat(value << shift, begin)
    over = np.flatnonzero(shift + np.uint64(width) > 64)  # at most one id of a word
    out[word[over] + 1] += value[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()[: len(ids) * width + 7 >> 3]


def unpack(payload: bytes, width: int, start: int, n: int) -> np.ndarray:
    """Ids ``start .. start + n - 1`` of a block, without touching the rest (width <= 57)."""
    if width in PLAIN_WIDTHS:
        return np.frombuffer(payload, PLAIN_WIDTHS[width], n, start * width // 8).astype(np.uint32)
    bit = np.arange(start, start + n, dtype=np.int64) * width
    low = int(bit[0]) >> 3 if n else 0
    raw = np.frombuffer(payload[low : (int(bit[-1]) + width + 7 >> 3) if n else 0] + b"\0" * 8, np.uint8)
    at = (bit >> 3) - low
    word = np.zeros(n, np.uint64)
    for k in range((width + 7 + 7) // 8):
        word |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row, from the CRC-32 of each."""
    zeros = bytes(second_bytes)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def encoder(tokenizer: str, end_of_word: bool = False) -> ChunkEncoder:
    return worker_state(f"encoder {tokenizer}", lambda: ChunkEncoder(library_encoder(tokenizer, end_of_word), keep_space=not end_of_word))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id`` and write the files in ascending document order.

    The texts, not their ids, are range-partitioned on the document id; each task then writes
    one shard.  Only the number of ids of each shard reaches the driver.
    """
    spark = docs.sparkSession
    width = max(1, (max(load_tokenizer(tokenizer).get_vocab_size() - 1, end_id)).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, size
            ids = np.concatenate([h[2] for h in held])
            names = [h[0] for h in held]
            known = [d for d in names if d is not None]
            row = {"shard": shard, "block": block, "start": start, "n_ids": len(ids), "width": width, "payload": pack(ids, width), "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_ids": names, "parts": [h[1] for h in held], "counts": [len(h[2]) for h in held]}
            block, start, held, size = block + 1, start + len(ids), [], 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in text_slices(batches):
            flat, n = encoder(tokenizer).encode(column(batch, "text"))
            ends = np.cumsum(n)
            flat = np.insert(flat, ends, np.uint32(end_id))
            ends += np.arange(1, len(ends) + 1)
            at = 0
            for doc, end in zip(column(batch, "doc_id").to_pylist(), ends.tolist(), strict=True):
                ids = flat[at:end]
                at = end
                if held and size + len(ids) > block_ids:
                    yield flush()
                for part, a in enumerate(range(0, len(ids), block_ids)):
                    some = ids[a : a + block_ids]
                    held.append((doc, part, some))
                    size += len(some)
                    if size == block_ids:
                        yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    rows, at = [], 0
    for r in sorted(sizes.collect()):  # a row per shard, as many as the write had tasks
        rows.append((r["shard"], at))
        at += r["n_ids"]
    spark.createDataFrame(rows, "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")


BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def read_parts(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True, only: Column | None = None) -> DataFrame:
    """One row per document and block: ``doc_id, part, start, n, crc32`` and, if asked for,
    ``ids array<int>``.  ``doc_ids`` reads only the blocks that may hold those documents,
    ``only`` those that a condition on the block's columns chooses."""
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks if only is None else blocks.filter(only)
    wanted = None
    if doc_ids is not None:
        wanted = set(doc_ids)
        may = F.lit(False)
        for d in wanted:
            may = may | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
        blocks = blocks.filter(may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: column(batch, name)[row].as_py()  # noqa: B023, E731
                payload, width, shard, base = get("payload"), get("width"), get("shard"), get("start")
                counts = np.array(get("counts"), np.int64)
                begins = np.cumsum(counts) - counts
                names, parts = get("doc_ids"), get("parts")
                keep = [i for i, d in enumerate(names) if wanted is None or d in wanted]
                if wanted is None:
                    whole = unpack(payload, width, 0, int(counts.sum())).astype("<u4", copy=False)
                    lists = np.split(whole, begins[1:])
                else:
                    lists = [unpack(payload, width, int(begins[i]), int(counts[i])).astype("<u4", copy=False) for i in keep]
                cols = [
                    pa.array([names[i] for i in keep], pa.int64()),
                    pa.array([shard] * len(keep), pa.int32()),
                    pa.array([parts[i] for i in keep], pa.int32()),
                    pa.array(base + begins[keep], pa.int64()),
                    pa.array(counts[keep], pa.int64()),
                    pa.array([zlib.crc32(x) for x in lists], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "shard", "part", "local", "n", "crc32", "ids"][: len(cols)])

    schema = "doc_id long, shard int, part int, local long, n long, crc32 long" + (", ids array<int>" if with_ids else "")
    bases = F.broadcast(spark.read.parquet(f"{path}/shards"))  # a row per shard
    parts = blocks.select("shard", "start", "width", "payload", "doc_ids", "parts", "counts").mapInArrow(run, schema)
    rest = [c for c in ("n", "crc32", "ids") if with_ids or c != "ids"]
    return parts.join(bases, "shard").select("doc_id", "part", "shard", (F.col("local") + F.col("base")).alias("start"), *rest)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    Blocks that hold whole documents only are read on their own.  A document in parts has a
    block to itself at first; parts meet by document, and their checksums join without ids.
    """
    long_block = F.exists("parts", lambda p: p > 0) | (F.size("counts") == 1)
    single = read_parts(spark, path, with_ids=False, only=~long_block).select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, starts, totals, crcs = [], [], [], []
            for doc, some in zip(column(batch, "doc_id").to_pylist(), column(batch, "some").to_pylist(), strict=True):
                open_ = None
                for p in [*some, {"part": 0}]:  # parts lie in the order of their starts
                    if p["part"] == 0:
                        if open_:
                            names.append(doc)
                            starts.append(open_[0])
                            totals.append(open_[1])
                            crcs.append(open_[2])
                        open_ = (p["start"], p["n"], p["crc32"]) if "n" in p else None
                    else:
                        open_ = (open_[0], open_[1] + p["n"], crc_join(open_[2], p["crc32"], 4 * p["n"]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    long_parts = read_parts(spark, path, with_ids=False, only=long_block)
    grouped = long_parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "part", "n", "crc32"))).alias("some"))
    return single.unionByName(grouped.mapInArrow(join_parts, "doc_id long, start long, n_tokens long, ids_crc32 long"))
