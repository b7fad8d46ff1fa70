"""Packing by power-of-two decomposition: no sequence holds parts of two documents, and none is padded.

A document's ids (with the end id) are cut into pieces whose lengths are the binary digits of its length, the largest
allowed length as often as it fits, in descending order. Each piece is a sequence; sequences of a length share a bucket.
A task gathers each bucket's pieces and writes them in runs of one length, with consecutive sequence ids, so a batch drawn
from a run needs no padding. One pass, no shuffle: a piece depends on its document alone, and a task holds at most
RUN_TOKENS ids of each length.

Edge cases: null or empty text is the end id alone, one piece of length 1; a null doc_id stays null; repeated rows are
packed each, with sequence ids of their own; extra columns are ignored, whatever their names; a text of any length is
encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import partial

from arterial.llm.common import bound_batches
from arterial.llm.tokens import ChunkEncoder, encoder, tokenizer_path

SEQUENCE_TOKENS = 2048
END_ID = 1
#: ids of one length that a task gathers before it writes them as a run.
RUN_TOKENS = 1 << 17
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(n: int, most: int) -> list[int]:
    """Powers of two that add up to n, none above `most` (a power of two), in descending order."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(batches, tokenizer: str, end_id: int, most: int, with_ids: bool):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    codec = encoder(ChunkEncoder, tokenizer)
    end = end_id.to_bytes(4, "little")
    number = TaskContext.get().partitionId() << 40
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    waiting: dict[int, list[tuple]] = {}  # by length: (doc_id, start, checksum, tokens of the document, ids)

    def run(length: int):
        nonlocal number
        keys, starts, crcs, totals, ids = zip(*waiting.pop(length), strict=True)
        n = len(keys)
        same = lambda x, kind=np.int64: pa.array(np.full(n, x, kind))
        arrays = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), same(length), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()),
                  pa.array(np.arange(number, number + n)), same(0), same(length.bit_length() - 1, np.int32)]
        number += n
        return pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        for first in range(0, len(keys), 256):
            part = [t or "" for t in texts[first : first + 256].to_pylist()]
            for key, ids in zip(keys[first : first + 256], codec.encode(part), strict=True):
                ids += end
                total, at = len(ids) // 4, 0
                for length in binary_lengths(total, most):
                    piece = ids[4 * at : 4 * (at + length)]
                    held = waiting.setdefault(length, [])
                    held.append((key, at, zlib.crc32(piece), total, piece if with_ids else None))
                    if len(held) * length >= RUN_TOKENS:
                        yield run(length)
                    at += length
    for length in sorted(waiting):
        yield run(length)


def pack(docs, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
         most: int = SEQUENCE_TOKENS, with_ids: bool = True):
    """One row per piece; with_ids adds the ids themselves (little-endian unsigned 32-bit)."""
    bound_batches(docs.sparkSession)
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    from pyspark.sql import functions as F

    two = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    run = partial(_pieces, tokenizer=tokenizer or tokenizer_path("byte_bpe_50k.json"), end_id=end_id, most=most, with_ids=with_ids)
    return two.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
