"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the full windows of ``limit`` and then the binary digits of
the rest. Every piece is a sequence of its own, so that no sequence crosses documents and none needs padding; training
draws batches from the buckets of equal lengths.

Tokens come from a public tokenizer whose words never cross white space. A text's ids are thus the ids of its chunks
between ASCII white space, in order, and each worker encodes a chunk once and keeps its ids as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.langid import byte_letters

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int"
#: Chunks that a worker remembers before it starts anew, and the longest chunk that it remembers.
REMEMBERED, LONGEST = 800_000, 64
#: A word of ASCII or Latin-1 letters and a run of ASCII signs without the apostrophe, which starts contractions.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Bytes of ids in one batch to the JVM.
BATCH_BYTES = 4 << 20


def decompose(n: int, limit: int) -> list[int]:
    """The lengths of the pieces of n tokens, longest first."""
    full, rest = divmod(n, limit)
    return [limit] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class ChunkIds(dict):
    """Chunk to its ids as little-endian unsigned 32-bit bytes; filled on demand, of bounded size.

    A chunk of Latin letters, with or without a run of ASCII signs behind, is by the tokenizer's own rules one word and
    one run of signs; their lower-cased byte letters go to its BPE model directly. Any other chunk is encoded in full.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        if (found := self.parts.get(text)) is None:
            spelled = text if text.isascii() else "".join([self.letter[b] for b in text.encode()])
            found = self.parts[text] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])
        return found

    def encode(self, chunk: str) -> bytes:
        if len(chunk) <= LONGEST and (m := PLAIN(chunk)):
            word, signs = m.groups()
            return self.part(word.lower()) + (self.part(signs) if signs else b"")
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit integers; ``bucket`` is the base-2 logarithm of
    its length. ``limit`` must be a power of two. A null or empty text is the end id alone. Repeated rows are packed
    each; other columns are not read. An empty table gives no row. No shuffle; memory is bounded by one text.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())])
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds(tokenizer_path)
        chunks = re.compile(r"[^ \t-\r]+").findall
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(known.__getitem__, chunks(text.as_py() or ""))) + end
                known.trim()
                total, start = len(ids) // 4, 0
                for length in decompose(total, limit):
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total, length.bit_length() - 1))
                    start += length
                    held += 4 * length
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences below ``path``, one folder per bucket of equal lengths."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
