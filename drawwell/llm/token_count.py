"""Token counts of whole documents.

Long documents are encoded in overlapping chunks. Two neighbours are spliced at a byte offset in their overlap where
both have a token boundary and the boundary is proven stable: a space symbol follows a non-space, and no piece of the
vocabulary holds a space symbol after another symbol, so no merge can ever cross it. If an overlap has no such offset
the left chunk grows, twice as far each time, until one is found or the text ends.

Defined cases: null and empty texts have no tokens; texts without any space (or otherwise without a stable boundary)
end up as one chunk; a text whose tokens do not stand for its bytes one by one is encoded as a whole; repeated rows are
counted one by one; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawwell.llm.common import table

CHUNK_BYTES = 16384
OVERLAP_BYTES = 256
#: Chunks that are encoded in one call, and how far a chunk is widened at first.
BATCH_CHUNKS = 64
WIDEN_BYTES = 1024
TOKEN_LIMIT = 4096
SPACE = "▁"


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives, without added tokens."""

    def __init__(self, model_file: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        ids = range(self.sp.get_piece_size())
        pieces = ["x" if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace(SPACE, " ") for i in ids]
        #: Bytes of text that each token stands for, the space symbol as one byte.
        self.width = np.array([len(p.encode()) for p in pieces], np.int64)
        #: False if some piece could cross a non-space followed by a space; then nothing is proven and no text is cut.
        self.stable = not any(re.search("[^ ] ", p) for i, p in enumerate(pieces) if self.sp.is_byte(i) is False)

    def _spans(self, data: bytes, size: int) -> list[tuple[int, int]]:
        """Overlapping [start, end) byte ranges over data, cut between characters."""

        def edge(at: int) -> int:
            while at < size and data[at] & 0xC0 == 0x80:
                at += 1
            return min(at, size)

        out, start = [], 0
        while True:
            end = edge(start + self.chunk)
            out.append((start, end))
            if end >= size:
                return out
            start = edge(end - self.overlap)

    def _cut(self, data: bytes, left: np.ndarray, right: np.ndarray) -> int:
        """The last byte offset that both lists of token starts hold and that is proven stable, or -1."""
        for at in np.intersect1d(left, right)[::-1].tolist():
            if data[at] == 0x20 and data[at - 1] != 0x20:
                return at
        return -1

    def _starts(self, start: int, ids: list[int]) -> np.ndarray:
        """Byte offsets in the document where the tokens of a chunk start. The first token holds the added space."""
        return start - 1 + np.concatenate(([1], np.cumsum(self.width[ids])[:-1])) if ids else np.zeros(0, np.int64)

    def _splice(self, data: bytes, spans: list[tuple[int, int]]) -> int | None:
        """Tokens of a document from its chunks; None if widths don't fit the text, so that nothing is proven."""
        held: dict[int, list[int]] = {}

        def encoded(i: int) -> list[int]:
            if i not in held:
                held.clear()
                batch = spans[i : i + BATCH_CHUNKS]
                held.update(enumerate(self.sp.encode([data[a:b].decode() for a, b in batch], num_threads=1), i))
            return held[i]

        size, total, i, base, reach = len(data), 0, 0, 0, WIDEN_BYTES
        (start, end), ids = spans[0], encoded(0)
        own = self._starts(start, ids)  # tokens before `base` of this chunk are already counted
        while True:
            if ids and int(self.width[ids].sum()) != end - start + 1:
                return None
            if end == size:
                return total + len(ids) - base
            while spans[i][1] <= end:  # the first chunk that goes on beyond this one
                i += 1
            next_start, next_end = spans[i]
            theirs = self._starts(next_start, next_ids := encoded(i))
            # the space added before a chunk is no non-space: the chunk itself must hold what stands before the cut
            cut = self._cut(data, own[base + 1 :], theirs[theirs > next_start])
            if cut < 0:  # twice as far each time, so all widenings of a chunk together cost no more than a few of the last
                end, reach = min(size, end + reach), 2 * reach
                while end < size and data[end] & 0xC0 == 0x80:
                    end += 1
                own = self._starts(start, ids := self.sp.encode(data[start:end].decode()))
                continue
            total += int(np.searchsorted(own, cut)) - base
            start, end, ids, own, reach = next_start, next_end, next_ids, theirs, WIDEN_BYTES
            base = int(np.searchsorted(theirs, cut))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. An encoder call takes at most BATCH_CHUNKS chunks; only a text without stable boundaries
        is encoded as a whole, as the library does."""
        out, plain, at = [0] * len(texts), [], []

        def flush() -> None:
            for i, ids in zip(at, self.sp.encode(plain, num_threads=1), strict=True):
                out[i] = len(ids)
            plain.clear()
            at.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= self.chunk // 3 or not self.stable or len(data := text.replace(SPACE, " ").encode()) <= self.chunk:
                plain.append(text)
                at.append(i)
                if len(plain) >= BATCH_CHUNKS:
                    flush()
            else:
                spliced = self._splice(data, self._spans(data, len(data)))
                out[i] = len(self.sp.encode(text)) if spliced is None else spliced
        if plain:
            flush()
        return out


def count_tokens(text: Column, model_file: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> Column:
    """The number of tokens of a text column (long, never null). model_file must be readable on every executor."""
    loaded = []

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(PieceCounter(model_file, chunk, overlap))
        return pa.array(loaded[0].count(texts.to_pylist()), pa.int64())

    return tokens(text)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document with the 32k piece model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", count_tokens(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )
