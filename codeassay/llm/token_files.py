"""Token-ID output: texts encoded, packed into patched frame-of-reference files, and read back.

Documents are range-partitioned by id, so file images are in ascending order across partitions.
Images are rows of a written table (part, segment, payload): Spark's commit protocol makes the write
safe when executors are lost, on any file system. ``pfor`` describes the bytes of an image.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeassay.llm import pfor
from codeassay.llm.common import in_batches, order_id, row_digest, small_batches, stable, table, worker_cache

END_ID = 1
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 20
_END = b"\n"
#: Distinct words whose ids a task remembers.
REMEMBERED = 400_000


def default_tokenizer() -> str:
    """The public vocabulary file the queries use; any other tokenizers file is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Numbers words as they come and lists the new ones; number 0 is the end of a document."""

    def __init__(self) -> None:
        super().__init__({_END: 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes texts word by word and remembers the ids of words.

    Right for a tokenizer that lower-cases, drops white space and never joins text across it, such
    as ``word_bpe_49k.json``: its pieces hold no white space, and it composes and lower-cases
    character by character. (The tests compare it with whole texts.) The first ``REMEMBERED``
    words stay known; later ones are encoded again with each batch.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.numbers = _Numbers()
        self.table = np.array([end_id], np.uint32)
        self.starts = np.array([0, 1], np.int64)

    def _learn(self) -> None:
        """Encode the new words, many in one call; a piece's offset tells the word it belongs to."""
        new, self.numbers.new = self.numbers.new, []
        pieces, counts = [self.table], [self.starts[:0]]
        for k in range(0, len(new), 20_000):
            groups = [new[i : i + 200] for i in range(k, min(k + 20_000, len(new)), 200)]
            joined = [b" ".join(g).decode() for g in groups]
            for group, text, e in zip(
                groups, joined, self.tokenizer.encode_batch(joined, add_special_tokens=False), strict=True
            ):
                sizes = map(len, text.split(" ") if len(text) != sum(map(len, group)) + len(group) - 1 else group)
                begins = np.fromiter(sizes, np.int64, len(group)).cumsum() + np.arange(1, len(group) + 1)
                at = np.searchsorted(begins, np.fromiter((o[0] for o in e.offsets), np.int64), "right")
                counts.append(np.bincount(at, minlength=len(group)))
                pieces.append(np.array(e.ids, np.uint32))
        if new:
            self.table = np.concatenate(pieces)
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(np.concatenate(counts))))

    def _forget(self) -> None:
        while len(self.numbers) > REMEMBERED:
            self.numbers.popitem()
        self.starts = self.starts[: len(self.numbers) + 1]
        self.table = self.table[: self.starts[-1]]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one document after the other, each closed by the end id; ids of each document."""
        cut = [_words(t or b"") for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(
            map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int32, int(sizes.sum())
        )
        self._learn()
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        before = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.table[np.repeat(first - before[:-1], lengths) + np.arange(before[-1])]
        self._forget()
        return ids, np.diff(before[np.concatenate(([0], np.cumsum(sizes)))])


def _words(text: bytes) -> list[bytes]:
    """Words and the end; lower-cased ones share an entry, unless a special token may be among them."""
    words = (text if b"<|" in text else text.lower()).split()
    words.append(_END)
    return words


def write_segments(docs: DataFrame, tokenizer: str, segment_ids: int = SEGMENT_IDS, end_id: int = END_ID) -> DataFrame:
    """The written table of file images: part, segment, first, doc_ids, n_tokens, payload.

    Parts and the segments in them are in ascending order of id, null ids last; rows that share an
    id are ordered by their text's digest, and equal rows are written each. A null or empty text is its end id alone.
    ``first`` counts the ids before a segment in its part.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        part, encoder = TaskContext.get().partitionId(), worker_cache(
            f"{tokenizer} {end_id}", lambda: WordEncoder(tokenizer, end_id)
        )
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        doc_ids: list = []
        held = before = segment = 0

        def close() -> dict:
            nonlocal ids, lengths, doc_ids, held, before, segment
            payload = pfor.encode(np.concatenate(ids), np.concatenate(lengths))
            row = {
                "part": [part], "segment": [segment], "first": [before], "n_tokens": [held],
                "doc_ids": [doc_ids], "payload": [payload],
            }
            before, segment = before + held, segment + 1
            ids, lengths, doc_ids, held = [], [], [], 0
            return row

        for b in batches:
            size = np.cumsum([len(t or b"") + 1 for t in b["text"]])
            group = size // (4 * segment_ids)  # bytes of text that are encoded at once
            for g in np.unique(group).tolist():
                lo, hi = np.searchsorted(group, g), np.searchsorted(group, g, "right")
                found, n = encoder.encode(b["text"][lo:hi])
                ids.append(found)
                lengths.append(n)
                doc_ids += b["doc_id"][lo:hi]
                held += len(found)
                if held >= segment_ids:
                    yield close()
        if doc_ids:
            yield close()

    by = ("_id", "_digest")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order_id().alias("_id"), row_digest().alias("_digest"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("doc_id", "text")
    )
    kind = "part int, segment int, first long, n_tokens long, doc_ids array<long>, payload binary"
    with small_batches(docs.sparkSession):
        return stable(in_batches(ordered, rows, kind))


def read_segments(segments: DataFrame) -> DataFrame:
    """Per document of written images: doc_id, start, n_tokens, ids_crc32."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for part, first, doc_ids, image in zip(b["part"], b["first"], b["doc_ids"], b["payload"], strict=True):
                lengths = pfor.lengths_of(image)
                ends = np.cumsum(lengths)
                raw = pfor.decode(image).astype("<u4").tobytes()
                yield {
                    "part": [part] * len(doc_ids),
                    "doc_id": doc_ids,
                    "in_part": (first + ends - lengths).tolist(),
                    "n_tokens": lengths.tolist(),
                    "ids_crc32": [
                        zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)
                    ],
                }

    found = in_batches(
        segments.select("part", "first", "doc_ids", "payload"),
        rows,
        "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long",
    )
    # One row per partition of the write: the ids of all parts before it.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        segments.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return found.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_segments(write_segments(docs, default_tokenizer()))
