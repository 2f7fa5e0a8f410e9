"""Line dedup: every line that another document already holds goes.

Distinct line keys of each document are range-partitioned by hash with a secondary sort by document,
so a line that a third of all documents hold spreads over many tasks. One streaming pass marks all
but the first holder. What leaves the pass are compressed bitmaps of the lines to keep, not texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeassay.llm.common import in_batches, order_id, row_digest, stable, table

MIN_KEY_CHARS = 10
_KEY = ("h1", "h2", "id", "digest")


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def line_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One row per document and distinct key: 128-bit hash, document, its line count, positions."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in (*_KEY, "n_lines", "positions")}
            for i, digest, text in zip(b["id"], b["digest"], b["text"], strict=True):
                lines = (text or b"").split(b"\n")
                where: dict[bytes, list[int]] = {}
                for pos, line in enumerate(lines):
                    where.setdefault(line_key(line), []).append(pos)
                for key, positions in where.items():
                    if not _long_enough(key, min_chars):
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    out["h1"].append(int.from_bytes(h[:8], "little", signed=True))
                    out["h2"].append(int.from_bytes(h[8:], "little", signed=True))
                    out["id"].append(i)
                    out["digest"].append(digest)
                    out["n_lines"].append(len(lines))
                    out["positions"].append(positions)
            yield out

    rows_in = docs.select(order_id().alias("id"), row_digest().alias("digest"), "text")
    return in_batches(
        rows_in, rows, "h1 long, h2 long, id long, digest long, n_lines int, positions array<int>"
    )


def _stream(keys: DataFrame) -> DataFrame:
    """Per range partition: ``drop`` rows, ``first`` rows of its first hash, one ``last`` hash.

    Within a partition the first document of a hash holds the line. Only the first hash can have
    begun in an earlier partition, so only its holder stays open.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        current, first, owner = None, None, None
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("kind", "part", *_KEY, "n_lines", "positions")}
            for h1, h2, i, digest, n, pos in zip(*(b[k] for k in (*_KEY, "n_lines", "positions")), strict=True):
                if (h1, h2) != current:
                    current, owner = (h1, h2), i
                    first = first or current
                if i != owner or current == first:
                    for k, v in zip(
                        out, ("drop" if i != owner else "first", part, h1, h2, i, digest, n, pos), strict=True
                    ):
                        out[k].append(v)
            yield out
        if current is not None:
            yield {
                "kind": ["last"], "part": [part], "h1": [current[0]], "h2": [current[1]], "id": [owner],
                "digest": [0], "n_lines": [0], "positions": [[]],
            }

    in_order = keys.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    return in_batches(
        in_order,
        rows,
        "kind string, part int, h1 long, h2 long, id long, digest long, n_lines int, positions array<int>",
    )


def _bitmaps(dropped: DataFrame) -> DataFrame:
    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            maps = []
            for n, lists in zip(b["n_lines"], b["positions"], strict=True):
                keep = np.ones(n, bool)
                keep[np.concatenate([np.asarray(x, np.int64) for x in lists])] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield {"id": b["id"], "digest": b["digest"], "n_lines": b["n_lines"], "keep": maps}

    by_doc = dropped.groupBy("id", "digest", "n_lines").agg(F.collect_list("positions").alias("positions"))
    return in_batches(by_doc, rows, "id long, digest long, n_lines int, keep binary")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(id, digest, n_lines, keep) of every document that loses a line.

    ``keep`` is a zlib-compressed bit per line, 1 for a line that stays. A document is known by its
    id (null: the largest) and a digest of its text; repeated rows share a bitmap. A key of at least
    ``min_chars`` code points in several ids stays in the smallest of them, with all its lines there.
    """
    keys = stable(line_keys(docs, min_chars))
    marked = stable(_stream(keys))
    last = marked.filter("kind = 'last'").select("h1", "h2", "id", "part")
    opened = marked.filter("kind = 'first'")
    # One hash per partition on either side: the holder in an earlier partition, if there is one.
    earlier = (
        opened.select("h1", "h2", "part").distinct().alias("f")
        .join(last.alias("l"), (F.col("f.h1") == F.col("l.h1")) & (F.col("f.h2") == F.col("l.h2")) & (F.col("l.part") < F.col("f.part")))
        .groupBy("f.h1", "f.h2", "f.part")
        .agg(F.min("l.id").alias("owner"))
    )
    late = opened.join(earlier, ["h1", "h2", "part"]).filter("owner < id")
    drop = marked.filter("kind = 'drop'").unionByName(late.drop("owner"))
    return _bitmaps(drop.select("id", "digest", "n_lines", "positions"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept (the remaining lines, joined by a newline)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_lines", "n_dropped", "kept")}
            for i, text, packed in zip(b["doc_id"], b["text"], b["keep"], strict=True):
                lines = (text or b"").split(b"\n")
                n = len(lines)
                if packed is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n)
                    lines = [line for line, k in zip(lines, keep, strict=True) if k]
                out["doc_id"].append(i)
                out["n_lines"].append(n)
                out["n_dropped"].append(n - len(lines))
                out["kept"].append(b"\n".join(lines))
            yield out

    keyed = docs.select("doc_id", "text", order_id().alias("id"), row_digest().alias("digest"))
    joined = keyed.join(bitmaps.select("id", "digest", "keep"), ["id", "digest"], "left")
    return in_batches(
        joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "keep"),
        rows,
        "doc_id long, n_lines long, n_dropped long, kept binary",
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; further columns are ignored): its lines after dedup.

    A null or empty text is one empty line. ``kept`` is UTF-8 bytes.
    """
    return apply_bitmaps(docs, stable(keep_bitmaps(docs, min_chars)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         lower_ascii AS key
  FROM (
    SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line,
           translate(trim(unnest(ls), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
  )
),
owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT l.*, o.owner IS NOT NULL AND o.owner < l.doc_id AS gone
  FROM lines l LEFT JOIN owners o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
