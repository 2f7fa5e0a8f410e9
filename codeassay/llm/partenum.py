"""N-gram Jaccard join by prefix filtering in frequency order, in bands of set sizes.

This replaces PartEnum, of which only the bands and the bound k are left: there is no partition into cells
of several shingles and no enumeration of subsets of cells. That form missed the limits (projected to
30 GB: disk 20.3 x input and 1034 CPU seconds a GB, and a stop on check_h); see the README.

Texts are sets of hashed word shingles. Sets are put in bands of similar size. A cell is a 64-bit hash of a
shingle, and a signature is a band with one cell of a set. For sets of a and b shingles at most
k = a - ceil(t (a + b) / (1 + t)) cells of the first differ.
It is enough to enumerate a set's k + 1 first cells in a fixed order, for the largest k in the band:
sets with i common cells have one among their first a - i + 1 and b - i + 1 under one total order.

Any total order is right. Shingles in often used buckets of a hash table come last: a passage that many
texts share is then in no signature of a text that has enough of its own, so groups stay small. A
common cell counts only where so few come before it that enough are left. Pairs that share a signature are
first held against bitmaps of the whole sets, of one or two bits a shingle, which rule out almost all
pairs that aren't linked and none that is. What is left is verified on the exact sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeassay.llm.common import NULL_ID, discard, fresh, in_batches, order_id, release, row_digest, small_batches, stable, table, worker_cache
from codeassay.llm.components import components
from codeassay.operators.skew import lookup_join

#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Members of a group of equal signatures that are handled as one row; larger groups go by rounds.
SMALL = 64
#: Buckets of the table of shingle counts, its blocks, and shingles counted in it at a time. Sets are
#: the rarer the earlier a shingle comes in their order; the result doesn't depend on it.
BUCKETS, BLOCKS, CHUNK = 1 << 22, 64, 1 << 20
#: Bytes up to which the components of all sets are broadcast; beyond, rows of hot sets are split.
SMALL_LOOKUP = 4 << 20
#: Bits of the filter for texts that have candidates.
FILTER_BITS = 1 << 26


@dataclass(frozen=True)
class Scheme:
    """Shingles of ``words`` words; sets are linked from ``percent`` of their union on."""

    words: int = 5
    percent: int = 80

    def common(self, a: int, b: int) -> int:
        """The least size of the intersection of linked sets of ``a`` and ``b``."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def bands(self, n: int) -> tuple[int, int, int | None]:
        """Band of a set of ``n`` (sizes 2**band to 2**(band + 1) - 1), k there, and k in the band below.

        The latter is for smaller partners; it is null if all partners are in the set's own band or
        in the next one, where they come down to it.
        """
        band, least = n.bit_length() - 1, -(-n * self.percent // 100)
        own = n - self.common(n, max(least, 1 << band))
        return band, own, n - self.common(n, least) if least < 1 << band else None


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[bytes | None], words: int, hashes: dict[bytes, int]) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; a few megabytes at a time."""
    group: list[list[bytes]] = []
    held = 0
    for text in texts:
        group.append((text or b"").lower().split())
        held += len(text or b"")
        if held > 1 << 21:
            yield from _shingles(group, words, hashes)
            group, held = [], 0
    yield from _shingles(group, words, hashes)


def _shingles(group: list[list[bytes]], words: int, hashes: dict[bytes, int]) -> Iterator[np.ndarray]:
    sizes = [len(cut) for cut in group]
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(group)), np.uint64, sum(sizes))
    n = max(len(h) - words + 1, 0)
    found = np.zeros(n, np.uint64)
    for j in range(words):
        found *= np.uint64(0xD1342543DE82EF95)
        found += h[j : n + j]
    found = _mix(found)
    at = 0
    for cut, size in zip(group, sizes, strict=True):
        if size >= words:
            own = np.sort(found[at : at + size - words + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif size:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(cut), size)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        at += size


def set_id(elements: np.ndarray) -> int:
    return int(np.int64(xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)))


def first_cells(elements: np.ndarray, length: int, counts: np.ndarray) -> np.ndarray:
    """The ``length`` first cells of a set: by the counts of their buckets, then by hash.

    ``elements`` ascend, so the stable sort breaks ties between equal keys by element: a total order.
    """
    cells = _mix(elements)
    rank = counts[(elements & np.uint64(len(counts) - 1)).view(np.int64)].astype(np.uint64)
    key = (rank << np.uint64(32)) | (cells >> np.uint64(32))
    return cells[np.argsort(key, kind="stable")[:length]]


def bitmap(elements: np.ndarray) -> bytes:
    """Parities of a set: each element toggles one bit of as many as the next power of two above its size (64 at least).

    The bits in which two such bitmaps of equal length differ are at most as many as the elements that
    are in one of the sets only: common elements toggle the same bit twice.
    """
    size = max(64, 1 << len(elements).bit_length())
    at = (_mix(elements) & np.uint64(size - 1)).view(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1 == 1, bitorder="little").tobytes()


def least_difference(one: bytes, two: bytes) -> int:
    """At least so many elements are in one of the sets of two bitmaps only; the longer one is folded."""
    if len(one) < len(two):
        one, two = two, one
    x, size = int.from_bytes(one, "little"), len(one) * 8
    while size > len(two) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(two, "little")).bit_count()


def _hashes() -> _Hashes:
    hashes = worker_cache("word hashes", _Hashes)
    if len(hashes) > REMEMBERED:
        hashes.clear()
    return hashes


def _bucket_counts(docs: DataFrame, scheme: Scheme) -> np.ndarray:
    """How many distinct sets of a task hold a shingle of each bucket, added up over all tasks.

    The table has a fixed size; tasks hand it on in compressed blocks, which Spark adds up.
    """
    size = BUCKETS // BLOCKS

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total, sets, held = np.zeros(BUCKETS, np.uint32), [], 0
        seen: set[int] = set()

        def add() -> None:
            at = (np.concatenate(sets) & np.uint64(BUCKETS - 1)).view(np.int64)
            np.add(total, np.bincount(at, minlength=BUCKETS).astype(np.uint32), out=total)

        for b in batches:
            for elements in shingles(b["text"], scheme.words, _hashes()):
                own = set_id(elements)
                if own not in seen and len(elements):
                    seen.add(own)
                    sets.append(elements)
                    held += len(elements)
                if held > CHUNK:
                    add()
                    sets.clear()
                    held = 0
        if sets:
            add()
        for k in range(BLOCKS):
            yield {"block": [k], "counts": [zlib.compress(total[k * size : (k + 1) * size].tobytes(), 1)]}

    def add_up(batches: Iterator[dict]) -> Iterator[dict]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b["block"], b["counts"], strict=True):
                found = np.frombuffer(zlib.decompress(packed), np.uint32)
                totals[k] = totals[k] + found if k in totals else found
        for k, found in totals.items():
            yield {"block": [k], "counts": [zlib.compress(found.tobytes(), 1)]}

    blocks = in_batches(docs.select("text"), count, "block int, counts binary").repartition(8, "block")
    out = np.zeros(BUCKETS, np.uint32)
    for r in in_batches(blocks, add_up, "block int, counts binary").toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out


def _list_array(lists: list[np.ndarray | None]) -> pa.Array:
    """Null lists are empty."""
    offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in lists])))
    flat = np.concatenate([np.zeros(0, np.uint64), *[x for x in lists if x is not None]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _signed(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Per row: id, digest, set_id, n (shingles). For the first of equal sets in a task also its band, k
    there and below, the first cells (the largest k + 1) and its bitmap.
    """
    table_of = docs.sparkSession.sparkContext.broadcast(_bucket_counts(docs, scheme))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            hashes, counts = _hashes(), table_of.value
            names = ("set_id", "n", "band", "k", "k_low", "cells", "bits")
            out: dict[str, list] = {name: [] for name in names}
            for elements in shingles(b["text"], scheme.words, hashes):
                own, n = set_id(elements), len(elements)
                row = (own, n, None, None, None, None, None)
                if n and own not in seen:
                    seen.add(own)
                    band, k, k_low = scheme.bands(n)
                    most = max(k, k_low or 0)
                    row = (own, n, band, k, k_low, first_cells(elements, most + 1, counts), bitmap(elements))
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
            if len(seen) > 1_000_000:
                seen.clear()
            yield {"id": b["id"], "digest": b["digest"], **out, "cells": _list_array(out["cells"])}

    keyed = docs.select(order_id().alias("id"), row_digest().alias("digest"), "text")
    return in_batches(
        keyed, rows, "id long, digest long, set_id long, n long, band int, k int, k_low int, cells array<long>, bits binary"
    )


def _groups(signed: DataFrame, scheme: Scheme) -> DataFrame:
    """Groups of distinct sets with a common signature.

    ``sets`` and ``sizes`` of up to SMALL members (signature null), or single members of larger
    groups and of those that may go on in another range partition, each with its signature and the
    ``place`` of the cell in the member's order. Members of small groups whose place leaves too few
    cells for any partner in the group are left out; so are pairs of too different sizes.
    """
    percent = scheme.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["signature", "place", "sets", "sizes"]

        def batch(signature, place, offsets: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (sets, sizes)]
            nulls = pa.nulls(len(offsets) - 1, pa.int64())
            first = [nulls if x is None else pa.array(x.astype(np.int64)) for x in (signature, place)]
            return pa.RecordBatch.from_arrays([*first, *lists], names=names)

        def pruned(keep: np.ndarray, counts: np.ndarray, sid: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Groups of ``counts`` members (those of ``keep``) without members that have no partner."""
            rows = np.repeat(keep, counts)
            counts, sid, n, at = counts[keep], sid[rows], n[rows], at[rows]
            for _ in range(2):
                if not len(counts):
                    return
                starts = np.cumsum(counts) - counts
                least = np.repeat(np.minimum.reduceat(n, starts), counts)
                partner = np.maximum(-(-n * percent // 100), least)
                fits = (at <= n + (-percent * (n + partner)) // (100 + percent)) & (partner * percent <= n * 100)
                group = np.repeat(np.arange(len(counts)), counts)
                left = np.bincount(group[fits], minlength=len(counts))
                fits &= left[group] > 1
                two = left == 2
                if two.any():
                    pair = two[group] & fits
                    x = n[pair].reshape(-1, 2)
                    close = x.min(axis=1) * 100 >= percent * x.max(axis=1)
                    fits[pair] = np.repeat(close, 2)
                counts = np.bincount(group[fits], minlength=len(counts))
                counts, sid, n, at = counts[counts > 0], sid[fits], n[fits], at[fits]
            if len(counts):
                # The member with the fewest cells before the common one comes first, if it matters.
                group = np.repeat(np.arange(len(counts)), counts)
                front = np.lexsort((sid, at * (counts[group] > 2), group))[np.cumsum(counts) - counts]
                first = np.zeros(len(sid), np.int64)
                first[front] = -1
                order = np.lexsort((sid, first, group))
                yield batch(None, None, np.concatenate(([0], np.cumsum(counts))), sid[order], n[order])

        held = [np.zeros(0, np.int64)] * 4
        first = True  # the group at hand is the first of the partition, or known to be large
        for batch_ in batches:
            sig, sid, n, at = (np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch_.columns, strict=True))
            if not len(sig):
                continue
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])))
            sig, sid, n, at = sig[new], sid[new], n[new], at[new]
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            counts = np.diff(np.concatenate((starts, [len(sig)])))
            single = counts > SMALL
            single[0] |= first
            last = starts[-1]
            whole = np.ones(len(starts), bool)
            whole[-1] = False  # it may go on in the next batch
            rows = np.repeat(single & whole, counts)
            if single[-1]:  # large already: its members may go now, one stays to know it by
                rows[last : len(sig) - 1] = True
                last = len(sig) - 1
            if rows.any():
                yield batch(sig[rows], at[rows], np.arange(rows.sum() + 1), sid[rows], n[rows])
            yield from pruned(whole & ~single & (counts > 1), counts, sid, n, at)
            held = [sig[last:], sid[last:], n[last:], at[last:]]
            first = bool(single[-1])
        if len(held[0]):
            yield batch(held[0], held[3], np.arange(len(held[0]) + 1), held[1], held[2])

    bands = F.array(F.struct("band", "k"), F.struct((F.col("band") - 1).alias("band"), F.col("k_low").alias("k")))
    members = (
        signed.filter("band IS NOT NULL")
        .select("set_id", "n", "cells", F.explode(F.filter(bands, lambda x: x["k"].isNotNull())).alias("b"))
        .select("set_id", "n", "b.band", F.posexplode(F.slice("cells", F.lit(1), F.col("b.k") + 1)).alias("place", "cell"))
        .select(F.xxhash64("cell", "band").alias("signature"), "set_id", "n", F.col("place").cast("long").alias("place"))
    )
    by = ("signature", "set_id")
    return members.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        run, "signature long, place long, sets array<long>, sizes array<long>"
    )


#: Bits in a row of a bitmap.
_ROW = 1 << 15


def _mask_rows(keys: DataFrame) -> DataFrame:
    """(row, bits): a bitmap of FILTER_BITS for the longs of ``keys`` (key), by hash; empty rows are left out."""
    slots = keys.select(_slot("key").alias("slot"))
    bits = F.bitmap_construct_agg((F.col("slot") % _ROW).cast("long"))
    return slots.groupBy(F.floor(F.col("slot") / _ROW).alias("row")).agg(bits.alias("bits"))


def _mask(keys: DataFrame) -> np.ndarray:
    """The bitmap of ``_mask_rows`` as one array."""
    mask = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in _mask_rows(keys).toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        mask[r["row"] * _ROW // 8 : r["row"] * _ROW // 8 + len(part)] = part
    return mask


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _marked(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose long is among ``keys`` (key), and a few others: the bitmap, of fixed size, goes to the rows."""
    at = rows.withColumn("_slot", _slot(column)).withColumn("row", F.floor(F.col("_slot") / _ROW))
    met = at.join(F.broadcast(_mask_rows(keys)), "row")
    byte = "cast(conv(hex(substring(bits, cast(_slot % {0} div 8 + 1 AS INT), 1)), 16, 10) AS INT)".format(_ROW)
    return met.filter(f"getbit({byte}, cast(_slot % 8 AS INT)) = 1").select(*[F.col(c) for c in rows.columns])


def _has(mask: np.ndarray, slots: list[int]) -> list[int]:
    """Positions of the slots whose bit is set."""
    at = np.array(slots, np.int64)
    return np.flatnonzero(mask[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()


def _sets(docs: DataFrame, holders: DataFrame, scheme: Scheme) -> DataFrame:
    """(set_id, elements) of the documents in ``holders`` (doc), and of a few others.

    The bitmap spares most texts from being cut, and the sets from a join.
    """
    shared_mask = docs.sparkSession.sparkContext.broadcast(_mask(holders.select(F.col("doc").alias("key"))))

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            wanted = _has(shared_mask.value, b["slot"])
            found = list(shingles([b["text"][k] for k in wanted], scheme.words, _hashes()))
            yield {"set_id": [set_id(x) for x in found], "elements": [x.tobytes() for x in found]}

    keyed = docs.select(order_id().alias("id"), "text").select(_slot("id").alias("slot"), "text")
    return stable(in_batches(keyed, cut, "set_id long, elements binary"))


def _near(pairs: DataFrame, maps: DataFrame, scheme: Scheme) -> DataFrame:
    """The distinct pairs (a, b) of set ids that their bitmaps don't rule out, as a written table.

    Sets of a and b elements are linked if at most (a + b) (1 - t) / (1 + t) are in one of them only.
    """
    percent = scheme.percent

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for x, y, nx, ny, one, two in zip(b["a"], b["b"], b["na"], b["nb"], b["ba"], b["bb"], strict=True):
                if least_difference(one, two) * (100 + percent) <= (nx + ny) * (100 - percent):
                    out["a"].append(x)
                    out["b"].append(y)
            yield out

    one, two = (maps.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    both = pairs.distinct().join(one, "a").join(two, "b")
    return stable(in_batches(both.select("a", "b", "na", "nb", "ba", "bb"), rows, "a long, b long"))


@dataclass(frozen=True)
class _Candidates:
    """What pairs are verified on: bitmaps, sets, and the least document that holds a set."""

    maps: DataFrame
    sets: DataFrame
    holders: DataFrame
    scheme: Scheme

    def linked(self, pairs: DataFrame) -> DataFrame:
        return self.verified(_near(pairs, self.maps, self.scheme))

    def verified(self, near: DataFrame) -> DataFrame:
        """(a, b) of documents for the pairs (a, b) of set ids that are linked."""
        percent = self.scheme.percent
        sets = _marked(self.sets, "set_id", near.select(F.explode(F.array("a", "b")).alias("key")))

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                out: dict[str, list] = {"a": [], "b": []}
                for sa, sb, ea, eb in zip(b["a"], b["b"], b["ea"], b["eb"], strict=True):
                    x, y = np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        out["a"].append(sa)
                        out["b"].append(sb)
                yield out

        first, second = (sets.select(F.col("set_id").alias(x), F.col("elements").alias(f"e{x}")) for x in "ab")
        found = in_batches(near.join(first, "a").join(second, "b").select("a", "b", "ea", "eb"), rows, "a long, b long")
        docs = self.holders
        return (
            found.join(docs.select(F.col("set_id").alias("a"), F.col("doc").alias("da")), "a")
            .join(docs.select(F.col("set_id").alias("b"), F.col("doc").alias("db")), "b")
            .select(F.col("da").alias("a"), F.col("db").alias("b"))
        )


def _similar_sizes(scheme: Scheme, a: str, b: str) -> str:
    return f"least({a}, {b}) * 100 >= {scheme.percent} * greatest({a}, {b})"


def _roots(docs: DataFrame, signed: DataFrame, rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b) for documents that hold distinct sets: b is the least document of a's component.

    ``rows`` has the ids and sets of all rows; ``signed`` is removed as soon as it isn't needed.

    First each group's members are compared with one of them, the one with the fewest cells before the
    common one: it is the nearest to what the members share. A group whose members are then in
    one component is done. In the others every pair across components is compared: at once in small
    groups, block by block in the larger ones.
    """
    groups = stable(_groups(signed, scheme))
    small = stable(groups.filter("signature IS NULL").select("sets", "sizes").distinct())
    large = groups.filter("signature IS NOT NULL").select(
        "signature", F.col("sets")[0].alias("set_id"), F.col("sizes")[0].alias("n"), "place"
    )
    # (A group at the end of a range partition may have a single member after all.)
    real = large.groupBy("signature").agg(F.min("n").alias("least"), F.min("set_id").alias("x"), F.max("set_id").alias("y"))
    partner = "greatest(ceil(n * {0} / 100), least)".format(scheme.percent)
    large = stable(
        large.join(real.filter("x < y").select("signature", "least"), "signature")
        .filter(f"place <= n - ceil({scheme.percent} * (n + {partner}) / {100 + scheme.percent})")
        .select("signature", "set_id", "n", "place").distinct()
    )
    discard(groups)
    release(docs.sparkSession)
    in_small = small.select(F.explode("sets").alias("set_id"))
    wanted = stable(in_small.unionByName(large.select("set_id")).distinct())
    maps = stable(
        signed.filter("bits IS NOT NULL").select("set_id", "n", "bits").join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])
    )
    discard(signed)
    release(docs.sparkSession)
    first = small.select(
        F.col("sets")[0].alias("a"), F.col("sizes")[0].alias("na"), F.explode(F.slice(F.arrays_zip("sets", "sizes"), 2, SMALL)).alias("o")
    ).select("a", "na", F.col("o.sets").alias("b"), F.col("o.sizes").alias("nb"))
    hub = large.groupBy("signature").agg(F.min(F.struct("place", "set_id", "n")).alias("hub"))
    hubs = large.join(hub, "signature").filter("set_id <> hub.set_id")
    stars = first.unionByName(hubs.select(F.col("hub.set_id").alias("a"), F.col("hub.n").alias("na"), F.col("set_id").alias("b"), F.col("n").alias("nb")))
    near = _near(stars.filter(_similar_sizes(scheme, "na", "nb")).select("a", "b"), maps, scheme)
    # Sets that may be compared: those of pairs that are left, and of groups that have further pairs.
    further = small.filter(F.size("sets") > 2).select(F.explode("sets").alias("set_id")).unionByName(large.select("set_id"))
    used = near.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(further).distinct()
    least = rows.groupBy("set_id").agg(F.min("id").alias("doc"))  # combined before it moves: a set may have any number of rows
    node = stable(least.join(used, "set_id", "left_semi"))
    candidates = _Candidates(maps, _sets(docs, node, scheme), node, scheme)
    roots = components(candidates.verified(near))
    discard(near, wanted)
    release(docs.sparkSession)

    def labelled(members: DataFrame) -> DataFrame:
        with_doc = members.join(node, "set_id")
        return with_doc.join(roots.select(F.col("a").alias("doc"), F.col("b").alias("root")), "doc", "left").withColumn(
            "root", F.coalesce("root", "doc")
        )

    # Small groups: the pairs that are left, across components.
    members = small.filter(F.size("sets") > 2).select(
        F.xxhash64("sets").alias("g"), F.posexplode(F.arrays_zip("sets", "sizes")).alias("pos", "o")
    ).select("g", "pos", F.col("o.sets").alias("set_id"), F.col("o.sizes").alias("n"))
    by_group = labelled(members).groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("pos", "set_id", "n", "root"))).alias("m"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
    )
    # Members outside the group's largest component against all of the others.
    main = F.expr("element_at(array_sort(transform(array_distinct(m.root), r -> struct(size(filter(m, x -> x.root = r)) as c, r as r))), -1).r")
    crossing = F.expr(
        f"""flatten(transform(filter(m, x -> x.root <> main), x -> transform(
            filter(m, y -> y.root <> x.root AND (y.root = main OR y.set_id > x.set_id) AND {_similar_sizes(scheme, "x.n", "y.n")}),
            y -> struct(least(x.set_id, y.set_id) as a, greatest(x.set_id, y.set_id) as b))))"""
    )
    pairs = by_group.filter("low < high").withColumn("main", main).select(F.explode(crossing).alias("p")).select("p.*").distinct()
    starred, roots = roots, components(roots.unionByName(candidates.linked(pairs)))
    discard(starred, small)

    fewest = f"ceil({scheme.percent} * (n + hub_n) / {100 + scheme.percent})"
    # Larger groups, in rounds: members outside the group's largest component, a block at a time,
    # against all members of other components. They are done then; the largest one needs no more.
    while True:
        left = labelled(large)
        counted = left.groupBy("signature", "root").agg(F.count(F.lit(1)).alias("m"))
        main = counted.groupBy("signature").agg(F.max(F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
        open_groups = stable(left.join(main.filter("roots > 1").select("signature", F.col("main.root").alias("main")), "signature"))
        if open_groups.isEmpty():
            discard(maps, candidates.sets, node, large, open_groups)
            return roots
        order = Window.partitionBy("signature").orderBy("set_id")
        hubs = stable(
            open_groups.filter("root <> main").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SMALL)
            .select("signature", F.col("set_id").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"), F.col("place").alias("hub_place"))
        )
        pairs = (
            open_groups.join(hubs, "signature")
            .filter("root <> hub_root")
            .filter(_similar_sizes(scheme, "n", "hub_n"))
            .filter(f"place <= n - {fewest} AND hub_place <= hub_n - {fewest}")
            .select(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b"))
            .distinct()
        )
        found = components(roots.unionByName(candidates.linked(pairs)))
        done = hubs.select("signature", F.col("hub").alias("set_id"))
        rest = stable(open_groups.select("signature", "set_id", "n", "place").join(done, ["signature", "set_id"], "left_anti"))
        discard(roots, large, open_groups, hubs)
        roots, large = found, rest


def jaccard_components(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): id, digest, n_shingles, component.

    ``id`` is doc_id, the largest long for a null one; ``component`` the least id reachable by
    links. Texts without words (null, empty) are linked with nothing, not even each other. Rows
    with equal sets are one node, so copies are not compared.
    """
    with small_batches(docs.sparkSession):
        signed = stable(_signed(docs, scheme))
        rows = stable(signed.select("id", "digest", "set_id", F.col("n").alias("n_shingles")))
        release(docs.sparkSession)
        roots = _roots(docs, signed, rows, scheme).select(F.col("a").alias("doc"), "b")
    release(docs.sparkSession)
    classes = (
        rows.filter("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("id").alias("doc"))
        .join(roots, "doc", "left")
        .select("set_id", F.coalesce("b", "doc").alias("component"))
    )
    worded = rows.filter("n_shingles > 0")
    joined = lookup_join(worded, classes, "set_id", "inner", spread=["id", "digest"], census=worded.select("set_id"), max_bytes=SMALL_LOOKUP)
    found = joined.select("id", "digest", "n_shingles", "component")
    alone = rows.filter("n_shingles = 0").select("id", "digest", "n_shingles", F.col("id").alias("component"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """One row of each component, the one with the least id (then digest), with all its columns.

    Rows without words stay, once for each id.
    """
    found = jaccard_components(docs, scheme)
    ends = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("id", "digest")).alias("k"))
    alone = found.filter("n_shingles = 0").select(F.struct("id", "digest").alias("k")).distinct()
    keys = stable(ends.select("k.*").unionByName(alone.select("k.*")))
    key, digest = fresh(docs, "_id"), fresh(docs, "_digest")
    keyed = docs.withColumns({key: order_id(), digest: row_digest()})
    kept = keyed.join(keys.withColumnsRenamed({"id": key, "digest": digest}), [key, digest], "left_semi")
    return kept.dropDuplicates([key, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    own = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(own("id").alias("doc_id"), "n_shingles", own("component").alias("component_id"))
