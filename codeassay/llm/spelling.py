"""Spelling variants: Bloom-guided edit neighbourhoods of a vocabulary.

Words are counted once. Blocked Bloom filters of the vocabulary, one shard for each word length, are built in
tasks and broadcast in rounds of bounded size. Tasks generate the deletions and replacements of each
word as hashes and look them up in the shard of their length (insertions are deletions of the other
word). Only what a filter lets through becomes a string and meets the vocabulary in an exact join.
A word's form is its far more frequent near word; roots follow forms by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeassay.llm.common import discard, in_batches, shared, small_batches, stable, table

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many occurrences loses a code point.
SLIP = 199
#: Words longer than this share the last shard.
LONG = 64
#: Bits of a filter for each word, and bytes of filters that are broadcast at a time.
BITS_PER_WORD, ROUND_BYTES = 16, 32 << 20
#: Distinct words that a task counts before it hands them on, and code points that it edits at a time.
HELD_WORDS, CHUNK = 1 << 17, 1 << 17
_U = np.uint64


def slipped(prefix: int, run: str) -> str:
    """The run, without one of its code points where the hash of ``<doc_id>:<run>`` says so.

    ``prefix`` is the crc32 of ``<doc_id>:``.
    """
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of at least six code points and ``least_count`` occurrences, as a written table.

    Texts without words add nothing, null ones too; a null doc_id hashes as the empty text.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        runs_of = re.compile(f"[a-zÀ-ÿ]{{{LEAST_CHARS},}}").findall
        held: Counter[str] = Counter()
        for b in batches:
            for doc, text in zip(b["id"], b["text"], strict=True):
                prefix = zlib.crc32((doc or b"") + b":")
                for run, n in Counter(runs_of((text or b"").lower().decode())).items():
                    word = slipped(prefix, run)
                    if len(word) >= LEAST_CHARS:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield {"word": list(held), "n": list(held.values())}
                    held.clear()
        yield {"word": list(held), "n": list(held.values())}

    counted = in_batches(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), rows, "word string, n long")
    with small_batches(docs.sparkSession):
        return stable(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


# ---------------------------------------------------------------------------
# Hashes and filters
# ---------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(_BASE, -1, 1 << 64))


def _mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit, in place."""
    z ^= z >> _U(30)
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


def _patterns(seed: int) -> np.ndarray:
    """4096 patterns of three bits."""
    places = _mixed(np.arange(1 + seed, 4097 + seed, dtype=_U))
    return reduce(np.bitwise_or, [_U(1) << (places >> _U(6 * k)) % _U(64) for k in range(3)])


_FIRST, _SECOND = _patterns(0), _patterns(1 << 20)
_LETTER_HASH = _mixed(np.arange(1, 257, dtype=_U))


def _bits(h: np.ndarray) -> np.ndarray:
    """The six bits (or fewer) of a hash inside its block."""
    return _FIRST[h & _U(4095)] | _SECOND[(h >> _U(12)) & _U(4095)]


@dataclass
class Letters:
    """Words as flat arrays of their letters: code, word number, position, and partial hashes.

    The hash of a word is a polynomial in ``_BASE`` over its letters' hashes, so that of an edited
    word follows from partial sums. ``finish`` mixes in the length.
    """

    codes: np.ndarray
    word: np.ndarray
    length: np.ndarray
    power: np.ndarray
    before: np.ndarray
    after: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Letters:
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        start = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        position = np.arange(len(codes)) - start[word]
        powers = np.cumprod(np.concatenate(([_U(1)], np.full(int(lengths.max()) - 1, _BASE, _U))))
        power = powers[position]
        term = _LETTER_HASH[codes] * power
        upto = np.cumsum(term)
        base = (upto - term)[start]
        before = upto - term - base[word]
        total = upto[start + lengths - 1] - base
        return cls(codes, word, lengths[word].astype(_U), power, before, total[word] - before - term, start)

    def whole(self) -> np.ndarray:
        """Hashes of the words themselves."""
        at = self.first
        return self.finish(self.after[at] + _LETTER_HASH[self.codes[at]], self.length[at])

    def deleted(self) -> tuple[np.ndarray, np.ndarray]:
        """Letters whose deletion gives a word that no earlier deletion gives, and its hash."""
        at = np.flatnonzero(np.concatenate(([True], (self.codes[1:] != self.codes[:-1]) | (self.word[1:] != self.word[:-1]))))
        return at, self.finish(self.before[at] + self.after[at] * _INVERSE, self.length[at] - _U(1))

    @staticmethod
    def finish(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
        return _mixed(sums + length * _U(0xD6E8FEB86659FD93))


@dataclass
class Shard:
    """A slice of the blocked Bloom filter of one word length: blocks ``low`` up to ``low + len(blocks)``."""

    n_blocks: int
    low: int
    blocks: np.ndarray

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of the hashes that the filter lets through."""
        block = block_of(h, self.n_blocks)
        if len(self.blocks) < self.n_blocks:
            inside = np.flatnonzero((block >= self.low) & (block < self.low + len(self.blocks)))
            block, bits = block[inside] - self.low, _bits(h[inside])
            return inside[(self.blocks[block] & bits) == bits]
        bits = _bits(h)
        return np.flatnonzero((self.blocks[block] & bits) == bits)


def block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(n_blocks)) >> _U(32)).astype(np.int64)


def shard_of(length: int) -> int:
    return min(length, LONG)


def _chunks(words: list[str]) -> Iterator[list[str]]:
    """Parts of a list of words that have CHUNK letters each, or one word."""
    chunk, size = [], 0
    for w in words:
        if chunk and size + len(w) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(w)
        size += len(w)
    if chunk:
        yield chunk


def _by_length(words: list[str]) -> dict[int, list[str]]:
    """Words by length; those with a length beyond LONG together."""
    found: dict[int, list[str]] = {}
    for w in words:
        found.setdefault(min(len(w), LONG + 1), []).append(w)
    return found


def edits(words: list[str], filters: dict[int, Shard], alphabet: list[int]) -> Iterator[tuple[str, str]]:
    """(word, edited word) of all deletions, and replacements by a later letter, that the filters let through."""
    for length, group in _by_length(words).items():
        same, shorter = filters.get(shard_of(length)), filters.get(min(length - 1, LONG))
        if same is None and shorter is None:
            continue
        for chunk in _chunks(group):
            letters = Letters.of(chunk)
            if shorter is not None:
                at, h = letters.deleted()
                for i in at[shorter.has(h)].tolist():
                    w = chunk[letters.word[i]]
                    k = i - int(letters.first[letters.word[i]])
                    yield w, w[:k] + w[k + 1 :]
            if same is None:
                continue
            order = np.argsort(letters.codes, kind="stable")  # letters before x are a prefix of this
            codes = letters.codes[order]
            rest = (letters.before + letters.after)[order]
            power, size = letters.power[order], letters.length[order]
            for x in alphabet:
                end = int(np.searchsorted(codes, x))
                h = letters.finish(rest[:end] + _LETTER_HASH[x] * power[:end], size[:end])
                for i in order[same.has(h)].tolist():
                    w = chunk[letters.word[i]]
                    k = i - int(letters.first[letters.word[i]])
                    yield w, w[:k] + chr(x) + w[k + 1 :]


# ---------------------------------------------------------------------------
# Jobs
# ---------------------------------------------------------------------------


def _alphabet(words: DataFrame) -> list[int]:
    """Code points of the words: 90 at most."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"letter": sorted(set().union(*(w.decode() for w in b["word"])))}

    return sorted(ord(r.letter) for r in in_batches(words.select("word"), rows, "letter string").distinct().collect())


def _filter_blocks(words: DataFrame, n_blocks: dict[int, int]) -> DataFrame:
    """(shard, block, bits): the blocks of all filters that are not empty, as a written table."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for length, group in _by_length([w.decode() for w in b["word"]]).items():
                shard = shard_of(length)
                for chunk in _chunks(group):
                    h = Letters.of(chunk).whole()
                    yield {"shard": [shard] * len(h), "block": block_of(h, n_blocks[shard]).tolist(), "bits": _bits(h).view(np.int64).tolist()}

    marked = in_batches(words.select("word"), rows, "shard int, block long, bits long")
    return stable(marked.groupBy("shard", "block").agg(F.bit_or("bits").alias("bits")))


def _rounds(n_blocks: dict[int, int], round_bytes: int) -> Iterator[list[tuple[int, int, int]]]:
    """(shard, low, high) of the slices that are broadcast together: ``round_bytes`` at most."""
    most = max(1, round_bytes // 8)
    held, size = [], 0
    for shard, n in sorted(n_blocks.items()):
        for low in range(0, n, most):
            high = min(n, low + most)
            if held and size + high - low > most or any(s == shard for s, _, _ in held):
                yield held
                held, size = [], 0
            held.append((shard, low, high))
            size += high - low
    if held:
        yield held


def _load(blocks: DataFrame, part: list[tuple[int, int, int]], n_blocks: dict[int, int]) -> dict[int, Shard]:
    filters = {}
    for shard, low, high in part:
        mine = blocks.filter((F.col("shard") == shard) & (F.col("block") >= low) & (F.col("block") < high))
        arrow = mine.select("block", "bits").toArrow()
        bits = np.zeros(high - low, np.int64)
        bits[arrow["block"].to_numpy() - low] = arrow["bits"].to_numpy()
        filters[shard] = Shard(n_blocks[shard], low, bits.view(_U))
    return filters


def near_pairs(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near, near_n): each unordered pair of near words of (word, n) once.

    Two words are near if one code point is inserted, deleted or replaced between them. Words consist
    of code points below 256.
    """
    spark = words.sparkSession
    counts = words.groupBy(F.least(F.char_length("word"), F.lit(LONG)).alias("shard")).count().collect()
    n_blocks = {r["shard"]: max(64, r["count"] * BITS_PER_WORD // 64) for r in counts}
    alphabet = _alphabet(words)
    blocks = _filter_blocks(words, n_blocks)
    vocabulary = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = [spark.createDataFrame([], "word string, n long, near string, near_n long")]
    for part in _rounds(n_blocks, round_bytes):
        get = shared(spark, _load(blocks, part, n_blocks))

        def rows(batches: Iterator[dict], get=get) -> Iterator[dict]:
            for b in batches:
                n = {w.decode(): k for w, k in zip(b["word"], b["n"], strict=True)}
                found = list(edits(list(n), get(), alphabet))
                yield {"word": [w for w, _ in found], "n": [n[w] for w, _ in found], "near": [e for _, e in found]}

        length = F.char_length("word")
        lengths = {s for shard, _, _ in part for s in (shard, shard + 1)}
        touched = words.filter(length.isin(*lengths) | (length > LONG) if any(s >= LONG for s in lengths) else length.isin(*lengths))
        likely = in_batches(touched.select("word", "n"), rows, "word string, n long, near string")
        pairs.append(stable(likely.join(vocabulary, "near").select("word", "n", "near", "near_n")))
    discard(blocks)
    return reduce(DataFrame.unionAll, pairs)


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word of (word, n)."""
    both = pairs.select("word", "near", "near_n").unionAll(pairs.selectExpr("near", "word", "n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    most = -F.col("best.less")
    taken = most >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, most).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, as a written table: the last form of the chain.

    Counts grow along a chain, so it ends; each round doubles the part of it that is known.
    """
    links = stable(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left")
        step = stable(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(links)
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links
        links._stable_path = step._stable_path


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text; other columns are ignored).

    Words are maximal runs of Latin letters, A-Z lower-cased, less the code point that some
    occurrences lose (``slipped``). Near words of equal n are told apart by code points. Repeated rows count
    each; without words there are no rows.
    """
    words = vocabulary(docs, least_count)
    formed = stable(forms(words, near_pairs(words, round_bytes), ratio))
    found = formed.join(roots(formed), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
