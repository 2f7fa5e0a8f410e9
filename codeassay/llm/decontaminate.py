"""Benchmark decontamination with a generalised suffix automaton over words of test items.

Automata of a bounded number of states are built in tasks, each over some of the items, and sent to the
tasks one after the other. Each text streams through each of them once; the length of the longest match that ends at a word
tells which words belong to an occurrence of a window (ten consecutive words of an item, or a whole
shorter item).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeassay.functions.text import settle
from codeassay.llm.common import by_text, discard, fresh, in_batches, shared, stable, table

WINDOW = 10
#: UTF-8 bytes and words of items in one automaton at most (or one piece of an item); more items make more
#: automata, one pass for each. An automaton has at most two states a word, and one.
SHARD_BYTES, SHARD_WORDS = 16 * 1024 * 1024, 1 << 17
_SEPARATORS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z lower-cased."""
    return (text or b"").translate(_SEPARATORS).split()


@dataclass
class Matches:
    """What one text shares with the items: which words are hit, and which items occur."""

    n_words: int
    hit: np.ndarray
    items: set[int]


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with the items' windows marked."""

    window: int = WINDOW
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    ids: list[str] = field(default_factory=list)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: Of a state: the items in which its strings of ``window`` words occur; the nearest such state
    #: on its suffix path; the short whole items (length, item) that end with it.
    window_items: dict[int, set[int]] = field(default_factory=dict)
    window_state: list[int] = field(default_factory=list)
    short_items: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    shortest: int = WINDOW

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
        """Items are (id, words); those without words have no windows."""
        a = cls(window, shortest=window)
        items = [(i, w) for i, w in items if w]
        numbered = []
        for i, words in items:
            a.ids.append(i)
            numbered.append([a.vocabulary.setdefault(w, len(a.vocabulary)) for w in words])
        for codes in numbered:
            last = 0
            for c in codes:
                last = a._extend(last, c)
        a._mark(numbered)
        return a

    def _add(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of ``q`` that ``p`` followed by ``c`` spells."""
        clone = self._add(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, numbered: list[list[int]]) -> None:
        n, k = len(self.length), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        self.window_state = [-1] * n
        for v in order[1:]:
            up = self.link[v]
            self.window_state[v] = v if self.length[up] < k <= self.length[v] else self.window_state[up]
        whole: dict[int, set[tuple[int, int]]] = {}
        for item, codes in enumerate(numbered):
            v = 0
            for end, c in enumerate(codes, 1):
                v = self.step[v][c]
                if end >= k:
                    self.window_items.setdefault(self.window_state[v], set()).add(item)
            if len(codes) < k:
                whole.setdefault(v, set()).add((len(codes), item))
                self.shortest = min(self.shortest, len(codes))
        self.short_items = [()] * n
        for v in order[1:]:
            self.short_items[v] = (*sorted(whole.get(v, ())), *self.short_items[self.link[v]])

    def match(self, words: list[bytes]) -> Matches:
        """Stream the words; only runs of words that some item has can hold a window."""
        n, get = len(words), self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).astype(np.int8), [0]))))
        cover = np.zeros(n + 1, np.int64)
        items: set[int] = set()
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                self._run(codes[start:end].tolist(), start, cover, items)
        return Matches(n, np.cumsum(cover)[:n] > 0, items)

    def _run(self, codes: list[int], start: int, cover: np.ndarray, items: set[int]) -> None:
        step, link, length, k = self.step, self.link, self.length, self.window
        v, matched = 0, 0
        for end, c in enumerate(codes, start + 1):
            while c not in step[v]:
                v = link[v]
                if v < 0:
                    break
                matched = length[v]
            if v < 0:
                v, matched = 0, 0
                continue
            v = step[v][c]
            matched += 1
            if matched >= k:
                cover[end - matched] += 1
                cover[end] -= 1
                items |= self.window_items[self.window_state[v]]
            for size, item in self.short_items[v]:
                if size <= matched:
                    cover[end - size] += 1
                    cover[end] -= 1
                    items.add(item)


def pieces_of(words: list[bytes], window: int) -> Iterator[list[bytes]]:
    """Parts of an item of SHARD_WORDS words at most (or two windows), which have all its windows."""
    size = max(SHARD_WORDS, 2 * window)
    for start in range(0, max(1, len(words) - window + 1), size - window + 1):
        yield words[start : start + size]


def _automata(items: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(number, states): the automata of all distinct (item_id, text) rows, as a written table.

    Tasks build them; one begins a new automaton when the next piece of an item would overfill it. Item
    ids are taken as text, a null id as the empty one.
    """
    distinct = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").dropna(subset=["text"])

    def build(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple[str, list[bytes]]] = []
        n_words = n_bytes = 0

        def built() -> dict:
            a = Automaton.of(held, window)
            return {"n_states": [len(a.length)], "states": [pickle.dumps(a.__dict__)]}

        for b in batches:
            for item, text in zip(b["item_id"], b["text"], strict=True):
                for piece in pieces_of(words_of(text), window):
                    size = sum(map(len, piece)) + len(piece)
                    if held and (n_words + len(piece) > SHARD_WORDS or n_bytes + size > shard_bytes):
                        yield built()
                        held.clear()
                        n_words = n_bytes = 0
                    if piece:
                        held.append((item.decode(), piece))
                        n_words, n_bytes = n_words + len(piece), n_bytes + size
        if held:
            yield built()

    total = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-total // min(shard_bytes, 8 * SHARD_WORDS)))
    built = in_batches(distinct.distinct().coalesce(tasks), build, "n_states long, states binary")
    return stable(built.withColumn("number", F.monotonically_increasing_id()))


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("rest", T.StringType()),
    ]
)


def _matcher(spark: SparkSession, states: bytes, cut: bool = False):
    """A column function over texts; ``rest`` is the text without its hit words if ``cut`` and there are any."""
    load = shared(spark, states)
    loaded: list[Automaton] = []

    def match(texts: list[bytes | None]) -> list[tuple]:
        if not loaded:
            loaded.append(Automaton(**pickle.loads(load())))
        a, found = loaded[0], []
        for text in texts:
            m = a.match(words_of(text))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], m.hit.astype(np.int8), [0]))))
            rest = without_spans(text, edges.tolist()).decode() if cut and len(edges) else None
            found.append((m.n_words, edges.tolist(), sorted({a.ids[i] for i in m.items}), rest))
        return found

    return by_text(match, _FOUND)


def find_overlaps(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, cut: bool = False
) -> DataFrame:
    """``docs`` with a column ``overlap``: n_words, spans, items and rest of each text.

    ``spans`` holds start and end word of each maximal stretch of hit words, in turn; ``items`` the
    ids (as text, in order) of items with a window in the text. Null and empty texts have no words,
    items without words no windows. ``rest`` is the text without its hit words if ``cut`` and it has any, or
    null. A column ``overlap`` in ``docs`` is replaced.

    If there are several automata, ``docs`` is written with a number for each row, the hits of each automaton
    are written before the next one is loaded, and all are merged by row: the driver and each task hold one
    automaton at a time.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != "overlap"]
    automata = _automata(items, window, shard_bytes)
    numbers = [r.number for r in automata.select("number").orderBy("number").collect()]

    def matcher(number: int):
        return _matcher(spark, bytes(automata.filter(F.col("number") == number).first()["states"]))

    if len(numbers) < 2:
        states = bytes(automata.first()["states"]) if numbers else pickle.dumps(Automaton.of([], window).__dict__)
        match = _matcher(spark, states, cut)
        discard(automata)
        return docs.select(*[F.col(f"`{c}`") for c in kept], match("text").alias("overlap"))
    row = fresh(docs, "_row")
    keyed = stable(docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(row)))
    parts = []
    for number in numbers:
        m = keyed.select(F.col(row).alias("row"), matcher(number)("text").alias("m")).filter(F.size("m.spans") > 0)
        parts.append(stable(m.select("row", "m.spans", "m.items")))
    discard(automata)
    text = F.concat_ws(",", F.transform("spans", lambda x: x.cast("string")))
    spans = by_text(_union_spans, T.ArrayType(T.IntegerType()))
    merged = (
        reduce(DataFrame.unionAll, parts)
        .groupBy("row")
        .agg(F.concat_ws(";", F.collect_list(text)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    hits = stable(merged.select(F.col("row").alias(row), F.struct(spans("spans").alias("spans"), "items").alias("_hits")))
    discard(*parts)
    hit = fresh(docs, "_hits")
    found = F.struct(
        _counter(cut)("text", F.col(hit)["spans"]).alias("_c"),
        F.coalesce(F.col(hit)["spans"], F.array().cast("array<int>")).alias("spans"),
        F.coalesce(F.col(hit)["items"], F.array().cast("array<string>")).alias("items"),
    )
    merged = keyed.join(hits.withColumnRenamed("_hits", hit), row, "left").select(*[F.col(f"`{c}`") for c in kept], found.alias("overlap"))
    o = F.col("overlap")
    parts = [o["_c"]["n_words"].alias("n_words"), o["spans"].alias("spans"), o["items"].alias("items"), o["_c"]["rest"].alias("rest")]
    return merged.withColumn("overlap", F.struct(*parts))


def _counter(cut: bool):
    """A column function over texts and stretches: n_words and rest."""
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("rest", T.StringType())])

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, rests = [], []
        for start in range(0, len(texts), 500):  # a batch's texts are not taken out all at once
            part = texts.slice(start, 500).cast(pa.binary()).to_pylist()
            for text, stretches in zip(part, spans.slice(start, 500).to_pylist(), strict=True):
                counts.append(len(words_of(text)))
                rests.append(without_spans(text, stretches).decode() if cut and text and stretches else None)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(rests, pa.string())], names=["n_words", "rest"])

    return F.arrow_udf(run, kind)


def _union_spans(rows: list[bytes | None]) -> list[list[int]]:
    """The union of several lists of stretches, written as 'a,b,c,d;e,f'."""
    out = []
    for row in rows:
        pairs: list[list[int]] = []
        for part in (row or b"").split(b";"):
            numbers = [int(x) for x in part.split(b",") if x]
            pairs += zip(numbers[::2], numbers[1::2], strict=True)
        merged: list[int] = []
        for start, end in sorted(pairs):
            if merged and start <= merged[-1]:
                merged[-1] = max(merged[-1], end)
            else:
                merged += [start, end]
        out.append(merged)
    return out


@dataclass(frozen=True)
class Limits:
    """A text loses the hit words; one with a larger share of them (in percent) goes as a whole."""

    max_percent: int = 50


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the bytes from the first to the last word of each stretch.

    White space that is left at a cut is reduced to one separator.
    """
    flat = text.translate(_SEPARATORS)
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], (np.frombuffer(flat, np.uint8) != 32).astype(np.int8), [0]))))
    starts, ends = bounds[::2], bounds[1::2]
    pieces, at = [], 0
    for first, end in zip(spans[::2], spans[1::2], strict=True):
        pieces.append(text[at : starts[first]].rstrip())
        at = int(ends[end - 1])
        while at < len(text) and flat[at] == 32 and not text[at : at + 1].isspace():
            at += 1  # punctuation that belongs to the removed words
    tail = text[at:]
    pieces.append(tail.lstrip() if not tail.strip() or not any(pieces) else tail)
    return b"".join(p if k == 0 or not p or p[:1].isspace() else b" " + p for k, p in enumerate(pieces))


def decontaminate(
    docs: DataFrame, items: DataFrame, limits: Limits = Limits(), window: int = WINDOW
) -> DataFrame:
    """``docs`` (same columns) without the hit words; mostly copied texts go.

    Texts that share no window with an item stay byte for byte, null and empty ones too. ``n_chars`` follows
    the text. Each text meets an automaton once: what was found is settled before rows are filtered by it.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = find_overlaps(docs.select(row, "text"), items, window, cut=True)
    overlap = F.col("overlap")
    touched = F.size(overlap["spans"]) > 0
    share = F.aggregate(
        F.transform(overlap["spans"], lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x
    )
    values = {"touched": touched, "rest": overlap["rest"], "share": share, "n_words": overlap["n_words"]}
    stay = settle(found.drop("text"), values).filter(
        ~F.col("touched") | (100 * F.col("share") <= limits.max_percent * F.col("n_words"))
    )
    new = {c: F.col("row")[c] for c in docs.columns}
    for c in docs.columns:
        if c.lower() == "text":
            new[c] = F.when(F.col("touched"), F.col("rest")).otherwise(new[c])
        elif c == "n_chars":
            new[c] = F.when(F.col("touched"), F.length("rest")).otherwise(new[c]).cast(docs.schema[c].dataType)
    return stay.select(*[c.alias(name) for name, c in new.items()])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    ).select("doc_id", "overlap")
    spans, items = F.col("overlap.spans"), F.col("overlap.items")
    signed = F.transform(spans, lambda x, k: F.when(k % 2 == 1, x).otherwise(-x).cast("long"))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        F.col("overlap.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents)
),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM benchmark)
),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0
),
grams AS (
  SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM d, (SELECT DISTINCT k FROM wins) AS ks, unnest(range(1, len(ws) - k + 2)) AS t(i)
),
hits AS (SELECT g.rid, g.i, g.k, w.item_id FROM grams g JOIN wins w ON g.k = w.k AND g.win = w.win),
n_hit AS (SELECT rid, count(DISTINCT i + j) AS n FROM hits, unnest(range(0, k)) AS t(j) GROUP BY rid),
n_items AS (
  SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hit h USING (rid) LEFT JOIN n_items i USING (rid)
"""
