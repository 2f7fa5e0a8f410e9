"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). The most frequent words are
classes of their own; the others are hashed into classes, whose number grows with the corpus. The
class softmax has hashed features of the classes before: the last (n-gram), the one before that (skip) and
both together. Its weights are fitted by gradient updates: tasks add up the gradients of the contexts they hold.

Within a class the choice goes down a binary tree over its words, at each node by a softmax over the
two sides whose features are the words before: the last (n-gram), the one before that (skip) and both. Such
features belong to one class, so the events of a class are shuffled together; its task fits their weights by
Newton steps and scores with them. Feature tables grow with the events. Without features, words
would have their smoothed share of the class's tokens.

Counts of all words stay in a table. Only a bounded head of it (HEAD words) goes to the tasks; other
words are counted where the events of their class meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeassay.llm.common import discard, in_batches, release, remainder, shared, stable, table

#: Words whose counts are sent to the tasks, at most.
HEAD = 1 << 18
#: Counts of words (of a batch each) a task holds before it adds them up and hands them on.
COUNTED = 1_000_000
#: Cells of contexts and classes that are added up together.
CELLS = 1 << 18
#: Tokens whose cells a task holds before it counts them and hands them on.
HELD = 1 << 20
#: Tokens whose features are looked up at a time.
AT_ONCE = 1 << 16
#: Rows of weights whose gradients are added up together.
SLICE = 256
#: Groups that the rows of texts go through the shuffle in.
PASSED = 1024
#: What is said of an event: learned from, scored.
LEARN, SCORE = 1, 2
#: The token that ends a text; no word is empty.
END = b""


@dataclass(frozen=True)
class Shape:
    """Classes (single words, then hashed endings), rows of hashed features, and the training.

    An ending of 0 letters is the whole word. ``rounds`` and ``ridge`` are those of the words within classes.
    """

    single: int = 32
    hashed: int = 32
    ending: int = 3
    rows: int = 2048
    steps: int = 20
    rate: float = 0.5
    decay: float = 1e-6
    rounds: int = 2
    ridge: float = 1.0

    @classmethod
    def grown(cls, tokens: int) -> Shape:
        """Classes whose cells (two classes before, one class) are as many as a quarter of the tokens.

        Whole words are hashed, so that no class outgrows the others: a word that would is single.
        """
        classes = max(64, round((tokens / 4) ** (1 / 3)))
        return cls(single=classes // 3, hashed=classes - classes // 3, ending=0, rows=max(2048, 8 * classes))

    @property
    def classes(self) -> int:
        return self.single + self.hashed

    def hashed_class(self, word: bytes) -> int:
        return self.single + xxhash.xxh32_intdigest(word[-self.ending :]) % self.hashed


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def tokens_of(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


def _cut(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in turn (``tokens_of`` without ends), and how many each text has."""
    column = pa.array([t or b"" for t in texts], pa.binary()).view(pa.string())
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(column)))
    words, sizes = found.flatten(), pc.list_value_length(found).to_numpy().astype(np.int64)
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():  # what is split from a text without words is one empty word
        none = np.zeros(len(full) + 1, np.int64)
        np.cumsum(~full, out=none[1:])
        ends = np.cumsum(sizes)
        sizes = sizes - (none[ends] - none[ends - sizes])
        words = words.filter(pa.array(full))
    return words, sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n): how often each token occurs in ``docs``; added up in tasks first."""

    def added(held: list[pa.Table]) -> dict:
        total = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        return {"token": pa.array(total["token"].combine_chunks()), "n": total["n_sum"].combine_chunks()}

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[pa.Table] = []
        for b in batches:
            if not b["text"]:
                continue
            found = _cut(b["text"])[0].value_counts()
            ends = pa.table({"token": pa.array([END.decode()]), "n": pa.array([len(b["text"])], pa.int64())})
            held += [pa.table({"token": found.field(0), "n": found.field(1)}), ends]
            if sum(map(len, held)) > COUNTED:
                yield added(held)
                held = []
        if held:
            yield added(held)

    partial = in_batches(docs.select("text"), rows, "token string, n long")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame) -> dict[bytes, int]:
    """The end, and the most frequent words: all from a count on that at most HEAD words reach.

    The limit is found on sixteenths of powers of two, of which there are about a thousand.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r.n
        if total > HEAD:
            break
        least = r.step
    wanted = F.col("token") == END.decode()
    found = counts.filter(wanted if least is None else wanted | (step >= least)).toPandas()
    return {t.encode(): int(n) for t, n in zip(found["token"], found["n"], strict=True)}


@dataclass
class Vocabulary:
    """The head with its classes, logs and keys, and the totals."""

    shape: Shape
    words: pa.Array
    cls: np.ndarray
    log_count: np.ndarray
    key: np.ndarray
    n_tokens: int
    n_types: int

    @property
    def number(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words.cast(pa.binary()).to_pylist())}


def _vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    head = _head(counts)
    single = [END, *sorted((w for w in head if w != END), key=lambda w: (-head[w], w))[: shape.single - 1]]
    own = {w: k for k, w in enumerate(single)}
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
    words = list(head)
    cls = np.array([own[w] if w in own else shape.hashed_class(w) for w in words], np.int32)
    log_count = np.log10(np.array([head[w] for w in words], float) + 0.5)
    key = np.array([word_key(w) for w in words], np.uint64)
    return Vocabulary(shape, pa.array(words, pa.binary()).view(pa.string()), cls, log_count, key, total.n or 0, total.types)


class _Numbers:
    """Numbers of words: those of the head, the end, then the batch's others as they come."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        known = len(vocabulary.words)
        self.end = pc.index(vocabulary.words, END.decode()).as_py()
        self.end_known = self.end >= 0
        if not self.end_known:
            self.end = known
        self.fixed = max(known, self.end + 1)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Token numbers of all texts in turn, each text's first position, classes by number, new words."""
        words, sizes = _cut(texts)
        coded = words.dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.v.words), -1).to_numpy().copy()
        new = number < 0
        others = coded.dictionary.filter(pa.array(new)).view(pa.binary()).to_pylist()
        number[new] = self.fixed + np.arange(len(others), dtype=np.int32)
        last = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(words) + len(texts), bool)
        inner[last] = False
        numbers = np.full(len(inner), self.end, np.int32)
        numbers[inner] = number[coded.indices.to_numpy()]
        extra = [0] if not self.end_known else []
        cls = np.array(extra + [self.v.shape.hashed_class(w) for w in others], np.int32)
        return numbers, last - sizes, np.concatenate((self.v.cls, cls)), others


def _contexts(cls: np.ndarray, starts: np.ndarray, classes: int) -> np.ndarray:
    """For each token the number of its two classes before; a text begins after an end (class 0)."""
    before, earlier = _before(cls, starts, 0)
    return earlier * classes + before


def _before(values: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What the token before each has, and the one before that; a text begins after ends."""
    ends = np.full(2, end, values.dtype)
    before = np.concatenate((ends[:1], values[:-1]))
    earlier = np.concatenate((ends, values[:-2]))[: len(values)]
    earlier[starts] = end  # the token before a text is an end already
    return before, earlier


def _by_both(shape: Shape) -> np.ndarray:
    """All contexts, in order of the row that both classes before are hashed into."""
    return np.argsort(features(np.arange(shape.classes**2), shape)[:, 3], kind="stable")


def context_counts(docs: DataFrame, vocabulary: Callable[[], Vocabulary], shape: Shape) -> DataFrame:
    """How often each class follows each context, over all tokens of ``docs``: (n, contexts, cells), rows of contexts that
    follow each other in ``_by_both``. n is their sum; contexts are the contexts and their counts and numbers of
    cells, cells the counts and classes, in bytes."""
    size = shape.classes
    span = max(1, CELLS // size)  # contexts of a part
    kind = np.int32 if size**3 < 1 << 31 else np.int64

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        numbers = _Numbers(vocabulary())
        place = np.empty(size**2, np.int32)
        place[_by_both(shape)] = np.arange(size**2, dtype=np.int32)
        held: list[np.ndarray] = []

        def counted() -> dict:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            parts, first = np.unique(cell // (span * size), return_index=True)
            ends = [*first.tolist()[1:], len(cell)]
            both = np.empty((2, len(cell)), np.uint32)
            both[0], both[1] = cell % (span * size), n
            return {"part": parts.tolist(), "cells": [both[:, i:j].tobytes() for i, j in zip(first, ends, strict=True)]}

        for b in batches:
            if not b["text"]:
                continue
            found, starts, cls_of, _ = numbers.of(b["text"])
            cls = cls_of[found]
            held.append(place[_contexts(cls, starts, size)].astype(kind) * kind(size) + cls.astype(kind))
            if sum(map(len, held)) > HELD:
                yield counted()
        if held:
            yield counted()

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(span * size, np.int64)
        for cells in group.column("cells"):
            cell, n = np.frombuffer(cells.as_py(), np.uint32).reshape(2, -1)
            total[cell] += n
        cell = np.flatnonzero(total)
        of_context = total.reshape(span, size).sum(axis=1)
        at = np.flatnonzero(of_context)
        cells = np.bincount(cell // size, minlength=span)[at]
        context = _by_both(shape)[group.column("part")[0].as_py() * span + at]
        packed = [
            b"".join(x.astype(kind).tobytes() for x, kind in columns)
            for columns in (((of_context[at], np.int64), (context, np.int64), (cells, np.int64)), ((total[cell], np.int64), (cell % size, np.int32)))
        ]
        return pa.table({"n": pa.array([int(total.sum())], pa.int64()), **{k: pa.array([x], pa.binary()) for k, x in zip(("contexts", "cells"), packed, strict=True)}})

    partial = in_batches(docs.select("text"), rows, "part int, cells binary")
    return partial.groupBy("part").applyInArrow(added, "n long, contexts binary, cells binary")


def features(context: np.ndarray, shape: Shape) -> np.ndarray:
    """Rows of the weight matrix for each context: bias, class before, skip, and both hashed."""
    before, earlier = context % shape.classes, context // shape.classes
    fixed = 1 + 2 * shape.classes
    mixed = (context.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    both = fixed + (mixed >> np.uint64(40)).astype(np.int64) % (shape.rows - fixed)
    return np.stack([np.zeros_like(context), 1 + before, 1 + shape.classes + earlier, both], axis=1)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights[rows].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _summed(slices: DataFrame, shape: Shape, kind: type) -> np.ndarray:
    """Sums of rows of weights: (k, at, g) has rows ``at`` of the k-th slice, as numbers and floats of a kind in bytes."""
    classes = shape.classes

    def added(group: pa.Table) -> pa.Table:
        out = np.zeros((SLICE, classes))
        for at, part in zip(group.column("at").to_pylist(), group.column("g").to_pylist(), strict=True):
            out[np.frombuffer(at, np.int32)] += np.frombuffer(part, kind).reshape(-1, classes)
        return pa.table({"k": group.column("k").slice(0, 1), "g": pa.array([out.tobytes()], pa.binary())})

    total = np.zeros((-(-shape.rows // SLICE) * SLICE, classes))
    for r in slices.groupBy("k").applyInArrow(added, "k int, g binary").collect():
        total[r.k * SLICE : (r.k + 1) * SLICE] = np.frombuffer(r.g).reshape(SLICE, classes)
    return total[: shape.rows]


def _slices(out: np.ndarray, kind: type) -> Iterator[dict]:
    for k in range(0, len(out), SLICE):
        at = np.flatnonzero(out[k : k + SLICE].any(axis=1))
        if len(at):
            yield {"k": [k // SLICE], "at": [at.astype(np.int32).tobytes()], "g": [out[k + at].astype(kind).tobytes()]}


def train(contexts: DataFrame, shape: Shape) -> np.ndarray:
    """Weights (rows, classes) by full gradient steps with Adam's scaling.

    A gradient is what the model expects of each feature and class less what was counted, which is added up once.
    Each step is a job over the ``contexts`` (of ``context_counts``), whose size is bounded by the classes. A task returns one
    gradient in slices of SLICE rows, without the rows of other tasks' contexts; they are added up slice by slice.
    """
    spark = contexts.sparkSession
    weights = np.zeros((shape.rows, shape.classes))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    held = stable(contexts)
    total = held.agg(F.sum("n")).first()[0] or 0

    def counted(batches: Iterator[dict]) -> Iterator[dict]:
        out = np.zeros((shape.rows, shape.classes))
        for packed, cells in (x for b in batches for x in zip(b["contexts"], b["cells"], strict=True)):
            _, context, each = np.frombuffer(packed, np.int64).reshape(3, -1)
            n = np.frombuffer(cells, np.int64, len(cells) // 12)
            c = np.frombuffer(cells, np.int32, offset=n.nbytes)
            for row in features(context, shape).T:
                np.add.at(out.reshape(-1), np.repeat(row * shape.classes, each) + c, n)
        yield from _slices(out, np.float64)

    seen = _summed(in_batches(held.select("contexts", "cells"), counted, "k int, at binary, g binary"), shape, np.float64) if total else weights
    for step in range(1, shape.steps + 1 if total else 1):
        current = shared(spark, weights.astype(np.float32))

        def expected(batches: Iterator[dict], current: Callable = current) -> Iterator[dict]:
            w = current()
            out = np.zeros(w.shape)
            for packed in (x for b in batches for x in b["contexts"]):
                n, context, _ = np.frombuffer(packed, np.int64).reshape(3, -1)
                if not len(n):
                    continue
                rows = features(context, shape)
                p = w[rows[:, 3]]
                for row in rows.T[:3]:
                    p += w[row]
                p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                p *= (n / p.sum(axis=1)).astype(np.float32)[:, None]
                out[0] += p.sum(axis=0)
                for row in rows.T[1:]:
                    order = np.argsort(row, kind="stable")
                    at, first = np.unique(row[order], return_index=True)
                    out[at] += np.add.reduceat(p[order], first, axis=0)
            yield from _slices(out, np.float32)

        g = _summed(in_batches(held.select("contexts"), expected, "k int, at binary, g binary"), shape, np.float32) - seen
        g = g / total + shape.decay * weights
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        scaled = (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-9)
        weights = weights - shape.rate * (1 - (step - 1) / shape.steps) * scaled
    discard(held)
    return weights


def class_table(weights: np.ndarray, shape: Shape) -> np.ndarray:
    """log10 P(class | context) of every context; for few classes."""
    every = np.arange(shape.classes**2)
    return log_softmax(weights, features(every, shape)) / np.log(10)


def normalizers(weights: np.ndarray, shape: Shape) -> np.ndarray:
    """Of every context the log of the sum that the softmax divides by."""
    out = np.empty(shape.classes**2)
    for start in range(0, len(out), 4096):
        part = features(np.arange(start, min(start + 4096, len(out))), shape)
        out[start : start + 4096] = weights[part[:, 0], 0] + sum(weights[r, 0] for r in part.T[1:]) - log_softmax(weights, part)[:, 0]
    return out


def _tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree: (depth, leaf) the nodes from the root to each leaf, -1 below it, and the sides taken there;
    of each node the log of the second side's weight over the first's."""
    size = len(weights)
    order = np.argsort(weights, kind="stable")
    leaves, inner = weights[order].tolist(), []
    side, odds = np.zeros(2 * size - 1, bool), np.zeros(size - 1)
    up = [0] * (2 * size - 1)
    i = j = 0
    for node in range(size, 2 * size - 1):
        pair = []
        for second in (False, True):
            if i < size and (j >= len(inner) or leaves[i] <= inner[j]):
                child, weight, i = i, leaves[i], i + 1
            else:
                child, weight, j = size + j, inner[j], j + 1
            up[child], side[child] = node, second
            pair.append(weight)
        odds[node - size] = np.log(pair[1] / pair[0])
        inner.append(pair[0] + pair[1])
    depth = [0] * (2 * size - 1)
    for k in range(2 * size - 3, -1, -1):
        depth[k] = depth[up[k]] + 1
    parent, depths = np.array(up), np.array(depth)
    deepest = int(depths.max())
    nodes, sides = np.full((deepest, size), -1, np.int32), np.zeros((deepest, size), bool)
    at, leaf = np.arange(size), order
    while len(at := at[live := depths[at] > 0]):
        leaf = leaf[live]
        nodes[depths[at] - 1, leaf] = parent[at] - size
        sides[depths[at] - 1, leaf] = side[at]
        at = parent[at]
    return nodes, sides, odds


def _renumbered(ids: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 on in place of ``ids`` below ``size``, in their order, and how many there are."""
    held = np.zeros(size, bool)
    held[ids] = True
    number = np.cumsum(held, dtype=np.int32)
    number -= 1
    return number[ids], int(number[-1]) + 1 if size else 0


def _log_words(leaf: np.ndarray, words: np.ndarray, n: np.ndarray, weights: np.ndarray, shape: Shape) -> np.ndarray:
    """log P(leaf | words before) of distinct events, fitted to the first ones: those with a count in ``n``.

    ``words`` has a row for each family of features. A node's features are no other node's, so the
    tree is fitted level by level; a family's features exclude each other, so each has a Newton step of its own.
    Events share a node's feature if they have a word and all sides before in common.
    """
    nodes, sides, odds = _tree(weights)
    out = np.zeros(len(leaf))
    live = np.flatnonzero(nodes[0][leaf] >= 0) if len(nodes) else out[:0].astype(np.int64)
    features = []
    for w in words:
        held, at = np.unique(w[live], return_inverse=True)
        features.append((at.astype(np.int32), len(held)))
    for level in range(len(nodes)):
        node, y = nodes[level][leaf[live]], sides[level][leaf[live]]
        k = int(np.searchsorted(live, len(n)))
        z = odds[node]
        count, now = n[live[:k]], z[:k]
        right = count * y[:k]
        fitted = [np.zeros(size) for _, size in features]
        for _ in range(shape.rounds if k else 0):
            for w, (at, size) in zip(fitted, features, strict=True):
                at = at[:k]
                p = np.exp(-now)
                p += 1
                mass = count / p
                down = np.bincount(at, right - mass, size) - shape.ridge * w
                curve = np.bincount(at, mass - mass / p, size) + shape.ridge
                down /= curve
                np.clip(down, -2, 2, out=down)
                w += down
                now += down[at]
        for w, (at, _) in zip(fitted, features, strict=True):
            z[k:] += w[at[k:]]
        np.negative(z, out=z, where=y)
        out[live] -= np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
        if level + 1 < len(nodes):
            on = nodes[level + 1][leaf[live]] >= 0
            live, y = live[on], y[on]
            features = [_renumbered(2 * at[on] + y, 2 * size) for at, size in features]
    return out


def _class_scores(
    word: np.ndarray, before: np.ndarray, earlier: np.ndarray, learn: np.ndarray, shape: Shape
) -> tuple[np.ndarray, np.ndarray]:
    """Of a class's events how often the word occurs among those learned from, and log10 P(word | class, history).

    Words are numbered in the order of their keys."""
    counts = np.bincount(word[learn], minlength=int(word.max()) + 1 if len(word) else 0)
    words = np.flatnonzero(counts)
    if not len(words):
        return np.zeros(len(word), np.int64), np.zeros(len(word))
    leaves = np.full(len(counts), len(words), np.int32)  # the last is for words not seen
    leaves[words] = np.arange(len(words), dtype=np.int32)
    leaf = leaves[word]
    both = before * np.uint32(0xC2B2AE35) ^ earlier * np.uint32(0x27D4EB2F)
    both ^= both >> np.uint32(15)
    # Equal events are learned and scored as one, those to learn from first.
    event = (before.astype(np.uint64) << np.uint64(32) | earlier) * np.uint64(0x9E3779B97F4A7C15)
    event = (event ^ (event >> np.uint64(29))) + leaf.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(event)
    event = event[order]
    begins = np.concatenate(([True], event[1:] != event[:-1]))
    first = order[begins]
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(begins, dtype=np.int32) - np.int32(1)
    del event
    n = np.bincount(back, learn, len(first))
    order = np.argsort(n == 0, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    first, n = first[order], n[order]
    found = _log_words(
        leaf[first], np.stack([before[first], earlier[first], both[first]]), n[: np.count_nonzero(n)], np.append(counts[words] + 0.5, 0.5), shape
    )
    return counts[word], found[place[back]] / np.log(10)


def score_texts(docs: DataFrame, training: DataFrame, shape: Shape | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_tokens, n_known, train_tokens,
    base_score and score, with everything learned from the texts of ``training``.

    A null text has one token, the end. ``score`` is the model's log10 probability; a word that was
    not seen shares one slot of its class, as in the base all unseen words share one. Without a shape, the
    model's grows with the training tokens.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("learn"), F.lit(True).alias("scored"))
    learned = training.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("learn"), F.lit(False).alias("scored"))
    return score_marked(scored.union(learned), shape)


def score_marked(texts: DataFrame, shape: Shape | None = None) -> DataFrame:
    """``score_texts`` over one table (doc_id, text, learn, scored) of texts to learn from, to score or both."""
    spark = texts.sparkSession
    training = texts.filter("learn").select("text")
    counts = stable(word_counts(training))
    if shape is None:
        shape = Shape.grown(counts.agg(F.sum("n")).first()[0] or 0)
    found = _vocabulary(counts, shape)
    vocabulary, head_keys = shared(spark, found), shared(spark, found.key)
    discard(counts)
    weights = train(context_counts(training, vocabulary, shape), shape)
    release(spark)
    log_classes = shared(spark, (weights, normalizers(weights, shape)))
    log_total = float(np.log10(found.n_tokens + 0.5 * (found.n_types + 1)))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        v, numbers = vocabulary(), _Numbers(vocabulary())
        by_feature, sums = log_classes()
        size, known = shape.classes, len(v.cls)
        for b in batches:
            if not b["text"]:
                continue
            at, starts, cls_of, others = numbers.of(b["text"])
            cls = cls_of[at]
            lengths = np.diff(np.concatenate((starts, [len(at)])))
            in_head = at < known
            base = np.where(in_head, v.log_count[np.where(in_head, at, 0)], 0.0) if known else np.zeros(len(at))
            context = _contexts(cls, starts, size)
            of_class = -sums[context]
            for part in (slice(k, k + AT_ONCE) for k in range(0, len(at), AT_ONCE)):
                for r in features(context[part], shape).T:
                    of_class[part] += by_feature[r, cls[part]]
            row = np.array(b["row"], np.int64)
            scored = np.array(b["scored"], bool)
            ended = 0 if numbers.end_known else 1  # an end that was never seen: 0.5 tokens of the base
            summary = {
                "row": row,
                "doc_id": pa.array(b["doc_id"], pa.int64()),
                "n_tokens": lengths,
                "known": np.add.reduceat(in_head.astype(np.int64), starts),
                "base": np.add.reduceat(base, starts) + ended * np.log10(0.5) - lengths * log_total,
                "score": np.add.reduceat(of_class, starts) / np.log(10),
            }
            yield {
                "class": np.full(scored.sum(), -1 - (row[0] ^ row[0] >> 33) % PASSED).tolist(),
                **{name: pa.array(c).filter(pa.array(scored)) for name, c in summary.items()},
                "keys": pa.nulls(scored.sum(), pa.binary()),
                "events": pa.nulls(scored.sum(), pa.binary()),
            }
            # Words within classes: their events go to the class's task, those outside the head with their keys.
            end = [] if numbers.end_known else [END]
            new = np.array([word_key(w) for w in (*end, *others)], np.uint64)
            history = (np.concatenate((v.key, new)) >> np.uint64(32)).astype(np.uint32)[at]
            before, earlier = _before(history, starts, np.uint32(word_key(END) >> 32))
            by_class = np.argsort(cls_of[known:], kind="stable")
            classes = cls_of[known:][by_class]
            name = np.empty(known + len(new), np.uint32)  # outside the head: the place among the keys sent for the class
            name[:known] = np.arange(known)
            name[known + by_class] = known + np.arange(len(new)) - np.searchsorted(classes, classes)
            flags = LEARN * np.array(b["learn"], np.uint32) + SCORE * scored.astype(np.uint32)
            owner = np.repeat((row - row[0]).astype(np.uint32) * np.uint32(4) + flags, lengths)
            event = np.flatnonzero(cls >= shape.single)
            event = event[np.argsort(cls[event].astype(np.uint16), kind="stable")]
            columns = np.stack([c[event] for c in (owner, name[at], before, earlier)])
            held, first = np.unique(cls[event], return_index=True)
            ends = [*first.tolist()[1:], len(event)]
            if len(held):
                sent = zip(np.searchsorted(classes, held), np.searchsorted(classes, held, "right"), strict=True)
                none = pa.nulls(len(held), pa.int64())
                yield {
                    "class": held.tolist(),
                    "row": np.full(len(held), row[0]),
                    **{name: none for name in ("doc_id", "n_tokens", "known")},
                    "base": pa.nulls(len(held), pa.float64()),
                    "score": pa.nulls(len(held), pa.float64()),
                    "keys": [new[by_class[i:j]].tobytes() for i, j in sent],
                    "events": [columns[:, i:j].tobytes() for i, j in zip(first, ends, strict=True)],
                }

    def of_class(group: pa.Table) -> pa.Table:
        names = ["row", "doc_id", "n_tokens", "known", "base", "score"]
        if group.column("class")[0].as_py() < 0:
            return group.select(names)
        head = head_keys()
        known = len(head)
        new = [np.frombuffer(k.as_py(), np.uint64) for k in group.column("keys")]
        outside, place = np.unique(np.concatenate(new), return_inverse=True)
        place = (known + place).astype(np.uint32)
        size = sum(len(e.as_py()) for e in group.column("events")) // 16
        owner, word, before, earlier = columns = np.empty((4, size), np.uint32)
        rows, ends = [], []
        at = sent = 0
        for base_row, k, e in zip(group.column("row").to_pylist(), new, group.column("events"), strict=True):
            part = np.frombuffer(e.as_py(), np.uint32).reshape(4, -1)
            end = at + part.shape[1]
            columns[:, at:end] = part
            late = np.flatnonzero(part[1] >= known)
            word[at + late] = place[sent + (part[1][late] - np.uint32(known)).astype(np.int64)]
            rows.append(base_row)
            ends.append(end)
            at, sent = end, sent + len(k)
        # Words are numbered in the order of their keys.
        held = np.zeros(known + len(outside), bool)
        held[word] = True
        held = np.flatnonzero(held)
        number = np.empty(known + len(outside), np.int32)
        number[held[np.argsort(np.concatenate((head, outside))[held])]] = np.arange(len(held), dtype=np.int32)
        n, score = _class_scores(number[word], before, earlier, owner & LEARN > 0, shape)
        scored = np.flatnonzero(owner & SCORE)
        # A part's events are in order of their rows.
        row = np.repeat(np.array(rows), np.diff([0, *ends]))[scored] + (owner[scored] >> 2)
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))[: len(row)])
        n, score, late = n[scored], score[scored], word[scored] >= known  # the others are in the base already
        none = pa.nulls(len(begins), pa.int64())
        known_n, base, score = (
            pa.array(np.add.reduceat(x, begins).astype(kind) if len(begins) else np.zeros(0, kind))
            for x, kind in ((late & (n > 0), np.int64), (np.where(late, np.log10(n + 0.5), 0), float), (score, float))
        )
        return pa.table(dict(zip(names, [pa.array(row[begins]), none, none, known_n, base, score], strict=True)))

    result = "row long, doc_id long, n_tokens long, known long, base double, score double"
    keyed = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "learn", "scored")
    parts = in_batches(keyed, rows, f"class int, {result}, keys binary, events binary")
    return (
        parts.groupBy("class")
        .applyInArrow(of_class, result)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .select("doc_id", "n_tokens", "n_known", F.lit(found.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )


def held_out(doc_id: str = "doc_id"):
    return remainder(doc_id, 5) == 1


def op6_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    scored = score_marked(docs.select("doc_id", "text", (~F.col("held_out")).alias("learn"), F.lit(True).alias("scored")))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
