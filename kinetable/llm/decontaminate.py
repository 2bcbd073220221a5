"""Benchmark decontamination by BM25 over an inverted index of test items, searched with block-max WAND.

The index holds each test item's words with their BM25 weights, divided by the item's own total, so that an item
scores 1 against itself; document frequencies and the mean length are of the whole benchmark.  Items are in blocks of
``BLOCK``, and each word has a largest weight of all and one for each block.  Every document is cut into overlapping
passages that cover it whole, and many passages are searched at once, in the steps of the pivot test.  A passage whose
words' largest weights don't sum up to the threshold is passed over; of the others the largest weights in each block
are summed, ``WIDTH`` blocks at a time, and blocks that don't reach the threshold are skipped; in the blocks that do, the
postings of the passage's words are met and items are scored in full.  All items that score at least as much are found.

For each of these, question and answer must both overlap with the passage: so large a share of their words must stand in
runs of ``RUN`` words that the passage has too.  An item of fewer than ``RUN`` words must stand there word for word,
question and answer in a row.

The documents are only read: nothing is shuffled.  The index is held in memory, so items are taken ``INDEX_WORDS``
words at a time; a larger benchmark takes several passes over the documents, with the same scores.

Null and empty texts match nothing, nor do items without words.  Repeated rows give repeated results; a null doc_id is
kept as null; an empty table, or an empty benchmark, gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm import tokens
from kinetable.llm.common import filter_texts, map_texts, stored

K1, B = 1.2, 0.75
#: The share of an item's own BM25 score, and of the words of its question and of its answer.
SCORE, OVERLAP = 0.5, 0.6
RUN = 5
#: Items of a block; words of a stride, at least; words of the items of a pass, which bound the index.
BLOCK, STRIDE, INDEX_WORDS = 4, 64, 2_000_000
#: Test items that the driver reads for a pass.
ITEMS = 20_000
#: Words in so many of the blocks are multiplied as a dense matrix; blocks whose sums are held at once.
COMMON, WIDTH = 0.25, 512
#: Pairs of a passage and a block that are scored at once.
PAIRS = 20_000
_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*:|(?<=\?)", re.IGNORECASE)


def question_and_answer(text: str) -> tuple[str, str]:
    """A stated answer, or what follows the first question mark; without either, the last third of the words."""
    if (m := _ANSWER.search(text)) and text[: m.start()].strip() and text[m.end() :].strip():
        return text[: m.start()], text[m.end() :]
    words = text.split()
    at = len(words) - len(words) // 3
    return " ".join(words[:at]), " ".join(words[at:])


@dataclass(frozen=True)
class Collection:
    """What weights depend on: the items of the whole benchmark, their mean length, and the items that have each word."""

    n: int
    mean: float
    words: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Collection:
        words, df = np.unique(np.concatenate([np.unique(x) for x in items]), return_counts=True)
        return cls(len(items), max(1.0, float(np.mean([len(x) for x in items]))), words, df)

    def idf(self, words: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.words, words)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


@dataclass
class Index:
    """Items of similar length: BM25 postings with block maxima; ``stride`` words are no fewer than those of any item.

    The postings of term t are ``items[first[t]:first[t + 1]]`` with ``weights``.
    """

    ids: list
    question: list[np.ndarray]
    answer: list[np.ndarray]
    stride: int
    collection: Collection

    def __post_init__(self) -> None:
        own = [np.concatenate([q, a]) for q, a in zip(self.question, self.answer, strict=True)]
        self.terms, n = np.unique(np.concatenate(own)), len(own)
        idf = self.collection.idf(self.terms)
        found = [np.unique(np.searchsorted(self.terms, x), return_counts=True) for x in own]
        term, tf = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        item = np.repeat(np.arange(n), [len(t) for t, _ in found])
        length = np.array([len(x) for x in own])[item] / self.collection.mean
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        weight /= np.bincount(item, weight, n)[item]
        order = np.lexsort((item, term))
        term, self.items, self.weights = term[order], item[order], weight[order]
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weights, self.first[:-1])
        # Of each term the blocks that it occurs in, the largest weight there, and where its postings there begin.
        block = self.items // BLOCK
        start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        self.block_most, self.block_at = np.maximum.reduceat(self.weights, start), np.append(start, len(term))
        blocks, block_first = block[start], np.searchsorted(term[start], np.arange(len(self.terms) + 1))
        self.n_blocks = -(-n // BLOCK)
        self.block_key = term[start] * self.n_blocks + blocks
        count = np.diff(block_first)
        wide = count >= max(2, COMMON * self.n_blocks)
        #: Of each common word its row in the dense matrix; else -1.
        self.row = np.where(wide, np.cumsum(wide) - 1, -1)
        self.dense = np.zeros((int(wide.sum()), self.n_blocks), np.float32)
        at = np.repeat(np.arange(len(self.terms)), count)
        self.dense[self.row[at[wide[at]]], blocks[wide[at]]] = self.block_most[wide[at]]
        self.rare_n = np.where(wide, 0, count)
        self.rare_first = np.cumsum(self.rare_n) - self.rare_n
        self.rare_block, self.rare_most = blocks[~wide[at]], self.block_most[~wide[at]]
        bits = max(12, int(16 * len(self.terms)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (self.terms >> self.shift).astype(np.int64)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[slot] = np.arange(len(self.terms))
        self.crowded = np.bincount(slot, minlength=1 << bits) > 1
        self.runs = [(runs_of(q), runs_of(a)) for q, a in zip(self.question, self.answer, strict=True)]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the terms, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        found = self.slots[slot]
        wrong = self.terms[found] != hashes
        again = np.flatnonzero(wrong & self.crowded[slot])
        found = found.copy()
        found[wrong] = -1
        at = np.minimum(np.searchsorted(self.terms, hashes[again]), len(self.terms) - 1)
        found[again] = np.where(self.terms[at] == hashes[again], at, -1)
        return found

    def bounds(self, passage: np.ndarray, term: np.ndarray, n: int, start: int, width: int) -> np.ndarray:
        """(n, width): the sums of the largest weights of each passage's terms in blocks from ``start`` on."""
        row = self.row[term]
        there = np.zeros((n, len(self.dense)), np.float32)
        there[passage[row >= 0], row[row >= 0]] = 1
        count = self.rare_n[term]
        at = np.repeat(self.rare_first[term] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        block, owner = self.rare_block[at] - start, np.repeat(passage, count)
        own = (block >= 0) & (block < width)
        out = np.bincount(owner[own] * width + block[own], self.rare_most[at[own]], n * width).astype(float).reshape(n, width)  # of nothing: whole numbers
        return out + there @ self.dense[:, start : start + width]

    def search(self, passage: np.ndarray, term: np.ndarray, n: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n passages with these distinct terms, in order of passages: the passage, item and score of all that score at least ``least``."""
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        hopeful = np.bincount(passage, self.most[term], n).astype(float) >= least - 1e-9
        own = hopeful[passage]
        which, passage, term = np.flatnonzero(hopeful), (np.cumsum(hopeful) - 1)[passage[own]], term[own]
        first = np.searchsorted(passage, np.arange(len(which) + 1))
        for start in range(0, self.n_blocks, WIDTH):
            width = min(WIDTH, self.n_blocks - start)
            who, block = np.nonzero(self.bounds(passage, term, len(which), start, width) >= least - 1e-5)
            for at in range(0, len(who), PAIRS):
                p, b = who[at : at + PAIRS], block[at : at + PAIRS] + start
                size = first[p + 1] - first[p]
                t = term[np.repeat(first[p] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                key = t * self.n_blocks + np.repeat(b, size)
                i = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
                held = self.block_key[i] == key
                i, pair = i[held], np.repeat(np.arange(len(p)), size)[held]
                size = self.block_at[i + 1] - self.block_at[i]
                j = np.repeat(self.block_at[i] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                cell = np.repeat(pair, size) * BLOCK + self.items[j] % BLOCK
                score = np.bincount(cell, self.weights[j], len(p) * BLOCK).astype(float)
                hit = np.flatnonzero(score >= least - 1e-9)
                found.append((which[p[hit // BLOCK]], b[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words, or of all words if they are fewer."""
    size = min(RUN, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    weights = tokens.powers(0xE7037ED1A0B428DB, size)
    return tokens.mix((np.lib.stride_tricks.sliding_window_view(words, size) * weights).sum(1, dtype=np.uint64) + np.uint64(size))


def overlap(runs: np.ndarray, n: int, passage: dict[int, set[int]]) -> float:
    """The share of the ``n`` words that stand in runs which the passage has."""
    size = min(RUN, n)
    if not size:
        return 1.0
    held = np.zeros(n, bool)
    for i, h in enumerate(runs.tolist()):
        if h in passage[size]:
            held[i : i + size] = True
    return float(held.mean())


class Passages(dict):
    """The runs of a passage's words by their size, made when asked for."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __missing__(self, size: int) -> set[int]:
        own = np.lib.stride_tricks.sliding_window_view(self.words, size) if len(self.words) >= size else np.zeros((0, size), np.uint64)
        self[size] = set(tokens.mix((own * tokens.powers(0xE7037ED1A0B428DB, size)).sum(1, dtype=np.uint64) + np.uint64(size)).tolist())
        return self[size]


#: Segments whose bounds are summed at once.
LANES = 2048


def matches(words: tokens.Words, index: Index, score: float, least: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item) to the best score, and the overlaps of question and answer there."""
    known = index.lookup(words.hashes)
    stride, counts = index.stride, words.counts
    owner = np.repeat(np.arange(words.n), counts)
    # Segments of a stride; a passage is a segment and the next one of the same text.
    n_segments = -(-counts // stride)
    first = np.cumsum(n_segments) - n_segments
    segment = first[owner] + (np.arange(len(known)) - words.first[owner]) // stride
    whose = np.repeat(np.arange(words.n), n_segments)
    hits = known >= 0
    known_at, segment_at = known[hits], segment[hits]
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for a in range(0, len(whose), LANES):
        z = min(a + LANES + 1, len(whose))  # one more, for the last one's passage
        lo, hi = np.searchsorted(segment_at, [a, z])
        follows = np.append(whose[a : z - 1] == whose[a + 1 : z], False)
        # Each passage has the terms of its segment and of the next.
        own, t = segment_at[lo:hi] - a, known_at[lo:hi]
        again = (own > 0) & follows[own - 1]
        key = np.unique(np.concatenate([own, own[again] - 1]) * len(index.terms) + np.concatenate([t, t[again]]))
        key = key[key < LANES * len(index.terms)]
        passages: dict[int, Passages] = {}
        for s, item, x in zip(*(v.tolist() for v in index.search(key // len(index.terms), key % len(index.terms), LANES, score)), strict=True):
            i = int(whose[a + s])
            start = int(words.first[i]) + (a + s - int(first[i])) * stride
            if s not in passages:
                passages[s] = Passages(words.hashes[start : min(start + 2 * stride, int(words.first[i + 1]))])
            q, r = overlaps(index, item, passages[s])
            if min(q, r) >= least:
                found[i, item] = max(found.get((i, item), (0.0, 0.0, 0.0)), (min(1.0, x), q, r))
    return found


def overlaps(index: Index, item: int, passage: Passages) -> tuple[float, float]:
    """Of question and of answer; a short item is there whole or not at all."""
    question, answer = index.question[item], index.answer[item]
    if len(question) + len(answer) < RUN:
        whole = np.concatenate([question, answer])
        return (1.0, 1.0) if int(runs_of(whole)[0]) in passage[len(whole)] else (0.0, 0.0)
    return overlap(index.runs[item][0], len(question), passage), overlap(index.runs[item][1], len(answer), passage)


Item = tuple[object, np.ndarray, np.ndarray]


def hashed(rows: list[tuple]) -> list[Item]:
    """(id, question, answer) with the hashes of the words, of those that have any, in an order that depends on them alone."""
    out = [(i, tokens.words_of([q]).hashes, tokens.words_of([a]).hashes) for i, q, a in sorted(rows, key=lambda r: (r[1], r[2], str(r[0])))]
    return [x for x in out if len(x[1]) + len(x[2])]


def indexes(items: list[Item], collection: Collection, most_words: int = INDEX_WORDS) -> Iterator[list[Index]]:
    """Passes of indexes, each of items whose lengths are of one power of two."""
    sized: dict[int, list[Item]] = {}
    for x in items:
        sized.setdefault(max(STRIDE, 1 << (len(x[1]) + len(x[2]) - 1).bit_length()), []).append(x)
    part, size = [], 0
    for stride, own in sorted(sized.items()):
        start = 0
        while start < len(own):
            stop, here = start, 0
            while stop < len(own) and (stop == start or size + here + len(own[stop][1]) + len(own[stop][2]) <= most_words):
                here += len(own[stop][1]) + len(own[stop][2])
                stop += 1
            part.append(Index(*map(list, zip(*own[start:stop], strict=True)), stride, collection))
            size, start = size + here, stop
            if size >= most_words or start < len(own):
                yield part
                part, size = [], 0
    if part:
        yield part


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item, and once, under a null word, its length."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        word, n = [], []
        for row in zip(*columns, strict=True):
            own = np.concatenate([tokens.words_of([x]).hashes for x in row])
            if len(own):
                word += [None, *np.unique(own).view(np.int64).tolist()]
                n += [len(own), *[1] * len(np.unique(own))]
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])


def collection_of(counts: DataFrame, items: list[Item]) -> Collection:
    """The whole benchmark's numbers from (word, n, items), with the frequencies of these items' words (no more than a pass holds)."""
    whole = counts.filter("word is null").first()
    own = np.unique(np.concatenate([np.concatenate(x[1:]) for x in items]))
    wanted = counts.sparkSession.createDataFrame(pa.table({"word": own.view(np.int64)}))
    df = counts.join(wanted, "word").select("word", "items").toArrow()
    word = df.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Collection(whole["items"], max(1.0, whole["n"] / whole["items"]), word[order], df.column("items").to_numpy()[order])


def passes(benchmark: DataFrame, items_per_pass: int = ITEMS) -> Iterator[list[Index]]:
    """The indexes over (item_id, text), or (item_id, question, answer), as many at a time as memory is set aside for."""
    parts = {"question", "answer"} <= {*benchmark.columns}
    items = benchmark.select("item_id", *(["question", "answer"] if parts else ["text"]))
    k = -(-items.count() // items_per_pass)
    counts = None
    if k > 1:
        counts = items.select(*items.columns[1:]).mapInArrow(_words_of_items, "word bigint, n bigint")
        counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("items")), "frequencies")
    for j in range(k):
        own = items if k == 1 else items.filter(F.pmod(F.xxhash64(*items.columns), F.lit(k)) == j)
        rows = hashed([(r[0], *((r[1] or "", r[2] or "") if parts else question_and_answer(r[1] or ""))) for r in own.toLocalIterator()])
        if rows:
            yield from indexes(rows, Collection.of([np.concatenate(x[1:]) for x in rows]) if counts is None else collection_of(counts, rows))


def leaks_of(texts: list, held: list[Index], score: float, least: float) -> list[list[dict]]:
    """For each text the items that it holds."""
    leaks: list[list[dict]] = [[] for _ in texts]
    for own in tokens.blocks(texts):
        words = tokens.words_of(texts[own])
        for index in held:
            for (i, item), (x, q, a) in sorted(matches(words, index, score, least).items()):
                leaks[own.start + i].append({"item_id": index.ids[item], "score": x, "question_overlap": q, "answer_overlap": a})
    return leaks


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, least: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each test item that a row of (doc_id, text) holds."""
    kind = f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},score:double,question_overlap:double,answer_overlap:double>>"

    def found(held: list[Index]) -> DataFrame:
        rows = map_texts(docs, ["doc_id"], f"leaks {kind}", lambda texts: [leaks_of(texts, held, score, least)])
        return rows.select("doc_id", F.inline("leaks"))

    every = [found(held) for held in passes(benchmark)]
    return reduce(DataFrame.union, every) if every else docs.select("doc_id", F.inline(F.array().cast(kind)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, least: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no test item."""

    def clean(held: list[Index]) -> DataFrame:
        return filter_texts(docs, lambda texts: [not x for x in leaks_of(texts, held, score, least)])

    for held in passes(benchmark):
        docs = clean(held)
    return docs
