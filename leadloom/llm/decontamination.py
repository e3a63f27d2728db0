"""Benchmark decontamination: edit-tolerant search of benchmark items in documents.

Texts are sequences of words. The random-walk embedding of Chakraborty, Goldenberg and Koucky reads a sequence
with a pointer: step ``j`` outputs the word under the pointer and moves on if a random bit, drawn for the step
and the word, is 1. Sequences at a small edit distance then mostly output the same words at the same steps, so
edit distance becomes Hamming distance. Each repetition draws its own bits and samples coordinates of the
embedding; an item-sized window of a document is a candidate if it agrees with an item in all of them.
Repetitions start at places spread over the whole items, so an edit in one place does not spoil all of them. There
are as many of them as find the target share of a sample of the items, edited as far as a match may be.

Windows start at every word. Those whose first coordinate is no item's are left out before the walk goes on,
and so on from coordinate to coordinate; what agrees in all is verified by exact edit distance in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import slices, text_of
from leadloom.llm.word_hashes import hash_words

#: Share of an item's words that may be edited in a match.
EDITS = 0.2
#: Share of passages with that many edits that repetitions must find, and the range of how many there may be.
TARGET, REPETITIONS = 0.99, (24, 96)
#: Items on which the share is measured, and edited copies of each.
MEASURED, COPIES = 500, 2
#: The range of steps that each further coordinate is drawn from.
LATER = ((1, 4), (4, 16))
#: Bytes of benchmark text that are searched for at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20


def best_match(item: list[int], window: list[int]) -> tuple[int, int]:
    """The least number of word edits that turn ``item`` into a part of ``window``, and where that part ends.

    Myers' bit vectors: one column of the edit matrix per word of the window.
    """
    n = len(item)
    if not n:
        return 0, 0
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, word in enumerate(window):
        eq = masks.get(word, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(zero | up) & full, up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(zero | plus) & full, plus & zero
        if score < best:
            best, end = score, j + 1
    return best, end


def laid_out(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, where each begins, and its words; a gap of zeros keeps walks from one text out of the next."""
    gap = LATER[-1][1] + 1
    begins = np.cumsum(counts) - counts + gap * np.arange(len(counts))
    codes = np.zeros(len(words) + gap * len(counts), np.int32)
    codes[np.arange(len(words)) + gap * np.repeat(np.arange(len(counts)), counts)] = words
    return codes, begins, counts


def edited(words: list[int], edits: int, random: np.random.Generator) -> list[int]:
    """``words`` after that many substitutions, insertions and deletions by an unknown word, as often each."""
    out = list(words)
    for kind, place in zip(random.integers(0, 3, edits).tolist(), random.random(edits).tolist()):
        at = int(place * len(out))
        if kind == 0 and out:
            out[at] = 0
        elif kind == 1:
            out.insert(at, 0)
        elif len(out) > 1:
            del out[at]
    return out


class Index:
    """Items of one block, and the sampled coordinates of their embeddings in each repetition."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 7):
        hashes, counts = hash_words([text for _, text in items])
        self.vocabulary = np.unique(hashes)
        codes = np.searchsorted(self.vocabulary, hashes) + 1 if len(hashes) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        self.ids = [i for (i, _), n in zip(items, counts) if n]
        self.words = [codes[e - n : e].tolist() for e, n in zip(ends, counts) if n]
        self.sets = [set(w) for w in self.words]
        size = len(self.vocabulary) + 1
        self.common = np.bincount(codes, minlength=size)
        self.passes: list[tuple] = []
        self.recall = self._repeat(np.random.default_rng(seed), size)

    def _repeat(self, random: np.random.Generator, size: int) -> float:
        """Add repetitions until they find the target share of edited items; the share that they find."""
        picked = np.linspace(0, len(self.words) - 1, min(MEASURED, len(self.words))).astype(int).repeat(COPIES)
        texts = [edited(self.words[k], int(EDITS * len(self.words[k])), random) for k in picked]
        codes, begins, _ = laid_out(np.array([c for t in texts for c in t], np.int64), np.array([len(t) for t in texts], np.int64))
        found, share = np.zeros(len(texts), bool), 1.0
        for r in range(REPETITIONS[1]):
            self.passes.append(self._prepare(random, r, size))
            if len(texts):
                got = list(self._candidates(codes, self.passes[-1]))
                text = np.searchsorted(begins, [max(start, 0) + 1 + len(self.words[item]) // 4 for start, item in got], side="right") - 1
                for t, (_, item) in zip(text.tolist(), got):
                    found[t] |= picked[t] == item
                share = float(found.mean())
            if r + 1 >= REPETITIONS[0] and share >= TARGET:
                break
        return share

    def _prepare(self, random: np.random.Generator, repetition: int, size: int):
        """Bits by step, sampled steps, and what items output there: at first, at first and second, at all."""
        samples = [int(random.integers(low, high)) for low, high in LATER]
        bits = random.integers(0, 2, (samples[-1], size)).astype(np.int8)
        share = int(f"{repetition + 1:010b}"[::-1], 2) / 1024  # any number of repetitions is spread evenly
        first = np.zeros(size, bool)
        stages: list[dict[tuple[int, ...], list[tuple[int, int]]]] = [{} for _ in samples]
        done: list[dict[tuple[int, ...], list[tuple[int, int]]]] = [{} for _ in range(len(samples) + 1)]
        for k, words in enumerate(self.words):
            # Start at the word of the next few that the benchmark holds least: fewer windows begin like it.
            near = int(share * max(1, len(words) - 3))
            offset = min(range(near, min(near + 4, len(words))), key=lambda i: (self.common[words[i]], i))
            key, at, step = (words[offset],), offset, 0
            first[words[offset]] = True
            for n, sample in enumerate(samples):
                while step < sample and at < len(words):
                    at += int(bits[step, words[at]])
                    step += 1
                if at >= len(words):  # the walk leaves a short item: what it has output is its key
                    done[n].setdefault(key, []).append((k, offset))
                    break
                key += (words[at],)
                stages[n].setdefault(key, [])
            else:
                done[-1].setdefault(key, []).append((k, offset))
        wide = np.int64(size)
        pack = lambda key: int(sum(int(c) * int(wide) ** i for i, c in enumerate(key)))
        known = [np.array(sorted(pack(k) for k in s), np.int64) for s in stages]
        finished = [{pack(k): v for k, v in d.items()} for d in done]
        return bits, samples, first, known, finished, wide

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(position of the item's start, item)`` for every window that agrees in all coordinates.

        ``codes`` ends with as many zeros as a walk may go on. Zero is any word outside the benchmark.
        """
        for one in self.passes:
            yield from self._candidates(codes, one)

    def _candidates(self, codes: np.ndarray, one: tuple) -> Iterator[tuple[int, int]]:
        bits, samples, first, known, finished, wide = one
        start = np.flatnonzero(first[codes])
        at, key, step, scale = start, codes[start].astype(np.int64), 0, wide
        yield from self._found(finished[0], key, start)
        for n, sample in enumerate(samples):
            while step < sample:
                at = at + bits[step][codes[at]]
                step += 1
            key = key + codes[at] * scale
            scale = scale * wide
            place = np.searchsorted(known[n], key)
            place[place == len(known[n])] = 0
            agree = known[n][place] == key if len(known[n]) else np.zeros(len(key), bool)
            start, at, key = start[agree], at[agree], key[agree]
            yield from self._found(finished[n + 1], key, start)

    @staticmethod
    def _found(finished: dict[int, list[tuple[int, int]]], keys: np.ndarray, starts: np.ndarray):
        if not finished or not len(keys):
            return
        wanted = np.isin(keys, np.fromiter(finished, np.int64, len(finished)))
        for key, start in zip(keys[wanted].tolist(), starts[wanted].tolist()):
            for item, offset in finished[key]:
                yield start - offset, item

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, edits, words of the item, first word in the text)``, the best match of each pair."""
        hashes, counts = hash_words(texts)
        if not len(hashes) or not len(self.vocabulary):
            return []
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        known = np.where(self.vocabulary[place] == hashes, place + 1, 0)
        codes, begins, counts = laid_out(known, counts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for start, item in self.candidates(codes):
            if (start, item) in tried:
                continue
            tried.add((start, item))
            words = self.words[item]
            n, most = len(words), int(EDITS * len(words))
            text = int(np.searchsorted(begins, max(start, 0) + most, side="right")) - 1
            low = max(int(begins[text]), start - most)
            high = min(int(begins[text] + counts[text]), start + n + most)
            held = best.get((text, item))
            if held and held[0] == 0 or high - low < n - most:
                continue
            window = codes[low:high].tolist()
            # Each edit takes at most one word of the item away.
            inside = self.sets[item]
            if sum(map(inside.__contains__, window)) < n - most:
                continue
            edits, end = best_match(words, window)
            if edits > most:
                continue
            back, length = best_match(words[::-1], window[:end][::-1])
            found = (edits, low + end - length - int(begins[text]))
            if not held or found < held:
                best[text, item] = found
        return [(t, self.ids[i], e, len(self.words[i]), at) for (t, i), (e, at) in sorted(best.items())]


SCHEMA = "doc_id bigint, item_id bigint, edits int, n_words int, first_word bigint"


def blocks_of(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time while a search is set up."""
    known = text_of(benchmark.where(F.col("item_id").isNotNull()), F.col("item_id").cast("long").alias("item_id"))
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + int(total) // BLOCK_BYTES
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield sorted((r.item_id, r.text) for r in rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, edits, n_words, first_word)``: the best match of each item in each row of ``docs``.

    A match needs word edits of at most a fifth of the item's words, insertions counting too. Null texts and
    texts or items without words match nothing; rows that repeat give rows that repeat; an empty table on
    either side gives no rows; other columns are not read. Nothing is shuffled. A benchmark larger than a
    block is searched block by block, with one pass over the documents for each.
    """
    spark = docs.sparkSession
    rows = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    found = None
    for items in blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch):
                    got = shared.value.matches(some.column("text").to_pylist())
                    columns = list(zip(*got)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([
                        some.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64()),
                    ], names=["doc_id", "item_id", "edits", "n_words", "first_word"])

        part = rows.mapInArrow(run, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, without any benchmark item; odd rows as in ``contaminated``."""
    kept = docs
    for items in blocks_of(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch):
                    hit = {m[0] for m in shared.value.matches([t or "" for t in some.column("text").to_pylist()])}
                    yield some.filter(pa.array([k not in hit for k in range(some.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
