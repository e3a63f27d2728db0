"""Whole-text encoding with the tokenizers library that encodes each distinct chunk once.

The byte-level split never puts a space that a non-space follows into the same word as what stands before
it. A text may therefore be cut before each such space, and the encodings of the chunks, in order, are the
encoding of the whole text. Most chunks repeat, so they are looked up instead of encoded again. The byte-level split
makes two words at most of Latin letters and ASCII marks behind them, which therefore go to the library's model directly.
"""

from __future__ import annotations

import re

import numpy as np

CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" \s| \Z")
#: ASCII marks but the apostrophe, which can begin a word with letters.
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
PLAIN = re.compile(f"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[{re.escape(MARKS)}]*")
#: The byte-level alphabet's characters of the bytes that do not stand for themselves in it.
ALPHABET = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Characters that go to the library at once.
PORTION = 100_000


def tokenizer_path(path: str | None, name: str) -> str:
    """``path``, or else the place of the public tokenizer ``name`` on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """The chunks of a text, those after the first without the space they begin with."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of all runs, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Places(dict):
    """Numbers given to keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        self.new.append(key)
        return place


class ChunkEncoder:
    """Ids of whole texts under a byte-level tokenizer file.

    At most about ``limit`` distinct chunks are remembered; beyond them the memory starts anew.
    """

    def __init__(self, path: str, limit: int = 1_300_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        #: Bytes of text that each id stands for.
        self.bytes_of = np.array([
            len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i) or "") for i in range(size)
        ], np.int64)
        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        #: Whether nothing but the byte-level split stands between a plain chunk and the model.
        self.direct = (
            isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
            and self.tokenizer.normalizer is None and isinstance(model, models.BPE) and not model.dropout
            and not any(re.fullmatch(f" ?[^\\W\\d_]*[{re.escape(MARKS)}]*", c) for c in special.values()))
        self.marks: dict[str, list[int]] = {}
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.places.new = []
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint16 if len(self.bytes_of) <= 65536 else np.int32)
        self.n, self.used = 0, 0

    def _encode_apart(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, encoded as one text per portion, and the number of ids of each."""
        texts, size, part = [], 0, []
        for chunk in chunks:
            part.append(chunk)
            size += len(chunk)
            if size > PORTION:
                texts.append("".join(part))
                part, size = [], 0
        texts.append("".join(part))
        ids = [np.array(e.ids, np.int64) for t in texts for e in self.tokenizer.encode_batch_fast([t], add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        reached = np.cumsum(self.bytes_of[ids])
        counts = np.searchsorted(reached, ends, side="right")
        counts[1:] -= counts[:-1].copy()
        return ids, counts

    def _encode_plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks as ``PLAIN`` has them, a space before each, and the number of ids of each."""
        tokenize, ids, counts = self.tokenizer.model.tokenize, [], []
        for chunk in chunks:
            word = chunk.rstrip(MARKS)
            marks = chunk[len(word) :]
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(ALPHABET)
            own = [t.id for t in tokenize("\u0120" + word)]
            if marks:
                if marks not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks.clear()
                    self.marks[marks] = [t.id for t in tokenize(marks)]
                own += self.marks[marks]
            ids += own
            counts.append(len(own))
        return np.array(ids, np.int64), np.array(counts, np.int64)

    def _encode_first(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of first chunks of texts, without the mark before each, and the number of ids of each."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast([c[1:] for c in chunks], add_special_tokens=False)]
        return np.array([x for i in own for x in i], np.int64), np.array([len(i) for i in own], np.int64)

    def _learn(self) -> None:
        # First chunks of texts are told apart by a mark before them, as they have no space.
        chunks = self.places.new
        plain = PLAIN.fullmatch if self.direct else lambda c: None
        kinds = np.array([0 if c[:1] == "\0" else 1 if plain(c) else 2 for c in chunks], np.int8)
        all_counts, all_starts, parts, taken = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), [], 0
        for kind, encode in enumerate((self._encode_first, self._encode_plain, self._encode_apart)):
            own = [chunks[i] for i in np.flatnonzero(kinds == kind).tolist()]
            if own:
                ids, counts = encode([" " + c for c in own] if kind == 2 else own)
                all_counts[kinds == kind] = counts
                all_starts[kinds == kind] = np.cumsum(counts) - counts + taken
                parts.append(ids)
                taken += len(ids)
        n = self.n + len(chunks)
        self.lengths = grown(self.lengths, n)
        self.starts = grown(self.starts, n)
        self.lengths[self.n : n] = all_counts
        self.starts[self.n : n] = all_starts + self.used
        end = self.used + taken
        self.ids = grown(self.ids, end)
        self.ids[self.used : end] = np.concatenate(parts)
        self.n, self.used, self.places.new = n, end, []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        if self.n > self.limit:
            self.forget()
        get, per_text = self.places.__getitem__, []
        for text in texts:
            pieces = cut(text)
            # A mark in the text itself is no first chunk's mark.
            if "\0" in text:
                pieces = ["\0" + text]
            else:
                pieces[0] = "\0" + pieces[0]
            per_text.append(np.fromiter(map(get, pieces), np.int32, len(pieces)))
        if self.places.new:
            self._learn()
        index = np.concatenate(per_text) if per_text else np.zeros(0, np.int32)
        lengths = self.lengths[index]
        sizes = np.array([len(p) for p in per_text], np.int64)
        totals = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ends = np.cumsum(sizes)
        counts = totals[ends] - totals[ends - sizes]
        return self.ids[ragged(self.starts[index], lengths)], counts


def grown(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker; it keeps what it has learnt from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
