"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts as one state with an arc per symbol. Each merge ``u v`` adds a gadget: the target of
the ``u`` arcs is replaced by a copy without the ``v`` arc, and every state with a ``u`` arc gets a ``uv``
arc to the target of ``v``. What it accepts in the end are exactly the encodings that the merges, applied
by rank, produce. All arcs of a token lead to one state, so a state is kept as the token that leads to it
with what its copies lost, and an arc is worked out when it is first taken and then stored in the table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm.chunk_encoder import Places, cut, grown, ragged, tokenizer_path
from leadloom.llm.common import map_batches, slices, text_of

NEVER = 1 << 60
PRINTED = re.compile(r"[\x20-\x7e\t\n\r]*").fullmatch
# Fixed value: the split pattern that the plain path restates.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Automaton:
    """The automaton of a merge list, with its table of arcs taken so far."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.label = {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.lost: dict[int, dict[int, int]] = {}
        self.table: dict[int, bool] = {}
        self.live = {i for t, i in vocab.items() if len(t.removesuffix(suffix)) == 1}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        #: Tokens that arcs carry; a text of one of them alone is encoded by it.
        self.accepted = {t: i for t, i in vocab.items() if i in self.live}
        #: The length of the longest token by the first four symbols; any other has three at most.
        self.reach: dict[str, int] = {}
        for t in self.accepted:
            symbols = t.removesuffix(suffix) or t
            if len(symbols) > 3:
                self.reach[symbols[:4]] = max(self.reach.get(symbols[:4], 3), len(symbols))

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if u not in self.live or v not in self.live or not self._arc(u, v):
            return  # the two never stand side by side, so nothing changes
        self.lost.setdefault(u, {})[v] = rank
        if uv not in self.live:
            self.live.add(uv)
            self.left[uv], self.right[uv], self.made[uv] = u, v, rank

    def _arc(self, state: int, token: int) -> bool:
        """Whether the state that ``state`` leads to has an arc for ``token``.

        The state descends by copying from those of its right parts, each as it was when the part was
        taken in; the token's arc exists where those of its left parts did when it was made. For a merge
        ``u u`` the copy has lost its ``u`` arc by then, so it gets no ``uu`` arc either.
        """
        until = NEVER
        while True:
            lost = self.lost.get(state)
            if lost:
                part, alive = token, NEVER
                while True:
                    rank = lost.get(part)
                    if rank is not None and rank < until and rank <= alive:
                        return False
                    if part not in self.left:
                        break
                    part, alive = self.left[part], self.made[part]
            if state not in self.right:
                return True
            state, until = self.right[state], self.made[state]

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word: the only path of arcs that spells it.

        Longer tokens are tried first; a state that proves a dead end is not entered again.
        """
        accepted, suffix, n = self.accepted, self.suffix, len(word)
        whole = accepted.get(word + suffix)
        if whole is not None:
            return [whole]
        table, reach, path, begins, dead = self.table, self.reach.get, [], [], set()
        at, length = 0, min(reach(word[:4], 3), n)
        while True:
            while length:
                end = at + length
                token = accepted.get(word[at:end] + suffix if end == n else word[at:end])
                if token is not None and (not dead or (end, token) not in dead):
                    if not path:
                        break
                    key = path[-1] << 20 | token
                    fits = table.get(key)
                    if fits is None:
                        fits = table[key] = self._arc(path[-1], token)
                    if fits:
                        break
                length -= 1
            if length:
                path.append(token)
                begins.append(at)
                if end == n:
                    return path
                at, length = end, min(reach(word[end : end + 4], 3), n - end)
            elif path:
                dead.add((at, path.pop()))
                length = at - begins[-1] - 1
                at = begins.pop()
            else:
                raise ValueError(f"no encoding of {word!r}")


class WordEncoder:
    """Whole texts under a word-level tokenizer file: normalised and pre-split by the library, encoded by
    the automaton. Texts are cut before single spaces, which end words, and each piece is encoded once; at
    most about ``limit`` pieces, and as many words, are remembered."""

    def __init__(self, path: str, limit: int = 180_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added
        ):
            raise ValueError(f"unsupported tokenizer file {path}")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.apart = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")") if self.special else None
        self.labels = {**self.automaton.label, **{i: t for t, i in self.special.items()}}
        size = max(self.labels, default=-1) + 1
        self.label_of = np.array([self.labels.get(i, "") for i in range(size)], object)
        self.digits_of = np.array([str(i) for i in range(size)], object)
        # ASCII text needs no library: this file's split, spelt out for it.
        plain = model["end_of_word_suffix"] == "</w>" and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORDS}
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall if plain else None
        self.limit, self.words = limit, {}
        self.forget()

    def forget(self) -> None:
        self.pieces = Places()
        self.pieces.new = []
        self.flat, self.starts, self.lengths = np.zeros(4096, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n, self.used = 0, 0

    def encode_piece(self, piece: str) -> list[int]:
        parts = self.apart.split(piece) if self.apart and self.apart.search(piece) else [piece]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if self.plain and part.isascii() and (part.isprintable() or PRINTED(part)):
                words = self.plain(part.lower())
            else:
                words = [word for word, _ in self.split(self.normalize(part))] if part else ()
            for word in words:
                ids = self.words.get(word)
                if ids is None:
                    ids = self.words[word] = self.automaton.encode(word)
                out += ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        if len(self.pieces) > self.limit:
            self.forget()
        if len(self.words) > self.limit:
            self.words = {}
        if len(self.automaton.table) > 2 * self.limit:
            self.automaton.table.clear()
        get, per_text = self.pieces.__getitem__, []
        for text in texts:
            pieces = cut(text)
            per_text.append(np.fromiter(map(get, pieces), np.int64, len(pieces)))
        if self.pieces.new:
            self._learn([self.encode_piece(piece) for piece in self.pieces.new])
            self.pieces.new = []
        index = np.concatenate(per_text) if per_text else np.zeros(0, np.int64)
        own = self.lengths[index]
        totals = np.concatenate([[0], np.cumsum(own)])
        sizes = np.array([len(p) for p in per_text], np.int64)
        ends = np.cumsum(sizes)
        return self.flat[ragged(self.starts[index], own)], totals[ends] - totals[ends - sizes]

    def _learn(self, encoded: list[list[int]]) -> None:
        counts = np.array([len(ids) for ids in encoded], np.int64)
        n, end = self.n + len(counts), self.used + int(counts.sum())
        self.starts, self.lengths, self.flat = grown(self.starts, n), grown(self.lengths, n), grown(self.flat, end)
        self.starts[self.n : n] = self.used + np.cumsum(counts) - counts
        self.lengths[self.n : n] = counts
        self.flat[self.used : end] = [i for ids in encoded for i in ids]
        self.n, self.used = n, end

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs in order, joined by the space that stands between decoded tokens."""
        return " ".join(self.label_of[ids])


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; its automaton is compiled once and kept."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of whole texts, special tokens in a text counting as themselves.

    A null text counts as empty and gives no ids. Repeated rows repeat, an empty table gives no rows, and
    other columns are not read. Nothing is shuffled.
    """
    def run(batch: pa.RecordBatch) -> dict[str, object]:
        own = word_encoder(tokenizer_path(tokenizer, "word_bpe_49k.json"))
        ids, counts = own.encode(batch.column("text").to_pylist())
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids))}

    return map_batches(text_of(docs, "doc_id"), run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, text)`` that the ids stand for; null ids decode to an empty text."""
    def run(batch: pa.RecordBatch) -> dict[str, object]:
        own = word_encoder(tokenizer_path(tokenizer, "word_bpe_49k.json"))
        texts = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoding and decoding in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(tokenizer_path(tokenizer, "word_bpe_49k.json"))
        for batch in batches:
            for some in slices(batch):
                ids, counts = own.encode(some.column("text").to_pylist())
                ends = np.cumsum(counts)
                sha, decoded = [], []
                for a, b in zip(ends - counts, ends):
                    sha.append(hashlib.sha256(" ".join(own.digits_of[ids[a:b]]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids[a:b]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return text_of(docs, "doc_id").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
