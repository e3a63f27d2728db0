"""64-bit hashes of the words and word shingles of many texts at once.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are lower-cased.
"""

from __future__ import annotations

import numpy as np

from leadloom.llm.license_scan import FOLD

_SPACE = np.uint8(32)
#: An odd factor and its inverse modulo 2**64: hashes of runs come from running sums.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
#: Texts end to end that are hashed at once.
_BYTES = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every bit over all 64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    if "up" not in _cache or len(_cache["up"]) < n:
        _cache["up"], _cache["down"] = _powers(_FACTOR, n), _powers(_INVERSE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _cache["up"][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _cache["down"][starts])


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    hashes, counts, part, size = [], [], [], 0

    def flush() -> None:
        data = np.frombuffer(b" ".join([b"", *part, b""]), np.uint8)
        space = data == _SPACE
        edges = np.diff(space.astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1) + 1, np.flatnonzero(edges == 1) + 1
        lengths = np.array([len(p) + 1 for p in part], np.int64)
        bounds = np.cumsum(lengths)
        below = np.searchsorted(starts, bounds, side="right")
        counts.append(np.diff(below, prepend=0))
        hashes.append(_run_hashes(data, starts, ends))

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
        part.append(raw)
        size += len(raw)
        if size >= _BYTES:
            flush()
            part, size = [], 0
    if part:
        flush()
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, how often each occurs, and the number per text.

    A text of fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    words, counts = hash_words(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    rolled = np.zeros(len(words), np.uint64)
    last = np.cumsum(counts)[doc] if len(doc) else doc
    place = np.arange(len(words))
    for k in range(size):
        inside = place + k < last
        term = np.zeros(len(words), np.uint64)
        term[inside] = words[place[inside] + k]
        rolled = mix(rolled * np.uint64(_FACTOR) + term)
    first = np.cumsum(counts) - counts
    short = counts[doc] < size if len(doc) else np.zeros(0, bool)
    keep = (place + size <= last) | (short & (place == first[doc] if len(doc) else short))
    doc, rolled = doc[keep], rolled[keep]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    at = np.flatnonzero(new)
    repeats = np.diff(np.append(at, len(doc)))
    return rolled[at], repeats, np.bincount(doc[at], minlength=len(texts)).astype(np.int64)
