"""Hashed n-gram counts of whole texts, for the classifiers."""

from __future__ import annotations

import numpy as np

#: Bytes to classes for languages: letters in lower case, non-ASCII bytes as they are, all else a space.
LETTERS = np.array([
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
], np.uint32)

#: Bytes to classes for style: a, A, 0 for letters and digits, non-ASCII as a letter, the rest as they are.
SHAPES = np.array([
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
], np.uint32)

#: Bytes of text whose n-grams are held at once.
BLOCK = 4_000_000


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each between spaces, and the text that each byte belongs to."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    owner = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    return np.frombuffer(b"".join(b" " + r + b" " for r in raw), np.uint8), owner


def _add(counts: np.ndarray, owner: np.ndarray, codes: np.ndarray, sizes: tuple[int, ...]) -> None:
    """Add the n-grams of consecutive codes of one owner."""
    dims = counts.shape[1]
    for n in sizes:
        if len(codes) < n:
            continue
        mixed = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            mixed = (mixed * np.uint32(0x9E3779B1)) ^ codes[k : len(codes) - n + 1 + k]
        mixed = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(dims).bit_length() + 1)
        whole = owner[: len(codes) - n + 1] == owner[n - 1 :]
        flat = owner[: len(codes) - n + 1][whole] * dims + mixed[whole]
        counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape).astype(np.float32)


def byte_ngrams(texts: list[str], classes: np.ndarray, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of n-grams of byte classes; ``dims`` is a power of two. Texts of any length are counted whole."""
    counts = np.zeros((len(texts), dims), np.float32)
    start, held = 0, 0
    for stop in range(1, len(texts) + 1):
        held += len(texts[stop - 1])
        if held >= BLOCK or stop == len(texts):
            data, owner = _laid_out(texts[start:stop])
            part = counts[start:stop]
            for low in range(0, len(data), BLOCK):  # a longest n-gram's overlap keeps blocks whole
                for n in sizes:
                    high = min(len(data), low + BLOCK + n - 1)
                    _add(part, owner[low:high], classes[data[low:high]], (n,))
            start, held = stop, 0
    return counts


def normalised(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length 1; rows without counts stay zero."""
    roots = np.sqrt(counts)
    norms = np.sqrt((roots * roots).sum(axis=1, keepdims=True))
    return roots / np.maximum(norms, 1e-12)
