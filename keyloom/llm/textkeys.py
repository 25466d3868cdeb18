"""Word and shingle hashes of whole batches of texts, by numpy over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .bpe import _BASE, _BYTE, BLOCK, Powers

_powers = Powers(_BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all of the input's."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums H with which (H[j] - H[i]) * down[i] is a 64-bit hash of b[i:j]; also ``down``."""
    up, down = _powers.to(len(b) + 1)
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=h[1:])
    return h, down


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of other bytes than ASCII white space, A-Z in lower case), and where each text's begin: n + 1 bounds."""
    hashes, bounds, total = [], [0], 0
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    while i < len(raws):
        j, n = i, 0
        while j < len(raws) and (j == i or n + len(raws[j]) < BLOCK):
            n += len(raws[j]) + 1
            j += 1
        b = _LOWER[np.frombuffer(b"\n" + b"\n".join(raws[i:j]) + b"\n", np.uint8)]
        white = _SPACE[b]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        h, down = prefix_hashes(b)
        hashes.append(mix((h[end] - h[start]) * down[start]))
        at = np.searchsorted(start, np.cumsum([1] + [len(r) + 1 for r in raws[i:j]])[1:])
        bounds += (total + at).tolist()
        total += len(start)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: every ``width`` words in a row; fewer words are one shingle; none give none."""
    mult = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    run = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        run += words[k : k + len(run)] * mult[k]
    run = mix(run)
    out = []
    for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        n = j - i
        if n >= width:
            out.append(np.unique(run[i : j - width + 1]))
        elif n:
            out.append(mix((words[i:j] * mult[:n]).sum(keepdims=True) + np.array([n], np.uint64) * _C1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
