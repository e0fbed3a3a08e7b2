"""Rolling hashes and window minima over batches of texts, in whole arrays."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (a finaliser of shifts and odd factors)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k symbols: a polynomial modulo 2**64 of the mixed symbols, mixed again."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    block = 1 << 14
    out = np.empty(n - k + 1, np.uint64)
    up, down = _powers(_BASE, block + k), _powers(_INVERSE, block + k)
    for at in range(0, n - k + 1, block):
        part = mix(codes[at : at + block + k - 1].astype(np.uint64) + np.uint64(1))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - k + 1
        out[at : at + m] = mix((total[k : k + m] - total[:m]) * down[:m])
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and where each begins (with the end, one more than there are texts)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from prefix and suffix minima of blocks of w."""
    n = len(values)
    if n < w:
        return np.empty(0, values.dtype)
    pad = -n % w
    grid = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
