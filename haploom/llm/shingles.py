"""Word and shingle hashes of whole batches of texts, by array operations over their bytes."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

#: Space and U+0009 to U+000D part words.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes whose words are found at a time (a longer text is taken whole): so few that all arrays stay in a core's cache.
AT_ONCE = 1 << 16
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers: dict[bool, np.ndarray] = {}


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of an odd base modulo 2^64, or of its inverse. As many as most blocks need are kept."""
    if n <= 2 * AT_ONCE:
        if len(_powers.get(inverse, ())) < 2 * AT_ONCE:
            _powers[inverse] = _made_power(2 * AT_ONCE, inverse)
        return _powers[inverse][:n]
    return _made_power(n, inverse)


def _made_power(n: int, inverse: bool) -> np.ndarray:
    base = pow(int(_PRIME), -1, 1 << 64) if inverse else int(_PRIME)
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts in order, number of words of each text).

    Words are what blanks part, A-Z in lower case. Only so many bytes are laid out at a time.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) for r in raws])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, AT_ONCE), side="right"))
    parts = [_words(raws[a:b]) for a, b in zip([0, *cuts], [*cuts, len(raws)], strict=True) if a < b]
    if not parts:
        return np.empty(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes, counts = zip(*parts, strict=True)
    return np.concatenate(hashes), np.concatenate(counts)


def _words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raws])
    low = LOWER[raw]
    blank = BLANKS[raw]
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begins):
        return np.empty(0, dtype=np.uint64), np.zeros(len(raws), dtype=np.int64)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(len(raw)), out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * _power(len(raw), inverse=True)[begins] + (ends - begins).astype(np.uint64))
    numbers = np.searchsorted(begins, ends_of_texts)
    return hashes, np.diff(np.concatenate([[0], numbers]))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; fewer words are one shingle, none give none."""
    hashes, counts = words(texts)
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled = rolled * _PRIME + hashes[j : n - k + 1 + j]
    rolled = mix(rolled, k)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            few = np.uint64(c)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + c]:
                    few = few * _PRIME + h
            out.append(mix(np.array([few], dtype=np.uint64), 1000 + c))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += c
    return out


def set_class(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    with np.errstate(over="ignore"):
        total = mix(shingles, 77).sum() + np.uint64(len(shingles)) * _M2
    return int(mix(np.array([total], dtype=np.uint64), 78).view(np.int64)[0])
