"""Sets of word shingles, as 64-bit hashes and exactly.

Words are the runs between ASCII white space of the text with A-Z lower-cased. A text's set holds
its distinct five-word shingles; a text of fewer words has its whole sequence as one; a text without
words has none.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SIZE = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of one vectorised pass.
_PASS = 1 << 18
#: Words are named by polynomials in two bases modulo a prime: unlike modulo a power of two, no texts
#: collide in every base.
PRIME = np.uint64((1 << 31) - 1)
BASES = (1103515245, 1566083941)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(PRIME))) % PRIME])
    return out[:n].astype(np.uint32)


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, at least ``n`` of them."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, _PASS + 2)
        _powers[:] = [(_powers_of(b, size), _powers_of(pow(b, -1, int(PRIME)), size)) for b in BASES]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``raw``, which is in lower case."""
    buf = np.frombuffer(raw, np.uint8)
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    value = buf.astype(np.uint64) + np.uint64(1)
    value[space] = 0
    # a sum has at most 2^18 terms below 2^40: a longer word of a longer pass is summed in parts
    h = np.zeros(len(starts), np.uint64)
    for up, down in prime_powers(len(buf)):
        own = value * up[: len(buf)]
        if len(buf) > _PASS:
            own %= PRIME
        h = (h << np.uint64(31)) | (np.add.reduceat(own, starts) % PRIME * down[starts] % PRIME)
    return starts, mixed(h)


def _long_word_hashes(raw: bytes) -> np.ndarray:
    """Word hashes of a text longer than a pass, which is cut at white space."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _PASS)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_word_hashes(raw[at:end])[1])
        at = end
    return np.concatenate(out)


def _joined(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Distinct shingle hashes of each text; ``ends`` are the word counts summed up."""
    n = len(words)
    rolled = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for k in range(SIZE):
        rolled = mixed(rolled * _STEP + words[k : n - SIZE + 1 + k]) if n >= SIZE else rolled
    out, begin = [], 0
    for end in ends.tolist():
        if end - begin >= SIZE:
            out.append(np.unique(rolled[begin : end - SIZE + 1]))
        else:
            h = np.full(min(end - begin, 1), end - begin, np.uint64)
            for w in words[begin:end]:
                h = mixed(h * _STEP + w)
            out.append(h)
        begin = end
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush():
        nonlocal group, size
        if group:
            at = np.cumsum([len(r) + 1 for r in group])
            starts, words = _word_hashes(b" ".join(group) + b" ")
            out.extend(_joined(words, np.searchsorted(starts, at)))
        group, size = [], 0

    for text in texts:
        raw = text.encode().lower()
        if len(raw) > _PASS // 2:
            flush()
            words = _long_word_hashes(raw)
            out += _joined(words, np.array([len(words)]))
            continue
        if size + len(raw) + 1 > _PASS:
            flush()
        group.append(raw)
        size += len(raw) + 1
    flush()
    return out


def words_of(text: str) -> list[bytes]:
    """The words; bytes.split() and bytes.lower() know the same white space and letters."""
    return text.encode().lower().split()


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b), the same for equal pairs."""
    return np.unique((a << 32) | b, return_inverse=True)[1]


def exact_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's shingles. Equal shingles of these texts, and no others, have
    the same number: words are numbered, then pairs of numbers, without any hash that decides."""
    number: dict[bytes, int] = {}
    parts = []
    for t in texts:
        words = words_of(t)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    long = [p for p in parts if len(p) >= SIZE]
    cuts = np.cumsum([0] + [len(p) for p in long])
    flat = np.concatenate(long) if long else np.zeros(0, np.int64)
    if len(flat):
        two = _numbered(flat[:-1], flat[1:])
        four = _numbered(two[:-2], two[2:])
        five = _numbered(four[:-1], flat[SIZE - 1 :])
    short: dict[tuple, int] = {}
    out, k = [], 0
    for p in parts:
        if len(p) >= SIZE:
            out.append(np.unique(five[cuts[k] : cuts[k + 1] - SIZE + 1]))
            k += 1
        else:
            own = tuple(p.tolist())
            out.append(np.array([-1 - short.setdefault(own, len(short))] if own else [], np.int64))
    return out
