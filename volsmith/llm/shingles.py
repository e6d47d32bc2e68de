"""Word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one go; temporary arrays take some forty times as much.
CHUNK = 1 << 20
WIDTH = 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240229)
_OF_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_OF_PLACE = _RANDOM.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(CHUNK + 1, _BASE, np.uint64)]))
_INVERSE = np.multiply.accumulate(
    np.concatenate([[np.uint64(1)], np.full(CHUNK + 1, pow(_BASE, -1, 1 << 64), np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in ``data``, which ends with a space."""
    starts, _, hashes = _words(data)
    return starts, hashes


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``data``, which ends with a space."""
    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if len(data) > CHUNK:  # one word of more than a chunk: powers of its own
        n = len(data) + 1
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))
    else:
        powers, inverse = _POWERS, _INVERSE
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_OF_BYTE[codes] * powers[:len(codes)], dtype=np.uint64)])
    return starts, ends, mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _cuts(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about a chunk that end with white space."""
    at = 0
    while at < len(data):
        end = at + CHUNK - 1
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end] + b" "
        at = end
    if not data:
        yield b" "


def _shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``WIDTH`` words, or of all words where they are fewer."""
    if not len(words):
        return words
    n = min(len(words), WIDTH)
    count = len(words) - n + 1
    total = np.full(count, n * _BASE % (1 << 64), np.uint64)
    for k in range(n):
        total += words[k:k + count] * _OF_PLACE[k]
    return np.unique(mixed(total))


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The shingle set of each text, A-Z in lower case, as sorted unsigned hashes."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        if size + len(data) + 1 > CHUNK and held:
            yield from _of_several(held)
            held, size = [], 0
        if len(data) + 1 > CHUNK:
            yield _shingles(np.concatenate([_word_hashes(part)[1] for part in _cuts(data)]))
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from _of_several(held)


def _of_several(texts: list[bytes]) -> Iterator[np.ndarray]:
    starts, words = _word_hashes(b" ".join(texts) + b" ")
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    begin = 0
    for end in ends:
        yield _shingles(words[begin:end])
        begin = end


def runs_of(words: np.ndarray) -> np.ndarray:
    """The hash of each run of ``WIDTH`` words, in order; none for fewer words."""
    count = max(len(words) - WIDTH + 1, 0)
    total = np.full(count, WIDTH * _BASE % (1 << 64), np.uint64)
    for k in range(WIDTH):
        total += words[k:k + count] * _OF_PLACE[k]
    return mixed(total)


def placed_words(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts and ends in code points and hashes of the words of each text, A-Z in lower case."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        if size + len(data) + 1 > CHUNK and held:
            yield from _places_of_several(held)
            held, size = [], 0
        if len(data) + 1 > CHUNK:
            parts, at = [], 0
            for part in _cuts(data):
                starts, ends, hashes = _in_code_points(part)
                parts.append((starts + at, ends + at, hashes))
                at += len(part[:-1].decode("utf-8", "surrogatepass"))
            yield tuple(np.concatenate(column) for column in zip(*parts))
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from _places_of_several(held)


def _in_code_points(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, hashes = _words(data)
    passed = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return passed[starts], passed[ends], hashes


def _places_of_several(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data = b" ".join(texts) + b" "
    starts, ends, hashes = _in_code_points(data)
    sizes = np.cumsum([0, *(len(t.decode("utf-8", "surrogatepass")) + 1 for t in texts)])
    cuts = np.searchsorted(starts, sizes).tolist()
    for begin, end, at in zip(cuts, cuts[1:], sizes.tolist()):
        yield starts[begin:end] - at, ends[begin:end] - at, hashes[begin:end]


def word_lists(texts: list[str]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, in order, A-Z in lower case."""
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        yield np.concatenate([_word_hashes(part)[1] for part in _cuts(data)])
