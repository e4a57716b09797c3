"""Words and word windows, shared by the operators that look for repeated or leaked text."""

from __future__ import annotations

import numpy as np

#: Words of the whole-text operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words that a worker remembers between documents; beyond it the memory starts afresh.
MEMO_WORDS = 200_000
#: The same for pieces of text and their tokens, which cost more to find.
MEMO_PIECES = 900_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def kept_in_worker(key, make):
    """What make() gives, made once in each Python worker and kept for its later tasks."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_flowspark_worker", ModuleType("_flowspark_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text. ``bytes.split`` separates at exactly the characters that WORD excludes."""
    return text.split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes: a polynomial modulo 2**64, built by doubling, then mixed."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, width = None, 0
    power, size, base = words, 1, _BASE
    left = n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, width = power, size
                else:
                    keep = len(words) - width - size + 1
                    out, width = out[:keep] * base + power[width : width + keep], width + size
            left >>= 1
            if left:
                keep = len(words) - 2 * size + 1
                power = power[:keep] * base + power[size : size + keep]
                base, size = base * base, size * 2
        return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    if len(x) < width:
        return x[:0]
    out, size = x, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    if size < width:
        out = np.minimum(out[: len(out) - (width - size)], out[width - size :])
    return out


def covered(starts: np.ndarray, lengths, n: int) -> np.ndarray:
    """Which of n places lie in any of the intervals."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + lengths, n), -1)
    return np.cumsum(marks[:n]) > 0


def whole_groups(batches, names: tuple[str, ...]):
    """Columns of sorted rows, in pieces that hold groups of the first two columns whole; a group's rows are put together once."""
    held: list = []
    for batch in batches:
        new = [np.asarray(batch.column(c)) for c in names]
        if not batch.num_rows:
            continue
        edge = np.flatnonzero((np.diff(new[0]) != 0) | (np.diff(new[1]) != 0))
        begins = not held or new[0][0] != held[-1][0][-1] or new[1][0] != held[-1][1][-1]
        if held and (begins or len(edge)):
            cut = 0 if begins else int(edge[0]) + 1
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in new], strict=True)]
            held, new = [], [x[cut:] for x in new]
            edge = edge[edge >= cut] - cut
        if len(edge):
            cut = int(edge[-1]) + 1
            yield [x[:cut] for x in new]
            new = [x[cut:] for x in new]
        held.append(new)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
