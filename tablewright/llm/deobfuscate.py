"""Noisy-channel restoring of disguised words under a character language model.

The model is a 4-gram model of letters inside words, counted over the words of all
documents. A disguised token is a lattice: each character may stand for some letters
(`3` for e), may be an extra copy of the letter before it, or may be a mark that stands for
nothing; between spaced letters a word may end. Viterbi decoding finds the reading that is
most likely under model and channel. Plain words need no decoding.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import groupby, product

import numpy as np

#: Symbols of the model: 0 the border of a word, 1-26 letters, 27 any other letter.
SYMBOLS = 28
CELLS = SYMBOLS**4
#: Letters that characters are used for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
#: Natural logarithms of the channel's probabilities.
LEET, MASK, SKIP, COPY, SINGLE, BREAK = -1.0, -2.5, -4.0, -0.5, -2.0, -1.5
LONGEST = 32  # characters decoded as one word; longer tokens are split, or decoded in overlapping pieces
RANDOM = -float(np.log(SYMBOLS))  # of a letter that says nothing

_LETTERS = np.full(256, 255, np.uint8)
_LETTERS[0] = 0
for _c in range(26):
    _LETTERS[97 + _c] = _c + 1
_LETTERS[[0xDF, 0xE6, 0xF0, 0xF8, 0xFE]] = 27
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$@|+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([^\W\d_])\1")
_BARE = "".join(c for c in _EDGE if c not in STANDS_FOR)
_LONG_RUN = re.compile(r"(.)\1{3,}", re.S)  # lattices read any run of three or more alike
_PARTS = re.compile(f"[^\\w{re.escape(''.join(c for c in STANDS_FOR if not c.isdigit()))}]+|_+")
_TAIL = re.compile(r"([^\w\s])\1\1+$")
_APART = re.compile(r"[\w$@!|+](?:([.\-_*·/])[\w$@!|+])(?:\1[\w$@!|+])+$")
#: Three or more characters standing alone, one space or tab apart.
SPACED = re.compile(r"(?<!\S)(?:[^\s,;:?\"'][ \t]){2,}[^\s,;:?\"'](?!\S)")


def fold(text: str) -> bytes:
    """Lower-cased Latin letters without accents, one byte each; other scripts are dropped."""
    return unicodedata.normalize("NFKD", text).lower().encode("latin-1", "ignore")


def count_grams(words: Counter) -> np.ndarray:
    """Counts of all 4-grams of the words (as often as the words occur), borders included."""
    if not words:
        return np.zeros(CELLS)
    joined = _LETTERS[np.frombuffer(fold("\0\0\0" + "\0\0\0".join(words) + "\0\0\0"), np.uint8)]
    joined = joined[joined != 255].astype(np.int64)
    weight = np.fromiter(words.values(), np.float64, len(words))
    # A word starts where a letter follows three borders; words without letters vanish.
    starts = (joined[3:] > 0) & (joined[2:-1] == 0)
    if int(starts.sum()) != len(words):
        usable = Counter({w: n for w, n in words.items() if any(97 <= b <= 122 for b in fold(w)) and w.isalpha()})
        return count_grams(usable) if len(usable) < len(words) else np.zeros(CELLS)
    owner = np.cumsum(starts) - 1
    cell = ((joined[:-3] * SYMBOLS + joined[1:-2]) * SYMBOLS + joined[2:-1]) * SYMBOLS + joined[3:]
    inside = (joined[3:] > 0) | (joined[2:-1] > 0)
    return np.bincount(cell[inside], weight[owner[inside]], CELLS)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before it), contexts mixed from short to long (Witten-Bell)."""
    counts = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        level = counts.sum(axis=tuple(range(3 - order)))
        seen = level.sum(-1, keepdims=True)
        follow = (level > 0).sum(-1, keepdims=True)
        p = (level + follow * p) / np.maximum(seen + follow, 1) + np.where(seen == 0, 1, 0) * p
    return np.log(p).astype(np.float32)


class Restorer:
    """Readings of tokens under a model (`log_probabilities`, as a flat list)."""

    def __init__(self, model: np.ndarray):
        self.model = model.ravel().tolist()

    def lattice(self, token: str, spaced: bool, core: tuple[int, int] | None = None) -> list[list[tuple[str, float]]] | None:
        """For each stretch of the token its readings; None if it can't be a word. Marks
        outside `core` (its first character and end) may also be plain punctuation."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            c = token[i]
            j = i + 1
            while j < len(token) and token[j] == c and not spaced:
                j += 1
            n = j - i
            folded = fold(c).decode("latin-1") if c.isalpha() else ""
            if folded and folded[0].isalpha():
                letter = folded[0]
                options = [(letter * min(n, 2), 0.0 if n < 3 else COPY)]
                if n > 1:
                    options.append((letter, COPY if n > 2 else SINGLE))
            elif c in STANDS_FOR:
                cost = MASK if c == "*" else LEET
                options = [(s * k, cost) for s in STANDS_FOR[c] for k in range(1, min(n, 2) + 1)]
                if not c.isdigit():
                    options.append(("", SKIP))
            elif c.isalnum():
                return None
            else:
                options = [("", SKIP / 2)]
            if core and not core[0] <= i < core[1]:
                options = [*(o for o in options if o[0]), ("", 0.0)]
            out.append(options)
            if spaced and j < len(token):
                out.append([("", 0.0), ("\0", BREAK)])
            i = j
        return out

    def viterbi(self, lattice: list[list[tuple[str, float]]], likely: bool = False) -> str:
        """The most likely reading; words are separated by a space. With `likely`, empty if the
        model finds it no likelier than letters at random."""
        model = self.model
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for options in [*lattice, [("\0", 0.0)]]:
            following: dict[int, tuple[float, tuple]] = {}
            for state, (score, read) in best.items():
                for letters, cost in options:
                    total, at, word = score + cost, state, read
                    if letters == "\0":
                        total += model[at * SYMBOLS]
                        at, word = 0, (read, " ")
                    elif letters:
                        for letter in letters:
                            symbol = ord(letter) - 96
                            symbol = symbol if 0 < symbol < 27 else 27
                            total += model[at * SYMBOLS + symbol]
                            at = (at * SYMBOLS + symbol) % (SYMBOLS**3)
                        word = (read, letters)
                    have = following.get(at)
                    if have is None or total > have[0]:
                        following[at] = (total, word)
            best = following
        score, read = max(best.values(), key=lambda b: b[0])
        if likely and score <= RANDOM + sum(max(cost + len(s) * RANDOM for s, cost in options) for options in lattice):
            return ""
        parts = []
        while read:
            read, letters = read
            parts.append(letters)
        return "".join(reversed(parts)).strip()

    def words(self, token: str) -> list[str]:
        """The words that a token (lower case, no white space) reads as."""
        if token.isalpha() and not _TWICE.search(token):
            return [token]
        token = _TAIL.sub("", token)
        core, full = token.strip(_EDGE), token.strip(_BARE)
        if core.isalpha() and not _RUN.search(core):
            if core == full:
                return self.undoubled(core)
            return list(dict.fromkeys([*self.undoubled(core), *self.decoded(full)]))
        if _APART.match(core):
            return self.spaced(core[::2])
        found = self.decoded(full)
        least = 0 if not found or sum(c.isalpha() for c in core) * 3 < len(core) else 2
        return found + [w for w in re.split(r"[\W\d_]+", core) if len(w) > least]

    def undoubled(self, word: str) -> list[str]:
        """The word, and its most likely reading if some doubled letters are better read once:
        what Viterbi finds for the lattice of this word, whose few readings are tried in turn.
        Words with many doubled letters take the lattice itself; those with other letters than
        a to z are left as they are."""
        parts = _TWICE.split(word)
        if len(parts) == 1 or not word.isascii():
            return [word]
        if len(parts) > 7:
            return list(dict.fromkeys([word, *self.decoded(word)]))
        best, most = word, self.likelihood(word)
        for once in product((False, True), repeat=len(parts) // 2):
            if any(once):
                letters = [c * (1 if o else 2) for c, o in zip(parts[1::2], once)]
                reading = "".join([x for pair in zip(parts[::2], letters) for x in pair]) + parts[-1]
                score = self.likelihood(reading) + SINGLE * sum(once)
                if score > most:
                    best, most = reading, score
        return [word] if best == word else [word, best]

    def likelihood(self, word: str) -> float:
        """log P of a word of the letters a to z."""
        model, at, total = self.model, 0, 0.0
        for byte in word.encode():
            total += model[at * SYMBOLS + byte - 96]
            at = (at * SYMBOLS + byte - 96) % (SYMBOLS**3)
        return total + model[at * SYMBOLS]

    def decoded(self, token: str) -> list[str]:
        """The words that a token reads as under the model. A token of over LONGEST characters
        is decoded part by part, and parts that are longer in overlapping pieces."""
        token = _LONG_RUN.sub(r"\1\1\1", token)
        if len(token) > LONGEST:
            parts = [p for p in _PARTS.split(token) if p]
            if len(parts) > 1:
                return [w for p in parts for w in self.decoded(p)]
            half = LONGEST // 2
            pieces = [token[at : at + LONGEST] for at in range(0, len(token) - half, half)]
        else:
            pieces = [token]
        found: list[str] = []
        for piece in pieces:
            core = piece.strip(_EDGE)
            first = piece.find(core)
            lattice = self.lattice(piece, False, (first, first + len(core))) if core else None
            if lattice is not None:
                letters = sum(c.isalpha() for c in core)
                found += self.viterbi(lattice, letters * 3 < len(core)).split()
        return found

    def spaced(self, letters: str) -> list[str]:
        """The words that spaced letters read as."""
        found: list[str] = []
        for readable, some in groupby(letters, self.readable):
            part = "".join(some)
            lattice = self.lattice(part, True) if readable and any(c.isalpha() for c in part) else None
            if lattice is not None:
                found += self.viterbi(lattice).split()
        return found

    def readable(self, c: str) -> bool:
        return self.lattice(c, True) is not None
