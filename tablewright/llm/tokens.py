"""Whole texts to token ids with a public tokenizer, one distinct word at a time.

Tokenizers of the `tokenizers` library split a text into words before they merge, so ids
of a text are the ids of its words in a row. Each worker keeps the ids of words it has
met; only new words reach the library. All else is done for a batch of texts at once: words
are found by their bytes, looked up by a 64-bit hash and then compared byte by byte, and
their ids gathered. A worker's table is bounded in bytes and starts anew when it is full.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import _SPACES, utf8, word_hashes

LIMIT = 128 << 20  # bytes of a worker's table
TOGETHER = 64  # new words in one call of the library
LONGEST = 128  # bytes of a word that is kept; texts with longer ones go to the library whole
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Table:
    """Ids of words by hash: open addressing in numpy arrays, words and ids one after another."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int32)
        self.count = 0
        self.text, self.text_at = np.zeros(1 << 10, np.uint8), np.zeros(1 << 10, np.int32)
        self.ids, self.ids_at = np.zeros(1 << 10, np.uint32), np.zeros(1 << 10, np.int32)

    def size(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.numbers, self.text, self.text_at, self.ids, self.ids_at))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The word's number for each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        mask = len(self.keys) - 1
        slot = (hashes >> np.uint64(20)).astype(np.int64) & mask
        left = np.arange(len(hashes))
        while len(left):
            have = self.keys[slot]
            hit = have == hashes[left]
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (have != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (hashes >> np.uint64(20)).astype(np.int64) & mask
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            won = free & (self.keys[slot] == hashes[left])
            self.numbers[slot[won]] = numbers[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & mask

    def add(self, hashes: np.ndarray, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """New words, each with a hash of its own; `ids` of all of them, `lengths` of each."""
        first = self.count
        text = np.frombuffer(b"".join(words), np.uint8)
        self.text, self.text_at = _appended(self.text, self.text_at, first, text, [len(w) for w in words])
        self.ids, self.ids_at = _appended(self.ids, self.ids_at, first, ids, lengths)
        self.count += len(words)
        if 5 * self.count > 3 * len(self.keys):
            old = self.keys != 0
            keys, numbers = self.keys[old], self.numbers[old]
            size = 1 << (2 * self.count).bit_length()
            self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, numbers)
        self._place(hashes, np.arange(first, self.count, dtype=np.int32))


def _appended(flat: np.ndarray, at: np.ndarray, count: int, more: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray]:
    """`flat` with `more` after its `count` entries, and the entries' bounds."""
    used = int(at[count])
    if used + len(more) > len(flat):
        flat = np.concatenate([flat[:used], np.zeros((used + len(more)) // 2 + len(more), flat.dtype)])
    flat[used : used + len(more)] = more
    if count + len(lengths) + 1 > len(at):
        at = np.concatenate([at[: count + 1], np.zeros(count // 2 + 2 * len(lengths) + 1, at.dtype)])
    at[count + 1 : count + 1 + len(lengths)] = used + np.cumsum(lengths)
    return flat, at


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of `flat`, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - ends + lengths, lengths)]


class Words:
    """`ids(texts)`: each text's ids as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer keeps the space before a word (`spaced`): there a word begins with
    the single space before it, and texts with other runs of white space stay whole. For
    other tokenizers white space only separates words, and A-Z are lower-cased at once. Texts
    that may hold an added token of the tokenizer stay whole too.
    """

    def __init__(self, path: str, spaced: bool, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = sorted({t.content[:2].encode() for t in added})
        self.table = Table(limit)
        # Where ids tell the end of a word, new words reach the library many at a time.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing: np.ndarray | None = None
        if suffix and not spaced:
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's own answer for whole strings."""
        return [r.ids for r in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """`texts` is a column of strings; null counts as empty."""
        if self.table.size() > self.table.limit:
            self.table.clear()
        raw, rows = utf8(texts)
        if not self.spaced:
            raw = _LOWER[raw]
        whole = self._whole(raw, rows)
        starts, ends = self._words(raw, rows)
        row = np.searchsorted(rows, starts, "right") - 1
        whole[row[ends - starts > LONGEST]] = True
        plain = ~whole[row]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        number = self._numbers(raw, starts, ends)
        table = self.table
        size = ends - starts
        same = table.text_at[number + 1] - table.text_at[number] == size
        at = np.flatnonzero(same)
        if len(at):
            unlike = gathered(table.text, table.text_at[number[at]], size[at]) != gathered(raw, starts[at], size[at])
            same[at] = ~np.logical_or.reduceat(unlike, np.cumsum(size[at]) - size[at])
        whole[row[~same]] = True  # two words of one hash
        counts = table.ids_at[number + 1] - table.ids_at[number]
        flat = gathered(table.ids, table.ids_at[number], counts).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, counts, len(rows) - 1).astype(np.int64))])
        data, bounds = flat.tobytes(), (4 * bounds).tolist()
        out = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        at = np.flatnonzero(whole)
        for i, ids in zip(at.tolist(), self.encode([texts[int(i)].as_py() for i in at])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _whole(self, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Texts that are not taken apart."""
        at: list[np.ndarray] = []
        data = raw.tobytes()
        for mark in self.marks:
            mark, found = mark if self.spaced else mark.lower(), -1
            while (found := data.find(mark, found + 1)) >= 0:
                at.append(np.array([found]))
                # one is enough for a text
                found = int(rows[np.searchsorted(rows, found, "right")]) - 1
        if self.spaced:
            space = np.flatnonzero(raw == 32)
            after = [np.append(raw[k:], np.zeros(k, np.uint8))[space] for k in (1, 2, 3)]
            ends = np.zeros(len(raw) + 1, bool)
            ends[rows] = True
            wide = (after[0] == 0xC2) & ((after[1] == 0x85) | (after[1] == 0xA0))
            wide |= (after[0] == 0xE1) & (after[1] == 0x9A) | (after[0] == 0xE3) & (after[1] == 0x80)
            wide |= (after[0] == 0xE2) & ((after[1] == 0x81) | (after[1] == 0x80) & ((after[2] < 0x8B) | (after[2] > 0xA7)))
            at.append(space[_SPACES[after[0]] | (after[0] >= 0x1C) & (after[0] < 0x20) | wide | ends[space + 1]])
        out = np.zeros(len(rows) - 1, bool)
        out[np.searchsorted(rows, np.concatenate([*at, np.zeros(0, np.int64)]), "right") - 1] = True
        return out

    def _words(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word. Commas, full stops and line breaks between ASCII letters,
        or behind the last one, are words of their own: tokenizers always cut there."""
        n = len(raw)
        edge = np.zeros(n + 1, bool)  # where a row begins or ends
        edge[rows] = True
        if self.spaced:
            first = edge[:-1] | (raw == 32)
            inside = np.ones(n, bool)
        else:
            inside = ~_SPACES[raw]
            first = inside & (edge[:-1] | np.append(True, ~inside[:-1])[:n])
        last = np.append(first[1:] | ~inside[1:], True)[:n]  # the word's last byte
        letter = _LETTER[raw]
        before = np.append(False, letter[:-1])[:n] & ~first
        after = last | np.append(letter[1:], False)[:n]
        mark = (raw == 44) | (raw == 46)
        if self.spaced:
            line = raw == 10
            two = mark & before & ~last & np.append(line[1:] & after[1:], False)[:n]
            mark = (mark | line) & before & after
        else:
            two, mark = np.zeros(n, bool), mark & before & after
        cut = first | mark | two
        cut[1:] |= mark[:-1]
        cut[2:] |= two[:-2]
        starts = np.flatnonzero(cut & inside)
        stop = np.flatnonzero((np.append(cut[1:], True)[:n] | last) & inside) + 1
        return starts, stop

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word in the table, which learns the new ones."""
        hashes = word_hashes(raw, starts, ends, lower=False)
        hashes[hashes == 0] = 1
        number = self.table.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            data = raw.tobytes()
            words = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            joined = np.array([w.isalpha() for w in words]) & (self.closing is not None)  # ASCII letters only
            for some, learn in ((joined, self._together), (~joined, self._apart)):
                chosen = np.flatnonzero(some)
                if len(chosen):
                    part = [words[i] for i in chosen.tolist()]
                    self.table.add(distinct[chosen], part, *learn(part))
            number[new] = self.table.find(hashes[new])
        return number

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode([w.decode() for w in words])
        lengths = np.array([len(x) for x in ids])
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lines = [b" ".join(words[i : i + TOGETHER]).decode() for i in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(x, np.uint32) for x in self.encode(lines)])
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(words):
            return self._apart(words)
        return ids, np.diff(ends, prepend=0)


@lru_cache(4)
def words_of(path: str, spaced: bool) -> Words:
    """One table for each worker process, kept between its tasks."""
    return Words(path, spaced)
