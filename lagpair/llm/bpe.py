"""Whole columns of texts to token ids, each distinct word encoded once.

The BPE models of the tokenizers library work word by word. A batch is cut into
words by array operations on its code points, exactly as the tokenizer's own
pattern would cut it; words are told apart by a 64-bit hash, and only those that
a process has not met yet go through the library's model. A text with a code
point outside the tables below goes through the library as a whole, and so does
one that holds an added token (``<|endoftext|>``): ids are always those that the
library gives by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from lagpair.llm import textkit as K

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 4
#: Code points with a class of their own lie under this.
LIMIT = 0x2030
#: Words that a process keeps, at most, before it starts anew; some 40 bytes each.
KEPT_WORDS = 2_000_000


def _classes() -> np.ndarray:
    """Class of each code point: Latin text and general punctuation; all else is UNKNOWN."""
    table = np.full(LIMIT + 1, UNKNOWN, dtype=np.uint8)
    for cp in [*range(0x250), *range(0x2010, 0x2028)]:
        c = chr(cp)
        if 0x1C <= cp <= 0x1F:
            continue
        if cp in (*range(9, 14), 0x20, 0x85, 0xA0):
            table[cp] = SPACE
        else:
            table[cp] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
        if len(c.lower()) != 1 or ord(c.lower()) >= LIMIT or table[cp] == LETTER and not regex.match(r"\p{L}", c.lower()):
            table[cp] = UNKNOWN
    return table


CLASS = _classes()
LOWERED = np.array([ord(chr(cp).lower()) if CLASS[cp] != UNKNOWN else cp for cp in range(LIMIT + 1)], dtype=np.uint32)
_VALUE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, LIMIT + 1, dtype=np.uint64)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: printable bytes for themselves, the rest from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


#: UTF-16 code of the letter of each byte.
BYTE_LETTERS = np.array([ord(letter) for _, letter in sorted(_byte_letters().items())], dtype="<u2")


class Encoder:
    """Texts to ids with the tokenizer in ``path``; ``lower`` and ``spaced`` say which of the two known patterns it has.

    ``spaced``: words keep one blank before them and white space is words too (byte-level BPE).
    Otherwise texts are lower-cased, white space is dropped and each digit is a word.
    The content of an added token is its id, as the library has it by default.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in tokens):
            raise ValueError("added tokens are sought in texts as they are, not in normalized ones")
        self.marks = [t.content for t in tokens]
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.n_words = self.n_ids = 0

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _marked(self, text: str, at: np.ndarray) -> np.ndarray:
        """Rows of the chunk that hold the content of an added token."""
        found = [m.start() for mark in self.marks if mark in text for m in re.finditer(re.escape(mark), text)]
        return np.unique(np.searchsorted(at, found, side="right") - 1).astype(np.int64)

    def _slots(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """A slot for each distinct word of the bytes; new words are encoded."""
        if self.n_words > KEPT_WORDS:
            self.forget()
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            place = np.searchsorted(self.keys, hashes)
            place[place == len(self.keys)] = 0
            same = self.keys[place] == hashes
            out[same] = self.slots[place[same]]
        missing = np.flatnonzero(out < 0)
        get, tokenize, recent = self.recent.get, self.tokenizer.model.tokenize, self.recent
        flat: list[int] = []
        lengths: list[int] = []
        letters = BYTE_LETTERS[raw].tobytes().decode("utf-16-le") if len(missing) else ""
        for k, h, a, b in zip(missing.tolist(), hashes[missing].tolist(), first[missing].tolist(), last[missing].tolist()):
            slot = get(h)
            if slot is None:
                ids = [t.id for t in tokenize(letters[a:b])]
                slot = recent[h] = self.n_words + len(lengths)
                flat += ids
                lengths.append(len(ids))
            out[k] = slot
        if lengths:
            self._keep(np.array(lengths, np.int32), np.array(flat, np.uint32))
        if len(recent) > 100_000:
            keys = np.concatenate([self.keys, np.fromiter(recent.keys(), np.uint64, len(recent))])
            slots = np.concatenate([self.slots, np.fromiter(recent.values(), np.int32, len(recent))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], slots[order]
            recent.clear()
        return out

    def _keep(self, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Appends new words' ids to arrays that grow by half when they are full."""
        n, m = self.n_words + len(lengths), self.n_ids + len(flat)
        if n > len(self.lengths):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)]) for x in (self.starts, self.lengths))
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(m - len(self.flat), len(self.flat) // 2), np.uint32)])
        self.lengths[self.n_words : n] = lengths
        self.starts[self.n_words : n] = self.n_ids + np.cumsum(lengths) - lengths
        self.flat[self.n_ids : m] = flat
        self.n_words, self.n_ids = n, m

    def chunk(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and their offsets."""
        rows = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        text = raw.tobytes().decode("utf-8")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(cps) == len(raw):
            at = offsets
        else:
            at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        known = np.minimum(cps, LIMIT)
        kind = CLASS[known]
        if not self.spaced:
            known = LOWERED[known]
        start = self._boundaries(known, kind, at)
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(cps))
        if not self.spaced:
            keep = kind[first] != SPACE
            first, last = first[keep], last[keep]
        hashes = K.run_hashes(_VALUE[known], first, last)
        odd = np.flatnonzero(np.add.reduceat(kind == UNKNOWN, np.minimum(at[:-1], len(cps) - 1)) * (at[1:] > at[:-1])) if (kind == UNKNOWN).any() else []
        odd = np.union1d(odd, self._marked(text, at)).astype(np.int64)
        row_of = np.searchsorted(first, at)
        if len(odd):
            drop = np.zeros(len(first), dtype=bool)
            for r in odd:
                drop[row_of[r] : row_of[r + 1]] = True
            hashes, first, last = hashes[~drop], first[~drop], last[~drop]
            row_of = np.searchsorted(first, at)
        distinct, at_first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if not self.spaced:
            raw = np.frombuffer(known.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
        if len(cps) != len(raw):  # the first byte of each code point
            byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            first, last = byte[first], byte[last]
        slots = self._slots(distinct, first[at_first], last[at_first], raw)[inverse]
        sizes = self.lengths[slots].astype(np.int64)
        ids = self.flat[K.ragged(self.starts[slots].astype(np.int64), sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[row_of]
        if not len(odd):
            return ids, bounds
        parts, sizes = [], np.diff(bounds)
        odd = set(int(r) for r in odd)
        for r in range(rows):
            parts.append(np.array(self.whole(text[at[r] : at[r + 1]]), dtype=np.uint32) if r in odd else ids[bounds[r] : bounds[r + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _boundaries(self, cps: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks the first code point of every word and of every run of white space."""
        n = len(cps)
        edge = np.zeros(n + 4, dtype=bool)
        edge[at] = True
        edge[n:] = True
        start = np.ones(n, dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= edge[:n]
        quotes = np.flatnonzero((cps == 39) & start)
        if self.spaced:
            head = np.flatnonzero(start & (kind != SPACE) & ~edge[:n])
            before = head - 1
            after_space = kind[before] == SPACE
            blank = cps[before] == 32
            start[head[blank]] = False
            start[before[after_space]] = True
        else:
            start |= kind == NUMBER
        if len(quotes):
            self._suffixes(cps, kind, edge, start, quotes[start[quotes]])
        return start

    @staticmethod
    def _suffixes(cps: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray, quotes: np.ndarray) -> None:
        """An apostrophe that begins a word and one of the suffixes s t m d re ve ll after it are a word."""
        n = len(cps)
        padded = np.concatenate([cps, np.zeros(4, cps.dtype)])
        kinds = np.concatenate([kind, np.full(4, SPACE, kind.dtype)])
        inside = ~edge[quotes + 1]
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = inside & np.isin(one, [ord(c) for c in "stmd"])
        double = inside & ~edge[quotes + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((single, 1), (double, 2)):
            q = quotes[found]
            start[q + 1] = False
            rest = q + 1 + size
            more = rest[~edge[rest] & (kinds[rest] == LETTER)]
            start[more[more < n]] = True


def encoder(path: str, spaced: bool) -> Encoder:
    """The process's encoder for a tokenizer file; it keeps the words it has met from task to task."""
    key = f"encoder {path}"
    kept = K.cache().get(key)
    if kept is None:
        kept = K.cache()[key] = Encoder(path, spaced)
    return kept


def encoded(column: pa.Array, path: str, spaced: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column: first row, end row, ids, offsets of the rows' ids."""
    model = encoder(path, spaced)
    for a, b, raw, offsets in K.chunks(column):
        if b - a > 1 or len(raw) <= 2 * K.CHUNK_BYTES:
            yield a, b, *model.chunk(raw, offsets)
            continue
        # a word begins at a blank between letters or digits, whatever stands before it
        found, at = [], 0
        for end in K.parts(raw, K.lone_blanks(raw)):
            found.append(model.chunk(raw[at:end], np.array([0, end - at]))[0])
            at = end
        ids = np.concatenate(found)
        yield a, b, ids, np.array([0, len(ids)])
