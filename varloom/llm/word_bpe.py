"""Word-level byte pair encoding of a tokenizer file: words, exact merges, token texts.

Shared by the encoder and by packing. A text is cut at the special tokens,
normalised (NFC, lower case per character) and split at white space. No token
crosses white space, so every word is encoded on its own and results can be kept
per word. Many words are merged at once on arrays: each round applies the pair of
lowest rank (leftmost first) of every word, which is the order of a single word.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Pieces of a word: contractions, letters, single digits, other signs.
_PIECES = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9]+")
#: White space without the control characters that Python counts as such.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
_NONE = 2**30
_WIDE = 40  # longer pieces are merged one by one


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


def _class_of(points: list[int]) -> str:
    """A character class of few ranges."""
    starts = [c for c in points if c - 1 not in set(points)]
    ends = [c for c in points if c + 1 not in set(points)]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]" if points else r"(?!)"


def _is_latin1(text: str) -> bool:
    """Quick for the usual text; it holds no letter that Python does not know."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Classes(dict):
    """A letter, a digit or a sign that stands for a character in :data:`_PIECES`.

    Which class a character has depends on the version of Unicode; the tokenizer file's own
    rule is asked, once per character that occurs.
    """

    def __init__(self, rule):
        super().__init__({c: c for c in range(128)})
        self.rule = rule

    def __missing__(self, code: int) -> int:
        c = chr(code)
        parts = len(self.rule(f"a{c}{c}b"))
        # letters stay together, every number is a part of its own, other signs are one part
        self[code] = ord({1: "z", 4: "0"}.get(parts, "-"))
        return self[code]


class _PairTable:
    """Rank of a pair of ids on arrays: two hash tables without collisions."""

    BITS = 20

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.array([r for r, _ in pairs.values()], np.int32)
        rng = np.random.default_rng(3)
        self.tables, left = [], np.arange(len(keys))
        while len(left):
            odd = np.uint64(int(rng.integers(0, 2**62)) * 2 + 1)
            slot = self._slot(keys[left], odd)
            _, first = np.unique(slot, return_index=True)
            held = np.full(1 << self.BITS, np.iinfo(np.uint64).max, np.uint64)
            rank = np.full(1 << self.BITS, _NONE, np.int32)
            held[slot[first]], rank[slot[first]] = keys[left[first]], ranks[left[first]]
            self.tables.append((odd, held, rank))
            left = np.delete(left, first)

    def _slot(self, keys, odd):
        return ((keys * odd) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks; pairs that are no merge, or have no right side (-1), get ``_NONE``."""
        keys = a.astype(np.uint64) << np.uint64(32) | (b.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        for odd, held, rank in self.tables:
            slot = self._slot(keys, odd)
            out = np.where(held[slot] == keys, rank[slot], out)
        return out


class WordBpe:
    """The tokenizer of one file; loaded once per Python worker through :func:`load`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.made = np.array([new for _, new in self.ranks.values()], np.int32)
        self.table = _PairTable(self.ranks)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        library = Tokenizer.from_file(path)
        self.classes = _Classes(library.pre_tokenizer.pre_tokenize_str)
        # capital letters that the tokenizer's version of Unicode knows and Python's does not
        unknown = (c for c in range(0x20000) if unicodedata.category(chr(c)) == "Cn")
        lower = ((c, library.normalizer.normalize_str(chr(c))) for c in unknown)
        self.lower_newer = {c: x for c, x in lower if x != chr(c)}
        self.newer = re.compile(_class_of(sorted(self.lower_newer)))
        letters = _byte_letters()
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int32)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # lower() of a whole text turns a capital sigma at a word's end into another letter
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            if not _is_latin1(text) and self.newer.search(text):
                text = text.translate(self.lower_newer)
        if _CONTROLS.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is marked by a leading space."""
        if "<|" not in text:
            return self._split(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(" " + part)
            elif part:
                out.extend(self._split(part))
        return out

    def pieces(self, word: str) -> list[str]:
        if word[0] == " ":
            return [word]
        if word.isascii():
            return [word] if word.isalpha() else _PIECES.findall(word)
        return [word[m.start() : m.end()] for m in _PIECES.finditer(word.translate(self.classes))]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, merged exactly."""
        cut = [self.pieces(w) for w in words]
        flat, offsets = self._merge([p for pieces in cut for p in pieces])
        ends = np.cumsum([len(pieces) for pieces in cut]) if cut else []
        out, start = [], 0
        for end in ends:
            out.append(flat[offsets[start] : offsets[end]])
            start = end
        return out

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        done: dict[int, np.ndarray] = {}
        for k, p in enumerate(pieces):
            if sizes[k] > _WIDE:
                done[k] = np.array(self._merge_long(data[k]), np.int32)
            elif p[0] == " ":
                done[k] = np.array([self.special[p[1:]]], np.int32)
        rows = np.array([k for k in range(len(data)) if k not in done], np.int64)
        width = int(sizes[rows].max()) if len(rows) else 0
        final = np.full((len(data), max(width, 1)), -1, np.int32)
        if len(rows):
            self._merge_rows(rows, [data[k] for k in rows], sizes[rows], final)
        counts = (final >= 0).sum(1)
        if not done:
            return final[final >= 0], np.concatenate(([0], np.cumsum(counts)))
        parts = [done[k] if k in done else final[k, : counts[k]] for k in range(len(data))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _merge_rows(self, rows, data, sizes, final) -> None:
        width = int(sizes.max())
        cells = np.frombuffer(b"".join(data), np.uint8)
        here = np.arange(width) < sizes[:, None]
        ids = np.full((len(data), width), -1, np.int32)
        ids[here] = self.inner[cells]
        ends = np.cumsum(sizes) - 1
        ids[np.arange(len(data)), sizes - 1] = self.last[cells[ends]]
        ranks = np.full((len(data), width), _NONE, np.int32)
        pair = here[:, 1:]
        if width > 1:
            ranks[:, :-1][pair] = self.table(ids[:, :-1][pair], ids[:, 1:][pair])
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                final[rows[over], : ids.shape[1]] = ids[over]
                go = ~over
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            if not len(rows):
                return
            line = np.arange(len(rows))
            ids[line, at] = self.made[best]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            ranks[:, -1] = _NONE
            inner = at > 0
            ranks[line[inner], at[inner] - 1] = self.table(ids[line[inner], at[inner] - 1], ids[line[inner], at[inner]])
            more = at + 1 < ids.shape[1]
            ranks[line[more], at[more]] = self.table(ids[line[more], at[more]], ids[line[more], at[more] + 1])

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for one long piece, with a heap over linked neighbours."""
        import heapq

        ids = [int(self.inner[b]) for b in data[:-1]] + [int(self.last[data[-1]])]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := self.ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else n
                if right < n and (r := self.ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (r[0], left, ids[left], ids[right], r[1]))
        return [x for x, here in zip(ids, alive) if here]

    def text(self, ids) -> str:
        """Token texts joined by a space, as the file states no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    """Place of the public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
