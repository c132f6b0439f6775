"""Exact tokenisation by the tokenizers library with a bounded memo of words."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from millrace.llm.shared import keeps, mix, text_bytes, word_hashes

#: Units kept in a worker's memory; beyond that the memo begins anew.
MEMO_UNITS = 2_000_000
#: Kinds of units: a word at the start of a line or text, a word after a blank, a run of newlines, one at the end of a text.
FIRST, LATER, LINES, LAST_LINES = range(4)
_CLASS = np.full(256, 2, np.uint8)
_CLASS[0x20], _CLASS[0x0A] = 0, 1
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _heads(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each unit as a number."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))[starts] & _MASK[np.minimum(ends - starts, 8)]


@dataclass
class Units:
    """A slice of texts cut at blanks and newline runs; ``whole`` are the texts in which no cut is safe."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    heads: np.ndarray
    unique: np.ndarray
    first: np.ndarray
    inverse: np.ndarray
    row: np.ndarray
    whole: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Units":
        raw, offsets = text_bytes(column)
        n = len(offsets) - 1
        kind = _CLASS[raw]
        fresh = np.zeros(len(raw) + 1, bool)  # where a text begins or ends
        fresh[offsets] = True
        before, after = np.concatenate([[3], kind[:-1]])[: len(raw)], np.concatenate([kind[1:], [3]])[: len(raw)]
        starts = np.flatnonzero((kind > 0) & ((kind != before) | fresh[:-1]))
        ends = np.flatnonzero((kind > 0) & ((kind != after) | fresh[1:])) + 1
        # a blank at a text's or line's end or beside another, or a newline at a text's start: no cut is safe there
        odd = np.flatnonzero(((kind == 0) & ((before < 2) | fresh[:-1] | (after < 2) | fresh[1:])) | ((kind == 1) & fresh[:-1]))
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offsets, odd, "right") - 1] = True
        kinds = np.where(kind[starts] == 1, np.where(fresh[ends], LAST_LINES, LINES), np.where((before[starts] == 0) & ~fresh[starts], LATER, FIRST))
        keys = mix(word_hashes(raw, starts, ends) + kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return cls(raw, offsets, starts, ends, kinds, _heads(raw, starts, ends), unique, first, inverse, np.searchsorted(offsets, starts, "right") - 1, whole)

    def texts(self, rows: np.ndarray) -> list[str]:
        data = self.raw.tobytes() if len(rows) else b""
        return [data[self.offsets[k] : self.offsets[k + 1]].decode("utf-8", "replace") for k in rows]


class _Ranks:
    """A rank file behind the calls of the tokenizers library that the memo makes; texts hold no special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[n for token, n in ranks.items() if token.startswith(b" ")]] = True

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode_ordinary(t) for t in texts]


class _Library:
    """A file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        names = [self.own.id_to_token(k) or "" for k in range(self.own.get_vocab_size(with_added_tokens=True))]
        #: Whether an id's text begins with a blank (byte-level BPE writes it as U+0120).
        self.opens = np.array([n.startswith("\u0120") for n in names])

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch(texts, add_special_tokens=False)]


class WordMemo:
    """Encodes whole texts; equal words are given to the library once.

    Byte-level BPE never merges across its pre-tokens, and a blank between two characters that
    are not white space always begins one; a run of newlines between such characters stands
    alone, its last newline apart unless it ends the text. So a text can be cut there into units
    without changing its ids. Texts with any other white space beside a cut go to the library whole.

    Units are told apart by a 64-bit hash, and by their first eight bytes; a text in which these disagree goes to the library whole.
    """

    def __init__(self, path: str):
        backend = _Ranks(path) if path.endswith(".tiktoken") else _Library(path)
        self.library, self.opens, self._ids = backend.own, backend.opens, backend.ids
        self.vocabulary = len(self.opens)
        self.special = [] if path.endswith(".tiktoken") else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.newline = self._ids(["\n"])[0][0]
        self._forget()

    def _forget(self) -> None:
        """Sorted unit keys with their heads, places in ``ids`` and counts; a count of -1 is for no word."""
        self.keys, self.heads = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, np.uint32) for ids in self._ids(texts)]

    def _words(self, words: list[str], gap: str) -> list[np.ndarray]:
        """Ids of each word after a blank, or at the start of a line, from one call for all.

        After a blank a word begins where an id opens with a blank; after a newline, which is an
        id of its own, it begins with the next id.
        """
        ids = np.asarray(self._ids(["".join([gap + w for w in words])])[0], np.uint32)
        at = np.flatnonzero(self.opens[ids] if gap == " " else ids == self.newline)
        if len(at) != len(words):
            return self._whole([gap.strip("\n") + w for w in words])
        skip, ends = int(gap != " "), np.append(at[1:], len(ids))
        return [ids[a + skip : b] for a, b in zip(at.tolist(), ends.tolist())]

    def _learn(self, keys: np.ndarray, heads: np.ndarray, kinds: np.ndarray, units: list[str]) -> None:
        """Add new units (sorted by key)."""
        found: list[np.ndarray | None] = [None] * len(units)
        joined = "\n".join(units)
        special = any(t in joined for t in self.special)
        for kind, gap in ((FIRST, "\n"), (LATER, " ")):
            good = [k for k in np.flatnonzero(kinds == kind).tolist() if (w := units[k]) and w.strip() is w and not (special and any(t in w for t in self.special))]
            for k in range(0, len(good), 1024):
                some = good[k : k + 1024]
                for n, ids in zip(some, self._words([units[n] for n in some], gap)):
                    found[n] = ids
        for k in np.flatnonzero(kinds >= LINES).tolist():
            run = units[k]
            found[k] = np.concatenate(self._whole([run] if kinds[k] == LAST_LINES else [p for p in (run[:-1], "\n") if p]))
        count = np.array([-1 if f is None else len(f) for f in found], np.int32)
        size = np.maximum(count, 0).astype(np.int64)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        self.ids = np.concatenate([self.ids, *(f for f in found if f is not None)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.heads = np.insert(self.keys, where, keys), np.insert(self.heads, where, heads)
        self.at, self.count = np.insert(self.at, where, at), np.insert(self.count, where, count)

    def _entries(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """The memo's entry of each unit, and the rows that go to the library whole."""
        if len(self.keys) > MEMO_UNITS:
            self._forget()
        where = np.searchsorted(self.keys, units.unique)
        new = np.flatnonzero(self.keys[np.minimum(where, len(self.keys) - 1)] != units.unique) if len(self.keys) else np.arange(len(units.unique))
        if len(new):
            at, data = units.first[new], units.raw.tobytes()
            words = [data[a:b].decode("utf-8", "replace") for a, b in zip(units.starts[at].tolist(), units.ends[at].tolist())]
            self._learn(units.unique[new], units.heads[at], units.kinds[at], words)
            where = np.searchsorted(self.keys, units.unique)
        entry, whole = where[units.inverse], units.whole.copy()
        whole[units.row[(self.count[entry] < 0) | (self.heads[entry] != units.heads)]] = True
        return entry, whole

    def count_ids(self, units: Units) -> np.ndarray:
        """The number of ids of each text."""
        entry, whole = self._entries(units)
        total = np.concatenate([[0], np.cumsum(self.count[entry].astype(np.int64))])
        at = np.searchsorted(units.starts, units.offsets)
        out, redo = total[at[1:]] - total[at[:-1]], np.flatnonzero(whole)
        out[redo] = [len(ids) for ids in self._ids(units.texts(redo))]
        return out

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and the n + 1 bounds; null is empty."""
        units = Units.of(column)
        entry, whole = self._entries(units)
        count = np.where(whole[units.row], 0, self.count[entry]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.at[entry] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(units.starts, units.offsets)]
        redo = np.flatnonzero(whole)
        if not len(redo):
            return ids, bounds
        sizes, parts, done = np.diff(bounds), [], 0
        for k, found in zip(redo.tolist(), self._whole(units.texts(redo))):
            parts += (ids[done : bounds[k]], found)
            done, sizes[k] = bounds[k], len(found)
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


_memos: dict[str, WordMemo] = keeps({})


def memo(path: str) -> WordMemo:
    """The worker's encoder for a tokenizer file, kept until an operator without encoders runs there (``let_go``)."""
    if path not in _memos:
        _memos[path] = WordMemo(path)
    return _memos[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """A byte-level BPE file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)
