"""Token ids of whole texts by the tokenizers library, with a memo of words already met.

A byte-level BPE vocabulary with the usual pre-tokenizer never joins what a single space or line
feed parts, nor a letter or digit with one closing punctuation mark other than an apostrophe. Texts without
other white space, without two white spaces in a row and without an added token are therefore cut at
white space and before such marks, in Arrow's own buffers; the library gets each piece that the worker's memo
lacks, and the ids are gathered. All other texts go to the library, very long ones in
parts that end between two plain words.

The memo keys a piece by its bytes themselves, in three machine words, so that one pass over arrays looks up all pieces.
"""

from __future__ import annotations

import os
import re
import sys

import numpy as np
import pyarrow as pa

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces that a worker keeps; beyond, those met again since the last time stay.
MEMO = 900_000
#: Bytes of text cut at a time, and bytes of a piece up to which it is worth a place in the memo.
WINDOW = 1 << 21
LONGEST = 23
#: Texts with a piece of over so many bytes go to the library as they are; so do others in parts of about PART characters.
WORD, PART = 400, 1 << 17

# White space other than space and line feed, bytes (fixed values).
_OTHER = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SPACE, _LINE, _BAD, _LEAD = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[32], _CLASS[10] = _SPACE, _LINE
_CLASS[list(_OTHER)] = _BAD
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD  # first bytes of wide white space
_CLOSING = np.zeros(256, bool)
_CLOSING[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_SAFE = re.compile(r"[A-Za-z0-9](?= [A-Za-z])")

# What stands before a piece: a space, a line feed, or nothing that it takes with it.
SPACED, LINED, BARE = 1, 2, 3
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Ids of pieces in flat arrays: an open table of places, keys of three words, and a bank of ids."""

    def __init__(self, kind: type):
        self.kind = kind
        self._reset(1 << 16)

    def _reset(self, room: int) -> None:
        self.bits = max(17, (2 * room - 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((room + 1, 3), np.uint64)
        self.at, self.size, self.hit = np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int32), np.zeros(room + 1, bool)
        self.bank, self.n, self.used = np.zeros(4 * room, self.kind), 0, 0

    def __len__(self) -> int:
        return self.n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _MIX[0] ^ (keys[:, 1] + _MIX[0]) * _MIX[1] ^ (keys[:, 2] + _MIX[1]) * _MIX[2]
        return ((h ^ h >> np.uint64(29)) * _MIX[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is unknown."""
        slot = self._slot(keys)
        out = self.table[slot]
        todo = np.flatnonzero((self.keys[out] != keys).any(axis=1) & (out >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & len(self.table) - 1
            out[todo] = self.table[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo]).any(axis=1)]
        return out

    def _enter(self, first: int) -> None:
        """Places of the keys from number ``first`` on, which the table lacks."""
        todo = np.arange(first, self.n)
        slot = self._slot(self.keys[todo])
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            open_ = self.table[slot] != todo
            todo, slot = todo[open_], slot[open_] + 1 & len(self.table) - 1

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """``keys`` are distinct and unknown; ``ids`` are theirs one after the other."""
        first, self.n, end = self.n, self.n + len(keys), self.used + len(ids)
        if self.n >= len(self.keys):
            room = self.n + self.n // 2
            for name in ("keys", "at", "size", "hit"):
                old = getattr(self, name)
                new = np.zeros((room + 1, *old.shape[1:]), old.dtype)
                new[:first] = old[:first]
                setattr(self, name, new)
        if end > len(self.bank):
            self.bank = np.concatenate((self.bank, np.zeros(end // 2, self.kind)))
        self.keys[first : self.n], self.size[first : self.n] = keys, size
        self.at[first : self.n] = self.used + np.cumsum(size) - size
        self.bank[self.used : end] = ids
        self.used = end
        if 2 * self.n > len(self.table):
            self.bits = (4 * self.n - 1).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            first = 0
        self._enter(first)

    def trim(self, most: int) -> None:
        """When over ``most`` pieces are held, keep those met since the last time, half of ``most`` at the utmost."""
        if self.n <= most:
            return
        kept = np.flatnonzero(self.hit[: self.n])
        kept = kept[max(0, len(kept) - most // 2) :]
        keys, size = self.keys[kept], self.size[kept]
        ids = self.bank[spread(self.at[kept], size.astype(np.int64))]
        self._reset(max(1 << 16, len(kept)))
        self.add(keys, ids, size)


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all runs, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - size), size) + np.arange(total)


class Encoder:
    """Ids of texts, as a tokenizers file at ``path`` gives them by default; none are added at the ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.added = [a.content.encode() for a in added]
        # matched in normalized text, or across the white space where texts are cut
        wide = any((a.normalized and self.tok.normalizer) or len(a.content.split()) != 1 or a.content != a.content.strip() for a in added)
        line = self.tok.encode("\n", add_special_tokens=False).ids
        probe = self.tok.encode("a\n b\nc, d", add_special_tokens=False).ids
        apart = [i for w in ("a", "\n", " b", "\n", "c", ",", " d") for i in self.tok.encode(w, add_special_tokens=False).ids]
        self.line = line[0] if len(line) == 1 and probe == apart and not wide else None  # else every text goes whole
        self.kind = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.memo = Memo(self.kind)

    def _whole(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while self.line is not None and len(text) - at > PART:
            m = _SAFE.search(text, at + PART)
            if not m:
                break
            parts.append(text[at : m.end()])
            at = m.end()
        parts.append(text[at:])
        return np.concatenate([np.array(self.tok.encode_batch_fast([p], add_special_tokens=False)[0].ids, self.kind) for p in parts])

    def _learn(self, pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces``, one after the other, and the count of each."""
        own: list[bytes] = [b""] * len(pieces)
        width, line = np.dtype(self.kind).itemsize, self.kind(self.line)
        for lead, which in ((" ", [i for i, p in enumerate(pieces) if p[0] == SPACED]), ("", [i for i, p in enumerate(pieces) if p[0] != SPACED and p[1]])):
            for k in range(0, len(which), 400):
                part = which[k : k + 400]
                words = [pieces[i][1].decode() for i in part]
                text = lead + f"\n{lead}".join(words)
                ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
                ends = np.append(np.flatnonzero(ids == line), len(ids)) * width
                raw, at = ids.tobytes(), 0
                for i, e in zip(part, ends.tolist(), strict=True):
                    own[i] = raw[at:e]
                    at = e + width
        head = line.tobytes()
        own = [head + b if p[0] == LINED else b for p, b in zip(pieces, own)]
        return np.frombuffer(b"".join(own), self.kind), np.fromiter(map(len, own), np.int64, len(own)) // width

    def encode(self, texts: list[str] | pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the count of each text; ``end_id`` follows the ids of each."""
        arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        arr = arr.cast(pa.large_string()).fill_null("")
        if not len(arr):
            return np.empty(0, self.kind), np.empty(0, np.int64)
        ends = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        kind = self.kind if end_id is None or end_id <= np.iinfo(self.kind).max else np.uint32
        odd = self._odd(data, ends)
        out: list[np.ndarray] = []
        counts = np.zeros(len(arr), np.int64)
        tail = np.array([] if end_id is None else [end_id], kind)
        a = 0
        while a < len(arr):
            if odd[a]:
                ids = self._whole(data[ends[a] : ends[a + 1]].tobytes().decode())
                out += [ids, tail]
                counts[a] = len(ids) + len(tail)
                a += 1
                continue
            stop = int(np.searchsorted(ends, ends[a] + WINDOW, side="right")) - 1
            b = max(a + 1, min(stop, len(arr)))
            mixed = np.flatnonzero(odd[a:b])
            b = a + int(mixed[0]) if len(mixed) else b
            if b == a + 1:
                at, full = int(ends[a]), int(ends[b])
                while True:  # a long text by windows that end before white space
                    to = full if full - at <= 2 * WINDOW else self._gap(data, at + WINDOW, full)
                    ids, n = self._cut(data[at:to], np.array([0, to - at]), tail[:0] if to < full else tail, kind, after=0 if at == ends[a] else int(_CLASS[data[at - 1]]))
                    out.append(ids)
                    counts[a] += n[0]
                    at = to + 1
                    if to == full:
                        break
            else:
                ids, counts[a:b] = self._cut(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], tail, kind)
                out.append(ids)
            a = b
        return np.concatenate(out), counts

    @staticmethod
    def _gap(data: np.ndarray, at: int, full: int) -> int:
        """The first white space from ``at`` on; texts whose words are too long for this go whole."""
        for i in range(at, full, 1 << 16):
            found = np.flatnonzero((data[i : i + (1 << 16)] == 32) | (data[i : i + (1 << 16)] == 10))
            if len(found):
                return i + int(found[0])
        return full

    def _odd(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that the rule of single white spaces does not cover."""
        odd = np.zeros(len(ends) - 1, bool)
        if self.line is None:
            return ~odd
        raw, places = None, []
        for i in range(0, len(data), WINDOW):
            part = data[i : i + WINDOW + 2]
            cls = _CLASS[part]
            at = np.flatnonzero(cls)
            kind = cls[at]
            places.append(at[kind == _BAD] + i)
            gap = at[kind <= _LINE]
            places.append(gap[1:][np.diff(gap) == 1] + i)
            lead = at[kind == _LEAD]
            if len(lead):
                raw = np.concatenate((part, np.zeros(2, np.uint8)))
                x, y, z = raw[lead], raw[lead + 1], raw[lead + 2]
                wide = (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
                wide |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
                places.append(lead[wide] + i)
            stops = np.concatenate(([-1], gap, [len(part)]))
            long = np.flatnonzero(np.diff(stops) > WORD)
            places.append(np.minimum(stops[long] + WORD + i, len(data) - 1))
        blob = None
        for token in self.added:
            blob = data.tobytes() if blob is None else blob
            at = blob.find(token)
            while at >= 0:
                places.append(np.array([at]))
                at = blob.find(token, at + 1)
        where = np.unique(np.concatenate(places)) if places else np.empty(0, np.int64)
        if len(where):
            owner = np.searchsorted(ends, where, side="right") - 1
            # two white spaces in a row: the second one may start a text
            first = np.isin(where, ends[:-1]) & np.isin(data[where], (32, 10))
            odd[owner[~first]] = True
        return odd

    def _cut(self, data: np.ndarray, ends: np.ndarray, tail: np.ndarray, kind: type, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts; ``after`` tells of white space that stood before the first."""
        cls = _CLASS[data]
        gap = np.flatnonzero((cls == _SPACE) | (cls == _LINE))
        low, high = np.searchsorted(gap, ends[:-1]), np.searchsorted(gap, ends[1:])
        start = np.insert(gap + 1, low, ends[:-1])
        stop = np.insert(gap, high, ends[1:])
        how = np.insert(cls[gap], low, BARE)
        if after:
            how[0] = after
        heads = low + np.arange(len(low))  # first piece of each text
        # one closing mark after a letter or digit is a piece of its own
        size = stop - start
        two = np.flatnonzero(size > 1)
        last, before = data[stop[two] - 1], data[stop[two] - 2]
        mark = _CLOSING[last] & _ALNUM[before]
        three = two[size[two] > 2]
        letter = np.zeros(len(two), bool)
        letter[size[two] > 2] = (data[stop[three] - 3] == 0xC3) & (data[stop[three] - 2] >= 0x80) & (data[stop[three] - 2] <= 0xBF) & (data[stop[three] - 2] != 0x97) & (data[stop[three] - 2] != 0xB7)
        marked = two[mark | (_CLOSING[last] & letter)]
        start, how = np.insert(start, marked + 1, stop[marked] - 1), np.insert(how, marked + 1, BARE)
        stop = np.insert(stop, marked, stop[marked] - 1)
        heads = heads + np.searchsorted(marked, heads)
        size = stop - start

        padded = np.concatenate((data, np.zeros(24, np.uint8)))
        view = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))
        keys = np.empty((len(start), 3), np.uint64)
        for j in range(3):
            keys[:, j] = view[np.minimum(start + 8 * j, len(data) + 16)] & _LOW[np.clip(size - 8 * j, 0, 8)]
        fits = size <= LONGEST
        keys[:, 2] &= _LOW[7]
        keys[:, 2] |= (np.minimum(size, LONGEST + 1).astype(np.uint64) | how.astype(np.uint64) << np.uint64(5)) << np.uint64(56)

        self.memo.trim(MEMO)
        memo = self.memo
        found = memo.find(keys)
        memo.hit[found[found >= 0]] = True
        found[~fits] = -1
        missing = np.flatnonzero(found < 0)
        long_at = np.empty(0, np.int64)
        if len(missing):
            raw = data.tobytes()
            nr: dict[tuple[int, bytes], int] = {}
            which = [nr.setdefault((h, raw[s:e]), len(nr)) for h, s, e in zip(how[missing].tolist(), start[missing].tolist(), stop[missing].tolist())]
            which = np.array(which)
            ids, n = self._learn(list(nr))
            first = np.zeros(len(nr), np.int64)
            first[which[::-1]] = missing[::-1]  # a place where each stands
            own = fits[first]
            memo.add(keys[first[own]], ids[np.repeat(own, n)], n[own])
            number = np.full(len(nr), -1, np.int64)
            number[own] = np.arange(memo.n - int(own.sum()), memo.n)
            found[missing] = number[which]
            long_at = missing[number[which] < 0]
        at, n_ids, bank = memo.at[found], memo.size[found].astype(np.int64), memo.bank
        if len(long_at):  # too long for the memo: right behind the bank for this once
            w = which[found[missing] < 0]
            at[long_at] = memo.used + (np.cumsum(n) - n)[w]
            n_ids[long_at] = n[w]
            bank = np.concatenate((memo.bank[: memo.used], ids))
        if len(tail):
            stops = np.append(heads[1:], len(start))
            at, n_ids = np.insert(at, stops, 0), np.insert(n_ids, stops, len(tail))
            heads = heads + np.arange(len(heads))
            marks = stops + np.arange(len(stops))
        done = np.concatenate(([0], np.cumsum(n_ids)))
        out = bank[spread(at, n_ids)].astype(kind, copy=False)
        if len(tail):
            out[done[marks]] = tail[0]
        return out, np.diff(done[np.append(heads, len(n_ids))])


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``: Python workers serve many tasks, so the memo stays until `release`."""
    held = sys.modules[__name__].__dict__.setdefault("_HELD", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def release() -> None:
    """Drop the worker's encoders: tasks of another kind, which the same worker runs later, need the memory."""
    sys.modules[__name__].__dict__.get("_HELD", {}).clear()


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value a text of its little-endian ids."""
    ends = np.concatenate(([0], np.cumsum(counts))) * ids.itemsize
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])


def in_slices(texts: list[str], limit: int = 1 << 23):
    """(first, last) index pairs of slices of about ``limit`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
