"""Token ids of whole texts by the ``tokenizers`` library, with a memo of words.

A byte-level BPE with the usual splitting pattern encodes each piece of that pattern by itself, so
the ids of a text are those of its pieces, in order. Many texts are cut into pieces at a time, which are known by 128 bits of hash.
The library's model encodes those pieces that a worker hasn't met or has
forgotten; texts with characters outside the blocks whose classes are given below, or with an
added token's string in them, are given to the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata

import numpy as np

from colstate.llm import common

SIMPLE = "\x00-ɏ‐-‧‰-⁞€"
#: The classes of the splitting pattern of byte-level BPE, written out for SIMPLE.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0   "
_LETTERS, _NUMBERS, _OTHERS, _BLANKS, _ODD, _END = range(6)


def _classes() -> np.ndarray:
    """The class of each 16-bit unit; U+FFFF stands between texts."""
    out = np.full(1 << 16, _ODD, np.uint8)
    for c in map(ord, re.findall(f"[{SIMPLE}]", "".join(map(chr, range(0x2100))))):
        kind = unicodedata.category(chr(c))[0] if c < 0x250 else ""
        out[c] = _BLANKS if chr(c) in _SPACE else {"L": _LETTERS, "N": _NUMBERS}.get(kind, _OTHERS)
    out[0xFFFF] = _END
    return out


_CLASS = _classes()
#: Units of a piece that are hashed in bulk; a longer piece is hashed by itself.
_SHORT = 64
#: Two hashes of 64 bits know a piece: sums of a random number of each unit times a random odd one of its place.
_RANDOM = np.random.default_rng()
_UNIT = _RANDOM.integers(1, 1 << 64, (2, 1 << 16), np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 64, (2, _SHORT), np.uint64) | np.uint64(1)
#: Pieces of a full memo: about 45 MB a worker. A few more than 629,000 would double the size of its table.
_MEMO_PIECES = 600_000
#: Characters of texts that are cut into pieces at a time.
_BATCH_CHARS = 1 << 17

#: The sign that byte-level BPE writes for each byte: printable ones of Latin-1 for themselves, the others numbered from U+0100.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGNS = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(0x100) if b not in _PLAIN)}


def _signs(text: str) -> str:
    """The signs of a text's bytes."""
    return text.encode().decode("latin-1").translate(_SIGNS)


def definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def version(definition_json: str) -> str:
    """Digest of all that decides the ids: the definition and the library's version."""
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}\n{definition_json}".encode()).hexdigest()


def _starts(u: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of units start: runs of a class, with one blank before them, and contractions."""
    start = np.ones(len(u) + 3, bool)
    start[1 : len(u)] = kind[1:] != kind[:-1]
    # the last of the blanks before a word isn't with the others; a space is the word's
    last = np.nonzero(start[1 : len(u)] & (kind[1:] <= _OTHERS) & (kind[:-1] == _BLANKS))[0]
    start[last] = True
    start[last[u[last] == 0x20] + 1] = False
    mark = np.nonzero((u == 0x27) & start[: len(u)])[0]
    if len(mark):
        x, y = (np.append(u, np.zeros(2, u.dtype))[mark + k] for k in (1, 2))
        one = np.isin(x, list(map(ord, "stmd")))
        two = np.isin(x, list(map(ord, "rv"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
        for k, hit in ((2, mark[one]), (3, mark[two])):
            start[hit + 1] = False
            start[hit + k] = True
    return np.nonzero(start[: len(u)])[0]


def _hashes(u: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two hashes of each piece; the pieces are all of ``u``, one after the other."""
    place = np.arange(len(u)) - np.repeat(start, size)
    long = np.nonzero(size > _SHORT)[0]
    if len(long):
        place = np.minimum(place, _SHORT - 1)
    out = np.stack([np.add.reduceat(_UNIT[k][u] * _PLACE[k][place], start) for k in (0, 1)])
    for i in long.tolist():
        d = hashlib.blake2b(u[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest()
        out[:, i] = np.frombuffer(d, np.uint64)
    return out


def _grown(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``a`` with ``more`` behind the first ``used`` places; it grows by half when it is full."""
    if used + len(more) > len(a):
        a = np.append(a, np.zeros(max(len(a) // 2, used + len(more) - len(a)), a.dtype))
    a[used : used + len(more)] = more
    return a


class Memo:
    """The ids of pieces by their hashes, in a table of open addresses. When it is full, it keeps those pieces that
    most batches asked for, more than one, since it was full last."""

    def __init__(self, most: int):
        self.most = most
        self._keep(np.empty((2, 0), np.uint64), np.empty(0, np.int64), np.empty(0, "<u4"))

    def _keep(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.count, self.size, self.flat, self.ids = len(size), size.astype(np.int32), flat, len(flat)
        self.start, self.used = np.cumsum(size) - size, np.zeros(len(size), np.int32)
        self._table(keys, 16)

    def _table(self, keys: np.ndarray, bits: int) -> None:
        """A new table, three fifths of it full at most."""
        while 5 * keys.shape[1] > 3 << bits:
            bits += 1
        self.bits, self.keys, self.codes = bits, np.zeros((2, 1 << bits), np.uint64), np.full(1 << bits, -1, np.int32)
        self._put(keys, np.arange(keys.shape[1], dtype=np.int32))

    def _known(self) -> np.ndarray:
        """The keys of all pieces, by number."""
        there = np.nonzero(self.codes >= 0)[0]
        out = np.empty((2, len(there)), np.uint64)
        out[:, self.codes[there]] = self.keys[:, there]
        return out

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, codes: np.ndarray) -> None:
        at, last = self._at(keys), (1 << self.bits) - 1
        while len(at):
            free = self.codes[at] < 0
            self.codes[at[free]] = codes[free]  # of several for a place, one gets it
            got = self.codes[at] == codes
            self.keys[:, at[got]] = keys[:, got]
            keys, codes, at = keys[:, ~got], codes[~got], (at[~got] + 1) & last

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of pieces, -1 for unknown ones."""
        out, todo, (a, b) = np.full(keys.shape[1], -1, np.int32), np.arange(keys.shape[1]), keys
        at, last = self._at(keys), (1 << self.bits) - 1
        while len(at):
            c = self.codes[at]
            same = (c >= 0) & (self.keys[0][at] == a) & (self.keys[1][at] == b)
            out[todo[same]] = c[same]
            on = (c >= 0) & ~same
            todo, a, b, at = todo[on], a[on], b[on], (at[on] + 1) & last
        return out

    def turn(self) -> None:
        """Forget pieces if there are too many of them, or long ones among them."""
        n = self.count
        if n <= self.most and self.ids <= 8 * self.most:
            return
        often = np.nonzero((self.used[:n] > 1) & (self.size[:n] <= 16))[0]
        kept = np.sort(often[np.argsort(-self.used[often], kind="stable")[: self.most // 2]])
        size = self.size[kept].astype(np.int64)
        self._keep(self._known()[:, kept], size, self.flat[_spans(self.start[kept], size)])

    def find(self, keys: np.ndarray, encode) -> np.ndarray:
        """The numbers of pieces; ``encode`` gives the ids of those that are new, by their places among ``keys``."""
        self.turn()
        codes = self._look(keys)
        new = np.nonzero(codes < 0)[0]
        if len(new):
            new = new[np.lexsort(keys[:, new])]
            head = np.append(True, (keys[:, new[1:]] != keys[:, new[:-1]]).any(axis=0))
            codes[new] = self.count + np.cumsum(head) - 1
            new, had = new[head], self.count
            flat, size = encode(new.tolist())
            self.start = _grown(self.start, had, self.ids + np.cumsum(size) - size)
            self.size, self.used = _grown(self.size, had, size), _grown(self.used, had, np.zeros(len(size), np.int32))
            self.flat, self.ids, self.count = _grown(self.flat, self.ids, flat), self.ids + len(flat), had + len(new)
            if 5 * self.count > 3 << self.bits:
                self._table(np.append(self._known(), keys[:, new], axis=1), self.bits)
            else:
                self._put(keys[:, new], codes[new])
        self.used[codes] += 1  # once for all of its places
        return codes


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of spans, one span after the other."""
    if not len(size):
        return np.empty(0, np.int64)
    until = np.cumsum(size)
    return np.repeat(start - (until - size), size) + np.arange(until[-1])


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, definition_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition_json)
        self.library.no_truncation()
        self.library.no_padding()
        shape = json.loads(definition_json)
        split = shape.get("pre_tokenizer") or {}
        self.by_piece = (
            shape.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", False)
            and not shape["model"].get("dropout")
        )
        added = [t["content"] for t in shape.get("added_tokens") or ()]
        # a text with one of these is given to the library whole, as is one with the sign between texts
        self.added = [*added, "\uffff"]
        self.pieces = Memo(_MEMO_PIECES)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0].tobytes()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            size, end = 0, len(out)
            while end < len(texts) and (end == len(out) or size + len(texts[end]) <= _BATCH_CHARS):
                size += len(texts[end])
                end += 1
            out += self._some(texts[len(out) : end])
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_piece and not any(x in t for x in self.added) for t in texts]
        raw = [t.encode("utf-16-le") if p else b"" for t, p in zip(texts, plain)]
        data, u, kind, ends = self._joined(raw)
        if len(odd := np.nonzero(kind == _ODD)[0]):
            for i in np.unique(np.searchsorted(ends, odd)).tolist():
                plain[i], raw[i] = False, b""
            data, u, kind, ends = self._joined(raw)
        start = _starts(u, kind)
        size = np.diff(np.append(start, len(u)))
        keys, word = _hashes(u, start, size), kind[start] != _END
        start, size = start[word], size[word]

        def encode(places: list[int]) -> tuple[np.ndarray, np.ndarray]:
            spans = zip((2 * start[places]).tolist(), (2 * (start + size)[places]).tolist())
            return self._encode([data[a:b].decode("utf-16-le") for a, b in spans])

        codes = self.pieces.find(keys[:, word], encode)
        size = self.pieces.size[codes]
        ids = self.pieces.flat[_spans(self.pieces.start[codes], size)]
        cut = np.append(0, np.cumsum(size))[np.searchsorted(start, ends)]
        return [ids[a:b] if p else self._whole(t) for t, p, a, b in zip(texts, plain, np.append(0, cut), cut)]

    @staticmethod
    def _joined(raw: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Texts one after the other, U+FFFF before each and at the end: bytes, units, their classes, where each text ends."""
        data = b"\xff\xff".join([b"", *raw, b""])
        u = np.frombuffer(data, "<u2")
        return data, u, _CLASS[u], np.cumsum(np.fromiter((len(x) // 2 + 1 for x in raw), np.int64, len(raw)))

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has. The library's model encodes them as they come
        out of its byte-level splitting; going through the whole of the library costs an encoding object for each."""
        text = "\n".join(pieces)
        if text.count("\n") == len(pieces) - 1:
            signs = _signs(text).split(_signs("\n"))
        else:
            signs = list(map(_signs, pieces))
        found = list(map(self.library.model.tokenize, signs))
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([t.id for x in found for t in x], "<u4"), size


_OPEN: dict[str, Encoder] = {}


def encoder(key: str, definition_json: str) -> Encoder:
    """One encoder a Python worker and definition."""
    if key not in _OPEN:
        _OPEN.clear()
        common.give_back()
        _OPEN[key] = Encoder(definition_json)
    return _OPEN[key]
