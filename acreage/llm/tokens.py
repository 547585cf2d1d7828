"""Token ids of whole texts by a public byte-level BPE tokenizer.

The tokenizer's own pre-tokenizer never lets a match run across certain places
(before a space or line end that follows a visible character, and between an
ASCII letter and an ASCII character that is none).  A text is cut there, every
different chunk is encoded once by the tokenizers library, and the ids of the
texts are put together from the ids of their chunks.  The library looks for the
tokenizer's added tokens ('<|endoftext|>') before that, and pre-tokenizes what is
between them; so does this module: an added token is a chunk of its own.  The result
is the one the library gives for the whole text; tests compare the two.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from acreage.llm.common import SEGMENT, span_hashes

# White space that the pre-tokenizer may join to a neighbour, and letters (ASCII).
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x0A, 0x20]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = True
_LETTER[ord("a"):ord("z") + 1] = True


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes before which a text can be cut without changing its ids.
    A blank counts only after a character that surely is visible: an ASCII one, or
    one of two bytes from U+00C0 on (Unicode white space has other first bytes)."""
    mask = np.zeros(len(data), dtype=bool)
    if len(data) < 2:
        return mask
    prev, cur = data[:-1], data[1:]
    seen = (prev < 0x80) & ~_BLANK[prev]
    lead = data[:-2]
    seen[1:] |= (prev[1:] >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
    mask[1:] = (_BREAK[cur] & seen) | (_LETTER[prev] & ~_LETTER[cur] & (cur < 0x80))
    return mask


class Encoder:
    """Encodes texts (UTF-8 bytes).  Ids of known chunks are kept in three arrays;
    beyond ``most_known`` chunks they are forgotten and learned again, which bounds
    memory and changes no result.  ``as_text``: added tokens are read like other text
    (the library's ``encode_special_tokens``), not as tokens of their own."""

    def __init__(self, path: str, most_known: int = 500_000, as_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        self.added = self._added(as_text)
        self.most_known = most_known
        self._forget()

    def _added(self, as_text: bool) -> re.Pattern | None:
        """Pattern of the added tokens that the library looks for, the longest at a place."""
        tokens = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (as_text and t.special)]
        odd = [t.content for t in tokens if t.lstrip or t.rstrip or t.single_word or t.normalized]
        if odd:
            raise ValueError(f"added tokens that depend on their neighbours or on a normalizer: {odd}")
        found = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        return re.compile(b"|".join(re.escape(x) for x in found)) if found else None

    def _split(self, text, mask: np.ndarray, at: int = 0) -> None:
        """Cuts the text at ``at`` of ``mask`` around its added tokens, and never inside them."""
        for m in self.added.finditer(text) if self.added else ():
            mask[at + m.start():at + m.end()] = False
            mask[at + m.start()] = True
            if at + m.end() < len(mask):
                mask[at + m.end()] = True

    def _forget(self) -> None:
        self.keys, self.second = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.flat, self.used = np.zeros(0, dtype=np.int32), 0

    def _learn(self, keys: np.ndarray, second: np.ndarray, chunks: list[str]) -> None:
        if len(self.keys) + len(keys) > self.most_known:
            self._forget()
        ids = [np.asarray(e.ids, dtype=np.int32)
               for i in range(0, len(chunks), 2000)
               for e in self.tokenizer.encode_batch_fast(chunks[i:i + 2000], add_special_tokens=False)]
        size = np.fromiter((len(x) for x in ids), dtype=np.int32, count=len(ids))
        new = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        at = self.used + np.cumsum(size, dtype=np.int64) - size
        if self.used + len(new) > len(self.flat):            # room is doubled, so each id is copied a few times at most
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(len(new), self.used, 1 << 16), dtype=np.int32)])
        self.flat[self.used:self.used + len(new)] = new
        self.used += len(new)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.second = np.insert(self.second, where, second)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)

    def _segment(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a byte string cut at ``starts`` (the first is 0), and the number of ids of each chunk."""
        ends = np.append(starts[1:], len(data))
        plain = np.frombuffer(data, dtype=np.uint8)
        keys, first, which = np.unique(span_hashes(plain, starts, ends), return_index=True, return_inverse=True)
        second = span_hashes(plain, starts, ends, 1)         # tells chunks of one hash apart
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if (second[first][which] != second).any() or (self.second[place[known]] != second[first][known]).any():
            ids = [np.asarray(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(
                [data[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends)], add_special_tokens=False)]
            return np.concatenate(ids), np.array([len(x) for x in ids], dtype=np.int32)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > self.most_known:
                self._forget()
                new = np.arange(len(keys))
            self._learn(keys[new], second[first][new], [data[starts[i]:ends[i]].decode("utf-8", "replace") for i in first[new]])
            place = np.searchsorted(self.keys, keys)
        size, at = self.size[place][which], self.at[place][which]
        total = int(size.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(at, size) + inner], size

    def encode(self, texts: Iterable) -> Iterator[np.ndarray]:
        """Ids (int32) of each text, in order."""
        group: list[bytes] = []
        room = SEGMENT
        for text in texts:
            if len(text) > SEGMENT:
                yield from self._group(group)
                group, room = [], SEGMENT
                yield self._long(bytes(text))
                continue
            if len(text) > room:
                yield from self._group(group)
                group, room = [], SEGMENT
            group.append(bytes(text))
            room -= len(text)
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        data = b"".join(texts)
        ends = np.cumsum(sizes)
        if not data:
            yield from (np.zeros(0, dtype=np.int32) for _ in texts)
            return
        mask = chunk_starts(np.frombuffer(data, dtype=np.uint8))
        begins = ends - sizes
        for text, begin in zip(texts, begins.tolist()):
            self._split(text, mask, begin)
        mask[begins[begins < len(data)]] = True
        starts = np.flatnonzero(mask)
        ids, counts = self._segment(data, starts)
        done = np.append(0, np.cumsum(counts))
        lo, hi = done[np.searchsorted(starts, begins)], done[np.searchsorted(starts, ends)]
        for a, b in zip(lo.tolist(), hi.tolist()):
            yield ids[a:b]

    def _long(self, text: bytes) -> np.ndarray:
        """A text beyond a segment, cut at places where cutting changes nothing."""
        cuts = chunk_starts(np.frombuffer(text, dtype=np.uint8))
        self._split(text, cuts)
        places = np.flatnonzero(cuts)
        parts, at = [], 0
        while at < len(text):
            last = np.searchsorted(places, at + SEGMENT, side="right")
            end = int(places[last - 1]) if last and places[last - 1] > at else (int(places[last]) if last < len(places) else len(text))
            if len(text) - at <= SEGMENT:
                end = len(text)
            piece = text[at:end]
            mask = cuts[at:end].copy()
            mask[0] = True
            parts.append(self._segment(piece, np.flatnonzero(mask))[0])
            at = end
        return np.concatenate(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, as_text=False)
    return _ENCODERS[path]
