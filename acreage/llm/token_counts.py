"""Operator 10: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character.
The dynamic program keeps the best score and the number of pieces for each prefix, no
path: a count is all that is asked for.  Ties and unknown characters follow the
tokenizers library's unigram model: a later candidate must be strictly better, candidates
of one end come in order of their start, a character that is no piece itself may be
unknown (score: the least of the vocabulary minus 10) and counts as its UTF-8 bytes.  The
unknown piece's own name in a text belongs to a run of unknown characters; alone it is one token.
Spaces become the word mark, which begins each word; words are independent, and each
different word is solved once.

The vocabulary is that of the sentencepiece file, with the score -ln(rank + 1) for the
piece of that rank (a fixed rule; no model is fitted).

Defined results: null and empty texts have no tokens; repeated rows are counted row by
row; a null key is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import SEGMENT, small_batches, span_hashes, text_bytes

MARK = "▁"
UNKNOWN_PENALTY = 10.0     # fixed value of the unigram model


def vocabulary(model: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with their scores by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), -math.log(i + 1)) for i in range(sp.get_piece_size())]


class Counter:
    """Token counts of words, kept for words already seen (up to ``most_known``, then learned again)."""

    def __init__(self, vocab: list[tuple[str, float]], most_known: int = 1_000_000) -> None:
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and not self.pieces.exists(piece):
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown_piece = vocab[0][0]
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.most_known = most_known
        self.keys, self.second, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def count(self, word: str) -> int:
        """Tokens of one word (with its mark)."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (size, score) in self.pieces.iter(word):      # per end, the longest first
            ends[last + 1].append((size, score))
            if size == 1:
                single[last] = True
        best, tokens = [0.0] * (n + 1), [0] * (n + 1)
        run = [0] * (n + 1)                                     # bytes of the run of unknowns that ends here; -1: its name alone
        name = self.unknown_piece
        for end in range(1, n + 1):
            top, at, unknown = None, end, False
            for size, score in ends[end]:
                s = score + best[end - size]
                if top is None or s > top:
                    top, at, unknown = s, end - size, size == len(name) and word[end - size:end] == name
            if not single[end - 1]:
                s = self.unknown + best[end - 1]
                if top is None or s > top:
                    top, at, unknown = s, end - 1, True
            best[end] = top
            if unknown:
                before = tokens[at] - (run[at] if run[at] != -1 else 1)
                size = len(word[at:end].encode())
                whole = (len(name) if run[at] == -1 else run[at]) + size
                alone = not run[at] and end - at == len(name)
                run[end], tokens[end] = (-1, before + 1) if alone else (whole, before + whole)
            else:
                tokens[end] = tokens[at] + 1
        return tokens[n]

    def of_words(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        plain = np.frombuffer(data, dtype=np.uint8)
        keys, first, which = np.unique(span_hashes(plain, starts, ends), return_index=True, return_inverse=True)
        second = span_hashes(plain, starts, ends, 1)         # tells words of one hash apart
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if (second[first][which] != second).any() or (self.second[place[known]] != second[first][known]).any():
            return np.array([self.count(MARK + data[a:b].decode("utf-8", "replace")) for a, b in zip(starts, ends)], dtype=np.int64)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most_known:
                self.keys, self.second, self.counts = self.keys[:0], self.second[:0], self.counts[:0]
                known[:] = False
            new = np.flatnonzero(~known)
            found = [self.count(MARK + data[starts[i]:ends[i]].decode("utf-8", "replace")) for i in first[new]]
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.second = np.insert(self.second, where, second[first][new])
            self.counts = np.insert(self.counts, where, found)
            place = np.searchsorted(self.keys, keys)
        return self.counts[place][which]

    def of_texts(self, texts) -> list[int]:
        """Tokens of each text (UTF-8 bytes).  Words of several short texts are looked up together."""
        out: list[int] = []
        group: list[bytes] = []
        room = SEGMENT

        def flush():
            nonlocal group, room
            if group:
                data = b" ".join(group)
                blanks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
                starts, ends = np.append(0, blanks + 1), np.append(blanks, len(data))
                counts = np.append(0, np.cumsum(self.of_words(data, starts, ends)))
                sizes = np.array([len(t) for t in group])
                begin = np.cumsum(sizes + 1) - sizes - 1
                lo, hi = np.searchsorted(starts, begin), np.searchsorted(starts, begin + sizes + 1)
                out.extend((counts[hi] - counts[lo]).tolist())
            group, room = [], SEGMENT

        for t in texts:
            t = bytes(t).replace(MARK.encode(), b" ")
            if not t:
                flush()
                out.append(0)
                continue
            t = t[1:] if t[:1] == b" " else t          # a leading space is the first word's mark
            if len(t) > SEGMENT:
                flush()
                out.append(self._long(t))
                continue
            if len(t) > room:
                flush()
            group.append(t)
            room -= len(t)
        flush()
        return out

    def _long(self, text: bytes) -> int:
        total, at = 0, 0
        while at <= len(text):
            end = len(text)
            if end - at > SEGMENT:
                end = text.rfind(b" ", at, at + SEGMENT)
                end = end if end >= at else text.find(b" ", at + SEGMENT)
                end = end if end >= 0 else len(text)
            part = text[at:end]
            blanks = np.flatnonzero(np.frombuffer(part, dtype=np.uint8) == 0x20)
            total += int(self.of_words(part, np.append(0, blanks + 1), np.append(blanks, len(part))).sum())
            at = end + 1
        return total


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) for every document."""
    kind = dict(docs.dtypes)[key]

    def count(batches):
        if model not in _COUNTERS:
            _COUNTERS[model] = Counter(vocabulary(model))
        for batch in batches:
            n = _COUNTERS[model].of_texts(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens bigint")
