"""Whole texts to token ids with the ``tokenizers`` library, each distinct word encoded once.

The vocabulary drops white space, and none of its pieces crosses a space, so the ids of a text are
those of its words in order. Words repeat far more often than texts do; a worker keeps the ids of
the words it has met (at most MOST_WORDS, then it starts afresh: a cache, not a limit).
"""

from __future__ import annotations

import os
import re

import numpy as np

from .words import Flat, Words, distinct, hashes, words

MOST_WORDS = 600_000
VOCABULARY = "word_bpe_49k.json"
#: Words that the vocabulary neither normalizes nor parts: lower-case Latin letters, composed.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_stops(w: Words) -> Words:
    """A full stop or comma after an ASCII letter or digit, at the end of a word, as a word of its own.

    The vocabulary's own pattern parts them there too, so ids stay the same and fewer words are distinct.
    """
    if not len(w.start):
        return w
    last, before = w.data[w.end - 1], w.data[np.maximum(w.end - 2, 0)]
    cut = ((last == 46) | (last == 44)) & (w.end - w.start > 1) & (((before | 32) >= 97) & ((before | 32) <= 122) | (before >= 48) & (before <= 57))
    at = np.arange(len(cut)) + np.cumsum(cut) - cut
    start, end = np.empty(len(cut) + cut.sum(), np.int64), np.empty(len(cut) + cut.sum(), np.int64)
    start[at], end[at] = w.start, w.end - cut
    start[at[cut] + 1], end[at[cut] + 1] = w.end[cut] - 1, w.end[cut]
    return Words(w.data, start, end, np.append(at, len(start))[w.bounds])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._clear_cache()
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these bytes stand for themselves,
        rest = [b for b in range(256) if b not in keep]  # the others for the code points from 256 on
        self.alphabet = {b: 256 + k for k, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.ids, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.n_ids = 0

    def plain(self, word: str) -> list[int]:
        """Ids of a PLAIN word from the model alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(word)]

    def learn(self, keys: list[int], new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            got = [self.plain(x) if PLAIN.fullmatch(x) else None for x in new[at:at + 20_000]]
            rest = [i for i, x in enumerate(got) if x is None]
            for i, e in zip(rest, self.tokenizer.encode_batch([new[at + i] for i in rest], add_special_tokens=False), strict=True):
                got[i] = e.ids
            length = np.fromiter(map(len, got), np.int64, len(got))
            row, total = len(self.row), int(length.sum())
            while row + len(got) + 1 > len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            while self.n_ids + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.n_ids:self.n_ids + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
            self.first[row + 1:row + 1 + len(got)] = self.n_ids + np.cumsum(length)
            self.n_ids += total
            self.row.update(zip(keys[at:at + 20_000], range(row, row + len(got)), strict=True))

    def encode(self, texts: Flat) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin."""
        special = b"<|" in texts.data.tobytes()
        w = split_stops(words(texts, lower=not special))
        value, first, back = distinct(hashes(w))
        if len(self.row) + len(value) > MOST_WORDS:
            self.forget()
        keys = value.tolist()
        known = list(map(self.row.get, keys))
        missing = [i for i, r in enumerate(known) if r is None]
        raw, start, end = w.data.tobytes(), w.start[first].tolist(), w.end[first].tolist()
        self.learn([keys[i] for i in missing], [raw[start[i]:end[i]].decode() for i in missing])
        for i in missing:
            known[i] = self.row[keys[i]]
        row = np.array(known, np.int64)[back]
        begin, length = self.first[row], self.first[row + 1] - self.first[row]
        bounds = np.append(0, np.cumsum(length))
        ids = self.ids[np.repeat(begin - bounds[:-1], length) + np.arange(bounds[-1])]
        return ids, bounds[w.bounds]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; it outlives a task as the worker does."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
