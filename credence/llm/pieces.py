"""Tokens of whole texts piece by piece: each distinct piece goes to the tokenizer once per worker.

Where white space is kept, a text is cut before every space that has a character other than
white space on at least one of its sides. There the tokenizer's own splitting rule always begins
a new word: a run of white space gives its last space to the word behind it, and a cut at such a
place divides no run otherwise. Where a neighbour's bytes leave it open whether it is white
space, nothing is cut. Further cuts: where an ASCII letter meets a point, comma or line end,
where one of these two signs meets a line end, and between such a single line end and a letter.
Where white space is dropped, pieces are the words, cut before a point or comma behind a letter.

So pieces are independent, and a text of any length takes no more memory than its bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np

from credence.llm.textkit import LOWER, SPACES, U64, run_hashes, word_runs

# Distinct pieces remembered per worker. It bounds memory only: beyond it the book begins anew.
REMEMBERED = 1_500_000
BATCH = 4096

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_LATIN_LEAD = 0xC3  # two-byte letters à to ÿ and their capitals; no white space begins with it
_OPEN_LEAD = np.zeros(256, bool)
_OPEN_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # some white space begins with these


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def may_cut(tokenizer) -> bool:
    """Whether no added token reaches over the places where texts are cut."""
    added = tokenizer.get_added_tokens_decoder().values()
    return not any(t.lstrip or t.rstrip or t.single_word or re.search(r"[\s.,]", t.content) for t in added)


def added_leads(tokenizer) -> np.ndarray:
    """Which bytes begin an added token, in either case. Such tokens are found before the text is lower-cased."""
    firsts = [LOWER[t.content.encode()[0]] for t in tokenizer.get_added_tokens_decoder().values()]
    return np.isin(LOWER, firsts)


def lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The bytes in lower case, but for pieces in which an added token may begin: those stay as they are."""
    low = LOWER[data]
    own = np.unique(np.searchsorted(starts, np.flatnonzero(leads[data]), side="right") - 1)
    steps = np.zeros(data.size + 1, np.int8)
    steps[starts[own]] += 1
    steps[ends[own]] -= 1
    return np.where(np.cumsum(steps[:-1], dtype=np.int8) > 0, data, low) if own.size else low


def spaced_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, and the first piece of each text, where white space is kept."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(bounds.size, np.int64)
    before = np.empty_like(data)
    before[0], before[1:] = 0x20, data[:-1]
    second = np.empty_like(data)
    second[0], second[1:] = 0x20, before[:-1]
    after = np.empty_like(data)
    after[-1], after[:-1] = 0x20, data[1:]
    solid_before = np.where(before < 0x80, ~SPACES[before], second == _LATIN_LEAD)
    solid_after = ~SPACES[after] & ~_OPEN_LEAD[after]
    solid_after[bounds[1:][bounds[1:] > 0] - 1] = False
    word_end = _LETTER[before] | _STOP[before]
    cut = (data == 0x20) & (solid_before | solid_after)
    cut |= _STOP[data] & _LETTER[before]
    cut |= (data == 0x0A) & word_end
    cut |= _LETTER[data] & (before == 0x0A) & (_LETTER[second] | _STOP[second])
    # The byte before a text is another text's: begin there, and judge its next byte by what it has itself.
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    nexts = heads[(heads + 1 < data.size)] + 1
    inner = nexts[~np.isin(nexts, heads)]
    cut[inner] &= ~(_LETTER[data[inner]] & (data[inner - 1] == 0x0A))
    cut[heads] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], data.size), np.searchsorted(starts, bounds)


def word_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where white space is dropped."""
    starts, ends, _ = word_runs(data, bounds)
    cut = np.flatnonzero(_STOP[data[1:]] & _LETTER[data[:-1]]) + 1
    cut = cut[~np.isin(cut, bounds)]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, bounds)


class TokenBook:
    """Token counts, and on demand the ids, of distinct pieces, found by a 64-bit hash."""

    def __init__(self, tokenizer, keeps_spaces: bool, with_ids: bool, remembered: int = REMEMBERED):
        self.tokenizer, self.keeps_spaces, self.with_ids, self.remembered = tokenizer, keeps_spaces, with_ids, remembered
        self.cuts, self.leads = may_cut(tokenizer), added_leads(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.keys, self.sizes, self.places = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def cut(self, data: np.ndarray, bounds: np.ndarray):
        """The bytes to encode, and where their pieces and the texts' first pieces are."""
        if not self.cuts:
            filled = np.flatnonzero(bounds[1:] > bounds[:-1])
            return data, bounds[filled], bounds[filled + 1], np.searchsorted(bounds[filled], bounds)
        if self.keeps_spaces:
            return data, *spaced_pieces(data, bounds)
        starts, ends, firsts = word_pieces(data, bounds)
        # The tokenizer lower-cases too, so this changes nothing but the number of pieces.
        return lowered(data, starts, ends, self.leads), starts, ends, firsts

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the book of every piece."""
        if not starts.size:
            return np.zeros(0, np.int64)
        hashes, first, inverse = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.keys.size + hashes.size > self.remembered:
            self.forget()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(hashes.size, bool)
        inside = at < self.keys.size
        new[inside] = self.keys[at[inside]] != hashes[inside]
        if new.any():
            raw = data.tobytes()
            chosen = first[new]
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[chosen].tolist(), ends[chosen].tolist(), strict=True)]
            self.add(hashes[new], at[new], texts)
            at = np.searchsorted(self.keys, hashes)
        return at[inverse]

    def add(self, hashes: np.ndarray, at: np.ndarray, texts: list[str]) -> None:
        sizes = []
        for k in range(0, len(texts), BATCH):
            encoded = self.tokenizer.encode_batch_fast(texts[k : k + BATCH], add_special_tokens=False)
            sizes += [len(e) for e in encoded]
            if self.with_ids:
                ids = np.fromiter((i for e in encoded for i in e.ids), np.uint32)
                while self.used + ids.size > self.ids.size:
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.used : self.used + ids.size] = ids
                self.used += ids.size
        sizes = np.array(sizes, np.int32)
        places = self.used - np.cumsum(sizes[::-1], dtype=np.int64)[::-1] if self.with_ids else np.zeros(sizes.size, np.int64)
        self.keys = np.insert(self.keys, at, hashes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.places = np.insert(self.places, at, places)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        data, starts, ends, firsts = self.cut(data, bounds)
        at = self.look_up(data, starts, ends)
        sums = np.concatenate([[0], np.cumsum(self.sizes[at], dtype=np.int64)])
        return sums[firsts[1:]] - sums[firsts[:-1]]

    def encoded(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        data, starts, ends, firsts = self.cut(data, bounds)
        at = self.look_up(data, starts, ends)
        sizes = self.sizes[at].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        from_book = np.repeat(self.places[at] - sums[:-1], sizes) + np.arange(sums[-1])
        return self.ids[from_book], sums[firsts]
