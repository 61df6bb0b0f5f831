"""Token ids of texts by a public tokenizer, each distinct word encoded once per task.

The vocabulary splits a lower-cased text into letter runs, single digits and other runs
before it merges anything, so ids of a text are the ids of its runs in order. Texts of
ASCII and Latin-1 letters take the vectorised way; any other text (apostrophes, special
token strings, other scripts, control characters) is encoded whole by the library.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np

from .texts import Block, byte_class, span_hash

#: Words that a worker process keeps; more only if one block has more.
CACHE = 250_000
#: Bits of the direct look-up in front of the cache: one place per word hash, the last word has it.
PLACES = 18
_BLANK, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.int8)
_CLASS[byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = _LETTER
_CLASS[byte_class((0x30, 0x39))] = _DIGIT
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_ODD = byte_class((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x27, 0x27), (0x7F, 0x7F), (0xC0, 0xC2), (0xC4, 0xFF))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_encoder(path: str) -> Encoder:
    """The encoder of this worker process: tasks that follow each other share its words."""
    held = sys.modules.setdefault("_task_encoders", types.ModuleType("_task_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, the slot of each
        self.place_hash, self.place_slot = np.zeros(1 << PLACES, np.uint64), np.zeros(1 << PLACES, np.int64)
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        for at, ids in enumerate(self._ids_of_words(texts), len(self.known)):
            if at >= len(self.start):
                self.start, self.size = np.resize(self.start, 2 * at), np.resize(self.size, 2 * at)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[at], self.size[at] = self.used, len(ids)
            self.used += len(ids)
        place, slots = np.searchsorted(self.known, hashes), np.arange(len(self.known), len(self.known) + len(hashes))
        self.known, self.slot = np.insert(self.known, place, hashes), np.insert(self.slot, place, slots)

    def _ids_of_words(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each word: many words are encoded as one text, every word ends in an id that closes it."""
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 500):
            some = texts[at : at + 500]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                out += np.split(ids, stops[:-1])
            else:
                out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
        return out

    def _slots(self, hashes: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache slot of every word; words that are not known yet are encoded."""
        place = (hashes >> np.uint64(64 - PLACES)).astype(np.int64)
        slots = self.place_slot[place]
        missed = np.flatnonzero(self.place_hash[place] != hashes)
        if len(missed):
            different, first, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[first]
            new = np.flatnonzero(self.known[np.searchsorted(self.known[:-1], different)] != different) if len(self.known) else np.arange(len(different))
            if len(self.known) and len(self.known) + len(new) > CACHE:  # all words of the block anew, however many
                self._clear()
                return self._slots(hashes, low, starts, ends)
            if len(new):
                self._learn(different[new], [low[starts[at[i]] : ends[at[i]]].tobytes().decode() for i in new])
            found = self.slot[np.searchsorted(self.known, different)]
            slots[missed] = found[inverse]
            where = (different >> np.uint64(64 - PLACES)).astype(np.int64)
            self.place_hash[where], self.place_slot[where] = different, found
        return slots

    def encode(self, block: Block) -> list[np.ndarray]:
        """The ids of every row of the block."""
        data, at = block.data, block.offsets
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * block.rows
        if not len(data):
            return out
        odd = _ODD[data]
        odd[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        seen = np.concatenate([[0], np.cumsum(odd)])
        strange = seen[at[1:]] > seen[at[:-1]]
        low = data + (32 * byte_class((0x41, 0x5A))[data]).astype(np.uint8)
        low[1:] += (32 * ((data[:-1] == 0xC3) & (data[1:] <= 0x9E))).astype(np.uint8)
        kind = _CLASS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:-1]
        starts = np.flatnonzero(cut & (kind != _BLANK))
        ends = np.flatnonzero(np.append(cut[1:], True) & (kind != _BLANK)) + 1
        row = np.searchsorted(at, starts, "right") - 1
        plain = ~strange[row]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        if len(starts):
            slots = self._slots(span_hash(low, starts, ends, fold=False), low, starts, ends)
            size = self.size[slots]
            stop = np.cumsum(size)
            ids = self.flat[np.repeat(self.start[slots] - stop + size, size) + np.arange(stop[-1])]
            bounds = np.concatenate([[0], stop])[np.searchsorted(row, np.arange(block.rows + 1))]
            for r in range(block.rows):
                out[r] = ids[bounds[r] : bounds[r + 1]]
        for r in np.flatnonzero(strange):
            out[r] = np.array(self.tokenizer.encode(block.text(r), add_special_tokens=False).ids, np.uint32)
        return out
