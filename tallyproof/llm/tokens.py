"""Token ids by the tokenizers library, encoded once for each distinct word.

The tokenizer splits at white space and drops it, so the ids of a text are the
ids of its words end to end; each worker encodes a word the first time it meets
it and looks it up (by its bytes) from then on.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tallyproof.llm.common import Known, buffers, distinct_words, pieces, words


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Only for tokenizers that drop white space and never join across it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.known = Known()
        self._clear()

    def _clear(self) -> None:
        self.count, self.start, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.width)

    def _learn(self, new: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        start = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], self.width)])
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, count])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's first."""
        hashes, starts, ends, first = words(data, offsets, lower=False)
        if not len(hashes):
            return np.empty(0, self.width), np.zeros(len(offsets), np.int64)
        where, kind = distinct_words(data, hashes, starts, ends)
        at, new, anew = self.known.numbers(data, hashes[where], starts[where], ends[where])
        if anew:
            self._clear()
        if len(new):
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        start, count = self.start[at][kind], self.count[at][kind]
        total = np.concatenate([[0], np.cumsum(count)])
        index = np.repeat(start - total[:-1], count) + np.arange(total[-1])
        return self.ids[index], total[first]

    def column(self, column: pa.Array, most: int = 2 << 20):
        """For each row its ids, in order."""
        data, offsets = buffers(column)
        for i, j in pieces(data, offsets, most):
            part = offsets[i : j + 1]
            ids, first = self.encode(data[part[0] : part[-1]], part - part[0])
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield ids[a:b]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
