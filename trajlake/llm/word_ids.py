"""Token ids of whole texts by a public tokenizer file, with bounded caches of what recurs."""
from __future__ import annotations

import os
import re

WORD_BPE = "word_bpe_49k.json"
#: Entries a cache holds before it starts anew.
CHUNKS, WORDS = 400_000, 600_000
#: Letters that are their own normal form and have a one-letter lower case, then ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?()\"]*)")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts for a tokenizer that drops white space and never joins characters across it.

    A text is cut at spaces and line ends, and every distinct chunk is tokenized once while it stays in the cache. Chunks of
    plain letters and closing punctuation share the ids of their lower-case letters; all others go to the tokenizer as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    def _raw(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str], size: int = 256) -> None:
        """Many words in one call; the ids of a word end with its only word-end token."""
        for at in range(0, len(words), size):
            some = words[at:at + size]
            ids = self.np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = self.np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and (not len(ids) or ends[-1] == len(ids)):
                data, start = ids.tobytes(), 0
                for word, end in zip(some, ends.tolist()):
                    self.words[word] = data[4 * start:4 * end]
                    start = end
            else:
                self.words.update((w, self._raw(w)) for w in some)

    def _learn(self, chunks: set[str]) -> None:
        if len(self.chunks) + len(chunks) > CHUNKS:
            self.chunks.clear()
        plain = {c: (m[1].lower(), m[2]) for c in chunks if (m := _PLAIN.fullmatch(c))}
        if len(self.words) + 2 * len(plain) > WORDS:
            self.words.clear()
        self._learn_words(list({w for w, _ in plain.values() if w not in self.words}))
        for mark in {m for _, m in plain.values() if m and m not in self.words}:
            self.words[mark] = self._raw(mark)
        for chunk in chunks:
            parts = plain.get(chunk)
            self.chunks[chunk] = self._raw(chunk) if parts is None else self.words[parts[0]] + self.words[parts[1]] if parts[1] else self.words[parts[0]]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = text.replace("\n", " ").split(" ")
        known = self.chunks
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        out = []
        for at in range(0, len(parts), 100_000):
            some = parts[at:at + 100_000]
            new = {p for p in some if p not in known}
            if new:
                self._learn(new)
                new = {p for p in some if p not in known}
                if new:  # the cache has just started anew
                    self._learn(new)
            out += [known[p] for p in some]
        return b"".join(out)


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker: its caches outlive a task."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
