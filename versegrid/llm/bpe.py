"""Byte-level BPE ids of whole texts, with a bounded table of known words.

The tokenizer's own splitting starts a new piece at every single space between two
non-space characters, and at a line break between two of them. So a text is cut there,
each word is looked up, and only new words go through the tokenizer. A word that starts
or ends with white space of any kind never enters the table: texts with such words are
cut at the safe spaces alone, and what then still holds white space is encoded as it
stands. So is a text that holds the name of a special token. Punctuation behind a letter or digit is a piece
of its own, so a new word of that kind is put together from its two parts. New words are
encoded as runs of ``RUN`` words; the byte lengths of the tokens tell where each word ends.
The ids are those of the whole text.

When the table passes ``TABLE_BYTES`` it becomes the old table, words still in use move
back out of it, and the one before goes, so a worker holds two tables at most.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Bytes of one word table, by an estimate of Python's own cost per entry.
TABLE_BYTES = 96 << 20
ENTRY_BYTES = 200
#: Characters of text that are looked up together.
GROUP = 1 << 18
#: New words that are encoded as one text.
RUN = 64
#: Behind a letter or digit these always start a new piece (the apostrophe does not).
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """``ids(texts)``: the ids of each text as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._model = Tokenizer.from_file(path)
        self._added = [token.content for token in self._model.get_added_tokens_decoder().values()]
        self._break = self._whole(["\n"])[0]
        # a token of a byte-level vocabulary has one character per byte
        self._sizes = np.zeros(self._model.get_vocab_size(), np.int64)
        for token, number in self._model.get_vocab(with_added_tokens=False).items():
            self._sizes[number] = len(token)
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._bytes = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Encode words in runs and cut the ids where the words end."""
        listed = list(words)
        pieces = [w if w[0] == "\n" else f" {w}" for w in listed]
        texts = ["".join(pieces[i:i + RUN]) for i in range(0, len(pieces), RUN)]
        data = np.frombuffer(b"".join(self._whole(texts)), "<u4")
        ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in pieces])
        covered = np.cumsum(self._sizes[data])
        cuts = np.searchsorted(covered, ends) + 1
        if not np.isin(ends, covered).all():
            raise ValueError("words do not match their ids")
        packed, at = data.tobytes(), 0
        for word, end in zip(listed, (4 * cuts).tolist()):
            self._known[word] = packed[at:end]
            at = end

    def _prepare(self, words: set[str]) -> None:
        """Make sure that all safe words of a group are in the table."""
        if self._bytes > TABLE_BYTES:
            self._known, self._old, self._bytes = {}, self._known, 0
        new = words.difference(self._known)
        self._bytes += ENTRY_BYTES * len(new) + 2 * sum(map(len, new))
        back = {w: self._old[w] for w in new if w in self._old}  # asks for each word, where an intersection would go through the table
        self._known.update(back)
        plain, joined = set(), []
        for word in new.difference(back):
            if word.isalnum():
                plain.add(word)
            elif (core := word.rstrip(PUNCTUATION)).isalnum():
                joined.append((word, core, f"\n{word[len(core):]}"))
                plain.update(joined[-1][1:])
            elif _is_safe(word):
                plain.add(word)
        if plain := plain.difference(self._known):
            self._learn(plain)
        self._known.update([(word, self._known[core] + self._known[tail][4:]) for word, core, tail in joined])

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= GROUP or i == len(texts) - 1:
                out += self._group(texts[at:i + 1])
                at, size = i + 1, 0
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [f"\n{_body(t)}".replace("\n", " \n").split(" ")[1:] if t and not self._special(t) else [] for t in texts]
        self._prepare({w for words in cut for w in words})
        return [self._joined(t, words) for t, words in zip(texts, cut)]

    def _special(self, text: str) -> bool:
        return any(token in text for token in self._added)

    def _joined(self, text: str, words: list[str]) -> bytes:
        if not words:
            return self._whole([text])[0]
        try:
            return b"".join(map(self._known.__getitem__, words))[4:] + (self._break if len(_body(text)) < len(text) else b"")
        except KeyError:
            return self._by_safe_spaces(text)

    def _by_safe_spaces(self, text: str) -> bytes:
        parts = SAFE_SPACE.split(text)
        keys = [f"\n{p}" if i == 0 else p for i, p in enumerate(parts)]
        odd = [i for i, p in enumerate(parts) if not _is_safe(keys[i]) or re.search(r"\s", p)]
        held = dict(zip(odd, self._whole([parts[i] if i == 0 else f" {parts[i]}" for i in odd])))
        self._prepare({k for i, k in enumerate(keys) if i not in held})
        return b"".join([held[i] if i in held else self._known[k][4 * (i == 0):] for i, k in enumerate(keys)])


def _body(text: str) -> str:
    """The text without a line break that ends it right behind a non-space character."""
    return text[:-1] if text[-1:] == "\n" and len(text) > 1 and not text[-2].isspace() else text


def _is_safe(word: str) -> bool:
    """Whether a word may be looked up; a leading line break says that no space precedes it."""
    own = word[1:] if word[:1] == "\n" else word
    return bool(own) and not own[0].isspace() and not own[-1].isspace() and "\n" not in own


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
