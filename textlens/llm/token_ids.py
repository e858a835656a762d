"""Ids of whole texts by a vocabulary file of `tokenizers`, with the ids of a word worked out once.

In a text of Western European letters, digits and signs there is no doubt where a vocabulary's
word pattern cuts, so that it can be cut here and the tokenizer's model is only asked for words
it has not seen yet; its normalizer and pattern would leave them as they are. Any other text
goes through the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words that a worker remembers the ids of, twice: those met since it last forgot, and those
#: before; and the longest of them. Some 45 MB in all, for as long as the worker lives.
REMEMBERED, LONGEST = 200_000, 48
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SIGNS = "!-/:-@\\[-`{-~¡§«°»¿–—‘-„…€"
#: How byte-level vocabularies spell the bytes that cannot be seen (fixed value).
_SPELT = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
_PLAIN = re.compile(f"[ \n0-9{_LETTERS}{_SIGNS}]*")
_OF_WORKER: dict[tuple[type, str], TextIds] = {}


class _Words(dict):
    """Ids of words, worked out when a word is first asked for."""

    def __init__(self, model, before: dict[str, bytes]):
        self.model, self.before = model, before

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            found = self.model.tokenize(word.encode().decode("latin-1").translate(_SPELT))
            ids = b"".join([t.id.to_bytes(4, "little") for t in found])
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class TextIds:
    """Ids of texts as little-endian 32-bit integers."""

    words: re.Pattern

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already keeps every core busy
        self.tokenizer = Tokenizer.from_file(path)
        cutter = self.tokenizer.pre_tokenizer
        steps = json.loads(cutter.__getstate__()) if cutter else {"type": None}
        #: Whether the model is given the bytes of words; if not, all texts are encoded whole.
        self.by_bytes = steps.get("pretokenizers", [steps])[-1]["type"] == "ByteLevel"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Words(self.tokenizer.model, {})

    @classmethod
    def of_worker(cls, path: str) -> TextIds:
        """The one that this Python worker uses in all its tasks."""
        if (cls, path) not in _OF_WORKER:
            _OF_WORKER[cls, path] = cls(path)
        return _OF_WORKER[cls, path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4") for f in found]

    def _cut(self, text: str) -> list[str]:
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts that quote a control token, or with other characters, are encoded whole."""
        plain = [self.by_bytes and bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        whole = iter(self._ids([t for t, p in zip(texts, plain) if not p]))
        if len(self.known) > REMEMBERED:  # words that do not come back are forgotten next time
            self.known.before = {}
            self.known = _Words(self.known.model, self.known)
        ids = self.known.__getitem__
        return [b"".join(map(ids, self._cut(t))) if p else next(whole).tobytes() for t, p in zip(texts, plain)]


class ByteLevelIds(TextIds):
    """For vocabularies in which a blank belongs to the word behind it."""

    #: The word pattern of byte-level vocabularies (fixed value), for plain texts.
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[ \n]+(?![^ \n])|[ \n]+")


class WordEndIds(TextIds):
    """For vocabularies that drop white space, lower the case and mark the end of a word."""

    #: The word pattern of such vocabularies (fixed value), for plain texts in lower case.
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}ⱥⱦ]+|[0-9]|[{_SIGNS}]+")

    def _cut(self, text: str) -> list[str]:
        return self.words.findall(text.lower())
