"""Ids of texts by a public tokenizer, asked word by word.

A byte-level tokenizer cuts a text into words by a fixed pattern before it merges bytes, so
ids of a word hang on that word alone; a worker keeps the ids of the words it met last, up to
CACHE of them, and asks the tokenizer for others. Texts with characters for which the pattern
of two libraries might differ go through the tokenizer as they are, in runs that end before a
single space between two characters that aren't white space, where the pattern always
cuts. Of another kind of tokenizer each text is asked whole.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

CACHE = 1 << 19
#: Characters of a text that the tokenizer sees at once.
RUN = 1 << 18

#: Fixed value: the pattern by which a byte-level tokenizer cuts words, for texts of the characters that ODD leaves.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Other characters than ASCII, Latin letters, dashes and quotation marks: for these alone the pattern's classes are surely those of the tokenizer.
ODD = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u2010-\u2027]")
#: A place before which the pattern always cuts.
SEAM = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> str:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary: those that are printable in Latin-1 stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class KnownWords(dict):
    """Ids of the words met lately; a new word is looked up in the tokenizer's model."""

    def __init__(self, model, most: int):
        super().__init__()
        self.model, self.most, self.letters, self.before = model, most, byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(self.letters)
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
        if 2 * len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = ids
        return ids


def cuts_words(form: dict) -> bool:
    """Whether a tokenizer (its JSON) is a byte-level BPE that cuts words by WORDS and changes nothing else of a text."""
    cut, model = form["pre_tokenizer"] or {}, form["model"]
    plain = form["normalizer"] is None and form["truncation"] is None and form["padding"] is None and all(t["special"] for t in form["added_tokens"])
    whole = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return plain and whole and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]


class _Made:
    """An encoder that is made where it arrives."""

    def __init__(self, kind: type, path: str):
        self.kind, self.path = kind, path

    def __reduce__(self):
        return self.kind, (self.path,)


class Encoder:
    """Ids of whole texts, as bytes of little-endian 32-bit integers; names of special tokens in a text are text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = KnownWords(self.tokenizer.model, self.bounds()[0])
        self.path = path
        form = json.loads(self.tokenizer.to_str())
        self.by_words, self.added = cuts_words(form), [t["content"] for t in form["added_tokens"]]

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(_Made(type(self), self.path)),)  # by value, as a broadcast goes by plain pickle

    def bounds(self) -> tuple[int, int]:
        """Words that are kept, and characters of a run."""
        return CACHE, RUN

    def asked(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def runs(self, text: str) -> Iterator[str]:
        at, run = 0, self.bounds()[1]
        while len(text) - at > run:
            seam = SEAM.search(text, at + run)
            if not seam:
                break
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self.asked(text)
        if ODD.search(text):
            return b"".join(map(self.asked, self.runs(text)))
        return b"".join(b"".join(map(self.known.__getitem__, WORDS.findall(run))) for run in self.runs(text))
