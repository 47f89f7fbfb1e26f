"""Whole-text encoding with a public tokenizer, fast enough for a corpus.

Both BPE files cut a text into words before they merge, and a space followed by a visible character always starts a new
word.  Encoding the pieces between such spaces one by one therefore gives the ids of the whole text.  Words repeat, so each
worker keeps the ids of the words it has met; new words go to the model of the tokenizers library.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterable

SPACE = re.compile(r" (?=\S)")      # where a text may be cut
ODD = re.compile(r" (?!\S)")        # a space that may not be a cut
KEPT_WORDS = 700_000                # words a worker remembers; the memory is emptied when full
LONGEST_KEPT = 48
# fixed value: the word pattern of byte-level BPE vocabularies
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def worker_store(kind: str) -> dict:
    """A place that outlives a task in a reused Python worker, for one kind of thing at a time: another kind empties it, so a stage does
    not pay for the memory of the one before."""
    store = sys.modules.setdefault("_corpus_worker_store", types.ModuleType("_corpus_worker_store")).__dict__
    if store.get("kind") != kind:
        store["kind"], store["held"] = kind, {}
        gc.collect()
    return store["held"]


def tokenizer_path(name_or_path: str) -> str:
    """A path, or the name of one of the installed public vocabularies."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


class WordEncoder:
    """``encode_all`` returns the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path(file))
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.words = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"] if "pretokenizers" in split else BYTE_LEVEL_WORDS)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        spare = iter(c for c in map(chr, range(256, 256 + 68)))  # bytes without a visible form of their own are numbered from 256
        self.shown = {b: c for b in range(256) for c in [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(spare)]}
        assert all(self.shown[b] == c for b, c in shown.items())
        self.parts: dict[str, bytes] = {}   # words as the tokenizer cuts them
        self.inner: dict[str, bytes] = {}   # pieces that follow a space
        self.first: dict[str, bytes] = {}   # pieces that start a text

    @classmethod
    def shared(cls, file: str) -> WordEncoder:
        store = worker_store("encoders")
        if file not in store:
            store[file] = cls(file)
        return store[file]

    def _piece(self, piece: str) -> bytes:
        if self.lowers:
            if not piece.isascii() and ("Σ" in piece or not unicodedata.is_normalized("NFC", piece)):
                return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
            piece = piece.lower()
        out = []
        for word in self.words.findall(piece):
            ids = self.parts.get(word)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()
                if len(word) <= LONGEST_KEPT:
                    self.parts[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """A null text has no ids, as an empty one."""
        for known in (self.parts, self.inner, self.first):
            if len(known) > KEPT_WORDS:
                known.clear()
        out, inner, first = [], self.inner, self.first
        for t in texts:
            if not t:
                out.append(b"")
                continue
            pieces = SPACE.split(t) if ODD.search(t) else t.split(" ")
            head = pieces[0]
            if head not in first:
                first[head] = self._piece(head)
            pieces[0] = first[head] if len(head) <= LONGEST_KEPT else first.pop(head)
            for i in range(1, len(pieces)):
                p = pieces[i]
                ids = inner.get(p)
                if ids is None:
                    ids = self._piece(" " + p)
                    if len(p) <= LONGEST_KEPT:
                        inner[p] = ids
                pieces[i] = ids
            out.append(b"".join(pieces))
        return out
