"""Byte-pair encoding of whole texts with the ``tokenizers`` library, faster.

The library spends most of its time splitting text and building offsets.  A
text is therefore cut before every space that follows a non-space, where the
byte-level splitter always has a boundary, and each distinct chunk goes through
the library's splitter and merge model once per worker.  Ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.

That holds for byte-level BPE as ``plain_byte_level`` checks it when a
vocabulary is loaded; with any other, every text goes through ``encode`` whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks of a generation; a worker keeps the one that it fills and the one before, of which what is met again moves on (results do not change).
CACHE_CHUNKS = 450_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCT = r"!-&(-/:-@\[-`{-~"  # ASCII without the apostrophe, which starts contractions
#: Chunks that this pattern covers split as its alternatives do; all others go through the library's splitter.
_PLAIN = re.compile(rf"(?: ?[{_LETTER}]+| ?[0-9]+| ?[{_PUNCT}]+|\n(?!\s))+\Z")
_PIECE = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+| ?[{_PUNCT}]+|\n")
_ENDS = frozenset(".,;:!?")
_LAST = "\u024f"  # up to here, what Python takes for letters the splitter does too
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
_ODD_SPACE = [c + " " for c in _SPACES]
_ODD_ASCII = [x for x in _ODD_SPACE if x.isascii()]
_CUT = re.compile(r"(?<=\S)(?= )")
_APART_BYTE, _APART = "\x03", "ă"  # a byte and its letter in the byte-level alphabet
_loaded: dict[str, "Encoder"] = {}


def plain_byte_level(description: dict) -> bool:
    """Whether a tokenizer is byte-level BPE without what would make a text's parts depend on each other.

    No normalizer and no prefix space, the byte-level splitter alone, all
    merges as listed, and the byte 0x03 in none of them.
    """
    model, split = description["model"], description.get("pre_tokenizer") or {}
    merges = model.get("merges") or []
    return (
        description.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk"))
        and _APART in model["vocab"]
        and not any(_APART in (m if isinstance(m, str) else "".join(m)) for m in merges)
    )


class Encoder:
    """Encodes texts to little-endian ids of ``dtype``, which holds every id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = plain_byte_level(json.loads(self.whole.to_str()))
        self.model, self.split = self.whole.model, self.whole.pre_tokenizer
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.keep = CACHE_CHUNKS
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # a byte that no merge takes in: what stands on its two sides merges as if alone
        self.apart = self.model.token_to_id(_APART)
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _merge(self, pieces: list[str], shown: Callable[[str], str]) -> None:
        """Put the ids of plain pieces into ``parts``; ``shown`` turns joined pieces to the byte-level alphabet."""
        for k in range(0, len(pieces), 64):
            some = pieces[k : k + 64]
            tokens = array(self.code, [t.id for t in self.model.tokenize(shown(_APART_BYTE.join(some)))])
            packed, width = tokens.tobytes(), tokens.itemsize
            at = 0
            for piece, end in zip(some, [*(np.flatnonzero(np.frombuffer(packed, self.dtype) == self.apart) * width).tolist(), len(packed)]):
                self.parts[piece] = packed[at:end]
                at = end + width

    def _learn(self, chunks: Iterable[str]) -> None:
        """Put the ids of new chunks into ``parts``, by way of their distinct pieces, which are chunks too."""
        parts, odd = self.parts, self.pieces
        ended: list[str] = []
        cut: dict[str, list[str]] = {}
        new: set[str] = set()
        for c in chunks:
            if c[:1] == " ":
                body = c[1:]
                if body.isalpha():
                    if c.isascii() or max(body) <= _LAST:
                        new.add(c)
                        continue
                elif c[-1] in _ENDS and body[:-1].isalpha() and (c.isascii() or max(body) <= _LAST):
                    ended.append(c)
                    new.add(c[:-1])
                    continue
            if _PLAIN.match(c):
                cut[c] = own = _PIECE.findall(c)
                new.update(own)
                continue
            own = [p for p, _ in self.split.pre_tokenize_str(c)]
            for p in own:
                if p not in odd:
                    odd[p] = array(self.code, [t.id for t in self.model.tokenize(p)]).tobytes()
            parts[c] = b"".join([odd[p] for p in own])
        if ended:
            new.update(_ENDS)
        plain: list[str] = []
        other: list[str] = []
        for p in new:
            if p not in parts:
                (plain if p.isascii() else other).append(p)
        self._merge(plain, lambda joined: joined.replace(_APART_BYTE, _APART).replace(" ", "Ġ").replace("\n", "Ċ"))
        self._merge(other, lambda joined: joined.encode().decode("latin-1").translate(self.letters))
        for c in ended:
            parts[c] = parts[c[:-1]] + parts[c[-1]]
        for c, own in cut.items():
            parts[c] = b"".join([parts[p] for p in own])

    def _chunks(self, text: str) -> list[str]:
        if "\0" in text or any(x in text for x in (_ODD_ASCII if text.isascii() else _ODD_SPACE)):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts (null: none), each as packed integers of ``dtype``."""
        if not self.fast:
            return [array(self.code, self.whole.encode(t, add_special_tokens=False).ids).tobytes() if t else b"" for t in texts]
        if len(self.parts) > self.keep:
            self.before, self.parts = self.parts, {}
        if len(self.pieces) > self.keep:
            self.pieces.clear()
        cut = [[] if not t or any(s in t for s in self.specials) else self._chunks(t) for t in texts]
        known = self.parts.get
        found = [list(map(known, chunks)) for chunks in cut]  # None where a chunk is new
        new = [[i for i, v in enumerate(values) if v is None] for values in found]
        missing = {chunks[i] for chunks, places in zip(cut, new) for i in places}
        if self.before:
            again = {c: self.before[c] for c in missing if c in self.before}
            self.parts.update(again)
            missing.difference_update(again)
        self._learn(missing)
        for chunks, values, places in zip(cut, found, new):
            for i in places:
                values[i] = self.parts[chunks[i]]
        return [b"".join(values) if values or not t else array(self.code, self.whole.encode(t, add_special_tokens=False).ids).tobytes() for values, t in zip(found, texts)]

    def ids(self, text: str | None) -> bytes:
        """Ids of one whole text."""
        return self.many([text])[0]


def encoder(path: str, keep: int = CACHE_CHUNKS) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once; ``keep`` is the chunks of a generation from now on."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    _loaded[path].keep = keep
    return _loaded[path]
