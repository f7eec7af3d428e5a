"""Token ids of many texts with a BPE file of the `tokenizers` library, through a bounded word cache."""

from __future__ import annotations

import json
import re
from array import array
from functools import partial

import numpy as np
import regex

#: Cached words at most (about 200 bytes each); then the cache starts anew. Bounds the memory of a task.
CACHE_WORDS = 400_000
#: Separators that str.split() knows and the tokenizer's white space doesn't include: such texts take the plain path.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Letters beyond these have rules of their own in lower case or composition; texts with them aren't lowered as a whole.
_RARE = re.compile(r"[^\x00-įı-ɏ]")
#: Marks that end many words; each is a piece of its own.
_MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Codes(dict):
    """Word -> code; a missing word is encoded and gets the next code."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> int:
        code = self[word] = self.make(word)
        return code


class WordEncoder:
    """Same ids as Tokenizer.encode(text, add_special_tokens=False).

    White space separates words and never joins in a token of this kind of file (lower case, BPE with word ends), so a
    text's ids are its words' ids in turn. Words of Latin letters go to the BPE model straight away; others are first
    parted by the file's own pattern, and words with rarer letters go through the whole tokenizer. Texts with separators
    of unequal meaning are encoded whole. Holds CACHE_WORDS words and the tokenizer; meant to live for one task.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(parts[0]["pattern"]["Regex"]).findall
        self.letters, self.tokenize, self.rare = byte_letters(), self.tokenizer.model.tokenize, False
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes(self._add)
        self.flat, self.starts, self.lens = array("i"), array("q"), array("i")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.tokenize(piece)]

    def _ids(self, word: str) -> list[int]:
        if self.rare and _RARE.search(word):
            return self._whole(word)
        if self.rare:
            word = word.lower()
        if word.isalpha():
            return self._model(word)
        if word[-1] in _MARKS and word[:-1].isalpha():
            pieces = [word[:-1], word[-1]]
        else:
            pieces = self.pieces(word)
        if len(pieces) == 1 and pieces[0] == word:
            return self._model(word)
        out: list[int] = []
        for piece in pieces:
            code = self.codes[piece]
            at = self.starts[code]
            out += self.flat[at : at + self.lens[code]]
        return out

    def _add(self, word: str) -> int:
        ids = self._ids(word)
        self.starts.append(len(self.flat))
        self.lens.append(len(ids))
        self.flat.extend(ids)
        return len(self.lens) - 1

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn ("<u4") and each text's offsets; end_id, if given, follows each text."""
        if len(self.codes) > CACHE_WORDS:
            self._reset()
        codes, counts, odd = [], np.zeros(len(texts), np.int64), {}
        look = partial(map, self.codes.__getitem__)
        end = None
        if end_id is not None:
            # The end is a word that white space can't give.
            if "" not in self.codes:
                self.codes[""] = len(self.lens)
                self.starts.append(len(self.flat))
                self.lens.append(1)
                self.flat.append(end_id)
            end = np.array([self.codes[""]])
        for i, text in enumerate(texts):
            if any(c in text for c in _ODD_SPACE):
                odd[i] = self._whole(text)
                words = []
            else:
                self.rare = not text.isascii() and _RARE.search(text) is not None
                words = (text if self.rare else text.lower()).split()
            counts[i] = len(words) + (end is not None)
            codes.append(np.fromiter(look(words), np.int64, len(words)))
            if end is not None:
                codes.append(end)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        starts, lens, flat = (np.array(x) for x in (self.starts, self.lens, self.flat))
        n, at = lens[code].astype(np.int64), starts[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat(at - ends + n, n) + np.arange(n.sum())].astype("<u4")
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if not odd:
            return ids, bounds
        parts = [np.concatenate([np.array(odd.get(i, []), "<u4"), ids[bounds[i] : bounds[i + 1]]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
