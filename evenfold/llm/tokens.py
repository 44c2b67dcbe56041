"""Token ids of whole texts, with a bounded cache of words.

A text is cut at spaces where the tokenizer always begins a new pre-token, so the
ids of a text are those of its words in a row and a frequent word is encoded once.
Words of plain letters go straight to the tokenizer's merge model; all others pass
the whole tokenizer. The cache lives in the Python worker, stops growing when it is
full, and never changes a result.
"""

from __future__ import annotations

import re

from tokenizers import Tokenizer

#: White space beside a space may belong to a run, which the byte-level pre-tokenizer keeps together.
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Letters that both tokenizers keep together and that no normaliser recomposes, then marks of one pre-token.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([,.;:!?*#%$&|]*)")

CACHE_WORDS = 340_000
CACHED_LENGTH = 40


def byte_letters() -> dict[int, str]:
    """The printable characters that byte-level vocabularies use for bytes that are none themselves."""
    others = iter(range(256, 512))
    return {b: chr(next(others)) for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)}


class WordEncoder(dict):
    """Ids of words as little-endian unsigned 32-bit integers; missing words are encoded when asked for.

    ``leading_space``: a word's space is part of its first token (byte-level BPE); else white space is dropped
    and letters are lowered.
    """

    def __init__(self, path: str, leading_space: bool, cache_words: int = CACHE_WORDS):
        super().__init__()
        self.cache_words = cache_words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = byte_letters()
        self.leading_space = leading_space
        self.space = self.letters[32] if leading_space else ""
        self.marks: dict[str, bytes] = {"": b""}
        self.bare: dict[str, bytes] = {}
        self.line = self._whole("\n")

    def _pre_token(self, piece: str, space: str = "") -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.merges.tokenize(space + piece)])

    def _whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _marks(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._pre_token(marks)
            if len(self.marks) < 1000:
                self.marks[marks] = ids
        return ids

    def _bare(self, word: str) -> bytes:
        """A word at the beginning of a text or line, with no space before it."""
        ids = self.bare.get(word)
        if ids is None:
            plain = _PLAIN.fullmatch(word)
            ids = self._pre_token(plain[1]) + self._marks(plain[2]) if plain else self._whole(word)
            if len(word) <= CACHED_LENGTH and len(self.bare) < self.cache_words // 10:
                self.bare[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            if not self.leading_space:
                letters = letters.lower()
            if letters == word:
                return self._keep(word, self._pre_token(letters, self.space))
            return self._keep(word, self[letters] + self._marks(marks))
        if self.leading_space:
            lines = word.split("\n")
            if len(lines) > 1 and all(x and not (x[0].isspace() or x[-1].isspace()) for x in lines):
                return self._keep(word, self[lines[0]] + b"".join([self.line + self._bare(x) for x in lines[1:]]))
        return self._keep(word, self._whole(" " + word if self.leading_space else word))

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHED_LENGTH and len(self) < self.cache_words:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text; a null text has none."""
        if not text:
            return b""
        if not self.leading_space:
            return b"".join(map(self.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        beside = [" ", *[c for c in _OTHER_SPACES if c in text]]
        runs = text[0] == " " or text[-1] == " " or any(f" {c}" in text or f"{c} " in text for c in beside)
        head, *rest = _SINGLE.split(text) if runs else text.split(" ")
        return self._bare(head) + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, leading_space: bool, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One encoder per Python worker and tokenizer; about 160 bytes per cached word."""
    if (path, leading_space) not in _ENCODERS:
        _ENCODERS[path, leading_space] = WordEncoder(path, leading_space, cache_words)
    return _ENCODERS[path, leading_space]
