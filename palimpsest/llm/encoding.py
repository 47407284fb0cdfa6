"""Token ids by the tokenizers library, with a bounded memory of words already encoded.

Both public vocabularies split a text into pretokens before any merge, and a space between two characters that are
not white space always ends a pretoken. A text may so be encoded piece by piece, and a piece that was seen before
needs no merges. Pieces of plain letters and marks go to the library's model; any other piece goes through its
whole pipeline.
"""

from __future__ import annotations

import os
import re
from array import array

from palimpsest.llm.remembered import begins

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ASCII_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
#: Letters, then ASCII marks: one pretoken each in either vocabulary.
PLAIN = re.compile(f"([{LETTERS}]+)([!-/:-@\\[-`{{-~]*)")
NARROW = re.compile(r"(?<=\S) (?=\S)")
#: Line ends beside other white space.
LINE_ENDS = re.compile(r"\n.*\n|\s\n|\n\s|[^\S\n]")
KEPT, LONGEST = 600_000, 48
#: The same for a vocabulary that lower-cases: the other half would save a sixth of the time and take 41 MB of each worker.
KEPT_LOWER = 300_000
#: A piece that is more than letters is kept when its hash comes the second time, among so many.
SECOND = 1 << 21
#: All white space but blanks and line ends.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def byte_marks() -> dict[int, str]:
    """Byte to the character that byte-level vocabularies write for it: printable ones stand for themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


MARKS = byte_marks()


def wide(text: str) -> bool:
    """White space may stand beside a space: such a text isn't cut at that space."""
    return "  " in text or " \n" in text or "\n " in text or any(map(text.__contains__, OTHER_SPACE))


class _Memory(dict):
    """Piece to its ids as little-endian 32-bit integers. Once `kept` pieces are in, others are encoded each time.

    Words are kept at once. Words with marks or line ends are made of pieces that are kept, and most never come again.
    """

    def __init__(self, encode, kept: int):
        super().__init__()
        self.encode, self.kept, self.seen = encode, kept, bytearray(SECOND)

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONGEST and len(self) < self.kept:
            at = hash(piece) % SECOND
            if self.seen[at] or piece.isalpha():
                self[piece] = ids
            else:
                self.seen[at] = 1
        return ids


class Encoder:
    """Encodes whole texts with one vocabulary file, as encode(text, add_special_tokens=False) does: the names of special tokens in a text give their ids.

    lower: the vocabulary lower-cases and drops white space.
    """

    def __init__(self, path: str, lower: bool, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.lower = self.whole.model, lower
        self.end = array("I", [end]).tobytes()
        kept = KEPT_LOWER if lower else KEPT
        self.first = _Memory(lambda piece: self._ids("", piece), kept)
        self.rest = self.first if lower else _Memory(lambda piece: self._ids(" ", piece), kept)
        self.marks = _Memory(self._merged, kept)

    def _merged(self, pretoken: str) -> bytes:
        """Ids of one pretoken, by the library's model."""
        if not pretoken.isascii():
            pretoken = pretoken.encode().decode("latin-1")
        return self._tokens(pretoken.translate(MARKS))

    def _tokens(self, written: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _ids(self, before: str, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha() and (piece.islower() or not self.lower):
            return self._tokens(MARKS[32] + piece if before else piece)  # letters stand for themselves
        known = self.rest if before else self.first
        word = piece.rstrip(ASCII_MARKS)
        if len(word) < len(piece) and word.isascii() and word.isalpha():
            return known[word] + self.marks[piece[len(word) :]]
        left, line, right = piece.partition("\n")
        if line and left and right and not LINE_ENDS.search(piece):  # the line end is a pretoken by itself
            return known[left] + self.marks[line] + self.first[right]
        if not (m := PLAIN.fullmatch(piece)):
            return array("I", self.whole.encode(before + piece, add_special_tokens=False).ids).tobytes()
        word, marks = m.groups()
        if marks:
            return known[word] + self.marks[marks]
        if self.lower and not word.islower():
            return self.first[word.lower()]
        return self._merged(before + word)

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text (null: none) and the end id, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.end
        if self.lower:
            pieces = text.replace("\n", " ").split(" ")
            return b"".join([*map(self.rest.__getitem__, filter(None, pieces)), self.end])
        pieces = NARROW.split(text) if wide(text) else text.split(" ")
        head = self.first[pieces[0]] if pieces[0] else b""
        return b"".join([head, *map(self.rest.__getitem__, pieces[1:]), self.end])


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, lower: bool, end: int) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    begins("encoding", _encoders.clear)
    key = (path, lower, end)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
