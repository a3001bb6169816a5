"""Token ids of whole texts inside a task: the tokenizers library, asked once for each distinct run of text between spaces."""

from __future__ import annotations

import os
import re
import sys
from array import array

WHITE = r" \t\n\r\f\v"
#: What keeps a text from being cut before each space and line end: a run of them, other white space, the mark used for cutting.
RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\f", "\v", "\0")
OTHER_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LONGEST = 64  # of the pieces that are kept
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"  # letters, each one code point in normal form


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of UTF-8 texts as bytes (little-endian unsigned 32-bit), equal to `Tokenizer.encode(..., add_special_tokens=False)`.

    Both supported families split at white space before any merge, so a text is cut at ASCII white space and each
    piece's ids are kept: words repeat far more than texts. Pieces of printable ASCII and Latin letters go to the
    model's merges directly, all others through the whole tokenizer. Pieces of up to `LONGEST` bytes live in two generations of `most` each; the
    older one is dropped when the newer is full, which bounds a worker's memory in bytes and changes no result. Texts whose
    white space cannot be cut so, those that may hold a mark that the tokenizer adds (`<|endoftext|>`), and those of tokenizers of another
    family, are encoded in one piece.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = {token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.sign = re.match(rb"[^a-z]*", os.path.commonprefix(sorted(self.marks)))[0]  # what all marks start with
        self.model = self.tokenizer.model
        steps = repr(self.tokenizer.normalizer), repr(self.tokenizer.pre_tokenizer)
        self.simple = re.compile(f"[\n ]?[!-~{LATIN}]+")
        self.letters = _byte_letters()
        self.encode = self._encode_whole
        if "Split" in steps[1] and "Removed" in steps[1] and "Lowercase" in steps[0]:
            self.encode, self._piece = self._encode_words, self._lower_piece
            self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s0-9{LATIN}]+")
        elif steps[0] == "None" and re.fullmatch(r"ByteLevel\(add_prefix_space=False, trim_offsets=\w+, use_regex=True\)", steps[1]):
            self.encode, self._piece = self._encode_spaced, self._spaced_piece
            self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
            self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
        self.most, self.small, self.old, self.new = most, {}, {}, self._generation()
        self.get = self.new.__getitem__

    def _generation(self) -> dict:
        encoder = self

        class Generation(dict):
            def __missing__(self, piece):
                ids = encoder.old.get(piece) or encoder._piece(piece)
                if len(piece) <= LONGEST:
                    self[piece] = ids
                return ids

        return Generation()

    def _joined(self, pieces: list) -> bytes:
        if len(self.new) > self.most:
            self.old, self.new = self.new, self._generation()
            self.get = self.new.__getitem__
        return b"".join(map(self.get, pieces))

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _is_simple(self, piece: str) -> bool:
        if piece.isascii():
            return " " not in piece[1:] and (piece[1:] if piece[:1] == "\n" else piece).isprintable()
        return bool(self.simple.fullmatch(piece))

    def _merged(self, parts: list[str]) -> bytes:
        return b"".join([self.small.get(x) or self._part(x) for x in parts])

    def _part(self, part: str) -> bytes:
        """The ids of what the tokenizer merges as one, in the letters of its byte alphabet."""
        if not part.isascii():
            mapped = part.encode().decode("latin-1").translate(self.letters)
        elif part[0] == " ":
            mapped = self.letters[32] + part[1:]
        else:
            mapped = part if part.isprintable() else part.translate(self.letters)
        ids = _packed([token.id for token in self.model.tokenize(mapped)])
        if len(self.small) > self.most:
            self.small.clear()
        if len(part) <= LONGEST:
            self.small[part] = ids
        return ids

    def _lower_piece(self, raw: bytes) -> bytes:
        piece = raw.decode()
        if not self._is_simple(piece):
            return self._whole(piece)
        piece = piece.lower()
        return self._merged([piece] if piece.isalpha() else self.parts.findall(piece))

    def _spaced_piece(self, piece: str) -> bytes:
        if not self._is_simple(piece):
            return self._whole(piece)
        return self._merged([piece] if piece[:1] == " " and piece[1:].isalpha() else self.parts.findall(piece))

    def _encode_whole(self, text: bytes | None) -> bytes:
        return self._whole(text.decode()) if text else b""

    def _may_hold_mark(self, text: bytes) -> bool:
        """Whether a mark stands in the text, letters in either case: more than the tokenizer takes for one, never less."""
        return bool(self.marks) and self.sign in text and any(mark in text.lower() for mark in self.marks)

    def _encode_words(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return self._whole(text.decode()) if self._may_hold_mark(text) else self._joined(text.split())

    def _encode_spaced(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        marked = self._may_hold_mark(text)
        text = text.decode()
        if marked:
            return self._whole(text)
        if OTHER_WHITE.search(text):
            return self._whole(text)
        if any(run in text for run in RUNS):
            return self._joined(self.cut.findall(text))
        return self._joined(text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0"))


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process, so its store outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
