"""Token ids of whole texts, encoded by the tokenizers library one distinct word at a time."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Sequence

# White space next to a space or line feed: such a text is cut at runs of ASCII white space instead.
_RUN = re.compile(r"[ \n]\s|\s[ \n]")
_PIECES = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# Other white space before ASCII white space: such a text isn't cut at all.
_MIXED = re.compile(r"[^\S \t-\r][ \t-\r]")
# Marks that form one pre-token after letters (the apostrophe may belong to the word).
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
# White space (and the null character) that makes regular expressions decide; pairs that make a run without it.
_RARE = "".join(c for c in map(chr, range(0x3001)) if c == "\0" or (c.isspace() and c not in " \n"))
_PAIRS = ("  ", " \n", "\n ", "\n\n")
MAX_WORDS = 200_000


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _kind(path: str) -> str:
    """``byte``: byte-level BPE, white space starts pre-tokens. ``word``: white space is dropped, lower case."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, before = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE":
        return "other"
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "byte"
    steps = [s["type"] for s in before.get("pretokenizers", [])]
    changes = [s["type"] for s in (normal or {}).get("normalizers", [])]
    if steps == ["Split", "ByteLevel"] and before["pretokenizers"][0]["behavior"] == "Removed" and changes == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "other"


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    Where white space follows something else, a new pre-token starts in byte-level BPE, and word BPE
    drops white space; merges stay inside pre-tokens. So a text is the concatenation of its pieces
    ' word', each distinct piece is encoded once, and ids are joined from a table. A new piece of
    Latin-1 letters, perhaps with marks after it, is one or two pre-tokens and goes to the
    tokenizer's BPE model as such; other pieces go through the whole tokenizer, as does every text of
    another kind of tokenizer. The table holds ``max_words`` pieces at most.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = _kind(path)
        self.model = self.tokenizer.model
        self.max_words = max_words
        self.model_tokens = self.model.tokenize
        self.known = _Known(self)
        self.letters = str.maketrans(_byte_letters())
        self.space = " ".translate(self.letters)
        self.marks: dict[str, bytes] = {}
        self.feed = self._plain(["\n"])[0] if self.kind == "byte" else b""

    @property
    def id_count(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _plain(self, pieces: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _fresh(self, piece: str) -> bytes:
        """The ids of one piece."""
        first = piece[0]
        rest = piece[1:] if first in " \n" else piece
        word, end = rest, b""
        if not word.isalpha():
            word = rest.rstrip(_MARKS)
            if not word.isalpha():
                return self._plain([piece])[0]
            marks = rest[len(word) :]
            end = self.marks.get(marks)
            if end is None:
                end = self.marks[marks] = self._plain([marks])[0]
                if len(self.marks) > 10_000:
                    self.marks = {}
        if self.kind == "word":
            word = word.lower()
        if not word.isascii():  # ASCII letters are written as themselves
            if max(word) > "\xff":
                return self._plain([piece])[0]
            word = word.encode().decode("latin-1").translate(self.letters)
        if first == " " and self.kind == "byte":
            word = self.space + word
        ids = array("I", [t.id for t in self.model_tokens(word)]).tobytes()
        return (self.feed + ids + end) if first == "\n" else ids + end

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; NULL counts as empty."""
        return [self._text(text) if text else b"" for text in texts]

    def _text(self, text: str) -> bytes:
        # With spaces and line feeds as its only white space, a text needs no regular expression.
        plain = not any(c in text for c in _RARE)
        if self.kind == "other" or (not plain and _MIXED.search(text)):
            return self._plain([text])[0]
        runs = any(p in text for p in _PAIRS) if plain else "\0" in text or _RUN.search(text)
        if runs:
            pieces = _PIECES.findall(text)
        else:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return b"".join(map(self.known.__getitem__, pieces))


class _Known(dict):
    """Ids by piece; a new piece is encoded when it is first asked for. Emptied at ``max_words`` pieces."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            return b""
        if len(self) >= self.encoder.max_words:
            self.clear()
        found = self[piece] = self.encoder._fresh(piece)
        return found


@functools.lru_cache(maxsize=4)
def encoder(path: str, max_words: int = MAX_WORDS) -> Encoder:
    """One encoder per process, tokenizer file and table size."""
    return Encoder(path, max_words)
