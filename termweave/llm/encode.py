"""Token identifiers of whole texts as the tokenizers library gives them, each distinct word and piece encoded once by a worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

#: A word of more bytes than this is never kept, so WORDS words and as many pieces bound a worker's memory.
LONG_WORD = 48
WORDS = 400_000
#: The normaliser and the split pattern (fixed values of a public tokenizer) that the cut into words and pieces stands for: white
#: space is never kept and nothing is joined across it; NFC joins no character to white space before it.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same pattern for words without _ODD: word characters less digits and _ are the letters, digits the numbers.
_PIECES = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")
#: Characters that Python's classes see otherwise than the tokenizer's: separators 1C-1F, superscripts, fractions, dotted I, and all
#: beyond extended Latin; and what may start a special token. Words that hold one go through the whole library.
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\U0010ffff]|<\\|")
#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
_open: dict[tuple[str, bool], WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _steps(spec: dict | None, inner: str) -> list[dict]:
    if spec is None:
        return []
    return [x for s in spec[inner] for x in _steps(s, inner)] if spec["type"] == "Sequence" else [spec]


def cut_is_known(path: str) -> bool:
    """Whether the tokenizer's file has the normaliser, split pattern and byte-level alphabet that this module's cut stands for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cuts = _steps(spec.get("pre_tokenizer"), "pretokenizers")
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    bytewise = len(cuts) == 2 and cuts[0] == split and cuts[1]["type"] == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
    plain = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and " " not in t["content"] for t in spec.get("added_tokens", []))
    return bytewise and plain and _steps(spec.get("normalizer"), "normalizers") == _NORMALIZER


class _Kept(dict):
    """Packed ids by word or piece; a missing one is made, a full cache starts anew, long ones are not kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key) -> bytes:
        ids = self.make(key)
        if len(key) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


class WordEncoder:
    """Ids of whole texts, equal to the library's, for any tokenizer file.

    Merging is always the library's. Where the file has the known cut, a text is cut at ASCII white space, each distinct word into
    pieces, and each distinct piece goes to the library's model once; words with characters of other classes, or that may hold a
    special token, go through the whole library. Tokenizers with another cut get whole texts through the whole library.
    """

    def __init__(self, path: str, plain_specials: bool = False, words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.pieces = _Kept(self._piece, words)
        self.words = _Kept(self._word, words) if cut_is_known(path) else None

    @classmethod
    def get(cls, path: str, plain_specials: bool = False) -> WordEncoder:
        """One encoder for each worker process, kept from task to task."""
        if (path, plain_specials) not in _open:
            _open[path, plain_specials] = cls(path, plain_specials)
        return _open[path, plain_specials]

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        return array(self.dtype.char, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if _ODD.search(word) or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return self._packed([word])[0]
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text, no special tokens added."""
        if self.words is None:
            return self._packed([t.decode() for t in texts])
        ids = self.words.__getitem__
        return [b"".join(map(ids, text.split())) for text in texts]
