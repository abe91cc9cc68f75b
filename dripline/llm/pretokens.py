"""Words that a tokenizer encodes one by one, so that their codes can be kept and looked up.

The cut that the vocabulary file states never reaches over white space, and its normal form makes
all white space plain spaces. So a text's tokens are those of the words between the spaces of the
normalised text, one after the other. Two kinds of text are left to the library as a whole: those
with one of its special strings, and those with a word that the normal form would change a second
time (such as a capital letter whose accent joins it only in lower case).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from pathlib import Path

import numpy as np

# Fixed value: the cut into pre-tokens as the vocabulary file states it.
STATED_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STATED_STEPS = ["NFC", "Replace", "Lowercase"]


def _class(kind: str) -> str:
    """The characters below U+0250 whose Unicode category begins with a letter, for a pattern."""
    return "".join(
        f"\\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i)).startswith(kind)
    )


# The same cut for what white space divides, below U+0250.
CUT = re.compile(
    f"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^{_class('L')}{_class('N')}]+"
)
# Below U+0250 normal form C changes nothing and lower case is the same everywhere, but for
# U+0130, which becomes two characters, and U+001C to U+001F, which divide words in Python only.
NOT_PLAIN = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")


# Words that are handed to the library as one text; a call for each costs more than the word.
_TOGETHER = 1_000


class Codes(dict):
    """Ids of words as bytes. A word that is not there yet gives an empty buffer, which is filled
    when all new words of some texts are encoded together."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytearray:
        waiting = self[word] = bytearray()
        self.new.append(word)
        return waiting

    def of(self, words: list[str]) -> list[bytes | bytearray]:
        return list(map(self.__getitem__, words))

    def fill(self, encoded: list[bytes | None]) -> set[str]:
        """Give the new words their ids; those without stay unknown and are returned."""
        without = set()
        for word, ids in zip(self.new, encoded, strict=True):
            if ids is None:
                without.add(word)
                del self[word]
            else:
                waiting = self[word]
                waiting += ids
                self[word] = ids
        self.new = []
        return without


class Words:
    """Cuts texts into the words that one tokenizer of the ``tokenizers`` library encodes alone."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        stated = json.loads(Path(path).read_text(encoding="utf-8"))
        self.specials = [x["content"] for x in stated["added_tokens"]]
        steps = (stated.get("normalizer") or {}).get("normalizers", [])
        cuts = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = [x["type"] for x in steps] == STATED_STEPS and [
            x["pattern"].get("Regex") for x in cuts if x["type"] == "Split"
        ] == [STATED_CUT]
        end = stated["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if end:
            known = self.tokenizer.get_vocab()
            self.ends[[i for token, i in known.items() if token.endswith(end)]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of whole texts."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, text: str) -> list[str] | None:
        """The normalised words of a text, or None if it has to be encoded whole."""
        if not self.by_words:
            return None
        if any(special in text for special in self.specials):
            return None
        if not NOT_PLAIN.search(text):
            return text.lower().split()
        return [x for x in self.tokenizer.normalizer.normalize_str(text).split(" ") if x]

    def encode_words(self, words: list[str], dtype: np.dtype) -> list[bytes | None]:
        """The ids of words as bytes; None for those that are not encoded alone.

        Plain words go to the library many at a time. Each part of a word ends with a token that
        says so, and the parts are counted, so the ids of the words can be told apart.
        """
        out: dict[str, bytes | None] = {}
        plain = [x for x in words if not NOT_PLAIN.search(x)]
        others = [x for x in words if NOT_PLAIN.search(x)]
        runs = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        for run, found in zip(runs, self.encode([" ".join(x) for x in runs]), strict=True):
            ids = np.array(found, dtype=dtype)
            last = np.cumsum([len(CUT.findall(x)) for x in run]) - 1
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != last[-1] + 1:
                others += run
                continue
            data = ids.tobytes()
            cuts = [0, *(ends[last] * ids.itemsize).tolist()]
            out.update(
                (word, data[low:high])
                for word, low, high in zip(run, cuts, cuts[1:], strict=False)
            )
        for word, found in zip(others, self.encode(others), strict=True):
            alone = self.pieces(word) is not None
            out[word] = np.array(found, dtype=dtype).tobytes() if alone else None
        return [out[x] for x in words]

    def pieces(self, word: str) -> list[str] | None:
        """The parts of a word that are encoded alone; None for a word that can't be."""
        if not NOT_PLAIN.search(word):
            return CUT.findall(word)
        return [word] if self.tokenizer.normalizer.normalize_str(word) == word else None


# What a byte-level tokenizer encodes alone, below U+0250.
_L, _N = _class("L"), _class("N")
BYTE_CUT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
)
_LINE = "\n"


class ByteWords:
    """Ids of whole texts by a byte-level tokenizer of the ``tokenizers`` library, from a cache.

    Texts with characters from U+0250 on are encoded whole by the library.
    """

    def __init__(self, tokenizer, stated: dict, cache_size: int):
        self.tokenizer = tokenizer
        cut = stated.get("pre_tokenizer") or {}
        self.by_words = (
            stated.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and bool(cut.get("use_regex"))
            and not cut.get("add_prefix_space")
        )
        self.cache = Codes()
        self.cache_size = cache_size
        (self.line,) = self._encode([_LINE])[0] if self.by_words else (None,)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces. Those without white space at their end go to the library in one text,
        between line ends, each of which is a token of its own there."""
        out: dict[str, bytes] = {}
        dark = [x for x in pieces if not x[-1].isspace()]
        others = [x for x in pieces if x[-1].isspace()]
        runs = [dark[i : i + _TOGETHER] for i in range(0, len(dark), _TOGETHER)]
        for run, found in zip(runs, self._encode([_LINE.join(x) for x in runs]), strict=True):
            ids = np.array(found, dtype="<u4")
            lines = np.flatnonzero(ids == self.line)
            if len(lines) != len(run) - 1:
                others += run
                continue
            data, width = ids.tobytes(), ids.itemsize
            lows = [0, *((lines + 1) * width).tolist()]
            highs = [*(lines * width).tolist(), len(data)]
            out.update(
                (piece, data[low:high]) for piece, low, high in zip(run, lows, highs, strict=True)
            )
        for piece, found in zip(others, self._encode(others), strict=True):
            out[piece] = np.array(found, dtype="<u4").tobytes()
        return [out[x] for x in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        known = [
            self.cache.of(BYTE_CUT.findall(x))
            if self.by_words and not NOT_PLAIN.search(x)
            else None
            for x in texts
        ]
        if self.cache.new:
            self.cache.fill(self._encode_pieces(self.cache.new))
        out = [
            None if found is None else np.frombuffer(b"".join(found), dtype="<u4")
            for found in known
        ]
        entire = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(entire, self._encode([texts[i] for i in entire]), strict=True):
            out[i] = np.array(ids, dtype="<u4")
        return out
