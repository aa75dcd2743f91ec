"""Ids of the public word BPE tokenizer, cached per word.

The tokenizer lower-cases, splits into words and merges each word by itself, so a word's ids can be kept. Texts of Latin
letters go word by word; any other text, and one that might hold a special token, goes to the tokenizer library as a
whole. Words not seen before are merged by rank, with the end-of-word mark as a byte that UTF-8 never uses. Many texts are
encoded together: their words are cut in one array of bytes, and each distinct word is looked up once.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: Words kept per Python worker; beyond that the table starts anew.
KEPT_WORDS = 100_000
#: The same for texts that are encoded together, at about 200 bytes a word.
KEPT_WORDS_ALL = 300_000
_END = b"\xff"
_LATIN = 0x250
#: Characters of two UTF-8 bytes at most; the lower cases of Latin texts that go word by word lie below.
_TWO_BYTES = 0x800
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _byte_symbols() -> dict[str, int]:
    """Byte of each printable stand-in that byte-level vocabularies use: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _char_class(kind: str) -> str:
    """Regex class of the Latin characters of a Unicode category and of their lower cases, as escaped code points.

    Some lower cases lie above the range, such as those of U+018F or U+023A.
    """
    chars = {x for c in range(_LATIN) for x in (chr(c), *chr(c).lower())}
    return "".join(f"\\u{ord(x):04x}" for x in sorted(chars) if unicodedata.category(x).startswith(kind))


class _Words(dict):
    """Little-endian 32-bit ids of each word, worked out when first asked for."""

    def __init__(self, merge, kept: int):
        super().__init__()
        self.merge, self.kept = merge, kept

    def __missing__(self, word: str) -> bytes:
        merged = self.merge(word.encode() + _END)
        ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(self) >= self.kept:
            self.clear()
        self[word] = ids
        return ids


class WordBpe:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        suffix = content["model"]["end_of_word_suffix"]
        special = {t["content"] for t in content["added_tokens"]}
        symbols, ranks = _byte_symbols(), {}
        for token, i in content["model"]["vocab"].items():
            if token in special:
                continue
            last = token.endswith(suffix)
            ranks[bytes(symbols[c] for c in (token[: -len(suffix)] if last else token)) + (_END if last else b"")] = i
        merger = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
        self.words, self.words_all = (_Words(merger._core_bpe.encode_single_piece, kept) for kept in (KEPT_WORDS, KEPT_WORDS_ALL))
        letters, numbers = _char_class("L"), _char_class("N")
        spaces = r"\t-\r \u0085 "
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        chars = "".join(map(chr, range(_TWO_BYTES)))
        self.kinds = np.full(_TWO_BYTES, _OTHER, np.uint8)
        for kind, own in ((_SPACE, spaces), (_LETTER, letters), (_NUMBER, numbers)):
            self.kinds[[m.start() for m in re.finditer(f"[{own}]", chars)]] = kind
        # U+0130 has a lower case of two characters, U+023A and U+023E have one of three bytes; special tokens start with "<|"
        self.other = re.compile(f"[^\\u0000-\\u012f\\u0131-\\u0239\\u023b-\\u023d\\u023f-{chr(_LATIN - 1)}]|<\\|").search

    @cached_property
    def whole(self):
        """The library's tokenizer, loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> WordBpe:
        return WordBpe(path)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if self.other(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per byte whether it belongs to a word and whether a word starts there, as ``split`` cuts them; three spaces end the data."""
        kind = self.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        kind[lead] = kind[lead + 1] = self.kinds[((data[lead] & 31).astype(np.int64) << 6) | (data[lead + 1] & 63)]
        inside, starts = kind != _SPACE, kind == _NUMBER
        starts[0] = True
        starts[1:] |= kind[1:] != kind[:-1]
        starts &= inside
        starts[lead + 1] = False
        # an apostrophe that starts a word takes the letters of 's 't 'm 'd 're 've 'll with it
        mark = np.flatnonzero(starts & (data == ord("'")))
        one, two = data[mark + 1], data[mark + 2]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        behind = (mark + 2 + long)[short | long]
        starts[mark[short | long] + 1] = False
        starts[behind] = inside[behind]
        return inside, starts

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some texts that go word by word."""
        parts = [text.lower().encode() + b" " for text in texts]
        data = np.frombuffer(b"".join(parts) + b"  ", np.uint8)
        inside, starts = self._cut(data)
        first = np.cumsum([0, *map(len, parts)])
        n_words = np.add.reduceat(starts, first[:-1], dtype=np.int64)
        # without the spaces, words lie next to each other
        body = data[inside]
        bounds = np.append(np.flatnonzero(starts[inside]), len(body)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(body)).dictionary_encode()
        found = list(map(self.words_all.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        table, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = words.indices.to_numpy()
        n_ids = lengths[code]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        ids = table[np.repeat((np.cumsum(lengths) - lengths)[code] - ends[:-1], n_ids) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum(n_words)[:-1]])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as 32-bit numbers; takes about 20 bytes of memory a byte of text."""
        latin = [text.isascii() and "<|" not in text or not self.other(text) for text in texts]
        rest = iter(self._latin([t for t, plain in zip(texts, latin, strict=True) if plain]) if any(latin) else ())
        return [next(rest) if plain else np.frombuffer(self.encode(t), "<u4") for t, plain in zip(texts, latin, strict=True)]
