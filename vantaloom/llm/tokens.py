"""Token ids of the public tokenizers, exactly as the ``tokenizers`` library gives them.

The library takes 0.3 s or so a MB on one core. Text of common characters gets the
same ids from ``tiktoken``'s merge loop, which is several times faster; any other
text, and any that contains a special token's string, goes through the library.
"Common" is a fixed set (below) on which the libraries' character classes and
normal forms cannot differ; ``tests/llm`` compare both ways on such text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# Tab, line feed, carriage return, printable ASCII, and Latin-1 letters and signs without the no-break space and the soft hyphen.
COMMON = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
# Ligatures, dashes, quotation marks, ellipsis and the euro sign, which are taken for a Latin-1 letter or sign in the test for common characters.
ALSO = str.maketrans({"œ": "é", "Œ": "É", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "„": '"', "…": ".", "€": "$"})

# Fixed value: the word rule of the file; below, the same rule spelt out for common characters, which the standard library matches faster.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿœŒ"
_NUMBERS = "0-9²³¹¼½¾"
COMMON_SPLIT = f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\t\n\r {_LETTERS}{_NUMBERS}]+"


def is_common(text: str) -> bool:
    """Whether all characters are of the set that both ways treat alike."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        try:
            raw = text.translate(ALSO).encode("latin-1")
        except UnicodeEncodeError:
            return False
    return not raw.translate(None, COMMON)


@lru_cache(maxsize=8)
def library(path: str):
    """The tokenizer of a file, once in each worker, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _bytes_of_chars() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one character: printable Latin-1 as itself, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=8)
def model(path: str) -> dict:
    """The parsed tokenizer file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class ByteBpe:
    """Ids of a byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken

        spec, chars = model(path), _bytes_of_chars()
        self.path, self.special = path, {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(chars.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value: the split of byte-level tokenizer files
        # Its merge loop takes the pair whose joined token has the least id; here ids follow the order of the merges.
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_vocab = max(*spec["model"]["vocab"].values(), *self.special.values()) + 1

    def encode(self, text: str) -> list[int]:
        if is_common(text) and not any(s in text for s in self.special):
            return self.fast(text)
        return library(self.path).encode(text, add_special_tokens=False).ids


class WordBpe:
    """Ids of a BPE file whose words carry an end-of-word suffix.

    The merge loop knows no suffix, so each word gets a last byte NUL, which first
    merges with the byte before it: those pairs have the least ranks.
    """

    END = "\0"

    def __init__(self, path: str):
        import tiktoken

        spec, chars = model(path), _bytes_of_chars()
        self.path, self.special = path, [t["content"] for t in spec["added_tokens"]]
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]

        def raw(token: str) -> bytes:
            word = token.endswith(suffix)
            return bytes(map(chars.__getitem__, token.removesuffix(suffix) if word else token)) + self.END.encode() * word

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            ranks.setdefault(raw(left + right), len(ranks))
        self.ids = np.full(len(ranks), -1, dtype=np.int64)
        for token, i in vocab.items():
            if token not in self.special:
                self.ids[ranks[raw(token)]] = i
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != WORD_SPLIT:
            raise ValueError("a word rule that is not known")
        self.words = re.compile(COMMON_SPLIT).findall
        self.fast = tiktoken.Encoding("word_bpe", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.n_vocab = max(vocab.values()) + 1 + len(self.special)

    def encode(self, text: str) -> np.ndarray:
        if is_common(text) and not any(s in text for s in self.special):
            words = self.words(text.lower())
            if not words:
                return np.zeros(0, dtype=np.int64)
            return self.ids[np.array(self.fast("\0".join(words) + "\0"), dtype=np.int64)]
        return np.array(library(self.path).encode(text, add_special_tokens=False).ids, dtype=np.int64)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
