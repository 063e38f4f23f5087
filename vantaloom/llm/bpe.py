"""Byte-pair encoding with a priority queue over a linked symbol list, and decoding.

A word's symbols form a doubly linked list. A heap holds (rank, position) of each
neighbouring pair that has a merge; the least is taken, an entry whose symbols have
changed since is stale and skipped, the merged symbol takes the left place, and its
new neighbouring pairs join the heap. Ties of rank go to the leftmost. Decoding
concatenates vocabulary strings.

Words repeat, so each worker keeps the ids of the words it has met, in a table that
is emptied when it reaches ``CACHE`` words of at most ``KEPT`` characters: memory is bounded, results are not
affected. Splitting a text into words follows the byte-level rule of the public
tokenizer files; text with characters that Python's Unicode tables do not know is
split by the library itself, whose tables may be newer.

Cases: a null text is empty and has no ids. A special token's string in a text is
that token. Lone surrogates cannot occur in Spark strings. Rows that repeat give rows
that repeat. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vantaloom.llm.tokens import _bytes_of_chars, library, model
from vantaloom.sources.runtime import ship_package

CACHE, KEPT = 400_000, 64
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # a fixed value: the word rule of byte-level tokenizer files

CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


class HeapBpe:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        spec, chars = model(path), _bytes_of_chars()
        vocab, self.path = spec["model"]["vocab"], path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.strings = {i: bytes(map(chars.__getitem__, token)) for token, i in vocab.items() if token not in self.special}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(SPLIT).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, list[int]] = {}

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word's bytes."""
        symbols = [self.byte_ids[b] for b in raw]
        n = len(symbols)
        merges = self.merges
        heap = [(m[0], i) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            merge = merges.get((symbols[i], symbols[j]))
            if merge is None or merge[0] != rank:
                continue
            symbols[i], symbols[j] = merge[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (m[0], h))
        return [s for s in symbols if s >= 0]

    def split(self, text: str) -> list[str]:
        if text.isascii() or _all_known(text):
            return self.words(text)
        return [text[a:b] for _, (a, b) in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> Iterator[int]:
        known, words = self.known, self.split(text)
        fresh = set(words).difference(known)
        if fresh:
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = set(words)
            long = {w: self.word(w.encode()) for w in fresh if len(w) > KEPT}
            known.update((w, self.word(w.encode())) for w in fresh if len(w) <= KEPT)
            if long:
                return chain.from_iterable(long[w] if w in long else known[w] for w in words)
        return chain.from_iterable(map(known.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        if self.specials is None or not any(s in text for s in self.special):
            return list(self._ordinary(text))
        out: list[int] = []
        for part in self.specials.split(text):
            out.extend([self.special[part]] if part in self.special else self._ordinary(part))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=65_536)
def _is_known(char: str) -> bool:
    return unicodedata.category(char) != "Cn"


def _all_known(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return all(map(_is_known, set(text)))
    return True


@lru_cache(maxsize=4)
def heap_bpe(path: str) -> HeapBpe:
    return HeapBpe(path)


def _mapped(df: DataFrame, tokenizer: str, text_col: str, id_col: str, schema: T.StructType, row) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = heap_bpe(tokenizer)
        kinds = [pa.int64(), *[{"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}.get(f.dataType.simpleString(), pa.list_(pa.int32())) for f in schema.fields[1:]]]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "")
                rows.append((doc_id, *row(ids, bpe.decode(ids))))
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)


def encode_decode(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document its ids and the text decoded from them."""
    return _mapped(df, tokenizer, text_col, id_col, CODED, lambda ids, text: (ids, text))


def digests(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document the number of ids, the hash of the ids and the hash of the decoded text."""

    def row(ids: list[int], text: str) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(df, tokenizer, text_col, id_col, DIGEST, row)
