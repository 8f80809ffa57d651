"""BPE encoding by longest matches with backtracking, decoding by an offset table, and counting by a merge heap.

* :func:`encode_texts`: an Aho-Corasick automaton finds the longest token at every position of a word; tokens
  are laid from left to right, and a token is accepted only if it and its predecessor are what the merges
  would make of their joined text (pair compatibility). A dead end is marked and never entered again, so the
  work is linear in the word.
* decoding takes the tokens' texts from one offset table.
* :func:`count_tokens`: adjacent pairs wait in a heap by rank; each pop merges two nodes of a linked list. The
  count is the initial symbols minus the merges; no identifiers are made.

Normalising and splitting into words is the tokenizer file's own (its normalizer and pre-tokenizer). Special
strings in a text become special tokens, as the library does by default.

Defined results: null counts as empty; an empty text has no tokens and decodes to an empty text; texts of any
length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import kept, small_batches

#: Texts of words, and words, kept with their results in a worker; the memory is emptied when full.
KEPT = 300_000
#: The same for encoders, whose results take several times the bytes of counts.
KEPT_IDS = 100_000
LONGEST_KEPT = 64
_END = 0x10000
#: Fixed value: the word pattern of the vocabulary with word ends. What it does to printable ASCII without
#: apostrophes is plain enough for a pattern of our own, which spares most texts the library's calls.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_WORDS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9 ]+").findall


class Vocabulary:
    """Merges of a byte-level BPE file of the tokenizers library; symbols are numbered by when a merge makes them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        number = {t: i for i, t in enumerate(base)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(base))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            n = number[a + b] = len(self.parts)
            self.parts.append((number[a], number[b]))
            self.pairs[number[a], number[b]] = n
        self.symbols = {self.spelled(t): n for t, n in number.items()}
        self.ids = [vocab[t] for t in number]
        self.lengths = [len(s) for s in self.symbols]
        self.bytelevel_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.texts = [texts.get(i, "") for i in range(max(texts) + 1)]
        self.words_alone = bool(self.suffix)
        self.normalizer, self.pre_tokenizer = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        splits = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        self.plain_ascii = self.words_alone and splits == [WORD_PATTERN]

    def spelled(self, token: str) -> str:
        """One character a symbol: the last one of a word-final token is moved out of the way of all others."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def spelled_word(self, word: str) -> str:
        return word[:-1] + chr(ord(word[-1]) + _END) if self.suffix and word else word

    def pieces(self, text: str) -> Iterator[tuple[str | None, int]]:
        """Words of a text in order, or None with the id of a special token."""
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                yield None, self.special[part]
            elif part:
                if self.plain_ascii and part.isascii() and part.isprintable() and "'" not in part:
                    for word in _ASCII_WORDS(part.lower()):
                        yield word, 0
                    continue
                if self.normalizer is not None:
                    part = self.normalizer.normalize_str(part)
                for word, _ in self.pre_tokenizer.pre_tokenize_str(part):
                    if word:
                        yield word, 0

    def spans(self, text: str) -> list[str]:
        """Stretches that can be treated one by one: white space ends every word where a vocabulary marks word ends."""
        return text.replace("\n", " ").split(" ") if self.words_alone else [text]


class Encoder:
    def __init__(self, path: str) -> None:
        self.v = v = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for s, n in v.symbols.items():
            self.automaton.add_word(s, n)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(v.parts)
        for s, n in v.symbols.items():
            for k in range(len(s) - 1, 0, -1):
                if (m := v.symbols.get(s[:k])) is not None:
                    self.shorter[n] = m
                    break
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[str, bytes]] = {}
        tail = "" if v.bytelevel_decoder else " "
        if v.bytelevel_decoder:
            back = _byte_of_char()
            self.table = pa.array([bytes(back[c] for c in t) if i not in v.special.values() else t.encode() for i, t in enumerate(v.texts)], pa.large_binary())
        else:
            self.table = pa.array([(t + tail).encode() for t in v.texts], pa.large_binary())

    def together(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart: undo the later of both again and again and look for an earlier merge across."""
        key = (a, b)
        if (known := self.compatible.get(key)) is not None:
            return known
        parts, pairs = self.v.parts, self.v.pairs
        limit, answer = len(parts), None
        while answer is None:
            if pairs.get((a, b), limit) < limit:
                answer = False
            elif parts[a][1] == a and parts[b][0] == b:
                answer = True  # nothing left to undo
            elif parts[b][0] == b or a > b and parts[a][1] != a:
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]
        if len(self.compatible) >= KEPT_IDS:
            self.compatible.clear()
        self.compatible[key] = answer
        return answer

    def word(self, word: str) -> list[int]:
        """Symbols of one word."""
        s = self.v.spelled_word(word)
        n, lengths = len(s), self.v.lengths
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(s):
            start = end + 1 - lengths[token]
            if longest[start] < 0 or lengths[longest[start]] < lengths[token]:
                longest[start] = token
        if longest[0] >= 0 and lengths[longest[0]] == n:
            return [longest[0]]
        open_, laid, at, token = [True] * (n + 1), [], 0, longest[0]
        while at < n:
            while True:
                end = at + lengths[token]
                if open_[end] and (not laid or self.together(laid[-1], token)):
                    laid.append(token)
                    at, token = end, longest[end]
                    break
                if (token := self.shorter[token]) < 0:
                    open_[at] = False
                    token = laid.pop()
                    at -= lengths[token]
                    break
        return laid

    def stretch(self, text: str) -> tuple[str, bytes]:
        ids: list[int] = []
        to_id = self.v.ids
        for word, special in self.v.pieces(text):
            if word is None:
                ids.append(special)
                continue
            if (got := self.words.get(word)) is None:
                got = tuple([to_id[x] for x in self.word(word)])
                if len(word) <= LONGEST_KEPT:
                    if len(self.words) >= KEPT_IDS:
                        self.words.clear()
                    self.words[word] = got
            ids += got
        return " ".join(map(str, ids)), array("i", ids).tobytes()

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Ids in decimal with spaces between, and as an array."""
        known = self.stretches
        names, arrays = [], []
        for x in self.v.spans(text):
            if (got := known.get(x)) is None:
                got = self.stretch(x)
                if len(x) <= LONGEST_KEPT:
                    if len(known) >= KEPT_IDS:
                        known.clear()
                    known[x] = got
            if got[1]:
                names.append(got[0])
                arrays.append(got[1])
        return " ".join(names), np.frombuffer(b"".join(arrays), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Concatenates slices of the offset table, as the library joins tokens."""
        if not len(ids):
            return ""
        taken = self.table.take(pa.array(ids))
        text = taken.buffers()[2].to_pybytes()[: taken.buffers()[1] and np.frombuffer(taken.buffers()[1], np.int64)[len(ids)]]
        return text.decode("utf-8", "replace") if self.v.bytelevel_decoder else text[:-1].decode()


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.words: dict[str, int] = {}
        self.stretches: dict[str, int] = {}

    def word(self, word: str) -> int:
        symbols, pairs = self.v.symbols, self.v.pairs
        node = [symbols[c] for c in self.v.spelled_word(word)]
        n = len(node)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get((node[i], node[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if node[i] >= 0 else n
            if j >= n or pairs.get((node[i], node[j])) != rank:
                continue  # a node has changed since
            merges += 1
            node[i], node[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get((rank, node[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pairs.get((node[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def stretch(self, text: str) -> int:
        total = 0
        for word, _ in self.v.pieces(text):
            if word is None:
                total += 1
            elif (got := self.words.get(word)) is not None:
                total += got
            else:
                total += (got := self.word(word))
                if len(word) <= LONGEST_KEPT:
                    if len(self.words) >= KEPT:
                        self.words.clear()
                    self.words[word] = got
        return total

    def count(self, text: str) -> int:
        total, known = 0, self.stretches
        for x in self.v.spans(text):
            if (got := known.get(x)) is None:
                got = self.stretch(x)
                if len(x) <= LONGEST_KEPT:
                    if len(known) >= KEPT:
                        known.clear()
                    known[x] = got
            total += got
        return total


def _kept(kind: type, path: str):  # noqa: ANN202
    """One instance a worker, until another operator's task follows in it."""
    return kept((kind, path), lambda: kind(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> and the text decoded from them."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept(Encoder, path)
        for b in batches:
            ids = [encoder.encode(t or "")[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same encoding and decoding, digested where it is made."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept(Encoder, path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for t in b.column("text"):
                names, ids = encoder.encode(t.as_py() or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(names.encode()).hexdigest())
                text_hash.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _kept(Counter, path)
        for b in batches:
            n = [counter.count(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    return small_batches(docs).select("doc_id", "text", n_bytes).mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
