"""LM scoring by an interpolated modified Kneser-Ney model of trigrams, or of bigrams where the order is set to two.

Counting is one Spark job with two shuffles. Tasks count the n-grams of their texts and deal them out by the hash of
the word before the last (of words that hold much of the corpus by that of the last two words instead, so that no
bucket is hot); the receiving tasks merge the counts, write each bucket as sorted hash arrays into the shared folder,
and send on what each bucket knows of a word: its count, the number of words before it, and how many words follow it
after one, two or more others; and, where a bucket has only part of a two-word context, what it knows of that. The second
set of tasks sums that and writes the word and context arrays. Files get their names by an atomic rename and hold the
same bytes whenever a task is run again. The model lists the buckets that were written, so that any file that cannot
be read fails the task.

Scoring tasks map these arrays into memory and look up the distinct words and n-grams of some megabytes of text
at a time, in hash order. A folder that is not a local path is fetched once per worker.

Every text begins with two start tokens. Bigrams count by the distinct words before them when the order is three. With
order two the first word of every trigram is the same one, and the bigram level is left out.

Defined results: words have A-Z lower-cased; every text, null and empty ones too, ends with an end token; unknown words
share what is left of the continuation probabilities; without any training text every token has probability one.
Words are known by 48 bits of their hash. A stored bucket keeps 41 to 56 bits of a key, the more the more keys it has, so that a
key that is not there is taken for one that is with a probability of some 10^-11.

On their way to the merging tasks the words that occur most in a few tasks' first texts are numbers of two bytes, all others
their hashes; which words have numbers changes no result.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold
from .scratch import shared_folder, small_batches
from .textkernel import mix, word_hashes

FOLDS, HELD_OUT = 7, 2
ORDER = 3
#: Tokens that a task counts and that it scores at a time, tokens per bucket about, and the least number of buckets.
STEP_TOKENS, SCORED_TOKENS, BUCKET_TOKENS, LEAST_BUCKETS = 1_500_000, 1_000_000, 500_000, 64
#: Parts of what is known of words that a merging task holds before it adds them up.
HELD_PARTS = 6
#: Words that have a number (65,535 stands for all others), tasks whose words are counted for that, and the bits of a word that choose its place among them.
NUMBERED, NUMBERING_TASKS, PLACE_BITS = 65_535, 16, 19
_BITS48 = np.uint64((1 << 48) - 1)
_BITS40 = np.uint64((1 << 40) - 1)
START, END = np.uint64(1), np.uint64(2)
_SEED = np.uint64(0x2545F4914F6CDD1D)


def token_runs(batches: Iterator[pa.RecordBatch], step: int = STEP_TOKENS) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids of some texts, their tokens and the tokens before each, and where each text begins."""
    ids, parts, sizes, held = [], [], [0], 0
    for b in batches:
        names = b.column("doc_id").to_pylist()
        for first, words, counts in word_hashes(b.column("text")):
            n = len(counts) - 1
            # after every text its end token
            tokens = np.full(len(words) + n, END, np.uint64)
            spots = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(counts))
            tokens[spots] = np.maximum(words & _BITS48, np.uint64(3))
            parts.append(tokens)
            sizes.extend(np.diff(counts) + 1)
            ids += names[first : first + n]
            held += len(tokens)
            if held >= step:
                yield ids, *_with_context(parts, sizes)
                ids, parts, sizes, held = [], [], [0], 0
    if ids:
        yield ids, *_with_context(parts, sizes)


def _with_context(parts: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens, starts = np.concatenate(parts), np.cumsum(sizes)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    return tokens, before, starts


def earlier(before: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The tokens two before each; all zero for order two."""
    out = np.zeros_like(before)
    if order == 3:
        out[1:] = before[:-1]
        out[starts[:-1]] = START
    return out


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word ^ _SEED) % np.uint64(buckets)).astype(np.int64)


def bigram_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) + word * np.uint64(0x9E3779B97F4A7C15))


def trigram_key(first: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return bigram_key(bigram_key(first, before), word)


def _is_spread(before: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return spread[np.minimum(np.searchsorted(spread, before), len(spread) - 1)] == before if len(spread) else np.zeros(len(before), bool)


def bigram_bucket(before: np.ndarray, word: np.ndarray, spread: np.ndarray, buckets: int) -> np.ndarray:
    out = word_bucket(before, buckets)
    wide = _is_spread(before, spread)
    if wide.any():
        out[wide] = (bigram_key(before[wide], word[wide]) % np.uint64(buckets)).astype(np.int64)
    return out


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(b, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _pack_counts(c: np.ndarray) -> bytes:
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<u4").tobytes()


def _unpack_counts(b: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(b[:n], np.uint8).astype(np.int64)
    c[c == 255] = np.frombuffer(b[n:], "<u4")
    return c


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, the last one first, and where groups of equal keys begin in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def _save(folder: str, name: str, value: np.ndarray) -> None:
    if folder.startswith("file:") or folder.startswith("/"):
        root = folder.removeprefix("file:").replace("//", "/")
        os.makedirs(root, exist_ok=True)
        with tempfile.NamedTemporaryFile(dir=root, delete=False) as f:
            np.save(f, value)
        os.replace(f.name, f"{root}/{name}.npy")
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with store.open_output_stream(draft) as f:
        np.save(f, value)
    store.move(draft, f"{root}/{name}.npy")


_fetched: dict[tuple[str, str], str] = {}


def _load(folder: str, name: str) -> np.ndarray:
    """Maps an array of the shared folder into memory for as long as it is in use."""
    if (folder, name) not in _fetched:
        if _fetched and next(iter(_fetched))[0] != folder:
            _fetched.clear()  # another model
        if folder.startswith("file:") or folder.startswith("/"):
            path = f"{folder.removeprefix('file:').replace('//', '/')}/{name}.npy"
        else:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(folder)
            path = f"{tempfile.mkdtemp()}/{name}.npy"
            with store.open_input_stream(f"{root}/{name}.npy") as source, open(path, "wb") as f:
                while block := source.read(1 << 22):
                    f.write(block)
        _fetched[folder, name] = path
    return np.load(_fetched[folder, name], mmap_mode="r")


def _even(cell: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where cells of n keys would begin if all were alike."""
    return cell * n >> bits


def _save_counts(folder: str, kind: str, name: int, key: np.ndarray, counts: np.ndarray) -> None:
    """One array of bytes: sizes, where each cell of keys with the same leading bits begins, 40 further bits of the keys in order, for each key the number of its row of counts among the 255 most usual rows, these, and all other rows."""
    by = np.argsort(key)
    key, counts = key[by], counts[by]
    n = len(key)
    bits = min(max(n.bit_length() - 4, 1), 16)
    cells = np.arange((1 << bits) + 1)
    starts = np.searchsorted(key >> np.uint64(64 - bits), cells.astype(np.uint64)) - _even(cells, n, bits)
    starts = starts.astype("<i2" if np.abs(starts).max() < 1 << 15 else "<i8")
    rest = key >> np.uint64(24 - bits)
    codes, usual = _coded(counts)
    large = np.flatnonzero(codes == 255)
    rows = np.column_stack([large, counts[large]])
    rows = rows.astype("<u4" if rows.max(initial=0) < 1 << 32 else "<i8")
    parts = [np.array([n, bits, starts.itemsize, len(usual), len(large), rows.itemsize]), starts, (rest >> np.uint64(8)).astype("<u4"), rest.astype(np.uint8), codes, usual, rows]
    raw = [x.tobytes() for x in parts]
    _save(folder, f"{kind}{name}", np.frombuffer(b"".join(x + bytes(-len(x) % 8) for x in raw), np.uint8))


def _coded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number among the most usual rows, 255 for any other, and these rows."""
    width = counts.shape[1]
    if width == 1:
        return np.minimum(counts[:, 0], 255).astype(np.uint8), np.arange(255)[:, None]
    bits = 64 // width
    fits = np.flatnonzero((counts < 1 << bits).all(axis=1))
    packed = np.zeros(len(fits), np.uint64)
    for k in range(width):
        packed |= counts[fits, k].astype(np.uint64) << np.uint64(bits * k)
    _, one, group, times = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
    most = np.argsort(-times, kind="stable")[:255]
    number = np.full(len(one), 255, np.uint8)
    number[most] = np.arange(len(most))
    codes = np.full(len(counts), 255, np.uint8)
    codes[fits] = number[group]
    return codes, counts[fits[one[most]]].astype(np.int64)


class _Bucket:
    """A stored bucket, mapped into memory."""

    def __init__(self, folder: str, kind: str, name: int, width: int) -> None:
        self.raw, self.at = _load(folder, f"{kind}{name}").view(np.ndarray), 0
        self.n, self.bits, item, usual, rows, size = self._next("<i8", 6).tolist()
        self.starts = self._next(f"<i{item}", (1 << self.bits) + 1)
        self.middle, self.last = self._next("<u4", self.n), self._next("u1", self.n)
        self.codes, self.usual = self._next("u1", self.n), np.zeros((256, width), np.int64)
        self.usual[:usual] = self._next("<i8", usual * width).reshape(-1, width)
        self.large = self._next("<u4" if size == 4 else "<i8", rows * (width + 1)).reshape(-1, width + 1)

    def _next(self, kind: str, n: int) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        part = self.raw[self.at : self.at + size].view(kind)
        self.at += size + -size % 8
        return part

    def _rest(self, at: np.ndarray) -> np.ndarray:
        return self.middle[at].astype(np.uint64) << np.uint64(8) | self.last[at]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are here, and where."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cell = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        want = key >> np.uint64(24 - self.bits) & _BITS40
        lo, end = (self.starts[c] + _even(c, self.n, self.bits) for c in (cell, cell + 1))
        hi, last = end, self.n - 1
        while (open_ := lo < hi).any():
            middle = (lo + hi) >> 1
            below = self._rest(np.minimum(middle, last)) < want
            lo, hi = np.where(open_ & below, middle + 1, lo), np.where(open_ & ~below, middle, hi)
        hit = np.flatnonzero((lo < end) & (self._rest(np.minimum(lo, last)) == want))
        return hit, lo[hit]

    def read(self, at: np.ndarray) -> np.ndarray:
        codes = self.codes[at]
        out = self.usual[codes]
        if len(full := np.flatnonzero(codes == 255)):
            out[full] = self.large[np.searchsorted(self.large[:, 0], at[full]), 1:]
        return out


def _counts(folder: str, kind: str, present: np.ndarray, bucket: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Counts of distinct keys; zero for those that are not in the model."""
    out = np.zeros((len(key), width), np.int64)
    order = np.lexsort((key, bucket))
    order = order[present[bucket[order]]]
    if not len(order):
        return out
    bucket, key = bucket[order], key[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        have = _Bucket(folder, kind, int(bucket[lo]), width)
        hit, at = have.find(key[lo:hi])
        out[order[lo + hit]] = have.read(at)
    return out


@dataclass
class Model:
    folder: str
    order: int
    buckets: int
    #: Buckets whose n-grams and whose words' and contexts' sums were written.
    written: np.ndarray
    summed: np.ndarray
    spread: np.ndarray
    tokens: int
    words: int
    bigrams: int
    discounts: np.ndarray
    middle_discounts: np.ndarray
    lower_discounts: np.ndarray
    lower_left: float


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many have count 1 to 4."""
    if not n.all():
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0, [0, 1, 2, 3])


def _kinds(n: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """In each group, how many counts are 1, 2 and more."""
    return [np.add.reduceat(c.astype(np.int64), starts) for c in (n == 1, n == 2, n >= 3)]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts the n-grams of all rows (doc_id, text) and writes the model's arrays."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/model"
    docs = docs.select("doc_id", "text")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = TaskContext.get().partitionId() < NUMBERING_TASKS
        for _, tokens, _, starts in token_runs(batches):
            word, count = np.unique(tokens, return_counts=True)
            most = count >= max(2, len(tokens) // (8 * LEAST_BUCKETS))
            if numbering:
                most[np.argsort(-count, kind="stable")[:NUMBERED]] = True
                numbering = False
            yield pa.RecordBatch.from_arrays([pa.array(np.append(word[most], START).view(np.int64)), pa.array(np.append(count[most], len(starts) - 1)), pa.array(np.append(np.zeros(most.sum(), np.int64), len(tokens)))], names=["word", "count", "tokens"])

    seen = docs.mapInArrow(frequent, "word long, count long, tokens long").groupBy("word").agg(F.sum("count").alias("count"), F.sum("tokens").alias("tokens"))
    seen = seen.orderBy(F.col("word") != int(START), F.desc("count"), "word").limit(NUMBERED).toPandas()  # START has the tokens
    total, often = int(seen["tokens"].sum()), seen["word"].to_numpy(np.int64).view(np.uint64)
    buckets = max(LEAST_BUCKETS, total // BUCKET_TOKENS)
    spread = np.sort(often[seen["count"].to_numpy(np.int64) * 4 * buckets >= total])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _numbers(often)
        for _, word, before, texts in token_runs(batches):
            first = earlier(before, texts, order)
            by, starts = _grouped(first, word, before)
            n = np.diff(np.append(starts, len(by)))
            by = by[starts]
            first, word, before = first[by], word[by], before[by]
            bucket = bigram_bucket(before, word, spread, buckets)
            by = np.argsort(bucket, kind="stable")
            first, word, before, n = first[by], word[by], before[by], n[by]
            names, at = np.unique(bucket[by], return_index=True)
            edges = np.append(at, len(by))
            blobs: list[bytes] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                v, w = before[lo:hi], word[lo:hi]
                pairs = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
                runs = np.flatnonzero(np.append(True, v[pairs][1:] != v[pairs][:-1]))
                words = [v[pairs[runs]], w[pairs], first[lo:hi] if order == 3 else first[:0]]
                counts = [np.diff(np.append(runs, len(pairs))), np.diff(np.append(pairs, hi - lo)), n[lo:hi]]
                blobs.append(_pack_ngrams(words, counts, number))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["bucket", "ngrams"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about: list[np.ndarray] = []
        contexts: list[np.ndarray] = []
        held = 0
        for b in batches:
            for k in range(b.num_rows):
                name = int(b.column("bucket")[k].as_py())
                first, before, word, n = (np.concatenate(c) for c in zip(*[_ngrams_of(p, often) for p in b.column("parts")[k].as_py()], strict=True))
                by, starts = _grouped(first, word, before)
                n = np.add.reduceat(n[by], starts)
                by = by[starts]
                first, word, before = first[by], word[by], before[by]
                _save_counts(folder, "t", name, trigram_key(first, before, word), n[:, None])
                # the words before each bigram, and what these say of its two words
                pairs = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])))
                kinds, raw = np.diff(np.append(pairs, len(n))), np.add.reduceat(n, pairs)
                v, w = before[pairs], word[pairs]
                if order == 3:
                    _save_counts(folder, "b", name, bigram_key(v, w), kinds[:, None])
                by, starts = _grouped(w)
                about.append(_facts(w[by[starts]], (np.add.reduceat(raw[by], starts), np.diff(np.append(starts, len(by))))))
                starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                none = np.zeros(len(starts), np.int64)
                about.append(_facts(v[starts], (none, none, *_kinds(kinds, starts), np.add.reduceat(kinds, starts))))
                # contexts of the n-grams: whole here unless their second word is spread
                key = bigram_key(first, before)
                by = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
                found = _facts(key[by[starts]], (np.add.reduceat(n[by], starts), *_kinds(n[by], starts)))
                partial = _is_spread(before[by[starts]], spread)
                _save_counts(folder, "c", name, found["word"][~partial], found["f"][~partial, :4])
                contexts.append(found[partial])
                yield pa.RecordBatch.from_arrays([pa.array([-1 - name]), pa.array([np.array([(x == c).sum() for x in (n, kinds) for c in (1, 2, 3, 4)], "<i8").tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["bucket", "facts", "contexts"])
                if len(about) >= HELD_PARTS:
                    about = [_summed(about)]
                held += len(word)
                if held >= 2 * STEP_TOKENS:
                    yield _dealt(about, contexts, buckets)
                    about, contexts, held = [], [], 0
        if about:
            yield _dealt(about, contexts, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, parts = int(b.column("bucket")[k].as_py()), b.column("parts")[k].as_py()
                if name < 0:
                    row = [*np.frombuffer(parts[0]["facts"], "<i8").tolist(), *[0] * 8]
                else:
                    found = _summed([_contexts_of(p["contexts"]) for p in parts])
                    _save_counts(folder, "p", name, found["word"], found["f"][:, :4])
                    facts = _summed([_facts_of(p["facts"]) for p in parts])
                    _save_counts(folder, "w", name, _word_key(facts["word"]), facts["f"])
                    real = facts[facts["f"][:, 0] > 0]
                    cont = real["f"][:, 1]
                    row = [*[0] * 8, int(real["f"][:, 0].sum()), len(real), int(cont.sum()), *[int((cont == c).sum()) for c in (1, 2, 3, 4)], int((cont >= 3).sum())]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([row], pa.list_(pa.int64()))], names=["bucket", "sums"])

    packed = docs.mapInArrow(count, "bucket long, ngrams binary")
    merged = packed.groupBy("bucket").agg(F.collect_list("ngrams").alias("parts")).mapInArrow(merge, "bucket long, facts binary, contexts binary")
    done = merged.groupBy("bucket").agg(F.collect_list(F.struct("facts", "contexts")).alias("parts")).mapInArrow(finish, "bucket long, sums array<long>")
    rows = done.collect()  # two a bucket
    sums = np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(16, np.int64)
    written, summed = np.zeros(buckets, bool), np.zeros(buckets, bool)
    written[[-1 - r["bucket"] for r in rows if r["bucket"] < 0]] = True
    summed[[r["bucket"] for r in rows if r["bucket"] >= 0]] = True
    tokens, words, bigrams = int(sums[8]), int(sums[9]), int(sums[10])
    lower = _discounts(sums[11:15])
    left = float(lower[1] * sums[11] + lower[2] * sums[12] + lower[3] * sums[15])
    return Model(folder, order, buckets, written, summed, spread, tokens, words, bigrams, _discounts(sums[:4]), _discounts(sums[4:8]), lower, left)


def _numbers(often: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives words their numbers; of words that share a place the more frequent has one."""
    place = lambda x: (x & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    at = place(often)[::-1]
    words, numbers = np.zeros(1 << PLACE_BITS, np.uint64), np.full(1 << PLACE_BITS, NUMBERED, "<u2")
    words[at], numbers[at] = often[::-1], np.arange(len(often))[::-1]

    def number(x: np.ndarray) -> np.ndarray:
        at = place(x)
        return np.where(words[at] == x, numbers[at], np.uint16(NUMBERED))

    return number


def _framed(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _unframed(blob: bytes) -> list[bytes]:
    sizes = np.frombuffer(blob, "<u4", int(np.frombuffer(blob, "<u4", 1)[0]), 4).tolist()
    at = np.cumsum([4 + 4 * len(sizes), *sizes]).tolist()
    return [blob[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _squeezed(b: bytes) -> bytes:
    """Compressed, or as it is where that is shorter, behind its length."""
    small = pa.compress(b, codec="zstd", asbytes=True) if b else b
    return len(b).to_bytes(4, "little") + (small if len(small) < len(b) else b)


def _whole(b: bytes) -> bytes:
    n = int.from_bytes(b[:4], "little")
    return b[4:] if len(b) - 4 == n else pa.decompress(b[4:], decompressed_size=n, codec="zstd", asbytes=True)


def _pack_ngrams(words: list[np.ndarray], counts: list[np.ndarray], number: Callable[[np.ndarray], np.ndarray]) -> bytes:
    """What a task sends of a bucket: words before the last, last words of their bigrams and first words of n-grams; how many bigrams begin with each of the first, how many n-grams end with each bigram, and counts."""
    numbers = [number(w) for w in words]
    low, high = ([(x >> shift).astype(np.uint8).tobytes() for x in numbers] for shift in (np.uint16(0), np.uint16(8)))
    rest = [_pack48(w[x == NUMBERED]) for w, x in zip(words, numbers, strict=True)]
    return _framed([*low, *rest, _squeezed(b"".join(high)), *[_squeezed(_pack_counts(c)) for c in counts]])


def _ngrams_of(blob: bytes, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, words before the last, last words and counts."""
    parts = _unframed(blob)
    high, at, words = np.frombuffer(_whole(parts[6]), np.uint8), 0, []
    for low, rest in zip(parts[:3], parts[3:6], strict=True):
        low = np.frombuffer(low, np.uint8)
        number = high[at : at + len(low)].astype(np.int64) << 8 | low
        at += len(low)
        word = often[np.minimum(number, len(often) - 1)]
        word[number == NUMBERED] = _unpack48(rest)
        words.append(word)
    before, word, first = words
    runs, ends = _unpack_counts(_whole(parts[7]), len(before)), _unpack_counts(_whole(parts[8]), len(word))
    n = _unpack_counts(_whole(parts[9]), int(ends.sum()))
    return first if len(first) else np.zeros(len(n), np.uint64), np.repeat(np.repeat(before, runs), ends), np.repeat(word, ends), n


_FACT = np.dtype([("word", "<u8"), ("f", "<i8", (6,))])


def _facts(word: np.ndarray, columns) -> np.ndarray:  # noqa: ANN001
    out = np.zeros(len(word), _FACT)
    out["word"] = word
    for k, c in enumerate(columns):
        out["f"][:, k] = c
    return out


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts)
    if not len(x):
        return x
    order, starts = _grouped(x["word"])
    return _facts(x["word"][order[starts]], np.add.reduceat(x["f"][order], starts, axis=0).T)


def _packed(x: np.ndarray, bucket: np.ndarray, buckets: int, columns: int, wide: bool) -> list[bytes]:
    """The rows of each bucket as bytes; their names in 48 bits, or in 64 where ``wide``."""
    by = np.argsort(bucket, kind="stable")
    out = []
    for part in np.split(x[by], np.searchsorted(bucket[by], np.arange(1, buckets))):
        packed = _framed([_pack_counts(part["f"][:, k]) for k in range(columns)])
        out.append(_framed([part["word"].tobytes() if wide else _pack48(part["word"]), _squeezed(packed)]) if len(part) else b"")
    return out


def _unpacked(blob: bytes, wide: bool) -> np.ndarray:
    if not blob:
        return np.zeros(0, _FACT)
    names, packed = _unframed(blob)
    word = np.frombuffer(names, "<u8") if wide else _unpack48(names)
    return _facts(word, [_unpack_counts(c, len(word)) for c in _unframed(_whole(packed))])


def _dealt(about: list[np.ndarray], contexts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    x, y = _summed(about), _summed(contexts)
    facts = _packed(x, word_bucket(x["word"], buckets), buckets, 6, False)
    found = _packed(y, (y["word"] % np.uint64(buckets)).astype(np.int64), buckets, 4, True)
    names = [k for k in range(buckets) if facts[k] or found[k]]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([facts[k] for k in names], pa.binary()), pa.array([found[k] for k in names], pa.binary())], names=["bucket", "facts", "contexts"])


def _facts_of(blob: bytes) -> np.ndarray:
    return _unpacked(blob, False)


def _contexts_of(blob: bytes) -> np.ndarray:
    return _unpacked(blob, True)


def _word_key(words: np.ndarray) -> np.ndarray:
    return words << np.uint64(16)


def _word_facts(model: Model, words: np.ndarray) -> np.ndarray:
    """count, words before, followers after one, two, more others, and all such pairs; of distinct words."""
    return _counts(model.folder, "w", model.summed, word_bucket(words, model.buckets), _word_key(words), 6)


def _context_facts(model: Model, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """count, followers once, twice, more often; of distinct contexts."""
    key, wide = bigram_key(first, before), _is_spread(before, model.spread)
    out = np.zeros((len(key), 4), np.int64)
    out[~wide] = _counts(model.folder, "c", model.written, word_bucket(before[~wide], model.buckets), key[~wide], 4)
    out[wide] = _counts(model.folder, "p", model.summed, (key[wide] % np.uint64(model.buckets)).astype(np.int64), key[wide], 4)
    return out


def log_probabilities(model: Model, word: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p(word | first, before) of every token of some whole texts, and the words' training counts."""
    # words before are the words one place on, or START
    names, w = np.unique(np.append(word, START), return_inverse=True)
    v = np.append(w[-1:], w[:-2])
    v[before == START] = w[-1]
    w = w[:-1]
    facts = _word_facts(model, names)
    low = model.lower_discounts
    cont = facts[:, 1]
    base = np.full(len(names), 1.0)
    if model.bigrams:
        base = np.where(cont > 0, cont - low[np.minimum(cont, 3)], 0) / model.bigrams + model.lower_left / model.bigrams / (model.words + 1)

    def level(n: np.ndarray, total: np.ndarray, left: np.ndarray, d: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.where(total > 0, (np.maximum(n - d[np.minimum(n, 3)], 0) + left * below) / np.maximum(total, 1), below)

    key, one, group = np.unique(trigram_key(first, before, word), return_index=True, return_inverse=True)
    u, b, x = first[one], before[one], word[one]
    p, bucket = base[w[one]], bigram_bucket(b, x, model.spread, model.buckets)
    if model.order == 3:
        pair, where, back = np.unique(bigram_key(b, x), return_index=True, return_inverse=True)
        n = _counts(model.folder, "b", model.written, bucket[where], pair, 1)[:, 0]
        left = facts[:, 2:5] @ model.middle_discounts[1:]
        p = level(n[back], facts[v[one], 5], left[v[one]], model.middle_discounts, p)
        del pair, where, back, left
    _, where, back = np.unique(bigram_key(u, b), return_index=True, return_inverse=True)
    context = _context_facts(model, u[where], b[where])
    total, left = context[:, 0][back], (context[:, 1:] @ model.discounts[1:])[back]
    n = _counts(model.folder, "t", model.written, bucket, key, 1)[:, 0]
    return np.log10(level(n, total, left, model.discounts, p))[group], facts[w, 0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row; perplexity is 10 ** (-score / n_tokens)."""
    kind = dict(docs.dtypes)["doc_id"]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    scale = np.log10(model.tokens + model.words + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, word, before, starts in token_runs(batches, SCORED_TOKENS):
            logs, count = log_probabilities(model, word, before, earlier(before, starts, model.order))
            first = starts[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kinds[kind]),
                    pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(np.log10(count + 1.0) - scale, first)),
                    pa.array(np.add.reduceat(logs, first)),
                ],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Trains on the rows outside the held-out fold and scores all."""
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(small_batches(docs).where(~held), order)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
