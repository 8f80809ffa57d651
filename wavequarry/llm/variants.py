"""Spelling variants: each word's Levenshtein automaton of distance one, run depth-first over broadcast compact trie shards.

The vocabulary is cut by ranges of words into shards of a bounded number of words. Each becomes a trie in level order: one label
byte a node and the place of its first child. Shards are sent to the tasks in groups of bounded bytes, one job a group, and every word
meets every shard; a shard whose top no automaton survives costs a few steps. Accepted neighbours are counted, and the best kept, by
an aggregation of all groups.

Defined results: null and empty texts have no words; a null doc_id counts as an empty text where it is hashed; repeated rows count as often
as they stand; an empty table gives no rows; other columns are ignored; a form has at least twice its word's occurrences, so chains end.
Words have no longest length: the automaton is as long as its word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import join_hot
from .scratch import shared_folder, stored

#: Letters of a word; all are below U+0100, so that a label is a byte.
RUN = "[A-Za-zÀ-ÿ]"
#: Fewest code points and occurrences of a word, and the occurrences of a form for each of its word's.
LEAST_LENGTH, LEAST_TIMES, FORM_TIMES = 5, 3, 2
#: One in so many runs loses a letter.
EDITED = 97
#: Words of a shard (its trie has some 10 bytes a node), bytes of the shards sent at a time, words of a task.
SHARD_WORDS, GROUP_BYTES, TASK_WORDS = 50_000, 32 << 20, 4_000


def occurrences(docs: DataFrame) -> DataFrame:
    """word, once for each run of letters that may become a word; some runs lose a letter, as the hash of document and run has it."""
    upper = "".join(map(chr, range(65, 91)))
    runs = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), F.lit(1)))
    x = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run")).withColumn("run", F.translate("run", upper, upper.lower()))
    x = x.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word: Column = F.when(F.col("h") % EDITED == 0, shorter).otherwise(F.col("run"))
    return x.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words that occur often enough."""
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


class Trie:
    """Nodes in level order: labels, first children (children of a node stand together) and n of the word that ends there, or 0."""

    def __init__(self, labels: bytes, first: array, n: array):
        self.labels, self.first, self.n = labels, first, n

    @classmethod
    def of(cls, words: list[bytes], n: list[int]) -> Trie:
        """From sorted distinct words."""
        labels, first, ends = bytearray(1), array("i"), array("q")
        level = [(0, len(words), 0)]
        while level:
            below = []
            for low, high, depth in level:
                ends.append(n[low] if low < high and len(words[low]) == depth else 0)
                low += ends[-1] > 0
                first.append(len(labels))
                while low < high:
                    label, end = words[low][depth], low + 1
                    while end < high and words[end][depth] == label:
                        end += 1
                    labels.append(label)
                    below.append((low, end, depth + 1))
                    low = end
            level = below
        first.append(len(labels))
        return cls(bytes(labels), first, ends)

    def pack(self) -> bytes:
        return b"".join([len(self.n).to_bytes(8, "little"), self.labels, self.first.tobytes(), self.n.tobytes()])

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        size = int.from_bytes(blob[:8], "little")
        at = 8 + size
        end = at + 4 * (size + 1)
        return cls(blob[8:at], array("i", blob[at:end]), array("q", blob[end : end + 8 * size]))

    def near(self, word: bytes) -> Iterator[tuple[bytes, int]]:
        """Words exactly one edit away, with their n, depth-first.

        A state of the automaton is a position of the word and whether its edit is spent. With the edit left only the node that
        spells the word so far is reached; from there each edit opens a branch, and a spent branch has one way on. Of equal
        results of an edit in a run of one letter the last is taken, so that each word comes once.
        """
        labels, first, n, size, node = self.labels, self.first, self.n, len(word), 0
        find = labels.find
        for k in range(size + 1):
            low, high = first[node], first[node + 1]
            own = word[k] if k < size else -1
            branches = [(node, k + 1, b"")] if k < size and word[k + 1 : k + 2] != word[k : k + 1] else []  # without letter k
            after = word[k + 1] if k + 1 < size else -1
            for child in range(low, high):
                if labels[child] == own:
                    continue
                start, end = first[child], first[child + 1]
                # another letter in place of letter k, and one in front of it; looked one letter ahead
                if own >= 0 and (n[child] if after < 0 else find(after, start, end) >= 0):
                    branches.append((child, k + 1, labels[child : child + 1]))
                if n[child] if own < 0 else find(own, start, end) >= 0:
                    branches.append((child, k, labels[child : child + 1]))
            for at, position, other in branches:
                for letter in word[position:]:
                    at = find(letter, first[at], first[at + 1])
                    if at < 0:
                        break
                if at >= 0 and n[at]:
                    yield word[:k] + other + word[position:], n[at]
            node = find(own, low, high) if own >= 0 else -1
            if node < 0:
                return

def shards(words: DataFrame, count: int, folder: str) -> DataFrame:
    """Stored tries (size, trie) of ranges of the words, SHARD_WORDS in each at most."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        n: list[int] = []

        def trie() -> pa.RecordBatch:
            packed = Trie.of(words, n).pack()
            return pa.RecordBatch.from_arrays([pa.array([len(packed)], pa.int64()), pa.array([packed], pa.binary())], names=["size", "trie"])

        for b in batches:
            for word, times in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                words.append(word.encode("latin-1"))
                n.append(times)
                if len(words) == SHARD_WORDS:
                    yield trie()
                    words, n = [], []
        if words:
            yield trie()

    parts = max(1, -(-count // SHARD_WORDS))
    return stored(words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(build, "size long, trie binary"), folder, "tries")


def neighbours(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """word, near, near_n for every neighbour of the words in the given shards."""
    sent = words.sparkSession.sparkContext.broadcast(tries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [Trie.unpack(t) for t in sent.value]
        for b in batches:
            found = [(w, near.decode("latin-1"), n) for w in b.column("word").to_pylist() for t in opened for near, n in t.near(w.encode("latin-1"))]
            own, near, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    return words.select("word").mapInArrow(work, "word string, near string, near_n long")


def groups(sizes: list[int], most: int) -> list[list[int]]:
    """Places of shards, in groups of ``most`` bytes; a larger shard is a group of its own."""
    out: list[list[int]] = []
    held = most + 1
    for k, size in enumerate(sizes):
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append(k)
        held += size
    return out


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root: the last word reached along the forms (word, form), by lookups that double their reach each round."""
    current = stored(forms.select("word", F.coalesce("form", "word").alias("root")), folder, "roots0")
    turn = 0
    while True:
        turn += 1
        onward = current.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(join_hot(current.where("word <> root"), onward, "root", "left").select("word", "root", "further"), folder, f"step{turn}")
        if step.where("further is not null").isEmpty():
            return current
        current = stored(current.where("word = root").unionByName(step.select("word", F.coalesce("further", "root").alias("root"))), folder, f"roots{turn}")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents (doc_id, text)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    words = stored(vocabulary(docs), folder, "words")
    count = words.count()
    tries = shards(words, count, folder).withColumn("key", F.xxhash64("trie"))
    known = [(r["key"], r["size"]) for r in tries.select("key", "size").orderBy("size", "key").collect()]  # 16 bytes a shard
    dealt = words.repartition(max(spark.sparkContext.defaultParallelism, -(-count // TASK_WORDS)))
    near = None
    for k, group in enumerate(groups([size for _, size in known], GROUP_BYTES)):
        blobs = [r["trie"] for r in tries.where(F.col("key").isin([known[i][0] for i in group])).select("trie").collect()]
        part = stored(neighbours(dealt, [bytes(b) for b in blobs]), folder, f"near{k}")
        near = part if near is None else near.unionByName(part)
    if near is None:
        near = words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    twice = -F.col("best.less") >= FORM_TIMES * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(twice, F.col("best.near")).alias("form"), F.when(twice, -F.col("best.less")).cast("long").alias("form_n")
    )
    forms = stored(forms, folder, "forms")
    return forms.join(roots(forms, folder), "word").select("word", "form", "root", "n", "n_near", "form_n")
