"""The ten corpus operators against brute force, libraries and awkward tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavequarry.llm import bpe, embeddings, fingerprints, graph, jaccard, lm, mixing, quality, scratch, sharding, textkernel, toxicity

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, bucket int, key string, n int, row int, size string, score string, label string, token string, _copy int, cells string"
EXTRA = ("h", 1, "k", 2, 3, "s", "x", "y", "t", 4, "c")
PHRASE = "one common phrase that many of these documents share with each other word for word"
AWKWARD = [
    (1, None, None, None, None, *EXTRA),
    (2, "", "en", "a", 0, *EXTRA),
    (3, "  \t\n ", "en", "a", 5, *EXTRA),
    (4, "One", "en", None, 3, *EXTRA),
    (5, "one", "en", None, 3, *EXTRA),
    (6, "two words", None, "b", 9, *EXTRA),
    (6, "two words", None, "b", 9, *EXTRA),
    (7, PHRASE, "en", "b", None, *EXTRA),
    (8, PHRASE.upper(), "en", "b", None, *EXTRA),
    (9, PHRASE + " <|endoftext|> naïve 字 🎉 don't", "en", "b", None, *EXTRA),
    (10, " ".join(f"w{k % 5003}" for k in range(120_000)), "en", "c", None, *EXTRA),
    (11, "x" * 300_000, "en", "c", None, *EXTRA),
    (None, "a row without a number", "en", "c", None, *EXTRA),
]
LABELS = [(k, k % 2, (k + 1) % 2) for k in range(1, 12)] + [(None, 1, 1), (3, None, None), (6, 0, 1)]
ON_DOCUMENTS = {
    "fingerprints": fingerprints.compare_edits,
    "bpe": lambda d: bpe.encode_digests(d, VOCABULARY),
    "jaccard": jaccard.join_components,
    "tokens": lambda d: bpe.count_tokens(d, VOCABULARY),
    "sharding": sharding.shard_rows,
    "lm": lm.score_documents,
    "mixing": mixing.mix_sources,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    frame = docs.toPandas()
    return dict(zip(frame.doc_id, frame.text.where(frame.text.notna(), "")))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


def by_id(df, name="doc_id"):
    return df.toPandas().set_index(name)


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def jaccard_roots(texts):
    sets, index, links = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), []
    for i, s in sets.items():
        shared = Counter(j for t in s for j in index[t])
        links += [(i, j) for j, c in shared.items() if 100 * c >= 90 * (len(s) + len(sets[j]) - c)]
        for t in s:
            index[t].append(i)
    return sets, roots(sets, links)


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_awkward_and_empty_tables(awkward, name):
    got = ON_DOCUMENTS[name](awkward).toPandas()
    assert len(got) == len(AWKWARD)
    assert Counter(got.doc_id.dropna().astype(int)) == Counter(r[0] for r in AWKWARD if r[0] is not None)
    assert ON_DOCUMENTS[name](awkward.where("false")).count() == 0


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_on_awkward_tables(spark, awkward, kind):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    for docs, marked, rows in ((awkward, labels, len(AWKWARD)), (awkward, labels.where("false"), len(AWKWARD)), (awkward.where("false"), labels, 0)):
        got = kind.classify(docs, marked).toPandas()
        assert len(got) == rows
        assert got.score.between(0, 1).all()


def test_fingerprints_of_edited_texts(docs, texts):
    got, ids = by_id(fingerprints.compare_edits(docs)), sorted(texts)
    for k, i in enumerate(ids):
        cut = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - cut] + texts[ids[(k + 1) % len(ids)]][:cut]
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.n_chars[i] == len(texts[i])
    named = defaultdict(set)
    for i in ids:
        named[texts[i]].add(got.fingerprint[i])
    assert all(len(v) == 1 for v in named.values())
    assert got[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert got.near_edited.median() > got.near_next.quantile(0.95)


def test_fingerprints_across_the_switch_of_windows(spark):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 2500").orderBy("doc_id").limit(60)
    rank = fingerprints.rarity(whole)
    texts = [r.text[k : k + n] for r in whole.collect() for k in (0, 900) for n in (400, 600, 800, 1000, 1300)]
    edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(texts, texts[7:] + texts[:7])]
    own, changed = (fingerprints.digests([t.encode() for t in some], rank) for some in (texts, edited))
    across = [k for k, (a, b) in enumerate(zip(own, changed)) if (a[0][1].sum() < 8) != (b[0][1].sum() < 8)]
    assert len(across) >= 10
    assert all(fingerprints.likeness(own[k], changed[k]) > 0.35 for k in across)
    assert np.median([fingerprints.likeness(own[k], changed[(k + 25) % len(texts)]) for k in across]) < 0.1
    # a plain text of few features against one of many windows: only picked windows are in both
    rng = np.random.default_rng(2)
    plain = bytes(rng.choice([97, 98], 6000, p=[0.95, 0.05]).astype(np.uint8))
    rich = plain[:4500] + bytes(rng.integers(97, 123, 1500).astype(np.uint8))
    a, b = fingerprints.digests([plain, rich], rank)
    assert a[0][1].sum() < 8 <= b[0][1].sum() and b[1] is None and fingerprints.likeness(a, b) > 0.4


def library_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_encoding_and_counts_equal_the_library(spark, docs, texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    hard = ["<|startoftext|>", "a<|endoftext|>b", "<|endoftext", "DON'T we'LL 's", "ǅ İ ß ﬀ é é", "​  x", "1234 a1b2", "🎉🎉 👩‍👩‍👧", "\x00\x01", "a" * 5000, "</w>", "한국어 日本語 ไทย"]
    own = spark.createDataFrame([(10_000_000 + k, t) for k, t in enumerate(hard)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(own)
    all_texts = texts | {10_000_000 + k: t for k, t in enumerate(hard)}
    encoded, counted = by_id(bpe.encode_digests(both, VOCABULARY)), by_id(bpe.count_tokens(both, VOCABULARY))
    for i, t in all_texts.items():
        ids = library_ids(tokenizer, t)
        assert encoded.n_tokens[i] == counted.n_tokens[i] == len(ids), t[:50]
        assert encoded.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t[:50]
        assert encoded.decoded_sha256[i] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(), t[:50]
        assert counted.n_bytes[i] == len(t.encode()) and counted.over_limit[i] == (len(ids) > 2048)


def test_jaccard_equals_brute_force(docs, texts):
    sets, want = jaccard_roots(texts)
    got = by_id(jaccard.join_components(docs))
    assert {i: int(got.component_id[i]) for i in texts} == want
    assert {i: int(got.n_shingles[i]) for i in texts} == {i: len(s) for i, s in sets.items()}


def test_jaccard_at_the_threshold_and_in_large_groups(spark):
    random = np.random.default_rng(3)
    base = [f"b{k}" for k in range(200)]
    texts = {}
    for k in range(300):  # one group of near copies about the threshold
        w = list(base)
        for at in random.integers(0, 200, random.integers(0, 6)):
            w[at] = f"e{random.integers(0, 40)}"
        texts[k] = " ".join(w)
    for k in range(300, 500):  # one passage that many share
        texts[k] = " ".join(base[:60] + [f"r{x}" for x in random.integers(0, 10_000, random.integers(1, 40))])
    for k in range(500, 560):
        texts[k] = " ".join(f"s{x}" for x in random.integers(0, 3, random.integers(0, 6)))
    sets, want = jaccard_roots(texts)
    got = by_id(jaccard.join_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: int(got.component_id[i]) for i in texts} == want


def test_jaccard_with_lists_families_and_blocks_in_many_parts(spark, monkeypatch):
    for where, name, value in ((jaccard, "LIST_PART", 40), (jaccard, "BLOCK", 16), (jaccard, "MEETING", 20), (jaccard, "BLOCK_TOKENS", 3000), (graph, "HOT_ROWS", 5), (jaccard, "REMEMBERED", 7)):
        monkeypatch.setattr(where, name, value)
    random = np.random.default_rng(8)
    base, texts = [f"b{k}" for k in range(150)], {}
    for k in range(400):
        w = list(base) if k % 4 else [*base[:110], *(f"o{x}" for x in range(40))]
        for at in random.integers(0, 150, random.integers(0, 7)):
            w[at] = f"e{random.integers(0, 30)}"
        texts[k] = " ".join(w)
    for k in range(400, 500):
        texts[k] = texts[int(random.integers(0, 400))]
    _, want = jaccard_roots(texts)
    assert len(set(want.values())) > 20
    got = by_id(jaccard.join_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)))
    assert {i: int(got.component_id[i]) for i in texts} == want


@pytest.mark.parametrize("tasks", [2, 40])
def test_jaccard_finds_hot_lists_whatever_the_tasks(spark, tmp_path, monkeypatch, tasks):
    monkeypatch.setattr(jaccard, "LIST_PART", 1000)  # above what a byte counts
    texts = [(k, f"one two three a{k} b{k} c{k}") for k in range(3000)] + [(k, f"x{k} y{k} z{k}") for k in range(3000, 3300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(tasks)
    folder, bits, block = scratch.shared_folder(spark), 16, 1 << 14
    described = scratch.stored(jaccard._described(docs, 3, bits, block), folder, "described")
    common, hot, parts = jaccard._common(described, folder, bits, block, 12_300)
    counts = np.zeros(1 << bits, np.int64)
    for tokens in jaccard.shingle_sets(pa.array([t for _, t in texts]), 3):
        counts[np.unique(tokens >> np.uint64(64 - bits)).astype(int)] += 1
    assert counts.max() >= 3000
    assert hot.tolist() == np.flatnonzero(counts >= 1000).tolist()
    assert parts.tolist() == [-(-n // 1000) for n in counts[hot].tolist()]
    assert np.flatnonzero(np.unpackbits(common)).tolist() == np.flatnonzero(counts >= 64).tolist()
    lists = jaccard._lists(docs, 3, 20, common, hot, parts, bits, 64)
    dealt = lists.where("dealt").groupBy("token").agg(F.countDistinct("lead").alias("parts"), F.count("*").alias("sets")).collect()
    assert {(r.parts, r.sets) for r in dealt} <= {(int(parts.max()), 3000), (1, 1)}


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    random = np.random.default_rng(4)
    links = [(0, k) for k in range(1, 60)] + [(1000 + k, 1001 + k) for k in range(40)] + [(500, k) for k in range(40, 100)] + random.integers(2000, 2300, (120, 2)).tolist()
    got = graph.components(spark.createDataFrame(links, "a long, b long"), scratch.shared_folder(spark)).toPandas()
    want = roots({i for link in links for i in link}, links)
    assert dict(zip(got.node, got.root)) == {i: r for i, r in want.items() if any(i in link and link[0] != link[1] for link in links)}


def test_cover_trees_find_all_pairs(spark):
    random = np.random.default_rng(5)
    centre = random.normal(size=(40, 16))
    rows = [c + random.normal(size=16) * s for c in centre for s in (0.0, 0.1, 0.2, 0.25, 0.3, 0.4)] + list(random.normal(size=(60, 16)))
    rows = [list(map(float, r)) for r in rows] + [list(map(float, rows[0]))] * 3 + [list(map(float, rows[1] * 7))]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    got = by_id(embeddings.near_duplicates(spark.createDataFrame(list(enumerate(rows + odd)), "vec_id long, embedding array<double>")), "vec_id")
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(len(rows) + len(odd)), np.argwhere(near).tolist())
    assert near.sum() > 100
    assert got.n_links.to_dict() == dict(enumerate([*near.sum(axis=1), *[0] * len(odd)]))
    assert got.component_id.to_dict() == want
    assert all(got.kept == (got.index == got.component_id))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_in_many_blocks_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 24)
    monkeypatch.setattr(embeddings, "SHELLS", 4)
    random = np.random.default_rng(9)
    centre = random.normal(size=(12, 8))
    rows = [(k, [float(v) for v in centre[k % 12] + random.normal(size=8) * random.choice([0.05, 0.2, 0.4])]) for k in range(400)]
    rows += [(k, [float(v) for v in random.normal(size=5)]) for k in range(400, 420)] + [(7, rows[3][1]), (None, rows[5][1]), (421, None), (None, [0.0, 0.0])]
    docs = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, links long, class string, home int").repartition(5)
    got = embeddings.near_duplicates(docs).toPandas()
    near = lambda x, y: x and y and len(x) == len(y) and any(x) and any(y) and float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) >= 0.95
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and near(rows[a][1], rows[b][1])]
    root, count = roots(range(len(rows)), links), Counter(a for a, _ in links)
    name = {r: min((rows[k][0] for k in root if root[k] == r and rows[k][0] is not None), default=None) for r in set(root.values())}
    want = sorted((rows[k][0] if rows[k][0] is not None else -1, count[k], name[root[k]] if name[root[k]] is not None else -1) for k in root)
    assert sorted(zip(got.vec_id.fillna(-1).astype(int), got.n_links, got.component_id.fillna(-1).astype(int))) == want


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 40, 1000, 4097):
        assert sorted(sharding.permute(np.arange(n), n, 17)) == list(range(n))


def test_shards_are_even_and_slots_gapless(docs, texts):
    got = sharding.shard_rows(docs).toPandas()
    assert all(s == len(texts[i].encode()) + 16 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = sharding.shard_rows(docs.repartition(5)).toPandas()
    assert got.set_index("doc_id").slot.sort_index().equals(again.set_index("doc_id").slot.sort_index())


def test_lm_counts_base_and_distribution(docs, texts):
    got = by_id(lm.score_documents(docs))
    tokens = {i: [*words_of(t), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        assert got.held_out[i] == held[i] and got.n_tokens[i] == len(t) and got.train_tokens[i] == total
        assert got.n_known[i] == sum(w in counts for w in t)
        assert math.isclose(got.base_score[i], sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t), rel_tol=1e-9)
    assert (got.score < 0).all()
    unseen = got[got.held_out]
    assert unseen.score.sum() > unseen.base_score.sum()


def kneser_ney(texts, order):
    """A function of a text's tokens: log10 of its probability, from plain dictionaries."""
    grams = Counter()
    for t in texts:
        padded = ["<s>"] * (order - 1) + t
        grams.update(tuple(padded[k : k + order]) for k in range(len(t)))
    levels = [grams]
    while len(next(iter(levels[0]))) > 1:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts, contexts = [], []
    for counts in levels:
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        discounts.append([0, *[min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3)]] if all(n) else [0, 0.5, 0.75, 0.9])
        about = defaultdict(lambda: [0, 0.0])
        for g, c in counts.items():
            about[g[:-1]][0] += c
            about[g[:-1]][1] += discounts[-1][min(c, 3)]
        contexts.append(about)

    def probability(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        counts, d, (total, left) = levels[len(gram) - 1], discounts[len(gram) - 1], contexts[len(gram) - 1].get(gram[:-1], (0, 0))
        below = probability(gram[1:])
        return (max(counts.get(gram, 0) - d[min(counts.get(gram, 0), 3)], 0) + left * below) / total if total else below

    def score(t):
        padded = ["<s>"] * (order - 1) + t
        return sum(math.log10(probability(tuple(padded[k : k + order]))) for k in range(len(t)))

    return score


@pytest.mark.parametrize("order", [3, 2])
def test_lm_equals_kneser_ney_by_brute_force(docs, texts, order):
    got = by_id(lm.score_documents(docs, order) if order != 3 else lm.score_documents(docs))
    tokens = {i: [*words_of(t), "\n"] for i, t in texts.items()}
    score = kneser_ney([t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2], order)
    for i, t in tokens.items():
        assert math.isclose(got.score[i], score(t), rel_tol=1e-9), i


def test_lm_read_errors_fail(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"a b c w{k} w{k % 7} d") for k in range(50)], "doc_id long, text string")
    model = lm.train(docs)
    bucket = int(np.flatnonzero(model.written)[0])
    os.remove(f"{model.folder.removeprefix('file:').replace('//', '/')}/t{bucket}.npy")
    with pytest.raises(Exception, match="No such file"):
        lm.score(docs, model).collect()


def test_jaccard_lists_move_once_for_their_families(spark, tmp_path):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(t, k, 20 + k % 3, p, 1) for t in range(6) for p, k in enumerate(range(t, t + 8))]
        lists = spark.createDataFrame(rows, "token long, key long, n int, pos int, lead long")
        families = spark.createDataFrame([(2, 1), (1, 1)], "node long, root long")
        found = jaccard._across(lists, families, str(tmp_path), 50)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["a"], r["b"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # four sides of joins among blocks, of which three are one, two sides of both joins with the lists, and the candidates
    assert plan.count("Exchange hashpartitioning") <= 9 and "Generate" not in plan
    shared = Counter((a, b) for t in range(6) for a in range(t, t + 8) for b in range(a + 1, t + 8))
    own = lambda n, m: -(-50 * max(n, m) // 100)
    assert got and got == {(a, b) for (a, b), c in shared.items() if {a, b} != {1, 2} and c > -(-50 * (40 + a % 3 + b % 3) // 150) - own(20 + a % 3, 20 + b % 3)}


def test_lm_stored_buckets(tmp_path):
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000, 70_000):
        key = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        if n == 5000:
            key = np.unique(np.concatenate([key >> np.uint64(30), key]))  # one cell holds half of the keys
        counts = rng.geometric(0.02, (len(key), 3))
        mixed = rng.permutation(len(key))
        lm._save_counts(str(tmp_path), "x", n, key[mixed], counts[mixed])
        asked = np.unique(np.concatenate([key, rng.integers(0, 1 << 64, 1000, np.uint64)]))
        hit, at = (have := lm._Bucket(str(tmp_path), "x", n, 3)).find(asked)
        if n == 5000:  # keys that differ in their last bits only are one
            assert set(key.tolist()) - set(asked[hit].tolist()) == set()
            continue
        assert np.array_equal(asked[hit], key) and np.array_equal(have.read(at), counts)
        alike = np.repeat([[1, 1, 0], [7, 3, 300]], [len(key) - len(key) // 3, len(key) // 3], axis=0)
        lm._save_counts(str(tmp_path), "y", n, key, alike)
        assert np.array_equal(lm._Bucket(str(tmp_path), "y", n, 3).read(np.arange(len(key))), alike)
        assert os.path.getsize(tmp_path / f"y{n}.npy") <= 400 + len(key) * 6.6


def test_lm_packed_ngrams():
    rng = np.random.default_rng(6)
    often, rare = (rng.integers(3, 1 << 48, n, np.uint64) for n in (3000, 500))
    number = lm._numbers(often)
    before = np.repeat(np.append(often[:30], rare[:10]), 5)
    word, first = rng.permutation(np.append(often[:180], rare[:20])), rng.choice(np.append(often, rare), 600)
    n = np.where(rng.random(600) < 0.9, 1, rng.integers(1, 1 << 20, 600))
    blob = lm._pack_ngrams([before[::5], word, first], [np.full(40, 5), np.full(200, 3), n], number)
    for got, want in zip(lm._ngrams_of(blob, often), (first, np.repeat(before, 3), np.repeat(word, 3), n)):
        assert np.array_equal(got, want)
    assert len(blob) < 3 * (40 + 200 + 600) + 6 * 250
    facts = lm._facts(rare, rng.geometric(0.01, (6, len(rare))))
    bucket = np.arange(len(rare)) % 3
    assert all(np.array_equal(lm._facts_of(b), facts[bucket == k]) for k, b in enumerate(lm._packed(facts, bucket, 4, 6, False)[:3]))


def auc(label, score):
    rank, n = pd.Series(score).rank(), label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("kind", "label", "folds", "out", "least"), [(quality, "quality", 5, 0, 0.9), (toxicity, "toxic", 3, 1, 0.8)])
def test_classifiers_on_held_out_labels(spark, kind, label, folds, out, least):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = kind.classify(spark.read.parquet(f"{base}/documents.parquet"), labels).toPandas()
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds == out)
    assert (got.held_out == held).all() and (got.predicted == (got.score >= kind.THRESHOLD)).all()
    judged = got[held].merge(labels.toPandas(), on="doc_id").reset_index(drop=True)
    assert auc(judged[label], judged.score) >= least


def test_toxicity_grams_and_scores_by_brute_force(spark, awkward):
    def spans(text):
        plain = re.sub(r"[\x20\x09-\x0D]", " ", (text or "").translate(FOLD))
        return {plain[k : k + n] for n in toxicity.SIZES for k in range(len(plain) - n + 1) if " " not in plain[k + 1 : k + n]}

    def buckets(text):
        parts = [x.encode() for x in spans(text)]
        data, offsets = textkernel.joined(parts)
        return {int(h) >> 64 - toxicity.BUCKET_BITS for h in textkernel.span_hash(textkernel.prefix_hash(data), offsets[:-1], offsets[1:])}

    texts = ["", None, "ab", "abc", "Aé字🎉x don't\tstop  naïve", "字字字字 字字字字"] + [f"some {w} words of {w}{w}" for w in ("good", "bad", "naïve")]
    own = [set() for _ in texts]
    for first, row, bucket in toxicity.grams(pa.array(texts, pa.string())):
        for r, x in zip(row, bucket):
            assert x not in own[first + r]
            own[first + r].add(int(x))
    assert own == [buckets(t) for t in texts]
    # ratios and scores of a model that was trained on them
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in (6, 7))) for k in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, folds=1, held_out=1)
    for b in set().union(*own):
        with_b = [sum(b in own[k] for k in some) for some in ((0, 1, 2, 3, 4, 5, 8), (6, 7))]
        rate = [(n + toxicity.PRIOR * t / 9) / (t + toxicity.PRIOR * t / 9) for n, t in zip(with_b, (7, 2))]
        assert model.ratio[b] == pytest.approx(np.log(rate[1] / rate[0]))
    for r in toxicity.score(docs, model).collect():
        size = max(2, sum(model.ratio[b] ** 2 for b in own[r.doc_id]) ** 0.5) / 3
        z = model.intercept + sum(float(model.weights[b]) for b in own[r.doc_id]) / size
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_fits_one_model_however_its_rows_are_dealt(spark):
    random = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bdkst" for b in "aeiou" for c in "lmnr"]
    rows = [(k, int(k % 5 == 0), " ".join([*random.choice(words, 12), *(["vile", "scum"] if k % 5 == 0 and k % 3 else [])])) for k in range(240)] + [(300, 1, "x" * 2_000_000), (301, 0, None), (302, 0, "")]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, y, _ in rows], "doc_id long, toxic int")
    one, many = (toxicity.train(docs.repartition(n), labels, folds=1, held_out=1) for n in (1, 7))
    assert np.array_equal(one.ratio, many.ratio) and one.intercept == pytest.approx(many.intercept, abs=1e-3)
    np.testing.assert_allclose(one.weights, many.weights, atol=1e-3)
    # the fit is where the weighted penalised loss has no slope
    own = np.zeros((len(rows), toxicity.BUCKETS), np.float32)
    for first, row, bucket in toxicity.grams(pa.array([t for *_, t in rows], pa.string())):
        own[first + row, bucket] = 1
    used = np.flatnonzero(own.any(axis=0) & (np.abs(one.ratio) > 1e-9))
    x = own[:, used] * one.ratio[used]
    x /= toxicity.length((x * x).sum(axis=1))[:, None]
    y = np.array([v for _, v, _ in rows])
    weight = np.where(y == 1, min(toxicity.MOST_WEIGHT, (y == 0).sum() / y.sum()), 1.0)
    weight /= weight.sum()
    w = one.weights[used] / one.ratio[used]
    error = weight * (1 / (1 + np.exp(-(x @ w + one.intercept))) - y)
    assert abs(error.sum()) < 1e-4 and np.abs(x.T @ error + toxicity.PENALTY * w).max() < 1e-4


def test_mix_meets_its_targets(spark):
    random = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(random.integers(1, 30))), "abc"[min(2, int(random.integers(0, 9)) // 4)] if k % 50 else None) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "source"]), on="doc_id")
    assert (got["size"] == got.text.str.split().str.len()).all()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"] == 0).all()
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    order, weight, capped = sorted(sums.index, key=lambda s: (not isinstance(s, str), str(s))), {}, {}
    for k, s in enumerate(order):
        weight[k] = (5, 2, 1)[k % 3]
    left, total, sizes = dict(weight), float(sums["size"].sum()), [float(sums["size"][[s]].iloc[0]) if isinstance(s, str) else float(sums["size"][sums.index.isna()].iloc[0]) for s in order]
    while True:
        share = {k: (total - sum(capped.values())) * w / sum(left.values()) for k, w in left.items()}
        over = [k for k in left if share[k] > 3 * sizes[k]]
        if not over:
            break
        for k in over:
            capped[k] = 3 * sizes[k]
            left.pop(k)
    want = capped | share
    for k, s in enumerate(order):
        row = sums[sums.index.isna()].iloc[0] if not isinstance(s, str) else sums.loc[s]
        assert math.isclose(row.target, want[k], rel_tol=1e-9)
        assert abs(row.taken - row.target) <= max(30, 0.01 * row.target)


def test_native_mixing_has_no_python_nodes(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_extra_columns_change_nothing(docs):
    wide = docs.withColumns({c: F.lit("x") for c in ("hash", "size", "bucket", "_source", "target")})
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(mixing.mix_sources(docs)) == key(mixing.mix_sources(wide))


@pytest.mark.parametrize("tokens", [1 << 18, 1000, 37])
def test_overlaps_do_not_depend_on_ranges(monkeypatch, tokens):
    monkeypatch.setattr(jaccard, "RANGE_TOKENS", tokens)
    rng = np.random.default_rng(1)
    base, sets = np.unique(rng.integers(0, 2**64, 400, np.uint64)), []
    for k in range(40):
        own = base if k % 2 else np.unique(rng.integers(0, 2**64, 300, np.uint64))
        sets.append(np.unique(np.concatenate([own[rng.random(len(own)) > 0.04], rng.integers(0, 2**64, int(rng.integers(0, 12)), np.uint64)])))
    links = {(a, b) for a in range(40) for b in range(40) if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    n = np.array([len(x) for x in sets])
    whole = jaccard._overlapping(list(range(40)), n, np.zeros(40), sets, 90)
    away = [np.setxor1d(x, base) for x in sets]  # the same from differences to one set
    forest = jaccard._overlapping(list(range(40)), n, np.array([len(np.intersect1d(x, base)) for x in sets]) - len(base) / 2, away, 90)
    assert sorted(map(sorted, whole)) == sorted(map(sorted, forest))
    reached = {a: {a} for a in range(40)}
    for a, b in forest:
        both = reached[a] | reached[b]
        for x in both:
            reached[x] = both
    assert links and set(forest) <= links and all(b in reached[a] for a, b in links)


def test_mixing_takes_rows_alike_one_by_one(spark):
    rows = [(7, "a b c d e f", "s")] * 1000 + [(k, "one two three", "t") for k in range(100, 400)] + [(k, "x", "u") for k in range(500, 510)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for _, part in got.groupby("source_size"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max()


def test_mixed_documents_keep_columns_of_any_name(spark):
    rows = [(k, f"w{k} " * (k % 7), "ab"[k % 2], *range(9)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, hash long, whole long, threshold long, _source long, _copy long, size long, times long, doc long, left long")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in rows}
    whole = mixing.mix_sources(docs).select(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in got.collect()) == whole


def test_toxicity_features_come_in_small_batches(spark, monkeypatch):
    """A batch of many texts does not turn into one batch of all their buckets, and nothing is lost; counts come without a shuffle."""
    texts = [f"w{k} " * 40 + "lorem ipsum" * (k % 7) for k in range(60)]
    docs = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "label int, text string").coalesce(1)
    monkeypatch.setattr(toxicity, "FEATURE_BYTES", 1 << 10)
    found = toxicity.features(docs)
    rows = found.toPandas()
    got = [sorted(b) for b in rows["buckets"]]
    want = [[] for _ in texts]
    for first, row, bucket in toxicity.grams(pa.array(texts, pa.string())):
        for r, b in zip(row, bucket):
            want[first + r].append(int(b))
    assert got == want and rows["label"].tolist() == [k % 2 for k in range(60)]
    sizes = found.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").toPandas()["n"]
    assert sizes.sum() == 60
    total, seen = toxicity.class_counts(found)
    assert total.tolist() == [30, 30] and all(seen[c].sum() == sum(len(w) for w in want[c::2]) for c in (0, 1))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counts", "counts")
    toxicity.class_counts(found)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(jobs.getJobInfo(j).stageIds) for j in jobs.getJobIdsForGroup("counts")] == [1]


def test_toxicity_sums_reach_the_driver_as_arrow(spark, monkeypatch):
    learned = spark.createDataFrame([(k % 2, [k % 2, 5, 9 + k]) for k in range(12)], "label int, buckets array<int>")

    def refused(self):
        raise AssertionError("sums of 2 MB became row objects")

    monkeypatch.setattr(type(learned), "collect", refused)
    total, seen = toxicity.class_counts(learned)
    assert total.tolist() == [6, 6] and seen[:, :2].tolist() == [[6, 0], [0, 6]] and seen[:, 5].tolist() == [6, 6]
    model = toxicity.fit(learned, toxicity.log_count_ratios(seen, total), 1.0)
    assert model.weights[1] > model.weights[0]


def test_batches_are_small_in_bytes_and_in_rows_read(docs):
    conf = scratch.small_batches(docs).sparkSession.conf
    assert int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 2 << 20
    assert int(conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_a_worker_drops_what_another_operator_kept():
    """An encoder serves its own tasks only; lean tasks begin without it and return what they are given."""
    made = []
    assert scratch.kept("encoder", lambda: made.append(1) or "one") == scratch.kept("encoder", lambda: made.append(2) or "two") == "one" and made == [1]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["n"])
    seen = []

    def work(batches, more):
        seen.append(dict(scratch._held))
        for b in batches:
            yield b.slice(more)

    assert [b.to_pydict() for b in scratch.lean(work)(iter([batch, batch]), more=1)] == 2 * [{"n": [2]}]
    assert seen == [{}]
    assert scratch.kept("encoder", lambda: "three") == "three" and scratch.kept("other", lambda: "four") == "four" and list(scratch._held) == ["other"]
    scratch.drop_kept()


def test_encoders_are_bounded_and_dropped_by_other_tasks(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_IDS", 8)
    encoder = bpe._kept(bpe.Encoder, VOCABULARY)
    text = " ".join(f"w{k}rd{k * k}x number{k}" for k in range(100))
    library = Tokenizer.from_file(VOCABULARY)
    assert encoder.encode(text)[1].tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(len(encoder.words), len(encoder.stretches), len(encoder.compatible)) <= 8
    list(scratch.lean(lambda batches: batches)(iter([])))
    assert bpe._kept(bpe.Encoder, VOCABULARY) is not encoder
    scratch.drop_kept()


@pytest.mark.parametrize("records", [1, 500])
def test_jaccard_deals_lists_over_several_batches(docs, texts, monkeypatch, records):
    monkeypatch.setattr(jaccard, "DEALT_RECORDS", records)
    few = docs.where("doc_id < 80").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.join_components(few).collect()}
    monkeypatch.undo()
    assert got == {r.doc_id: r.component_id for r in jaccard.join_components(few).collect()}
