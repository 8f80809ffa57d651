"""Ranked search, spelling variants and compression bands against plain versions, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard

from wavequarry.llm import bands, search, variants

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, letters="abcdeéß"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(1, 60))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " .,;"), (203, "Ünïcödé été ÉTÉ 中文 abc"), (None, "aab aab cde"), (204, rows[3][1]), (205, rows[3][1]), (206, rows[3][1]), (207, "abcde " * 400_000)]
    return rows + [(7, rows[7][1])]  # a repeated row


def clashing(spark, rows, names):
    """The rows with further columns of the names that the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({n: df.doc_id for n in names})


def best(rows, items, k):
    docs = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    count, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for i, text in items:
        scores = []
        for d, c in docs:
            m, score = 25 + 75 * sum(c.values()) * count // length, 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        out[i] = [(d, -s) for s, _, d in sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k]]
    return out


@pytest.mark.parametrize("limits", [(500_000, 500_000), (0, 0)])
def test_search(spark, texts, monkeypatch, limits):
    monkeypatch.setattr(search, "SENT_TERMS", limits[0])
    monkeypatch.setattr(search, "BROADCAST_TERMS", limits[1])
    items = [(1, "aa ab éa AAb aa"), (2, None), (3, ""), (4, "nowhereatall"), (5, "abcde été 中文"), (6, texts[3][1]), (7, "a b c d e é ß")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 10):
        found = search.search(clashing(spark, texts, ["row", "n", "term", "bucket", "tf", "score"]), asked, k).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.item_id, r.rank)):
            got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
        want = {i: [(n + 1, d, s) for n, (d, s) in enumerate(rows)] for i, rows in best(texts, items, k).items() if rows}
        assert got == want


def test_search_of_empty_tables(spark, texts):
    items = spark.createDataFrame([(1, "aa")], "item_id long, text string")
    assert search.search(clashing(spark, [], []), items).count() == 0
    assert search.search(clashing(spark, texts, []), items.where("false")).count() == 0


def test_terms_in_pieces(monkeypatch):
    data = " ".join(f"W{k % 97}x-é{k % 5}" for k in range(500)).encode()
    whole = search.term_counts(data)
    monkeypatch.setattr(search, "PIECE", 7)
    assert search.term_counts(data) == whole and sum(whole.values()) == 1000


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    forms, out = {}, {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = top if top and n[top] >= 2 * n[w] else None
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n[w], out[w], n.get(forms[w])))
    return rows


@pytest.mark.parametrize("shard, group", [(50_000, 32 << 20), (17, 2_000)])
def test_variants(spark, monkeypatch, shard, group):
    monkeypatch.setattr(variants, "SHARD_WORDS", shard)
    monkeypatch.setattr(variants, "GROUP_BYTES", group)
    rng = random.Random(11)
    base = ["".join(rng.choice("abeéÿÀ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for k in range(400):
        words = []
        for _ in range(20):
            w = base[min(rng.randrange(60), rng.randrange(60))]
            at, turn = rng.randrange(len(w)), rng.random()
            words.append(w if turn < 0.6 else w[:at] + w[at + 1 :] if turn < 0.75 else w[:at] + rng.choice("abé") + w[at + (turn < 0.9) :])
        rows.append((k, (" ", "-", "1", "、")[k % 4].join(words)))
    rows += [(None, rows[0][1]), (None, None), (500, ""), (501, "abcdef ABCDEF " * 50_000), (501, "abcdeg"), rows[1], rows[1]]
    docs = clashing(spark, rows, ["word", "n", "run", "h", "id"])
    got = variants.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = variants_of(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(r.form and r.root != r.form for r in got)
    assert variants.spelling_variants(docs.where("false")).count() == 0


def test_trie_answers_every_edit():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    trie = variants.Trie.unpack(variants.Trie.of([w.encode() for w in words], list(range(1, len(words) + 1))).pack())
    for w in [*words, "abcabc", "ccccccccc", "d"]:
        found = sorted(x.decode() for x, _ in trie.near(w.encode()))
        assert found == [v for v in words if one_edit(v, w)]
    assert all(words[n - 1].encode() == x for w in words for x, n in trie.near(w.encode()))


def test_groups_hold_every_shard():
    assert variants.groups([5, 5, 5, 30, 1], 10) == [[0, 1], [2], [3], [4]] and variants.groups([], 10) == []


def judged(text):
    text = text or ""
    words, data = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            inside |= set(range(k, k + 5))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    packer = zstandard.ZstdCompressor(level=3)
    ratios = [len(packer.compress(data[k : k + 2048])) / 2048 for k in range(0, len(data) - 2047, 2048)]
    outside = sum(not 0.38 <= r <= 0.75 for r in ratios)
    kept = not failed and bands.verdict(len(data), len(packer.compress(data)) / len(data), len(ratios), outside)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(inside), failed, kept


def test_bands(spark, texts):
    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9F00)) + " " * (k % 7 == 0) for k in range(4000))
    plain = prose(rng, 900, "abcdefghijklmnop")
    rows = [*texts, (300, plain), (301, noise), (302, "one two three four five six\n" * 3 + plain), (303, "\n\n a \n a \n\n"), (304, "x" * 3_000_000), (305, "# * < > |\x0b\x0c$ % &"), (306, plain + " zz" * 9000)]
    rows += [(307, f"{plain}\n{plain}")]
    got = sorted(map(tuple, bands.judge_documents(clashing(spark, rows, ["kept", "ratio", "n_bytes"])).select("doc_id", *[c.split()[0] for c in bands.SCHEMA.split(", ")[1:8]]).collect()), key=repr)
    assert got == sorted(((d, *judged(t)) for d, t in rows), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[300][7] and not by_id[301][6] and not by_id[301][7] and not by_id[306][7] and by_id[307][6]
    assert bands.judge_documents(clashing(spark, [], [])).count() == 0


def test_bands_follow_length():
    assert bands.verdict(5_000, 0.45, 2, 0) and not bands.verdict(5_000, 0.37, 2, 0) and bands.verdict(50_000, 0.37, 20, 5)
    assert not bands.verdict(50_000, 0.37, 20, 6) and not bands.verdict(5_000, 0.8, 2, 0) and bands.verdict(50, 3.0, 0, 0)


def test_words_are_hashed_in_pieces():
    import numpy as np

    from wavequarry.llm.textkernel import text_hashes

    data = np.frombuffer(("Ab cd\nab  " * 50 + "x" * 40 + " end").encode(), np.uint8)
    whole = text_hashes(data)
    assert len(whole) == 152 and len(set(whole.tolist())) == 5
    for limit in (1, 3, 7, 64):
        assert (text_hashes(data, limit) == whole).all()
