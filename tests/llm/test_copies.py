import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import repeats, simhash
from weftline.llm.suffixes import suffix_array

rng = random.Random(7)


def test_suffix_order_equals_sorting():
    for _ in range(3000):
        k, n = rng.randint(1, 4), rng.randint(0, 24)
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.4 and n:
            s = (s[: rng.randint(1, 5)] * 24)[:n]
        assert suffix_array(s) == sorted(range(n), key=lambda i: s[i:])


def plain_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for s in range(len(r) - length + 1):
            seen[r[s : s + length]] = seen.get(r[s : s + length], 0) + 1
    out = []
    for r in raws:
        gone = {s + k for s in range(len(r) - length + 1) if seen[r[s : s + length]] > 1 for k in range(length)}
        out.append(bytes(b for i, b in enumerate(r) if i not in gone))
    return out


def test_repeats_equal_brute_force(spark, table):
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared, other = word(130), word(90)
    texts = [word(200) + shared + word(30), shared, word(20) + shared[10:120] + other, other + word(5) + other, "ab" * 150, "ab" * 90 + "x", None, "", "short", word(100), word(100)]
    texts += [texts[9], shared[:64] + "q" + shared[65:], "z" * 64, "z" * 63]
    docs = table("doc_id long, text string, ranges string", [(i if i != 3 else None, t, "r") for i, t in enumerate(texts)])
    got = repeats.remove_repeats(docs, length=64).collect()
    expected = plain_removed(texts, 64)
    assert sorted((r.n_bytes, bytes(r.kept)) for r in got) == sorted((len((t or "").encode()), e) for t, e in zip(texts, expected))
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert repeats.remove_repeats(docs.limit(0), length=64).count() == 0


@pytest.mark.parametrize("hot", [0, 2, 64])
def test_planted_passages_equal_brute_force_with_hot_anchors(spark, table, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_KINDS", hot)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passages = [words(rng.randint(51, 120)) for _ in range(12)]
    texts = [" ".join([words(rng.randint(0, 60)), rng.choice(passages[: 1 + i % 12]), words(rng.randint(0, 60))]) for i in range(300)] + [words(150) for _ in range(100)]
    texts[7] = texts[8] = texts[9]
    docs = table("doc_id long, text string", list(enumerate(texts)))
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs, length=200).collect()}
    assert got == dict(enumerate(plain_removed(texts, 200)))


def test_texts_above_a_section(spark, table):
    body = "".join(rng.choice("abcdefghij ") for _ in range((1 << 20) + 5000))
    shared = body[(1 << 20) - 700 : (1 << 20) + 900]  # across the end of a section
    docs = table("doc_id long, text string", [(1, body), (2, "x" + shared + "y"), (3, body[:300])])
    got = {r.doc_id: (bytes(r.kept).decode(), len(r.spans)) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (body.replace(shared, ""), 1), 2: ("xy", 1), 3: (body[:300], 0)}


def test_equal_rows_repeat_each_other(spark, table):
    text = "".join(rng.choice("abcdef") for _ in range(900))
    rows = repeats.remove_repeats(table("doc_id long, text string", [(1, text), (1, text), (2, text[:399])])).collect()
    assert sorted((r.n_bytes, len(r.kept)) for r in rows) == [(399, 399), (900, 0), (900, 0)]


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "x y z x y z", "É é b\tc\x1cd e f g", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_hashes_are_those_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c", 42)


def brute_components(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for p in prints:
        groups.setdefault(find(p), set()).add(p)
    return sorted(map(sorted, groups.values()))


def family(n):
    prints = set()
    while len(prints) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(prints)


@pytest.mark.parametrize("hot, radius, even", [(20_000, 3, 64), (4, 3, 64), (20_000, 7, 64), (50, 7, 0)])
def test_links_equal_brute_force(spark, table, hot, radius, even, monkeypatch):
    monkeypatch.setattr(simhash, "EVEN_BUCKET", even)
    assert simhash.matched_bands(radius, 150) == (2 if even else 6)
    prints = family(150)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.fingerprint_components(table("fp long", [(signed(p),) for p in prints] * 2 + [(None,)]), radius, hot).collect()
    root = {r.node & (1 << 64) - 1: r.component for r in found}
    groups = {}
    for p in prints:
        groups.setdefault(root.get(p, ("alone", p)), set()).add(p)
    assert sorted(map(sorted, groups.values())) == brute_components(prints, radius)


def test_dense_bucket_keeps_all_links():
    prints = np.unique(np.array([rng.getrandbits(12) for _ in range(1500)], dtype=np.uint64))
    u, v = simhash.local_links(np.zeros(len(prints), np.int64), prints)
    assert len(set(u.tolist())) == len(prints) - 1 and len(set(v.tolist())) == 1


def test_components_and_representatives(spark, table):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base, "s"), (4, base, "t"), (4, base, "u"), (7, base.upper(), "v"), (5, "another text here altogether", "w"), (3, "", "x"), (2, None, "y"), (None, base, "z"), (None, "only without id", "q")]
    docs = table("doc_id long, text string, fp string", rows)
    found = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicate_components(docs).collect()), key=str)
    assert sorted(found, key=str) == sorted([(9, 4), (4, 4), (4, 4), (7, 4), (5, 5), (3, 2), (2, 2), (-1, 4), (-1, None)], key=str)
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "None"]
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0


def test_members_unlike_the_row_that_stays_are_kept(spark, table):
    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["other"] + words[151:]
    far = [w if i % 40 else f"x{i}" for i, w in enumerate(words)]
    docs = table("doc_id long, text string", [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(far)), (5, None), (6, "")])
    ids = lambda **k: sorted(r.doc_id for r in simhash.keep_one_per_group(docs, 5, **k).collect())
    assert ids(radius=20) == [1, 5]
    assert ids(radius=20, similarity=0.8) == [1, 3, 5]
