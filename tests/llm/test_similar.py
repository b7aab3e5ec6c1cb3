import random

import corpus_pipeline
from weftline.llm import similar

rng = random.Random(29)


def grams(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited(words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_no_pair_of_near_copies_stays(spark, table):
    texts, pairs = [], 0
    for _ in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 300))]
        copy = " ".join(edited(base, rng.randint(1, max(1, len(base) // 45))))
        texts += [" ".join(base), copy]
        pairs += jaccard(texts[-2], copy) >= 0.8
    assert pairs > 90
    docs = table("doc_id long, text string", list(enumerate(texts)))
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    both = [i for i in range(0, len(texts), 2) if {i, i + 1} <= kept]
    assert not [i for i in both if jaccard(texts[i], texts[i + 1]) >= 0.8]
    assert len(both) == 150 - pairs  # and what is less similar stays


def test_shingles_equal_plain_sets():
    import numpy as np
    import pyarrow as pa

    from weftline.llm.arrowtext import flat

    rows = ["", "a", "A b", "a b c d e f g", "x y " * 40, "É é b\tc\x1cd e f g", None, "p q r s t", " P q  r\ns t "]
    hashes, first = similar.shingles(*flat(pa.array(rows)), 5)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(first, first[1:])]
    plain = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in [(r or "").encode().lower().split() for r in rows]]
    assert all(len(s & t) == len(p & q) for s, p in zip(sets, plain) for t, q in zip(sets, plain))
    keys = similar.band_keys(*flat(pa.array(rows)), 5)
    assert (keys[7] == keys[8]).all() and (keys[0] == keys[6]).all() and not (keys[1] == keys[2]).any()
    assert similar.likeness(np.unique(hashes[first[3] : first[4]]), np.unique(hashes[first[3] : first[4]])) == 1


def test_members_unlike_the_first_are_compared_with_each_other(spark, table):
    base = [f"w{i}" for i in range(400)]
    chain = [base]
    for k in range(12):  # each step away from the first, near the one before
        chain.append([f"s{k}x{i}" if 30 * k <= i < 30 * k + 30 else w for i, w in enumerate(chain[-1])])
    texts = [" ".join(w) for w in chain] + [" ".join(w[:200] + ["sibling"] + w[201:]) for w in chain]
    order = rng.sample(range(len(texts)), len(texts))
    docs = table("doc_id long, text string", [(i, texts[k]) for i, k in enumerate(order)] + [(None, texts[5] + " end"), (99, texts[0].upper())])
    stay = []
    for k in order:
        if all(jaccard(texts[k], texts[j]) < 0.8 for j in stay):
            stay.append(k)
    assert len(stay) > 3
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert kept == sorted(str(order.index(k)) for k in stay)


def test_kept_sets_equal_brute_force():
    import numpy as np

    kept, plain = similar.Kept(0.8), []
    for _ in range(1500):
        start, size = rng.randrange(60), rng.randint(1, 40)
        own = np.array([x for x in range(start, start + size) if rng.random() < 0.95] or [start], dtype=np.uint64)
        stays = all(len(set(own) & set(p)) < 0.8 * len(set(own) | set(p)) for p in plain)
        assert kept.add(own) == stays
        plain += [own.tolist()] if stays else []
