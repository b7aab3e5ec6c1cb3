import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import decontaminate as dc
from weftline.llm.arrowtext import pieces

rng = random.Random(31)
PARTS, TAILS = ["tion", "ing", "sh", "er", "an", "wor", "lo", "mi"], ["a", "e", "th", "ol", "ard", "ex"]


def prose(n):
    return [rng.choice(PARTS) + rng.choice(TAILS) + rng.choice(["", "s", "ly", "on"]) for _ in range(n)]


def plain_best(item, passage):
    row = [0] * (len(passage) + 1)
    for i, a in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(passage, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def found(index, texts):
    return {(first + r, i): e for first, _, at, raw in pieces(pa.array(texts)) for r, i, e, _ in index.hits(at, raw)}


def changed(words, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(words) if rng.random() < 0.3 else "q" + rng.choice(TAILS)]
    return out


def test_edit_distance_equals_the_table():
    for _ in range(500):
        a = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(3) for _ in range(rng.randint(0, 20))]
        assert dc.best_distance(a, b)[0] == plain_best(a, b)


def test_walks_over_equal_texts_agree_and_fall_back_into_step():
    h = np.array([rng.getrandbits(64) | 1 for _ in range(60)], dtype=np.uint64)
    other = np.delete(h, 3)  # one word left out
    both = np.concatenate([h, other, [np.uint64(0)]])
    same = total = 0
    for t, symbol in enumerate(dc.walked(both, np.array([0, 60]), np.array([60, 119]), 70)):
        if t > 20:
            same, total = same + int((symbol[:, 0] == symbol[:, 1]).sum()), total + len(symbol)
    assert same > total / 4


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_recall_by_share_of_the_edits_that_count(share):
    sizes = (5, 7, 9, 12, 15, 20, 30, 45, 59)
    items = [prose(n) for n in sizes for _ in range(12)]
    index = dc.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    texts, true = [], {}
    for i, w in enumerate(items):
        for _ in range(6):
            text = " ".join([*prose(rng.randint(0, 90)), *changed(w, round(share * dc.most_edits(len(w)))), *prose(rng.randint(0, 90))])
            true[len(texts), i] = plain_best(w, text.split())
            texts.append(text)
    got = found(index, texts)
    for n in sizes:
        own = [x for x in true if len(items[x[1]]) == n and true[x] <= dc.most_edits(n)]
        hit = sum(got.get(x) == true[x] for x in own)
        assert len(own) > 30 and hit >= (1 if share == 0 else dc.TARGET) * len(own), (n, hit, len(own))


def test_nothing_is_reported_that_brute_force_does_not_find():
    letters = lambda n: [rng.choice(["ab", "é", "ba", "abé", "b"]) for _ in range(n)]
    items = [letters(rng.randint(1, 12)) for _ in range(40)]
    index = dc.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    texts = [" ".join(letters(rng.randint(0, 60))) + rng.choice(["", ".", " !"]) for _ in range(60)] + ["", " ".join(items[0])]
    true = {(r, i): e for r, t in enumerate(texts) for i, x in enumerate(items) for e in [plain_best(x, plain_words(t))] if e <= dc.most_edits(len(x))}
    got = found(index, texts)
    assert len(got) > 100 and got.keys() <= true.keys() and all(e >= true[x] for x, e in got.items())
    exact = {x for x, e in true.items() if e == 0}
    assert exact and {x for x, e in got.items() if e == 0} == exact  # few words or many


def test_long_texts_and_blocks(spark, table):
    item = prose(20)
    long = " ".join([*prose(150_000), *changed(item, 2), *prose(150_000)])
    assert len(long) > 3 << 19
    docs = table("doc_id long, text string", [(1, long), (2, " ".join(prose(50)))])
    items = table("item_id long, text string", [(i, " ".join(w)) for i, w in enumerate([item, *(prose(15) for _ in range(30))])])
    assert {(r.doc_id, r.item_id) for r in dc.contaminations(docs, items).collect()} == {(1, 0)}
    assert sum(1 for _ in dc.item_blocks(items, block_bytes=1000)) > 1


def test_contaminations_of_a_table(spark, table):
    item = " ".join(prose(20))
    items = table("item_id long, text string", [(1, item), (2, item), (3, "too short here"), (4, None), (5, "! ?"), (None, " ".join(prose(16)))])
    docs = table("doc_id long, text string, item_id string", [(1, "x y " + item + " z", "e"), (1, "x y " + item + " z", "e"), (2, None, "e"), (3, "", "e"), (None, item.upper(), "e"), (4, "So too: SHORT, here", "e"), (5, "too, so short here", "e")])
    rows = [(r.doc_id, r.item_id, r.edits) for r in dc.contaminations(docs, items).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, 0), (1, 2, 0)] * 2 + [(None, 1, 0), (None, 2, 0), (4, 3, 0)], key=str)
    kept = dc.without_items(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert dc.contaminations(docs, items.limit(0)).count() == 0 and dc.without_items(docs, items.limit(0)).count() == 7
    assert dc.contaminations(docs.limit(0), items).count() == 0
