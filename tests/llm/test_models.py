import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import brown, language, toxicity

rng = random.Random(13)


def words(parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


EN, FR = ["th", "ing", "er", "sh", "and"], ["eau", "qu", "é", "oi", "ment"]


def test_languages(spark, table):
    rows = [(i, words(EN if i % 2 else FR, rng.randint(5, 200)), "en" if i % 2 else "fr") for i in range(400)] + [(None, words(EN, 9), None)]
    docs = table("doc_id long, text string, lang string", rows)
    held = language.held_out(F.col("doc_id"))
    network = language.fit(docs.filter(~held))
    extra = table("doc_id long, text string, score string", [(9000, None, "x"), (9001, "", "x"), (9002, "12 34 !!", "x"), (9003, words(EN, 40_000), "x"), (9003, words(EN, 40), "x")])
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(extra, network).collect()}
    assert found[9000] == found[9001] == found[9002] == ("und", 0.0) and found[9003][0] == "en"
    told = language.identify(docs.filter("doc_id is not null").select("doc_id", "text"), network).withColumn("held", language.held_out(F.col("doc_id")))
    right = [r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in told.collect() if r.held]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    assert language.fit(docs.limit(0)) is None and language.identify(docs.select("doc_id", "text"), None).filter("lang_pred <> 'und'").count() == 0


def test_held_out_is_crc32(spark):
    for r in spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2)


def test_windows_cover_every_byte():
    at = np.array([0, 0, 5, 300, 300 + 128, 1000])
    row, start, end = language.windows_of(at, np.zeros(1000, np.uint8))
    for r in range(5):
        got = sorted((s, min(s + language.WINDOW, e)) for s, e, x in zip(start, end, row) if x == r)
        assert got and got[0][0] == at[r] and max(b for _, b in got) == at[r + 1]
        assert all(b[0] <= a[1] - max(language.WIDTHS) + 1 for a, b in zip(got, got[1:]))


def plain_kernel(a, b):
    fa, fb = toxicity.features(a), toxicity.features(b)
    return (sum(v * fb.get(k, 0) for k, v in fa.items()) / (toxicity.own_weight(a) * toxicity.own_weight(b))) ** toxicity.POWER


def test_kernel_of_words_equals_a_plain_version():
    marks = toxicity.Landmarks([b"idiot", b"pathetic"])
    text, spots = b"", []
    for w in (b"idiot", b"i-d-i-o-t", b"idxiot", b"xyz", b"ab", b"PATHETIC", b"pathetically"):
        spots.append((len(text), len(text) + len(w)))
        text += w + b" "
    live, values = marks.of_words(text, *np.array(spots).T)
    for row, k in zip(values, live.tolist()):
        own = text[slice(*spots[k])]
        assert np.allclose(row, [min(1.0, plain_kernel(own, m)) if toxicity.own_weight(own) else 0 for m in (b"idiot", b"pathetic")], atol=1e-4)
    assert {0, 1, 2, 5, 6} <= set(live.tolist()) and 3 not in live and 4 not in live


def test_toxicity_learns_gapped_insults(spark, table):
    bad = ["blorgus", "frimpek"]
    rows = []
    for i in range(500):
        w = words(EN, 60).split()
        if i % 5 == 0:
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
    docs, labels = table("doc_id long, text string", rows), table("doc_id long, quality int, toxic int", [(i, 1, int(i % 5 == 0)) for i in range(500)] + [(None, 1, 1), (3, 1, 0)])
    model = toxicity.fit(docs, labels)
    probes = table("doc_id long, text string, score string", [(1, words(EN, 50) + " b-l-o-r-g-u-s " + words(EN, 50), "x"), (2, words(EN, 30) + " f r i m p e k", "x"), (3, words(EN, 100), "x"), (4, None, "x"), (5, "", "x"), (6, words(EN, 20_000) + " blorgus", "x"), (6, "blorgus", "x")])
    found = {}
    for r in toxicity.scored(probes, model).collect():
        found.setdefault(r.doc_id, []).append(r.score)
    assert min(found[1] + found[2] + found[6]) >= 0.3 > max(found[3] + found[4] + found[5])
    assert toxicity.fit(docs, labels.limit(0)).scores(np.array([0, 1]), np.zeros(1, np.uint8)).tolist() == [0.0]
    assert toxicity.scored(probes.limit(0), model).count() == 0


def test_letters_of_every_script():
    as_letters = lambda t: toxicity._heard(t.encode()).tolist()
    assert as_letters("Id-i0o·t\u200b") == as_letters("idiot") == as_letters("\uff49\U0001d4ed\U0001d4f2ot")
    assert len(as_letters("глупец")) == 6 and as_letters("г-л.у_п е ц") == as_letters("глупец") and min(as_letters("глупец")) >= 26
    assert as_letters("é") != as_letters("e") and as_letters("12 !?") == [] and toxicity.heard(np.zeros(0, np.uint8)).tolist() == []
    marks = toxicity.Landmarks(["глупец".encode(), b"idiot"])
    text = "г·лу*п·ец столовая".encode()
    cut = text.index(b" ")
    live, values = marks.of_words(text, np.array([0, cut + 1]), np.array([cut, len(text)]))
    assert live[0] == 0 and values[0, 0] > 0.99 and values[1:, 0].max(initial=0) < 0.3


def test_insults_of_another_script_are_learned():
    other = "окно стол река поле лес гора море небо дом сад".split()
    texts, y = [], []
    for i in range(300):
        w = [rng.choice(other) + rng.choice(other) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "глупец"
        texts.append(" ".join(w).encode())
        y.append(int(i % 4 == 0))
    model = toxicity.train(texts, np.array(y))
    score = lambda t: float(model.scores(np.array([0, len(t.encode())]), np.frombuffer(t.encode(), np.uint8))[0])
    clean = " ".join(rng.choice(other) + rng.choice(other) for _ in range(60))
    assert score(clean + " г-л-у-п-е-ц") > 0.3 and score("г л у п е ц " + clean) > 0.3 and score(clean) < 0.3 and score("") < 0.3


def test_base_scores_and_a_better_model(spark, table):
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 12)) for x in (rng.choice(nouns), rng.choice(verbs)))) for i in range(300)] + [(7, "N1\tv1"), (7, "N1\tv1"), (None, "n1 unseenword v2"), (301, None)]
    docs = table("doc_id long, text string", rows).withColumn("held", language.held_out(F.col("doc_id"), 7))
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split() + [b"\n"])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in (t or "").encode().lower().split() + [b"\n"])
    found = brown.score(docs).collect()
    assert len(found) == len(rows) and {r.train_tokens for r in found} == {n}
    assert sorted((r.doc_id or -1, r.n_tokens, round(r.base_score, 6)) for r in found) == sorted((i or -1 if i is not None else -1, len((t or "").split()) + 1, round(base(t), 6)) if i != 0 else (-1, len((t or "").split()) + 1, round(base(t), 6)) for i, t in rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    empty = brown.score(docs.withColumn("held", F.lit(True)).limit(5)).collect()
    assert len(empty) == 5 and {r.train_tokens for r in empty} == {0} and all(math.isfinite(r.score) for r in empty)
    assert brown.score(docs.limit(0)).count() == 0


def test_exchange_finds_the_two_kinds():
    size = 12
    table_ = np.zeros((size + 1, size + 1))
    for i in range(size):
        for j in range(size):
            if i % 2 != j % 2:
                table_[i, j] = rng.randint(5, 9)
    label = brown.exchange(table_, classes=2)
    assert {label[i] for i in range(0, size, 2)} != {label[i] for i in range(1, size, 2)} and len(set(label[::2])) == 1
