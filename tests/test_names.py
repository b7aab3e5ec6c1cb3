import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import names


def plain(raw_in_order, threshold=tx.FUZZY_THRESHOLD):
    """The rule, one name after the other."""
    key_of = lambda x: re.sub(tx.DIACRITICS, "", re.sub(r"\s+", " ", unicodedata.normalize("NFC", x.strip()))).translate(str.maketrans(*tx.LETTER_VARIANTS))
    known, out = {}, {}
    for raw in raw_in_order:
        key = key_of(raw)
        if key in known:
            out[raw] = known[key]
            continue
        scores = [(tx.token_sort_ratio(key, other), -i, other) for i, other in enumerate(known)]
        best = max((s for s in scores if s[0] >= threshold), default=None)
        out[raw] = known[best[2]] if best else raw
        if not best:
            known[key] = raw
    return out


def asked(spark, raw, threshold=tx.FUZZY_THRESHOLD):
    rows = [(x, i) for i, x in enumerate(raw)] + [(raw[0], 10**6), (None, 3)]
    got = names.canonical_names(spark.createDataFrame(rows, "name string, first long").repartition(3), threshold).collect()
    assert len(got) == len({r["name"] for r in got})
    return {r["name"]: r["canonical"] for r in got}


def test_they_follow_first_sight(spark):
    raw = ["مدينة أحمد", "مدينه احمد", "Argoub Bou", "Argob Bou", "other", "", "  ", "b a", "a b"]
    assert asked(spark, raw) == plain(raw) == {"مدينة أحمد": "مدينة أحمد", "مدينه احمد": "مدينة أحمد", "Argoub Bou": "Argoub Bou", "Argob Bou": "Argoub Bou", "other": "other", "": "", "  ": "", "b a": "b a", "a b": "b a"}


@pytest.mark.parametrize("few, threshold", [(0, 90.0), (20_000, 90.0), (0, 75.0)])
def test_equal_to_one_after_the_other(spark, monkeypatch, few, threshold):
    monkeypatch.setattr(names, "FEW_LINKS", few)
    rng = random.Random(int(threshold) + few)
    raw = []
    for _ in range(60):
        word = " ".join("".join(rng.choice("abcdأإé") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 3)))
        for _ in range(rng.randint(1, 8)):  # drifts, so that chains of likeness arise
            word = list(word)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randint(0, 1)] = rng.choice(["a", "b", "", " ", "ه"])
            word = "".join(word)
            raw.append(rng.choice([word, word + " ", " ".join(word.split()[::-1])]) or "x")
    rng.shuffle(raw)
    raw = list(dict.fromkeys(raw))
    expected = plain(raw, threshold)
    assert sum(k != v for k, v in expected.items()) > 30 and asked(spark, raw, threshold) == expected


def test_no_link_is_lost(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 26))) for _ in range(160)})
    words += [w[: len(w) // 2] + rng.choice("abc") + w[len(w) // 2 :] for w in words]
    words = sorted(set(words))
    for threshold in (70.0, 80.0, 90.0, 95.0):
        got = {(r["u"], r["v"]) for r in names.similar(spark.createDataFrame(list(enumerate(words)), "id long, t string"), threshold).collect()}
        assert got == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if 200.0 * tx.common_length(words[i], words[j]) / (len(words[i]) + len(words[j])) >= threshold}
    with pytest.raises(ValueError):
        names.similar(spark.range(1).select("id", F.lit("a").alias("t")), 60.0)


def test_no_names(spark):
    assert names.canonical_names(spark.createDataFrame([], "name string, first long")).collect() == []
