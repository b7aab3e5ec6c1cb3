"""The pipeline against a plain version of its stages on a small corpus."""

import random

import corpus_pipeline
from weftline.llm import pii, simhash

rng = random.Random(17)


def prose(n):
    return " ".join(rng.choice(["tion", "ing", "sh", "er", "an", "wor"]) + rng.choice(["a", "e", "th", "ol", "ard", "ex"]) + rng.choice(["", "s", "ly", "on"]) for _ in range(n))


def test_stages_equal_a_plain_version(spark, tmp_path):
    item = prose(25)
    texts = [prose(rng.randint(30, 90)) for _ in range(120)]
    texts[3] = texts[9] = texts[1]
    texts[20] = prose(20) + " " + item + " " + prose(10)
    texts[21] = prose(30) + " write a.b@c.de " + prose(5)
    texts[22] = "few words"
    texts[23] = "same again " * 40
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(200, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    kept = [r for r in rows if r[1] and len(r[1].split()) >= 10 and r[0] != 23]
    prints = {r[0]: simhash.fingerprint(r[1].encode(), 5) for r in kept}
    root = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 7:
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    kept = [r for r in kept if r[0] == min(k for k, v in root.items() if v == root[r[0]])]
    kept = [r for r in kept if item not in r[1]]
    expected = {}
    for r in kept:
        text = r[1]
        for kind, a, b in sorted(pii.pattern_spans(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        expected[r[0]] = text

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    assert {r.doc_id: r.text for r in docs.collect()} == expected and all(r.n_chars == len(r.text) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(expected) and all(1 <= r.copies <= 3 and r.text == expected[r.doc_id] for r in out)
