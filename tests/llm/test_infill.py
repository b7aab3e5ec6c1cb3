import hashlib
import random
import re

import duckdb
import pytest

from weftline.llm import infill, queries

MARKS = (b"<P>", b"<S>", b"<M>")
rng = random.Random(5)


def units(t):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)


def plain(doc_id, text):
    """The contract, read plainly."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    w = units(text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(w), "plain", None, None, digest(text), digest(text)
    spm = h4 % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, len(w), "spm" if spm else "psm", len(pre), len(mid), digest(out), digest(text)


def random_text(n):
    return "".join(rng.choice("ab Z9é漢\U0001f600\n<>PS") for _ in range(n))


def test_ropes_split_and_join_at_every_rank():
    for n in (0, 1, 7, 60):
        text = random_text(n)
        whole, w = infill.rope(text.encode(), 5), units(text)
        assert (whole.units, whole.points, whole.size) == (len(w), len(text), len(text.encode()))
        for k in range(len(w) + 1):
            a, b = infill.split_units(whole, k)
            assert (a.body().decode(), b.body().decode()) == ("".join(w[:k]), "".join(w[k:])) and (a.units, b.points) == (k, len("".join(w[k:])))
            assert infill.join(a, b).units == len(w)


def test_marks_are_found_across_leaves():
    text = b"<" * 9 + b"<S>" + b"x<P" * 3
    assert infill.find(infill.rope(text, 2), b"<S>") == text.find(b"<S>") and infill.find(infill.rope(text, 3), b"<M>") == -1


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_comes_back(form):
    for _ in range(60):
        text = random_text(rng.randint(1, 80)).replace("<P>", "").replace("<S>", "").encode()
        *_, out = infill.rearranged(text, rng.getrandbits(32), rng.getrandbits(32), form, MARKS)
        assert infill.restored(out.body(), form, MARKS).body() == text


def test_sentinels_that_could_arise_by_chance_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            infill._marks(*bad)


def test_query_on_awkward_rows(spark, tmp_path):
    texts = [None, "", "a", "é", "plain <S> inside", "x" * 50_000, ("word " * 5 + "\U0001f600é\n") * 60_000, "tie", "tie"] + [random_text(rng.randint(1, 300)) for _ in range(150)]
    rows = [(i if i % 11 else i // 2, t, "x", 1, "f") for i, t in enumerate(texts)] + [(None, "no id at all", "y", 2, "g")]
    spark.createDataFrame(rows, "doc_id long, text string, form string, n int, output string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = [tuple(r[c] for c in names) for r in queries.QUERIES["op11_infill"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain(i, t)) for i, t, *_ in rows)
    assert {"psm", "spm", "plain"} == {r[2] for r in got}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = con.sql(queries.ORACLE_SQL["op11_infill"])
    assert sorted(told.columns) == sorted(names)
    assert sorted(map(repr, con.sql(f"select {', '.join(names)} from ({queries.ORACLE_SQL['op11_infill']})").fetchall())) == sorted(map(repr, got))
