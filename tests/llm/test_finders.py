import itertools
import random
import re

import numpy as np
import pytest

from weftline.llm import licenses, pii
from weftline.llm.tagger import Tagger

rng = random.Random(11)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ \-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda m: len(re.sub("[^0-9]", "", m[0]))
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= n(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= n(m) <= 15]


def test_patterns_equal_plain_regular_expressions():
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789..@a-+() %_é") for _ in range(rng.randint(0, 45)))
        assert pii.pattern_spans(t) == plain_spans(t)
    long = "1" * 200_000 + "@" * 1000 + "a" * 200_000
    assert pii.pattern_spans(long) == []


def test_slopes_of_the_tagger():
    tagger = Tagger(3, seed=1)
    tagger.p = {k: v.astype(np.float64) + (0.1 if k == "move" else 0) for k, v in tagger.p.items()}
    ids = np.array([[3, 5, 7, 9], [4, 6, 0, 0]])
    gold = np.array([[0, 1, 1, 2], [2, 0, 0, 0]])
    _, slopes = tagger._loss_slopes(ids, gold)
    for key in tagger.p:
        flat = tagger.p[key].reshape(-1)
        used = np.flatnonzero(np.abs(slopes[key].reshape(-1)) > 1e-6)[:6]
        for i in used:
            flat[i] += 1e-4
            up = tagger._loss_slopes(ids, gold)[0]
            flat[i] -= 2e-4
            down = tagger._loss_slopes(ids, gold)[0]
            flat[i] += 1e-4
            assert np.isclose((up - down) / 2e-4, slopes[key].reshape(-1)[i], rtol=0.02, atol=2e-4), key


@pytest.fixture(scope="module")
def tagger():
    return pii.default_tagger()


def test_tagger_on_held_out_lines(tagger):
    lines = pii.labelled_lines(250, seed=123)
    found = pii.tagged_spans([t for t, _ in lines], tagger)
    true = {(i, *s) for i, (_, spans) in enumerate(lines) for s in spans}
    got = {(i, *s) for i, spans in enumerate(found) for s in spans}
    assert len(true & got) >= 0.75 * len(true) and len(got - true) <= 0.02 * len(got)


def test_long_texts_agree_with_their_parts(tagger):
    filler = "the words of a line that goes on and on without numbers " * 40
    body = filler + "call (456) 555-2186 now " + filler + "or 456-555-2187 later " + filler
    spans = {(k, body[a:b]) for k, a, b in pii.tagged_spans([body], tagger)[0]}
    assert spans <= {("phone", "(456) 555-2186"), ("phone", "456-555-2187")} and spans


def test_spans_and_redaction(spark, table, tagger):
    docs = table("doc_id long, text string, kept string", [(1, "é mail a.b@c.de or 1.2.3.4 and 4111 1111 1111 1111, +1 (456) 555-2186.", "k"), (2, None, "k"), (3, "", "k"), (1, "@ ( [ 7 [", None), (None, "x@y.zz", "k")])
    rows = pii.personal_data(docs, tagger).collect()
    assert sorted((len(r.base), len(r.added)) for r in rows) == [(0, 0), (0, 0), (0, 0), (1, 0), (4, 0)]
    out = pii.redacted(docs, tagger)
    assert out.columns == docs.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["é mail [EMAIL] or [IP] and [CARD], [PHONE].", "None", "", "@ ( [ 7 [", "[EMAIL]"])
    assert pii.redacted(docs.limit(0), tagger).count() == 0


def test_fitted_to_texts_and_added_spans(spark, table):
    def host():
        return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "né"]) for _ in range(rng.randint(5, 60)))

    forms = [lambda: f"a{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: "+1 (%03d) 555-%04d" % (rng.randrange(1000), rng.randrange(10000)), lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))]
    texts = [f"{host()} {rng.choice(forms)()} {host()}" for _ in range(200)]
    token = "%040x" % rng.getrandbits(160)
    hidden = [f'{host()} token = "{token}" {host()}', host() + " john.doe (at) mail7 (dot) example (dot) com " + host()]
    docs = table("doc_id long, text string, source string", [(i, t, "s") for i, t in enumerate([*texts, *texts[:50], *hidden, "", None])])
    model = pii.fit(docs)
    rows = {r.doc_id: r for r in pii.personal_data(docs, model).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in rows[i].base] == sorted(plain_spans(t), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    assert [(s.kind, hidden[0][s.start : s.end]) for s in rows[250].added] == [("secret", token)]
    assert [(s.kind, hidden[1][s.start : s.end]) for s in rows[251].added] == [("email", "john.doe (at) mail7 (dot) example (dot) com")]
    assert rows[252].base == rows[252].added == rows[253].base == rows[253].added == []
    assert {r.doc_id: r.text for r in pii.redacted(docs, model).collect()}[250] == hidden[0].replace(token, "[SECRET]")
    assert pii.fit(docs.limit(0)).p["out"].shape[1] == 1 + len(pii.TAGGED)


def test_one_path_over_a_run_of_windows(tagger):
    ids = np.array([[rng.randint(1, 30) for _ in range(7)]])
    s = np.random.default_rng(1).normal(size=(1, 7, len(pii.TAGGED) + 1))
    best = max(itertools.product(range(s.shape[2]), repeat=7), key=lambda t: tagger.p["first"][t[0]] + sum(s[0, i, x] for i, x in enumerate(t)) + sum(tagger.p["move"][x, y] for x, y in zip(t, t[1:])))
    assert tuple(tagger.best_path(s, ids > 0)[0]) == best
    long = "word " * 30 + 'token = "' + "a1b2" * 20 + '" ' + "word " * 30
    assert [long[a:b] for k, a, b in pii.tagged_spans([long], tagger)[0]] == ["a1b2" * 20]


def test_license_labels(spark, table):
    apache = licenses.TEMPLATES[0][1]
    filler = "lorem ipsum dolor sit amet " * 30
    changed = apache.replace("you may not", "you may really not").replace("obtain", "get")
    docs = table("doc_id long, text string, label string", [(1, filler + apache + filler, "x"), (2, filler + changed, "x"), (3, filler, "x"), (4, None, "x"), (5, "", "x"), (6, "THE Mit license, cc-by cc by", "x"), (6, "THE Mit license, cc-by cc by", "x"), (None, "GNU General Public License", "x"), (7, "permission is hereby something else entirely", "x")])
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, [list(p) for p in r.places], sorted({s.label for s in r.spans})))
    assert found[1][0][2] == ["apache-2.0"] and found[2][0][2] == ["apache-2.0"] and found[3][0][2] == [] and found[7][0][2] == []
    assert found[4] == found[5] == [(0, [[], [], [], []], [])]
    assert len(found[6]) == 2 and found[6][0] == found[6][1] and found[6][0][1] == [[], [], [3, 5], [1]]
    assert found[None][0][1][0] == [0]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_two_notices_in_a_row_are_two_spans(spark, table):
    long = licenses.TEMPLATES[0][1]
    put_in = long.replace("except in", "ever, except, as we say, in")
    docs = table("doc_id long, text string", [(1, "Released under the MIT License. " * 2), (2, "x " * 300_000 + put_in + " y"), (3, "Released under the MIT License")])
    found = {r.doc_id: [(s.label, s.first, s.last) for s in r.spans] for r in licenses.scan(docs).collect()}
    assert found[1] == [("mit", 0, 4), ("mit", 5, 9)] and found[3] == [("mit", 0, 4)]
    assert [x for x in found[2] if x[2] - x[1] > 8] == [("apache-2.0", 300_000, 300_000 + len(licenses._words(put_in)) - 1)]


def test_spans_need_the_words_not_their_hash(spark, table, monkeypatch):
    index = licenses.template_grams(spark)
    other = index.withColumn("said", licenses.F.lit("other words here"))  # as if every hash collided
    monkeypatch.setattr(licenses, "template_grams", lambda *_: other)
    docs = table("doc_id long, text string", [(1, "Released under the MIT License.")])
    assert licenses.scan(docs).first().spans == []
