import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_figures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b c d e a b c d e", "x\n\nx\n x\nx", "é#é <b>|*\x0b&", "w " * 300, "a b c d e f g " * 3 + "z " + "a b c d e", "\x1ca\x85b c"]


def test_figures_equal_a_plain_version(spark, table):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", "\nq"]) for _ in range(60)]
    docs = table("i int, text string", list(enumerate(texts)))
    for r in docs.select("i", quality.figures(F.col("text")).alias("f")).collect():
        assert tuple(r.f)[:5] == plain_figures(texts[r.i]), texts[r.i]


@pytest.mark.parametrize("n, k, rate", [(100, 0, 0.02), (1000, 7, 0.01), (5000, 20, 0.01), (50, 3, 0.1)])
def test_binomial_tail(spark, n, k, rate):
    exact = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality._tail(F.lit(k).cast("long"), F.lit(n).cast("long"), rate).alias("p")).first().p
    assert math.isclose(got, exact, rel_tol=1e-9)


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [f"word{rng.randint(0, 9999)}" for _ in range(40)]
        rows.append((i, " ".join(w + "###" for w in words) if i % 10 == 0 else " ".join(words), "en" if i % 50 else None, 7))
    return rows


def test_rules_certify_with_labels_and_lose_nothing_without(spark, table):
    rows = corpus(random.Random(3), 3000)
    docs = table("doc_id long, text string, lang string, extra int", rows)
    labels = table("doc_id long, quality int, toxic int", [(i, int(i % 10 > 0), 0) for i, *_ in rows] + [(5, 0, 0), (None, 1, 0), (10**9, 1, 0)])
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    junk = {i for i, *_ in rows if i % 10 == 0}
    assert {i for i, _, lang, _ in rows if i % 10} <= kept
    assert kept & junk == {i for i in junk if i % 50 == 0}  # the stratum without a language has too few labels
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == 3000
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    told = quality.quality_table(docs.union(docs.limit(5)), labels)
    assert told.count() == 3005 and told.filter("base_failed and kept").count() == 0


def test_targets_stop_and_reshare():
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert math.isclose(sum(mixing.targets([3, 50, 9, 1, 700], [5, 2, 1, 5, 2])), 763)


def cheapest(patterns, sizes, quotas, most=3):
    """Brute force over words used per pattern and source."""
    best = None

    def go(p, left, cost, sent):
        nonlocal best
        if p == len(patterns):
            if best is None or (-sent, cost) < best:
                best = (-sent, cost)
            return
        def split(members, left, used):
            if not members:
                whole, rest = divmod(used, sizes[p]) if sizes[p] else (0, 0)
                own = sum(k * k * sizes[p] for k in range(whole)) + rest * whole**2
                go(p + 1, left, cost + own, sent + used)
                return
            s = members[0]
            for x in range(min(left[s], most * sizes[p] - used) + 1):
                split(members[1:], left[:s] + [left[s] - x] + left[s + 1 :], used + x)
        split(list(patterns[p]), left, 0)

    go(0, list(quotas), 0, 0)
    return best


def test_flow_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        sources = rng.randint(1, 2)
        patterns = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(rng.randint(1, 3))]
        sizes, quotas = [rng.randint(0, 3) for _ in patterns], [rng.randint(0, 6) for _ in range(sources)]
        flow = mixing.route(patterns, sizes, quotas)
        cost = sum(sum(k * k * n for k in range(f // n)) + (f % n) * (f // n) ** 2 for f, n in zip(flow, sizes) if n)
        assert (-sum(flow), cost) == cheapest(patterns, sizes, quotas)


def test_mix_meets_targets_again_and_again(spark, table):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", None]), "x") for i in range(1500)] + [(1, "w w", "a", "x")] * 3 + [(None, None, "b", "x")]
    docs = table("doc_id long, text string, source string, rest string", rows)
    mixed = mixing.mixed_documents(docs)
    told = {r.source: (r.source_size, r.target) for r in mixing.source_table(mixed).collect()}
    taken = {r.source: (r.n, r.most) for r in mixed.groupBy("source").agg(F.sum(F.col("__wl_size") * F.col("__wl_copies")).alias("n"), F.max("__wl_copies").alias("most")).collect()}
    assert list(sorted(told, key=lambda x: (x is None, x))) == ["a", "b", "c", None] and told["a"][1] > told["b"][1]
    for s, (n, target) in told.items():
        assert abs(taken[s][0] - target) <= 0.01 * target + 30 and taken[s][1] <= 3, s
    again = mixing.mixed_documents(docs.orderBy(F.desc("text")))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_overlapping_sources_share_their_documents(spark, table):
    docs = table("doc_id long, text string, source string", [(i, "w " * 10, "a") for i in range(40)])
    both = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    out = mixing.mix(docs, mixing.word_count(F.col("text")), both)
    assert out.columns == [*docs.columns, "__wl_size", "__wl_copies"] and out.filter("__wl_copies between 0 and 3").count() == 40


def test_targets_as_a_table_and_groups_apart(spark):
    rng = random.Random(12)
    for n in (1, 7, 40):
        sizes = [rng.choice([0, 1, 5, 60, 3000]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}" if i < n - 1 else None, x) for i, x in enumerate(sizes)], "source string, size long")
        got = [r.target for r in mixing.target_table(df).orderBy("id").collect()]
        assert got == pytest.approx(mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(n)]))
    patterns = sorted({tuple(sorted(rng.sample([f"a{g}", f"b{g}", f"c{g}"], rng.randint(1, 3)))) for g in range(6) for _ in range(4)} | {("z",)})
    sizes = {p: rng.choice([0, 10, 200]) for p in patterns}
    marked = spark.createDataFrame([(list(p), x) for p, x in sizes.items()], "__wl_pattern array<string>, __wl_size long")
    names = sorted({x for p in patterns for x in p})
    totals = [sum(x for p, x in sizes.items() if s in p) for s in names]
    quotas = [round(t) for t in mixing.targets(totals, [(5, 2, 1)[i % 3] for i in range(len(names))])]
    whole = mixing.route([[names.index(x) for x in p] for p in patterns], [sizes[p] for p in patterns], quotas)
    parts = {tuple(r[0]): r.each * sizes[tuple(r[0])] + r.rest for r in mixing._plan(marked, mixing.WEIGHTS, 3).collect()}
    cost = lambda flow: sum(k * k * max(0, min(f - k * sizes[p], sizes[p])) for p, f in flow.items() for k in range(3))
    assert set(parts) == set(patterns) and sum(parts.values()) == sum(whole) and cost(parts) == cost(dict(zip(patterns, whole)))
