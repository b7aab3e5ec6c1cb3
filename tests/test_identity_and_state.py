import itertools
import random
from collections import Counter

import pytest

from weftline.operators import identity, serving
from weftline.operators.components import connected_components
from weftline.operators.state import IdAllocator, JobLock, VersionedTable


def members(spark, clusters):
    return spark.createDataFrame([(m, c) for c, ms in clusters.items() for m in ms], "locality string, cluster_id int")


@pytest.mark.parametrize(
    "old, new, threshold, expected",
    [
        ({7: "ABCD"}, {0: "ABC", 1: "DE"}, 0.5, {0: 7, 1: 99}),
        ({7: "ABC"}, {0: "AXY"}, 0.5, {0: 99}),
        ({10: "abcd", 11: "p"}, {0: "abp", 1: "cd"}, 0.3, {0: 11, 1: 10}),
        ({10: "abcd", 11: "p"}, {0: "abp", 1: "cd"}, 0.5, {0: 99, 1: 10}),
    ],
)
def test_id_matching(spark, old, new, threshold, expected):
    assert {r.new_id: r.stable_id for r in identity.match_ids(members(spark, new), members(spark, old), 99, threshold).collect()} == expected


def test_ties_and_fresh_ids(spark):
    new, old = members(spark, {3: "ab", 4: "cd", 9: "xy", 8: "pq"}), members(spark, {7: "abcd"})
    assert {r.new_id: r.stable_id for r in identity.match_ids(new, old, 50).collect()} == {3: 7, 4: 50, 8: 51, 9: 52}


def test_twenty_thousand_clusters(spark):
    rng = random.Random(4)
    now, then = [], []
    for c in range(20_000):  # most lose or gain a member, some are halved, some join the next one
        own = [f"m{c}-{i}" for i in range(rng.randint(2, 6))]
        then += [(m, c) for m in own]
        kind = rng.random()
        now += [(m, 3 * c + (kind < 0.1 and i % 2) - 3 * (kind > 0.95 and c > 0)) for i, m in enumerate(own)] + [(f"n{c}", 3 * c)]
    schema = "locality string, cluster_id int"
    got = {r.new_id: r.stable_id for r in identity.match_ids(spark.createDataFrame(now, schema), spark.createDataFrame(then, schema), 10**6).collect()}
    size, before, shared = Counter(c for _, c in now), Counter(c for _, c in then), Counter()
    home = dict(then)
    for m, c in now:
        if m in home:
            shared[c, home[m]] += 1
    pairs = sorted(((n * 10**9 // (size[c] + before[o] - n), c, o) for (c, o), n in shared.items() if 2 * n >= size[c] + before[o] - n), key=lambda x: (-x[0], x[1:]))
    expected, used = {}, set()
    for _, c, o in pairs:  # groups are stars: the heaviest pair first is best
        if c not in expected and o not in used:
            expected[c] = o
            used.add(o)
    for k, c in enumerate(sorted(set(size) - set(expected))):
        expected[c] = 10**6 + k
    assert got == expected


def test_matching_has_the_largest_weight():
    rng = random.Random(2)
    for _ in range(200):
        table = [[rng.choice([0, 0, rng.randint(1, 20)]) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        width = max(map(len, table))
        table = [r + [0] * (width - len(r)) for r in table]
        got = sum(table[i][j] for i, j in enumerate(identity.best_matching(table)) if j >= 0)
        cols = list(range(width)) + [None] * len(table)
        assert got == max(sum(table[i][j] for i, j in enumerate(p) if j is not None) for p in itertools.permutations(cols, len(table)))


def test_roles(spark):
    new, old = members(spark, {0: "ABCD"}), members(spark, {7: "AB", 8: "CD"})
    rows = identity.lineage(new, old, spark.createDataFrame([(0, 7)], "new_id int, old_id int")).collect()
    assert {(r.old_id, r.role) for r in rows} == {(7, "inherited"), (8, "merged")}


def test_stability(spark):
    rows = [(d, m, 0) for d in ("2026-01-01", "2026-01-02") for m in "ab"] + [("2026-01-02", "c", 1)]
    found = {r.locality: r.stability for r in identity.stability(spark.createDataFrame(rows, "run_date string, locality string, cluster_id int")).collect()}
    assert found == {"a": 1.0, "b": 1.0, "c": 0.0}


@pytest.mark.parametrize("few", [0, 20_000])
def test_components(spark, monkeypatch, few):
    import weftline.operators.components as c

    monkeypatch.setattr(c, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(5, 5), (100, 90), (90, 95)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: i // 10 * 10 for i in range(40)}, 100: 90, 90: 90, 95: 90}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lock(tmp_path):
    lock = JobLock(str(tmp_path / "lock"))
    assert lock.acquire("a", 10, now=0) and not lock.acquire("b", 10, now=10) and lock.acquire("b", 10, now=10.1)
    assert not lock.release("a") and not lock.renew("a", 5) and lock.renew("b", 5, now=11) and lock.release("b")


def test_allocator_spends_reservations(tmp_path):
    ids = IdAllocator(str(tmp_path / "ids"), first=5)
    assert [ids.reserve(3), ids.reserve(0), ids.reserve(2), ids.reserve(1)] == [5, 8, 8, 10]


def test_versions(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"))
    assert table.read(spark) is None
    table.write(spark.range(3), "b1")
    with pytest.raises(ValueError, match="completed"):
        table.activate("b2")
    with pytest.raises(ValueError, match="not published"):
        table.activate("b1", lambda: "not published")
    table.activate("b1")
    table.write(spark.range(5), "b2")
    assert table.read(spark).count() == 3
    table.activate("b2")
    assert table.read(spark).count() == 5


def test_cursor_and_clamp():
    assert serving.decode_cursor(serving.encode_cursor("2026-01-01T00:00:00Z", "x")) == ("2026-01-01T00:00:00Z", "x")
    with pytest.raises(ValueError):
        serving.decode_cursor("!!")
    assert [serving.clamp(x) for x in (0, 7, 900)] == [1, 7, 500]
