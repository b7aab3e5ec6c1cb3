import json
import random
from datetime import datetime, timedelta

import pytest

from weftline.operators.upsert import BucketedTable
from weftline.streaming import ingest, upsert

SCHEMA = "k long, at long, v string, n long"


def table(spark, root, buckets=8):
    return BucketedTable(root, spark, SCHEMA, ["k"], ["at", "v"], ["n"], buckets)


def test_batches_equal_the_whole(spark, tmp_path):
    rng, rows, root = random.Random(3), [], str(tmp_path / "t")
    for number in range(4):
        batch = [(rng.choice([None, *range(30)]), rng.randint(0, 9), rng.choice("abc"), rng.randint(1, 5)) for _ in range(rng.randint(1, 25))]
        rows += batch
        assert table(spark, root).upsert(spark.createDataFrame(batch, SCHEMA), "s", number)
        assert table(spark, root).upsert(spark.createDataFrame(batch, SCHEMA), "s", number) == []  # a replay
        expected = {}
        for k, at, v, n in rows:
            old = expected.get(k, (-1, "", 0))
            expected[k] = (*max(old[:2], (at, v)), old[2] + n)
        assert {r.k: (r.at, r.v, r.n) for r in table(spark, root).read().collect()} == expected
    keys = spark.createDataFrame([(3,), (3,), (99,)], "k long")
    assert {r.k for r in table(spark, root).lookup(keys).collect()} <= {3}


def test_only_touched_buckets_move(spark, tmp_path):
    own = table(spark, str(tmp_path / "t"))
    own.upsert(spark.createDataFrame([(k, 1, "a", 1) for k in range(60)], SCHEMA))
    before = own._manifest()[1]["folders"]
    met = own.upsert(spark.createDataFrame([(5, 2, "b", 1), (5, 0, "z", 1)], SCHEMA))
    after = own._manifest()[1]["folders"]
    assert len(met) == 1 and [b for b in before if before[b] != after[b]] == [str(met[0])]
    assert own.read().filter("k = 5").first() == (5, 2, "b", 3) and own.read().count() == 60 and own.unused() == []
    with pytest.raises(ValueError, match="8 buckets"):
        table(spark, str(tmp_path / "t"), 4).read()
    late = table(spark, str(tmp_path / "t"))
    seen = late._manifest()
    own.upsert(spark.createDataFrame([(6, 2, "b", 1)], SCHEMA))
    late._manifest = lambda: seen
    with pytest.raises(RuntimeError, match="meanwhile"):
        late.upsert(spark.createDataFrame([(7, 2, "b", 1)], SCHEMA))


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    own = table(spark, str(tmp_path / "t"))
    assert own.upsert(spark.createDataFrame([], SCHEMA), "s", 0) == [] and own.read().count() == 0


START = datetime(2026, 1, 1)


def test_notices_as_a_stream(spark, tmp_path):
    land, root, ck = tmp_path / "land", str(tmp_path / "t"), str(tmp_path / "ck")
    land.mkdir()
    rng, rows = random.Random(1), []

    def put(name, batch):
        rows.extend(batch)
        (land / name).write_text("\n".join(json.dumps({"notice_id": k, "url": "u", "raw_html": h, "fetched_at": (START + timedelta(hours=t)).isoformat()}) for k, h, t in batch))

    def go():
        upsert.run(ingest.landed(spark, str(land)), root, ck, buckets=4).awaitTermination()
        return {r.notice_id: r for r in upsert.notice_table(spark, root, 4).read().collect()}

    def check(found):
        assert set(found) == {k for k, *_ in rows if k}
        for k, r in found.items():
            own = [(t, h) for n, h, t in rows if n == k]
            firsts = {}
            for t, h in sorted(own):
                firsts.setdefault(h, t)
            assert (r.seen, r.version, r.last_seen) == (len(own), len(firsts), START + timedelta(hours=max(own)[0]))
            assert r.raw_html in firsts

    put("1.json", [("a", "<1>", 0), ("b", "<x>", 0), (None, "?", 0)])
    found = go()
    check(found)
    put("2.json", [("a", "<1>", 5), ("b", "<y>", 1), ("c", "<z>", 2)])  # a replay, newer content, a new notice
    again = go()
    check(again)
    assert again["a"].raw_html == "<1>" and again["a"].seen == 2 and again["b"].raw_html == "<y>" and again["a"].snapshot_id == found["a"].snapshot_id
    put("3.json", [("b", "<older>", -9), ("a", "<2>", 6)])
    last = go()  # each start goes on from the checkpoint
    check(last)
    assert last["b"].raw_html == "<y>" and last["b"].version == 3 and last["a"].raw_html == "<2>"
    assert go() == last  # nothing has landed
