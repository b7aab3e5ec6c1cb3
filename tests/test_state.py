import threading

import pytest

from weftline.operators import state


def together(n, call):
    """What n callers, started at once, get."""
    gate, got = threading.Barrier(n), []

    def run(k):
        gate.wait()
        got.append((k, call(k)))

    work = [threading.Thread(target=run, args=(k,)) for k in range(n)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    return got


def test_one_holder_in_each_of_many_rounds(tmp_path):
    lock = str(tmp_path / "lock")
    for r in range(400):
        won = [k for k, x in together(16, lambda k: state.JobLock(lock).acquire(f"{r}-{k}", 5, now=r * 10.0)) if x]
        assert len(won) == 1
        assert not state.JobLock(lock).acquire("late", 5, now=r * 10.0 + 5) and state.JobLock(lock).log.top()[1]["owner"] == f"{r}-{won[0]}"
    assert len(list(tmp_path.iterdir())) <= state.KEPT_GENERATIONS + 1


def test_renewing_and_taking_over_never_both_succeed(tmp_path):
    for r in range(100):
        lock = str(tmp_path / f"lock{r}")
        assert state.JobLock(lock).acquire("a", 5, now=0.0)
        got = dict(together(8, lambda k: state.JobLock(lock).renew("a", 50, now=9.0) if k == 0 else state.JobLock(lock).acquire(f"b{k}", 5, now=9.0)))
        assert sum(got.values()) == 1


def test_ids_are_handed_out_once(tmp_path):
    path, taken = str(tmp_path / "ids"), []
    for _ in range(30):
        taken += [i for _, s in together(8, lambda k: state.IdAllocator(path, 5).reserve(3)) for i in range(s, s + 3)]
    assert sorted(taken) == list(range(5, 5 + 30 * 8 * 3))


def test_a_late_caller_loses(tmp_path):
    log = state.Generations(state.shared(str(tmp_path)), "x")
    assert log.put(0, {"n": 1})
    for g in range(1, 80):
        assert log.put(g, {"n": g + 1})
    for late in (0, 3, 79):
        assert not log.put(late, {"n": -1}) and log.top() == (80, {"n": 80})


def test_paths_of_spark(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.st.link./s", f"file://{tmp_path}")
    for root in (f"file://{tmp_path}/a", "viewfs://st/s/b"):
        lock = state.JobLock(f"{root}/lock", spark)
        assert lock.acquire("a", 10, now=0.0) and not lock.acquire("b", 10, now=1.0) and lock.release("a") and lock.acquire("b", 10, now=1.0)
        assert len({s for _, s in together(6, lambda k, root=root: state.IdAllocator(f"{root}/ids", 1, spark).reserve(2))}) == 6
        table = state.VersionedTable(f"{root}/t", spark)
        table.write(spark.range(4), "one")
        table.activate("one")
        assert table.read(spark).count() == 4
    assert isinstance(state.shared("viewfs://st/s/b", spark), state._Local)


def test_a_store_refuses_what_is_there(spark, tmp_path):
    files = state._Store(spark, f"file://{tmp_path}/s")
    log = state.Generations(files, "x")
    assert log.top() == (0, {}) and log.put(0, {"a": 1}) and not log.put(0, {"a": 2}) and log.put(1, {"a": 3}) and log.top() == (2, {"a": 3})
    assert sorted(n for n in files.names() if not n.endswith(".crc")) == ["x-000000000001", "x-000000000002"]


def test_of_two_activations_one_counts(spark, tmp_path):
    table = state.VersionedTable(str(tmp_path / "t"))
    for b in ("one", "two"):
        table.write(spark.range(1), b)
    with pytest.raises(ValueError, match="meanwhile"):
        table.activate("one", lambda: table.activate("two"))
    assert table.active() == "two"
