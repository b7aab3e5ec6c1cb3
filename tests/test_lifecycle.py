"""Rollbacks, runs, builds, imports, contracts, fetching and outputs."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import runtime
from weftline.operators import contracts, lifecycle, readiness, serving, state, validation
from weftline.sources import fetch, loaders, sinks


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_rollback_reads_and_refuses(spark):
    states = frame(spark, "notice_id long, active_parse string", (1, "b"), (2, "c"), (3, "f"))
    parses = frame(spark, "parse_id string, notice_id long, parse_status string", ("a", 1, "ok"), ("b", 1, "ok"), ("c", 2, "ok"), ("e", 3, "failed"), ("g", 4, "warning"))
    asked = frame(spark, "rollback_id string, notice_id long, parse_id string", ("r1", 1, "a"), ("r2", 2, "a"), ("r3", 3, "e"), ("r4", 4, "g"), ("r5", 9, "zz"))
    audit = lifecycle.rollback(states, parses, asked)
    assert {r.rollback_id: (r.from_parse, r.refusal) for r in audit.collect()} == {
        "r1": ("b", None), "r2": (None, "parse_of_another_notice"), "r3": (None, "failed_parse"), "r4": (None, "no_state"), "r5": (None, "parse_of_another_notice")
    }
    assert {r.notice_id: r.active_parse for r in lifecycle.rolled_back(states, audit).collect()} == {1: "a", 2: "c", 3: "f"}


def test_pins_follow_the_last_activation(spark):
    builds = spark.sql("select * from values (1L, timestamp'2026-01-01 00:00:00'), (2L, timestamp'2026-01-02 12:00:00'), (3L, timestamp'2026-01-05 00:00:00'), (4L, timestamp'2026-01-06 00:00:00') as t(build_id, created_at)")
    on = spark.sql("select * from values (7L, timestamp'2026-01-02 11:00:00'), (8L, timestamp'2026-01-02 13:00:00'), (9L, timestamp'2026-01-06 00:00:00') as t(canonical_id, activated_at)")
    assert {r.build_id: r.canonical_id for r in lifecycle.pinned(builds, on).collect()} == {1: None, 2: 7, 3: 8, 4: 9}


def test_builds_stay_when_a_step_fails(spark, tmp_path):
    table = state.VersionedTable(str(tmp_path / "t"))
    rows = frame(spark, "unit_id long, governorate string", (1, "A"), (2, "B"))
    known = frame(spark, "key string", ("A",), ("B",))
    assert lifecycle.staged_import(table, "one", rows, F.col("governorate"), known) == "dry run: active build none" and table.active() is None
    assert lifecycle.staged_import(table, "one", rows, F.col("governorate"), known, apply=True) == "activated one"
    with pytest.raises(ValueError, match="unknown governorates: B"):
        lifecycle.staged_import(table, "two", rows, F.col("governorate"), known.filter("key = 'A'"), apply=True)
    assert lifecycle.staged_import(table, "two", rows.limit(0), F.col("governorate"), known, apply=True) == "failed: no rows"
    with pytest.raises(ValueError, match="no edges"):
        lifecycle.rebuild(table, "three", lambda: rows, lambda: "no edges", apply=True)
    assert table.active() == "one" and table.read(spark).count() == 2
    same, other = (frame(spark, "notice_id long, active_parse string", (1, p)) for p in "ab")
    assert lifecycle.rebuild_if_changed(lifecycle.changed_evidence(same, same), table, "four", lambda: rows) is None
    assert lifecycle.rebuild_if_changed(lifecycle.changed_evidence(same, other), table, "four", lambda: rows) == "activated four"
    made = []
    for _ in range(2):
        lifecycle.recluster(table, "four", "2026-07-01-louvain", lambda: made.append(1) or rows)
    assert made == [1]


def test_reparses_append_and_then_find_nothing(spark):
    schema = "notice_id long, snapshot_id string, parse_id string, parser_version string, parsed_at string, parse_status string"
    parses = frame(spark, schema, (1, "s1", "a", "1", "2026-01-01", "ok"), (1, "s1", "b", "2", "2026-01-02", "warning"), (2, "s2", "c", "3", "2026-01-01", "ok"))
    fresh = lifecycle.reparses(parses, "3", "2")
    assert [(r.snapshot_id, r.source_parse) for r in fresh.collect()] == [("s1", "b")]
    after = lifecycle.apply_reparses(parses, fresh, "3", "2026-02-01")
    assert after.count() == 4 and after.filter("parser_version = '3' and snapshot_id = 's1' and parse_status = 'warning'").count() == 1
    assert lifecycle.reparses(after, "3", "2").isEmpty()


def test_pilot_scores_only_of_experimental_runs(spark):
    runs = frame(spark, "run_id string, cluster_id long, rows long, dates long, geography boolean, registered boolean", ("a", 1, 3, 2, True, True), ("b", 1, 3, 1, True, True), ("c", 1, 0, 5, True, True), ("d", 1, 3, 5, False, True), ("e", 1, 3, 5, True, False), ("f", 1, 3, 5, None, True))
    scores = frame(spark, "run_id string, asset_id string", *[(x, f"n{x}") for x in "abcdef"])
    stored, kept = lifecycle.pilot_tables(runs, scores, 8.0, "v1", "now")
    assert {r.run_id: r.status for r in stored.collect()} == {"a": "experimental", **dict.fromkeys("bcdef", "insufficient_evidence")}
    assert [r.run_id for r in kept.collect()] == ["a"] and {r.radius_km for r in stored.collect()} == {8.0}


def test_contracts(spark):
    reports = frame(spark, "utility string, status string, governorate string, ended_at string", ("water", "active", " Tunis ", None), ("gas", "active", "Tunis", None), ("water", "restored", "Tunis", None), ("water", "restored", "Tunis", "x"), ("water", "active", "Nowhere", None), ("water", None, "Tunis", None))
    assert [r.reason for r in contracts.validate_report(reports).collect()] == [None, "unknown_utility", "restored_without_end", None, "unknown_governorate", "unknown_status"]
    ids = frame(spark, "x string", ("a.b:c_d-1",), ("",), ("a" * 128,), ("a" * 129,), ("a b",), ("a\n",), (None,))
    assert [r[0] is not None for r in ids.select(contracts.request_id(F.col("x"))).collect()] == [True, False, True, False, False, False, False]
    changes = frame(spark, "before string, after string, active boolean", ("building", "completed", False), ("completed", "building", False), ("building", "failed", True))
    assert [r.reason for r in contracts.transitions(changes).collect()] == [None, "transition_not_allowed", "frozen_while_active"]


def test_exact_thresholds_pass_and_decide(spark):
    row = frame(spark, "valid_notices long, distinct_outage_dates long, unique_localities long, repeated_pairs long, active_ok_ratio double, largest_notice_pair_share double", (30, 15, 10, 20, 0.8, 0.2))
    operate = lambda ratio, age: frame(spark, "recent_parse_success_ratio double, scrape_freshness double", (ratio, age))
    for ratio, age, decision in ((0.8, 48.0, "published"), (0.8, 48.01, "experimental"), (None, 1.0, "experimental"), (0.9, None, "experimental")):
        assert readiness.decided(readiness.report(row, operate(ratio, age))).first().decision == decision
    assert readiness.decided(readiness.report(row.withColumn("repeated_pairs", F.lit(19)), operate(0.8, 1.0))).first().decision == "blocked"


def test_recall_leaves_unseen_localities_out(spark):
    part = frame(spark, "locality string, cluster long", ("a", 1), ("b", 1), ("c", 2))
    held = frame(spark, "locality_a string, locality_b string", ("a", "b"), ("a", "c"), ("a", "zz"))
    assert validation.holdout_recall(part, held).first() == (2, 1, 0.5)
    assert validation.holdout_recall(part, held.limit(0)).first() == (0, 0, None)


def test_retries_and_isolated_failures(spark):
    waits, calls = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 4:
            raise OSError("down")
        return "page"

    assert fetch.with_retries(flaky, "u", sleep=waits.append) == "page" and waits == [3.0, 6.0, 9.0]
    with pytest.raises(fetch.FetchError):
        fetch.with_retries(lambda u: 1 / 0, "u", sleep=waits.append)
    assert waits[3:] == [3.0, 6.0, 9.0, 12.0]
    got = fetch.pages(frame(spark, "url string", ("a",), ("bad",), ("c",)), lambda u: 1 / 0 if u == "bad" else u * 2, attempts=2, wait_s=0)
    came, failed = fetch.outcomes(got)
    assert sorted(r.html for r in came.collect()) == ["aa", "cc"] and [r.url for r in failed.collect()] == ["bad"]


def test_outputs(spark, tmp_path):
    a, b = frame(spark, "k long, v string", (1, "é"), (2, "y")), frame(spark, "k long, v string", (2, "z"))
    sinks.json_document(str(tmp_path / "x.json"), rows=a.orderBy("k"), name="n")
    assert json.loads((tmp_path / "x.json").read_text()) == {"name": "n", "rows": [{"k": 1, "v": "é"}, {"k": 2, "v": "y"}]}
    for df in (a, b, b):
        sinks.overwrite_partitions(df, str(tmp_path / "p"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "é"), (2, "z")}
    sinks.json_lines(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_listing_and_manifest(spark, tmp_path):
    html = '<div class="x panel y"><h3>avis mark</h3><a href="/fr/news/1">a</a><a href="/fr/news/2">b</a></div><div class="panel"><h3>other</h3><a href="/fr/news/3">c</a></div>'
    assert [r.url for r in loaders.notice_listing(frame(spark, "page_id long, html string", (1, html)), "mark").collect()] == ["/fr/news/1"]
    (tmp_path / "m.yaml").write_text("sources:\n- {id: s1, name: One}\nartifacts:\n- {source_id: s1, path: a.csv, sha256: x, size_bytes: 3}\n- {source_id: s9, path: b.csv}\n")
    sources, artifacts, unknown = loaders.manifest(spark, str(tmp_path / "m.yaml"))
    assert sources.count() == 1 and artifacts.count() == 2 and [r.path for r in unknown.collect()] == ["b.csv"]



def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            pass

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.scratch_root(Session())
    Session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError):
        runtime.scratch_root(Session())
    Session.sparkContext.master = "local[4]"
    assert runtime.scratch_root(Session())


def test_builds_from_the_shell(spark, tmp_path, capsys):
    from weftline.__main__ import main

    data, root = "/root/testdata/sf0.001", str(tmp_path)
    if not loaders.Path(data).is_dir():
        pytest.skip("test tables are not here")
    main(["rebuild", root, data])
    with pytest.raises(SystemExit):
        main(["recluster", root, data, "2026-07-01"])
    main(["rebuild", root, data, "--apply"])
    main(["recluster", root, data, "2026-07-01"])
    main(["recluster", root, data, "2026-07-01"])
    said = capsys.readouterr().out.split("\n")
    assert said[0] == "dry run: active build none" and said[1].startswith("activated ") and said[2:4] == ["activated", "present"]


def test_registered_artifacts_do_not_change(spark):
    schema = "source_id string, path string, sha256 string, size_bytes long"
    before = frame(spark, schema, ("s", "a", "1", 1), ("s", "b", "2", 2), ("s", "c", "3", 3), ("s", "d", None, None), (None, None, "4", 4))
    now = frame(spark, schema, ("s", "a", "1", 1), ("s", "b", "9", 2), ("s", "c", "3", 9), ("s", "new", "5", 5), (None, None, "4", 4))
    assert {(r.path, r.reason) for r in contracts.artifact_changes(before, now).collect()} == {("b", "checksum_changed"), ("c", "size_changed"), ("d", "artifact_removed")}


def test_cleaning_goes_in_batches_and_does_not_fail(spark):
    rows = frame(spark, "id long, at long", *[(i, i // 3) for i in range(11)])
    batches = serving.deletion_batches(rows, "at", "id", 4)
    gone = []
    assert serving.clean(batches, lambda df: gone.append(sorted(r.id for r in df.collect()))) == (3, None) and gone == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
    calls = []

    def broken(df):
        calls.append(df.count())
        if len(calls) == 2:
            raise OSError("locked")

    assert serving.clean(batches, broken) == (1, "OSError: locked") and serving.clean(batches.limit(0), broken) == (0, None)
