import time

import pytest

from weftline.sources import fetch
from weftline.sources.pagesource import PageSource


def page(number):
    if number == 3:
        raise OSError("down")
    return f"<p>{number}</p>" if number < 8 else None


def newest():
    return 7


@pytest.fixture()
def source(spark):
    spark.dataSource.register(PageSource)
    return lambda **options: spark.read.format("pages").options(attempts="2", wait_s="0", **options).load()


def test_pages_in_any_order_with_isolated_failures(source):
    got = {r.page: (r.html, r.error) for r in source(fetch="tests.test_pages:page", last="12", pages_per_task="2").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and got[4] == ("<p>4</p>", None) and got[3][0] is None and "down" in got[3][1]
    assert source(fetch="tests.test_pages:page", newest="tests.test_pages:newest", first="6").count() == 2
    with pytest.raises(Exception, match="one of the options"):
        source().collect()


def test_a_folder_as_a_stream_goes_on_after_a_restart(spark, source, tmp_path):
    land, out, ck = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "ck")
    land.mkdir()

    def go():
        stream = spark.readStream.format("pages").options(folder=str(land)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.page, r.html) for r in spark.read.parquet(out).collect())

    for n in (1, 2, 4):
        (land / f"{n}.html").write_text(f"p{n}")
    assert source(folder=str(land)).count() == 3
    assert go() == [(1, "p1"), (2, "p2"), (4, "p4")]
    (land / "1.html").write_text("changed, but read already")
    (land / "5.html").write_text("p5")
    assert go() == [(1, "p1"), (2, "p2"), (4, "p4"), (5, "p5")] and go() == go()


def test_a_crawl_ends_where_nothing_is_new(spark):
    shown = spark.createDataFrame([(1, ["a", "b", None]), (2, ["b", "c", "k"]), (3, ["k"]), (4, ["d"])], "page int, ids array<string>")
    known = spark.createDataFrame([("k",), ("zz",)], "id string")
    assert sorted(tuple(r) for r in fetch.crawl(shown, known).collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 1, "c")]
    assert fetch.crawl(shown.filter("page <> 3"), known).count() == 4
    assert fetch.crawl(shown.limit(0), known).count() == 0


def test_positions_are_asked_for_at_a_rate(spark):
    pending = spark.createDataFrame([("p",), ("q",), ("p",), ("r",), ("c",), (None,)], "name string")
    cache = spark.createDataFrame([("c", 1.0)], "name string, lat double")
    start = time.monotonic()
    got = fetch.geocoded(pending, cache, {"p": (1.0, 2.0), "c": (0.0, 0.0)}.get, per_second=5.0).collect()
    assert [tuple(r) for r in got] == [("p", 1.0, 2.0)] and time.monotonic() - start >= 0.4
