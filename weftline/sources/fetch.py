"""Pages from a fetching function: retries, isolated failures, a crawl to its end, positions of places.

The function that reaches the network is the caller's; nothing here opens a connection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: attempts of a page, seconds of waiting per attempt made, pages of a crawl
ATTEMPTS, WAIT_S, MOST_PAGES = 5, 3.0, 100


class FetchError(RuntimeError):
    """A page that could not be had in any attempt."""


def with_retries(fetch: Callable[[str], str], url: str, attempts: int = ATTEMPTS, wait_s: float = WAIT_S, sleep: Callable[[float], None] = time.sleep) -> str:
    """What fetch(url) gives; after a failure the wait grows by wait_s each time."""
    for attempt in range(1, attempts + 1):
        try:
            return fetch(url)
        except Exception as e:  # whatever the caller's function raises
            if attempt == attempts:
                raise FetchError(f"{url}: {e}") from e
            sleep(wait_s * attempt)
    raise FetchError(url)


def pages(urls: DataFrame, fetch: Callable[[str], str], attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> DataFrame:
    """(url, html, error) for each row of urls(url); a page that fails is a row with its error, and the rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, with_retries(fetch, url, attempts, wait_s), None))
                except FetchError as e:
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def outcomes(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that came, pages that failed)."""
    return fetched.filter(F.col("error").isNull()), fetched.filter(F.col("error").isNotNull())


def crawl(shown: DataFrame, known: DataFrame) -> DataFrame:
    """(page, place, id) of shown(page, ids) that known(id) lacks, of the pages before the first one that shows nothing
    new to this crawl. Known ids are not given again but count as new the first time they are seen, so they do not end the crawl.

    Where an id is seen first is an aggregate, so pages may be read in any order and many at once. Null ids are no ids."""
    seen = shown.select("page", F.posexplode("ids").alias("place", "id")).filter("id is not null")
    first = seen.groupBy("id").agg(F.min(F.struct("page", "place")).alias("at"))
    idle = shown.select("page").distinct().join(first.select(F.col("at.page").alias("page")), "page", "left_anti")
    end = idle.agg(F.min("page").alias("end"))
    fresh = first.select("at.page", "at.place", "id").crossJoin(end).filter("end is null or page < end")  # one row
    return fresh.join(known.select("id"), "id", "left_anti").select("page", "place", "id")


def geocoded(pending: DataFrame, cache: DataFrame, lookup: Callable[[str], tuple[float, float] | None], per_second: float = 1.0, tasks: int = 1) -> DataFrame:
    """(name, lat, lng) of the names of pending(name) that cache(name) lacks and lookup finds; what it does not find has no row,
    so it is asked again next time. All tasks together keep to the rate: each waits so many times longer."""
    wait_s = tasks / per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            rows = []
            for name in batch["name"]:
                if last is not None:
                    time.sleep(max(0.0, last + wait_s - time.monotonic()))
                last = time.monotonic()
                if place := lookup(name):
                    rows.append((name, *place))
            yield pd.DataFrame(rows, columns=["name", "lat", "lng"])

    return misses(pending, cache).repartition(tasks).mapInPandas(run, "name string, lat double, lng double")


def misses(pending: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct names that the cache lacks; a null name is none."""
    return pending.select("name").filter("name is not null").distinct().join(cache.select("name"), "name", "left_anti")
