"""Row-level rules of what comes in: reports, registry rows, request ids, changes of state.

Every function returns its rows with a `reason`: the first rule that a row breaks, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import GOVERNORATES

#: fixed values
UTILITIES, STATUSES = ("electricity", "water"), ("active", "restored")
PUBLICATION_CLASSES = ("public", "private_research")
ID_PATTERN, CHECKSUM_PATTERN = r"^[a-z0-9][a-z0-9_-]*$", r"^[a-f0-9]{64}$"
REQUEST_ID = r"^[A-Za-z0-9._:-]{1,128}$"
#: fixed values: the changes of a build's status that are allowed
TRANSITIONS = (("building", "completed"), ("building", "failed"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that is broken; a rule that cannot be told is."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for broken, name in rules])


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def validate_report(reports: DataFrame, names: tuple[str, ...] = tuple(g[0] for g in GOVERNORATES)) -> DataFrame:
    """reports(utility, status, governorate, ended_at, ...) with the reason against each."""
    rules = (
        (~F.col("utility").isin(*UTILITIES), "unknown_utility"), (~F.col("status").isin(*STATUSES), "unknown_status"),
        (~F.trim("governorate").isin(*names), "unknown_governorate"), ((F.col("status") == "restored") & F.col("ended_at").isNull(), "restored_without_end"),
    )
    return reports.withColumn("reason", first_reason(*rules))


def validate_sources(sources: DataFrame) -> DataFrame:
    """sources(source_id, title, owner, license_id, publication_class, refresh_policy) with the reason against each."""
    rules = (
        (~F.col("source_id").rlike(ID_PATTERN), "source_id_pattern"), (blank(F.col("title")), "title_required"), (blank(F.col("owner")), "owner_required"),
        (~F.col("publication_class").isin(*PUBLICATION_CLASSES), "unknown_publication_class"), (blank(F.col("refresh_policy")), "refresh_policy_required"),
        ((F.col("publication_class") == "public") & blank(F.col("license_id")), "public_without_license"),
    )
    return sources.withColumn("reason", first_reason(*rules))


def request_id(supplied: Column) -> Column:
    """The id that a caller gave if it keeps to the rule, else null (one is made then)."""
    return F.when(supplied.rlike(REQUEST_ID) & ~supplied.contains("\n"), supplied)


def transitions(states: DataFrame) -> DataFrame:
    """changes(key, before, after, active) with the reason against each: only the listed changes, and none while active."""
    listed = F.lit(False)
    for a, b in TRANSITIONS:
        listed = listed | ((F.col("before") == a) & (F.col("after") == b))
    return states.withColumn("reason", first_reason((F.col("active"), "frozen_while_active"), (~listed, "transition_not_allowed")))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def artifact_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(source_id, path, reason) of artifacts(source_id, path, sha256, size_bytes) that were registered and are not as they were.

    A registered artifact is never changed: other content takes another path. New ones have no row. Null paths and sources compare as equal."""
    there = now.select(F.col("source_id").alias("__s"), F.col("path").alias("__p"), F.col("sha256").alias("__h"), F.col("size_bytes").alias("__b"), F.lit(True).alias("__there"))
    both = before.join(there, F.col("source_id").eqNullSafe(F.col("__s")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    rules = ((F.col("__there").isNull(), "artifact_removed"), (~F.col("sha256").eqNullSafe(F.col("__h")), "checksum_changed"), (~F.col("size_bytes").eqNullSafe(F.col("__b")), "size_changed"))
    return both.withColumn("reason", first_reason(*rules)).filter("reason is not null").select("source_id", "path", "reason")
