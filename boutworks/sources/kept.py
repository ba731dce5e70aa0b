"""Prepared bouts and ratings kept as tables, at paths that name the version of their columns and what they cover.

Whoever changes the columns of a kind, or what they mean, raises its version: a table of
an older version is then made anew and never read as one of the new. A table is written
beside its place and moved there whole, so one that could not be made to its end, of
which a part is missing, or which two sessions make at once, is never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boutworks.runtime import discard, finished, move

_TIMES = {"timestamp", "timestamp_ntz", "date"}
#: By kind: the version, and the columns that its tables have at least, with their types.
KINDS = {
    "bouts": (1, {"a": {"string"}, "b": {"string"}, "outcome": {"double"}, "ts": _TIMES}),
    "ratings": (1, {"league": {"string"}, "competitor": {"string"}, "state": {"string"}, "rating": {"double"}, "games": {"bigint"}}),
}


def kept_path(root: str, kind: str, *covers: object) -> str:
    """Where a table of this version is kept; ``covers`` says what is in it, such as a name and the first and last season."""
    parts = [str(c) for c in covers]
    if wrong := [p for p in parts if not re.fullmatch(r"[A-Za-z0-9.-]+", p)]:
        raise ValueError(f"not for a path: {', '.join(wrong)}")
    return f"{root.rstrip('/')}/" + "_".join([kind, f"v{KINDS[kind][0]}", *parts])


def check_columns(table: DataFrame, kind: str) -> DataFrame:
    """``table``, or an error that names the columns of the kind that it lacks or has with another type."""
    has = dict(table.dtypes)
    if wrong := [f"{c} ({has.get(c, 'missing')})" for c, types in KINDS[kind][1].items() if has.get(c) not in types]:
        raise ValueError(f"not a table of {kind}, version {KINDS[kind][0]}: {', '.join(wrong)}")
    return table


def kept(spark: SparkSession, root: str, kind: str, covers: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The kept table, which ``make`` gives where there is none of this version; an error of ``make`` keeps nothing."""
    path = kept_path(root, kind, *covers)
    if not finished(spark, path):
        beside = f"{root.rstrip('/')}/.making-{uuid.uuid4().hex}"
        try:
            check_columns(make(), kind).write.parquet(beside)
            if not move(spark, beside, path) and not finished(spark, path):
                raise RuntimeError(f"what lies at {path} is not a whole table")
        finally:
            discard(spark, beside)
    return check_columns(spark.read.parquet(path), kind)


def kept_tables(spark: SparkSession, root: str) -> list[tuple[str, str, int, list[str]]]:
    """What is kept below ``root``, of any version: path, kind, version and what it covers."""
    found = []
    for path in finished(spark, f"{root.rstrip('/')}/*_v*"):
        kind, version, *covers = path.rsplit("/", 1)[1].split("_")
        if kind in KINDS and re.fullmatch(r"v\d+", version):
            found.append((path, kind, int(version[1:]), covers))
    return found


def drop_older(spark: SparkSession, root: str) -> list[str]:
    """Delete the tables of other versions than the present; their paths."""
    old = [path for path, kind, version, _ in kept_tables(spark, root) if version != KINDS[kind][0]]
    for path in old:
        discard(spark, path)
    return old
