"""Durable rating state: export, import and checks."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutworks.operators.systems import Ensemble

VERSION = 1
#: Numbers of a state by system, and how many of the last ones may be null (the day of the last bout).
SHAPES = {"elo": (1, 0), "glicko": (3, 1), "glicko2": (4, 1), "trueskill": (2, 0), "dwz": (2, 0)}


def export_state(ratings: DataFrame, system) -> DataFrame:
    """(league, competitor, document): a JSON document with id, type, version, time of creation, parameters and state."""
    if isinstance(system, Ensemble):
        said = {"members": [{"type": m.name, **dataclasses.asdict(m)} for m in system.members]}
    else:
        said = dataclasses.asdict(system) if dataclasses.is_dataclass(system) else {k: v for k, v in vars(system).items() if isinstance(v, (int, float, str, bool))}
    name = F.sha2(F.concat_ws("\u0001", "league", "competitor", F.lit(system.name), "state").cast("binary"), 256)
    body = F.concat(
        F.lit('{"id": "'), name, F.lit('", "created_at": "'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit(f'", "type": "{system.name}", "version": {VERSION}, "parameters": {json.dumps(said)}, "games": '), F.col("games").cast("string"),
        F.lit(', "rating": '), F.col("rating").cast("string"), F.lit(', "state": '), F.col("state"), F.lit("}"),
    )
    return ratings.select("league", "competitor", body.alias("document"))


def well_formed(state: Column, system) -> Column:
    """Whether a state has the numbers that its system needs."""
    if isinstance(system, Ensemble):
        parts = F.from_json(state, "array<array<double>>")
        own = [well_formed(F.to_json(F.get(parts, F.lit(i))), m) for i, m in enumerate(system.members)]
        ok = F.size(parts) == len(system.members)
        for o in own:
            ok = ok & o
        return F.coalesce(ok, F.lit(False))
    if system.name not in SHAPES and system.name != "ecf":  # a user's: any list
        return F.coalesce(F.get_json_object(state, "$[0]").isNotNull() | (state == "[]"), F.lit(False))
    numbers = F.from_json(state, "array<double>")
    if system.name == "ecf":
        ok = F.size(numbers).between(1, system.periods) & ~F.exists(numbers, lambda x: x.isNull())
    else:
        size, free = SHAPES[system.name]
        ok = (F.size(numbers) == size) & ~F.exists(F.slice(numbers, 1, size - free), lambda x: x.isNull())
    return F.coalesce(ok, F.lit(False))


def older_state(document: Column, system) -> Column:
    """The state of a flat document without a type, as earlier versions wrote them: current values, else initial ones, else a newcomer's."""
    # The names of the fields.
    if system.name not in SHAPES and system.name != "ecf":
        return F.lit(None).cast("string")
    new = system.new()
    number = lambda key: F.get_json_object(document, f"$.{key}").try_cast("double")
    either = lambda what, default: F.coalesce(number(f"current_{what}"), number(f"initial_{what}"), F.lit(float(default)))
    listed = lambda *values: F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(v.cast("string"), F.lit("null")) for v in values]), F.lit("]"))
    none = F.lit(None).cast("double")
    if system.name == "elo":
        return listed(either("rating", new[0]))
    if system.name == "glicko":
        return listed(either("rating", new[0]), either("rd", new[1]), none)
    if system.name == "glicko2":
        mu = F.coalesce(number("current_mu"), (either("rating", system.initial) - 1500) / system.scale)
        phi = F.coalesce(number("current_phi"), either("rd", system.rd) / system.scale)
        return listed(mu, phi, either("volatility", new[2]), none)
    if system.name == "trueskill":
        return listed(either("mu", new[0]), either("sigma", new[1]))
    if system.name == "dwz":
        return listed(either("rating", new[0]), F.coalesce(number("count"), number("initial_count"), F.lit(0.0)).cast("long"))
    if system.name == "ecf":
        return F.coalesce(F.when(F.size(F.from_json(F.get_json_object(document, "$.scores"), "array<double>")) > 0, F.get_json_object(document, "$.scores")), listed(F.coalesce(number("initial_rating"), F.lit(new[0]))))
    return F.lit(None).cast("string")


def _read(documents: DataFrame, system) -> DataFrame:
    """``documents`` with the state, null where it can't be used, and then the reason."""
    doc = lambda path: F.get_json_object("document", path)
    kind, version = doc("$.type"), doc("$.version")
    flat = F.from_json("document", "map<string,string>").isNotNull()
    own, older = doc("$.state"), older_state(F.col("document"), system)
    state = F.when(kind.isNull(), F.when(flat & well_formed(older, system), older)).when((kind == system.name) & (version == str(VERSION)) & well_formed(own, system), own)
    reason = (
        F.when(F.col("document").isNull(), "nothing")
        .when(kind.isNull(), F.when(flat, "older state").otherwise("not a document"))
        .when(kind != system.name, "another type")
        .when(version.eqNullSafe(F.lit(str(VERSION))), "state")
        .otherwise("another version")
    )
    return documents.withColumns({"_state": state, "_reason": F.when(state.isNull(), reason)})


def _imported(read: DataFrame, state: Column) -> DataFrame:
    doc = lambda path: F.get_json_object("document", path)
    return read.select("league", "competitor", state.alias("state"), F.coalesce(doc("$.games").cast("long"), F.lit(0).cast("long")).alias("games"), doc("$.rating").cast("double").alias("rating"))


def import_state(documents: DataFrame, system) -> DataFrame:
    """(league, competitor, state, games, rating).

    A document of another type or version, or whose state lacks a number, is an error. One without a type is read as an older, flat one.
    """
    wrong = F.raise_error(F.concat(F.lit(f"not a {system.name} state of version {VERSION}: "), F.coalesce("document", F.lit("nothing"))))
    return _imported(_read(documents, system), F.coalesce("_state", wrong))


def part_states(documents: DataFrame, system) -> tuple[DataFrame, DataFrame]:
    """What ``import_state`` gives for the documents that can be used, and the others with the reason: league, competitor, document, reason."""
    read = _read(documents, system)
    return _imported(read.where("_state is not null"), F.col("_state")), read.where("_state is null").select("league", "competitor", "document", F.col("_reason").alias("reason"))
