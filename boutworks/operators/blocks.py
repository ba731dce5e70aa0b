"""Fits of large groups by blocks: Newton steps whose conjugate gradients pass numbers, not rows, between blocks.

Competitors (or their days) are numbered and dealt to blocks, a block being one row with
its numbers and results as arrays. A step is one shuffle: a block works out its part of a
vector, sends each other block the numbers that its results there need, and sums over its
own results what arrived. Only sums of a block (and of a group in it) go to the driver. A
competitor's days are solved exactly inside the block, which leaves little to the
gradients, and a block is bounded by ``LINKS``.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutworks.runtime import discard, staged, work_path

#: Results, seen from both sides, that a block holds on average.
LINKS = 200_000
_STATE = "part int, state binary, sums binary"


class Curves:
    """Whole history: a rating for each day, tied to the days beside it. ``value`` of a node is its day's number."""

    centred = False

    def __init__(self, w2: float, initial: float, scale: float) -> None:
        self.w2, self.initial, self.scale, self.cap = w2, initial, scale, 200.0

    def start(self, s: dict, value: np.ndarray) -> None:
        s["x"] = np.full(s["size"], self.initial)
        apart = np.diff(value, prepend=0)
        s["tie"] = np.where(s["first"], 0.0, 1 / (self.w2 * np.maximum(apart, 1)))
        s["anchor"] = s["first"] / self.w2

    def slopes(self, s: dict, chance: np.ndarray) -> None:
        x, tie = s["x"], s["tie"]
        s["g"] = np.bincount(s["own"], s["n"] * (s["score"] - chance) / self.scale, s["size"]) + s["anchor"] * (self.initial - x)
        pull = tie * np.diff(x, prepend=0)
        s["g"] -= pull
        s["g"][:-1] += pull[1:]
        s["h"] = s["n"] * chance * (1 - chance) / self.scale**2
        s["diagonal"] = np.bincount(s["own"], s["h"], s["size"]) + s["anchor"] + tie
        s["diagonal"][:-1] += tie[1:]

    def group_sums(self, s: dict) -> dict:
        return {}

    def gap(self, s: dict, sums: dict) -> np.ndarray:
        return s["g"]


class Strengths:
    """Bradley-Terry: ``won + reg = c e`` with the expected wins e, mean zero and one c for each group. ``value`` of a node is what it won."""

    centred, scale, cap = True, 1.0, 1.0

    def __init__(self, reg: float) -> None:
        self.reg = reg

    def start(self, s: dict, value: np.ndarray) -> None:
        s["x"], s["won"], s["tie"] = np.zeros(s["size"]), value + self.reg, np.zeros(s["size"])

    def slopes(self, s: dict, chance: np.ndarray) -> None:
        own = 1 / (1 + np.exp(-s["x"]))
        s["g"] = np.bincount(s["own"], s["n"] * chance, s["size"]) + 2 * self.reg * own
        s["h"] = s["n"] * chance * (1 - chance)
        s["diagonal"] = np.bincount(s["own"], s["h"], s["size"]) + 2 * self.reg * own * (1 - own)

    def group_sums(self, s: dict) -> dict:
        return _by_group(s, s["won"], s["g"])

    def gap(self, s: dict, sums: dict) -> np.ndarray:
        c = np.array([sums[k][0] / sums[k][1] for k in s["groups"]])[s["group"]]
        return s["won"] / c - s["g"]


def _by_group(s: dict, *columns: np.ndarray) -> dict:
    found = [np.bincount(s["group"], c, len(s["groups"])) for c in (*columns, np.ones(s["size"]))]
    return {k: np.array(v) for k, *v in zip(s["groups"], *found, strict=True)}


def _lines(s: dict, right: np.ndarray) -> np.ndarray:
    """The days of each competitor solved exactly, all competitors at once."""
    tie, starts, longer = s["tie"], s["starts"], s["longer"]
    d, y = s["diagonal"].copy(), right.copy()
    for t in range(1, len(longer)):
        at = starts[: longer[t]] + t
        f = tie[at] / d[at - 1]
        d[at] -= f * tie[at]
        y[at] += f * y[at - 1]
    for t in range(len(longer) - 1, -1, -1):
        at = starts[: longer[t]] + t
        if t + 1 < len(longer):
            on = at[: longer[t + 1]]
            y[on] += tie[on + 1] * y[on + 1]
        y[at] /= d[at]
    return y


def _made(problem, group: pd.DataFrame) -> dict:
    """A block's arrays from rows of nodes (other null) and of results seen from one side."""
    nodes = group[group["other"].isna()].sort_values("id")
    links = group[group["other"].notna()]
    ids, part = nodes["id"].to_numpy(), int(group["part"].iloc[0])
    base, size = int(ids[0]), len(ids)
    other, to = links["other"].to_numpy(dtype=np.int64), links["other_part"].to_numpy(dtype=np.int64)
    own, far = links["id"].to_numpy() - base, to != part
    halo = np.unique(other[far])
    end = np.where(far, size + np.searchsorted(halo, other), other - base)
    came = np.full(len(halo), -1)
    came[np.searchsorted(halo, other[far])] = to[far]
    chain = nodes["chain"].to_numpy()
    first = np.concatenate([[True], chain[1:] != chain[:-1]])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, size))
    order = np.argsort(-lengths, kind="stable")
    groups, at = np.unique(nodes["grp"].to_numpy().astype(str), return_inverse=True)
    s = {
        "base": base, "size": size, "own": own.astype(np.int32), "end": end.astype(np.int32), "n": links["n"].to_numpy(dtype=float), "score": links["score"].to_numpy(dtype=float),
        "halo": len(halo), "from": {int(q): np.flatnonzero(came == q) for q in np.unique(came)}, "to": {int(q): np.unique(own[to == q]) for q in np.unique(to[far])},
        "first": first, "starts": starts[order], "longer": [int((lengths > t).sum()) for t in range(int(lengths.max()))], "groups": groups.tolist(), "group": at,
    }
    problem.start(s, nodes["value"].to_numpy(dtype=float))
    return s


def _moved(problem, s: dict, said: dict) -> np.ndarray:
    """What a block does with the driver's numbers before it sends: a step of the gradients, their begin, or the end of a Newton step."""
    if said["kind"] in ("on", "end"):
        s["d"] = s["d"] + said["far"] * s["p"]
    if said["kind"] == "end":
        mean = np.array([said["means"][k] for k in s["groups"]])[s["group"]] if problem.centred else 0.0
        move = np.clip(s["d"] - mean, -problem.cap, problem.cap)
        s["x"] = s["x"] + move
        s["moved"] = float(np.max(np.abs(move)))
    elif said["kind"] == "begin":
        s["r"] = problem.gap(s, said["sums"])
        s["z"], s["d"] = _lines(s, s["r"]), np.zeros(s["size"])
        s["p"] = s["z"]
    elif said["kind"] == "on":
        s["r"] = s["r"] - said["far"] * s["q"]
        s["z"] = s["z"] - said["far"] * s["y"]
        s["p"] = s["z"] + said["turn"] * s["p"]
    return s["p"] if said["kind"] in ("on", "begin") else s["x"]


def _summed(problem, s: dict, said: dict, halo: np.ndarray) -> dict:
    """What a block does with what arrived; its sums for the driver."""
    if said["kind"] in ("on", "begin"):
        p, tie = s["p"], s["tie"]
        around = np.concatenate([p, halo])[s["end"]]
        q = s["diagonal"] * p - np.bincount(s["own"], s["h"] * around, s["size"])
        q[1:] -= tie[1:] * p[:-1]
        q[:-1] -= tie[1:] * p[1:]
        s["q"], s["y"] = q, _lines(s, q)
        dots = np.array([s["r"] @ s["z"], p @ q, q @ s["z"], q @ s["y"]])
        return {"dots": dots, "groups": _by_group(s, s["x"] + s["d"], p) if problem.centred else {}}  # a cut step may have moved the mean
    x = np.concatenate([s["x"], halo])
    problem.slopes(s, 1 / (1 + np.exp(np.clip((x[s["end"]] - x[s["own"]]) / problem.scale, -700, 700))))
    return {"moved": s.pop("moved", math.inf), "groups": problem.group_sums(s)}


class _Steps:
    def __init__(self, problem, state: DataFrame, parts: int) -> None:
        self.problem, self.parts, self.path, self.state = problem, parts, None, state

    def step(self, said: dict) -> tuple[list[dict], dict]:
        """One step of all blocks; their sums, and those of groups."""
        problem = self.problem

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, state in zip(batch.column("part").to_pylist(), batch.column("state"), strict=True):
                    s = pickle.loads(state.as_buffer())
                    v = _moved(problem, s, said)
                    rows = [(part, part, pickle.dumps(s, 5)), *((q, part, v[at].tobytes()) for q, at in s["to"].items())]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "came", "state"])

        def receive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, {}

            def finished() -> pa.RecordBatch:
                s = pickle.loads(held.pop(now))
                halo = np.empty(s["halo"])
                for q, numbers in held.items():
                    halo[s["from"][q]] = np.frombuffer(numbers)
                sums = _summed(problem, s, said, halo)
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pickle.dumps(s, 5)], pa.binary()), pa.array([pickle.dumps(sums, 5)], pa.binary())], names=["part", "state", "sums"])

            for batch in batches:
                for part, came, state in zip(batch.column("part").to_pylist(), batch.column("came").to_pylist(), batch.column("state").to_pylist(), strict=True):
                    if held and part != now:
                        yield finished()
                        held = {}
                    now = part
                    held[came] = state
            if held:
                yield finished()

        sent = self.state.select("part", "state").mapInArrow(send, "part int, came int, state binary")
        out = sent.repartition(self.parts, "part").sortWithinPartitions("part").mapInArrow(receive, _STATE)
        spark, before = out.sparkSession, self.path
        self.path = work_path(spark, "block-step")
        out.write.parquet(self.path)
        if before:
            discard(spark, before)
        self.state = spark.read.schema(_STATE).parquet(self.path)
        sums = [pickle.loads(bytes(r[0])) for r in self.state.select("sums").collect()]  # a few numbers a block
        groups: dict = defaultdict(float)
        for one in sums:
            for k, v in one["groups"].items():
                groups[k] = groups[k] + v
        return sums, groups


def settle(problem, nodes: DataFrame, links: DataFrame, results: int, precision: float, steps: int) -> DataFrame | None:
    """(id, x) of the nodes; nothing where ``steps`` Newton steps don't settle.

    ``nodes``: id (0, 1, ... in the order of group and chain), grp, chain (days of one competitor, numbered), value.
    ``links``: each of ``results`` results once, as id, other (nodes), n, score (of id).
    """
    parts = max(1, -(-2 * results // LINKS))
    last = nodes.agg(F.max("chain")).first()[0]
    each = -(-(last + 1) // parts)
    placed = staged(nodes.withColumn("part", F.floor(F.col("chain") / each).cast("int")), "block-nodes")
    of = lambda c: placed.select(F.col("id").alias(c), F.col("part").alias(f"_{c}"))
    both = links.join(of("id"), "id").join(of("other"), "other")
    ends = F.explode(F.array(
        F.struct(F.col("_id").alias("part"), F.col("id").alias("id"), F.col("other").alias("other"), F.col("_other").alias("other_part"), F.col("n").cast("double").alias("n"), F.col("score").cast("double").alias("score")),
        F.struct(F.col("_other").alias("part"), F.col("other").alias("id"), F.col("id").alias("other"), F.col("_id").alias("other_part"), F.col("n").cast("double").alias("n"), (1 - F.col("score")).cast("double").alias("score")),
    ))
    rows = both.select(ends.alias("s")).select("s.*").unionByName(placed.select("part", "id", "grp", "chain", F.col("value").cast("double").alias("value")), allowMissingColumns=True)

    def make(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [group["part"].iloc[0]], "state": [pickle.dumps(_made(problem, group), 5)], "sums": [b""]})

    work = _Steps(problem, staged(rows.groupBy("part").applyInPandas(make, _STATE), "blocks"), parts)
    moved, said = math.inf, {"kind": "look"}
    for k in range(steps + 1):
        sums, groups = work.step(said)
        if k:
            moved = max(s["moved"] for s in sums)
            if not math.isfinite(moved):
                return None
            if moved < precision:
                break
        # far from the end a rough solution does
        least, begun, said = (1e-2 if moved > 0.1 * problem.cap else 1e-6), None, {"kind": "begin", "sums": dict(groups)}
        for _ in range(10_000):
            sums, groups = work.step(said)
            rz, pq, qz, qy = sum(s["dots"] for s in sums)
            begun = rz if begun is None else begun
            far = rz / pq if pq > 0 else 0.0
            after = max(rz - 2 * far * qz + far * far * qy, 0.0)
            if after <= least * begun:
                break
            said = {"kind": "on", "far": far, "turn": after / rz}
        else:
            return None
        said = {"kind": "end", "far": far, "means": {g: (v[0] + far * v[1]) / v[2] for g, v in groups.items()}}
    else:
        return None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column("state"):
                s = pickle.loads(state.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(s["base"] + np.arange(s["size"])), pa.array(s["x"])], names=["id", "x"])

    return work.state.mapInArrow(read, "id long, x double")
