"""Systems by name: those of the library and those that users register.

A step system is a class whose instances have ``name``, ``new``, ``rating``, ``spread``,
``expected`` and ``play`` (see ``systems``); a fit derives from ``models.Fit``. Registered
ones replay, stream, export, import and are evaluated like the library's own. Instances
travel to the workers by pickling; a class that lives in a module of the user's must be
importable there (``spark.addArtifacts`` or ``sparkContext.addPyFile``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from boutworks.operators.models import FITS, Fit
from boutworks.operators.systems import SYSTEMS

STEP_METHODS = ("new", "rating", "spread", "expected", "play")


def register(kind: type) -> type:
    """Add a class under its ``name``; usable as a decorator. What the interface lacks, or a name in use, is an error."""
    name = getattr(kind, "name", None)
    if not isinstance(name, str) or not name:
        raise TypeError("a system needs a name")
    if name in SYSTEMS or name in FITS:
        raise ValueError(f"there is a system {name} already")
    if issubclass(kind, Fit):
        if kind.expected_column is Fit.expected_column or (kind.fit is Fit.fit and not kind.pair_fit):
            raise TypeError("a fit needs fit (or pair_fit) and expected_column")
        FITS[name] = kind
        return kind
    if missing := [m for m in STEP_METHODS if not callable(getattr(kind, m, None))]:
        raise TypeError(f"{name} lacks {', '.join(missing)}")
    try:
        system = kind()
        a, b = system.new(), system.new()
        said = system.expected(a, b)
        system.play(a, b, 1.0, None, None)
        float(system.rating(a))
    except Exception as e:
        raise TypeError(f"{name} can't play a bout of two newcomers: {e}") from e
    if not isinstance(a, list) or not 0 <= said <= 1:
        raise TypeError(f"{name}: states must be lists, and predictions in [0, 1]")
    SYSTEMS[name] = kind
    return kind


def unregister(name: str) -> None:
    SYSTEMS.pop(name, None)
    FITS.pop(name, None)


def list_systems() -> list[str]:
    return sorted({**SYSTEMS, **FITS})


def system_named(name: str, **parameters):
    kind = {**SYSTEMS, **FITS}.get(name)
    if kind is None:
        raise ValueError(f"unknown system {name}; there are {', '.join(list_systems())}")
    return kind(**parameters)


def compared(bouts: DataFrame, decide: Callable[[pa.RecordBatch], pa.Array], columns: list[str] | None = None) -> DataFrame:
    """``bouts`` with ``outcome`` from a comparison of Arrow batches: true is a win of a, false of b, null a draw.

    ``decide`` sees ``columns``, all by default. Where a column expression can say it, ``outcomes.outcome_of`` is cheaper.
    """
    keep = [f for f in bouts.schema.fields if f.name != "outcome"]
    seen = columns or [f.name for f in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = decide(batch.select(seen)).to_pylist()
            if len(said) != batch.num_rows:
                raise ValueError("a comparison must say something of each bout")
            outcome = [0.5 if s is None else 1.0 if s else 0.0 for s in said]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(outcome, pa.float64())], names=[*(f.name for f in keep), "outcome"])

    return bouts.select(*[f.name for f in keep]).mapInArrow(run, T.StructType([*keep, T.StructField("outcome", T.DoubleType())]))
