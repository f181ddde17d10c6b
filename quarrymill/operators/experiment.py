"""Running a generator over contexts, configurations and seeds; scoring with further metrics; embedding with any encoder.

The hooks are callables that are sent to the Python workers: they must not hold a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facts

_OUT = pa.schema([("config", pa.string()), ("seed", pa.int32()), ("pair_id", pa.string()), ("final", pa.string()), ("error", pa.string())])


def open_tasks(contexts: DataFrame, matrix: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Each context (``pair_id`` and whatever a generator needs) with each row of a matrix (``config``, ``seed``), without those that are done.

    Contexts meet the whole matrix, a stated short list. A context done with an error is open again.
    """
    every = contexts.crossJoin(F.broadcast(matrix))
    if done is None:
        return every
    ok = done.where(F.coalesce("error", F.lit("")) == "").select("config", "seed", "pair_id").distinct()
    return every.join(ok, ["config", "seed", "pair_id"], "left_anti")


def generate(tasks: DataFrame, make: Callable[[int], Callable[[dict], str]], batch: int = 500) -> DataFrame:
    """(``config``, ``seed``, ``pair_id``, ``final``, ``error``) of every task.

    ``make`` gives the generator for a seed, once per task of Spark and seed; the generator takes a row as a
    dictionary. What it raises becomes the row's ``error``, so one failure does not stop the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients: dict[int, Callable[[dict], str]] = {}
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _OUT)], schema=_OUT)
        for b in batches:
            for r in b.to_pylist():
                seed = r["seed"]
                try:
                    if seed not in clients:
                        clients[seed] = make(seed)
                    out, error = clients[seed](r), None
                except Exception as e:  # noqa: BLE001
                    out, error = None, f"{type(e).__name__}: {e}"
                rows.append((r["config"], seed, r["pair_id"], out, error))
                if len(rows) >= batch:
                    yield flush()
                    rows = []
        if rows:
            yield flush()

    return tasks.mapInArrow(run, "config string, seed int, pair_id string, final string, error string")


def filtered(tables: DataFrame, config: str, filters: dict[str, Callable[[DataFrame], DataFrame] | None]) -> DataFrame:
    """Fact tables as a configuration sees them: through its filter, whole without one, none at all for ``None``."""
    f = filters.get(config, lambda t: t)
    return tables.limit(0) if f is None else f(tables)


def without(*families: str) -> Callable[[DataFrame], DataFrame]:
    """A filter that takes families of rows out of fact tables."""
    return lambda t: facts.drop_families(t, *families)


def scored(df: DataFrame, cand: str, ref: str, metrics: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``df`` with a column per metric, a function of candidate and reference columns; null where the candidate is blank, as there is nothing to judge."""
    blank = F.trim(F.coalesce(cand, F.lit(""))) == ""
    return df.withColumns({name: F.when(~blank, f(F.col(cand), F.col(ref))) for name, f in metrics.items()})


def text_metric(f: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A plain function of two texts as a metric over Arrow batches; null texts count as empty."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run


def embedded(units: DataFrame, encode: Callable[[list[str]], list[list[float]]], views: tuple[str, ...] = ("code", "ast", "cfg")) -> DataFrame:
    """(``pair_id``, ``view``, ``embedding``) of the views that are not blank; ``encode`` takes a batch of texts."""

    @F.arrow_udf("array<float>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([list(map(float, v)) for v in encode([x or "" for x in col.to_pylist()])], pa.list_(pa.float32()))

    long = units.select("pair_id", F.explode(F.map_filter("views", lambda k, v: k.isin(*views) & (F.trim(F.coalesce(v, F.lit(""))) != ""))).alias("view", "text"))
    return long.select("pair_id", "view", run("text").alias("embedding"))
