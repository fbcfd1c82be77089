"""Model calls as operators: the callable is the caller's, batches are Arrow's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelError(Exception):
    """``fatal`` where no later attempt can help, as with a refused key."""

    def __init__(self, error_class: str, fatal: bool = False) -> None:
        super().__init__(error_class)
        self.error_class, self.fatal = error_class, fatal


def failure_of(status: int | None) -> ModelError | None:
    """What a reply's status means: none at all is the transport's, 401 and 403 are refused keys, others not from 200 to 299 the model's."""
    if status is None:
        return ModelError("model-transport")
    if status in (401, 403):
        return ModelError("model-auth", fatal=True)
    return None if 200 <= status <= 299 else ModelError("model-status")


def _called(df: DataFrame, inputs: tuple[str, ...], call: Callable[[list], Sequence], kind: str, name: str, batch: int) -> DataFrame:
    columns = df.columns

    def run(frames):
        for frame in frames:
            values: list = [None] * len(frame)
            errors: list = [None] * len(frame)
            fatal: list = [None] * len(frame)
            given = list(frame[inputs[0]]) if len(inputs) == 1 else list(zip(*(frame[c] for c in inputs), strict=True))
            there = [k for k, x in enumerate(given) if not (x is None or isinstance(x, float) and x != x)]
            for at in range(0, len(there), batch):
                some = there[at : at + batch]
                try:
                    got = list(call([given[k] for k in some]))
                    if len(got) != len(some):
                        raise ModelError("model-reply")
                    for k, v in zip(some, got, strict=True):
                        values[k] = v
                except Exception as e:  # a failed call is its rows' outcome
                    for k in some:
                        errors[k], fatal[k] = getattr(e, "error_class", None) or "model-transport", bool(getattr(e, "fatal", False))
            yield frame.assign(**{name: pd.Series(values, index=frame.index, dtype=object), "error_class": pd.Series(errors, index=frame.index, dtype=object), "fatal": pd.Series(fatal, index=frame.index, dtype=object)})

    schema = df.select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast(kind).alias(name), F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("boolean").alias("fatal")).schema
    return df.mapInPandas(run, schema)


def complete(df: DataFrame, prompt: str, call: Callable[[list[str]], Sequence[str]], batch: int = 16) -> DataFrame:
    """Adds reply, error_class and fatal: ``call`` takes a list of prompts and gives a reply for each, in order.

    Null prompts are not sent. Where a call raises, its rows have no reply but the exception's class; they can be tried
    again. A task that is lost calls again, so calls should be safe to repeat.
    """
    return _called(df, (prompt,), call, "string", "reply", batch)


def embed(df: DataFrame, text: str, call: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 64) -> DataFrame:
    """Adds embedding, error_class and fatal: ``call`` takes a list of texts and gives a vector for each, in order."""
    return _called(df, (text,), lambda texts: [[float(x) for x in v] for v in call(texts)], "array<double>", "embedding", batch)
