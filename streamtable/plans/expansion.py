"""Transforms by name: a registry of builders with the configuration that each takes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtable.operators import core, grouping


@dataclass(frozen=True)
class Expansion:
    """fields: name -> (Python type, whether it must be given)."""

    urn: str
    fields: dict[str, tuple[type, bool]]
    build: Callable[..., DataFrame]


REGISTRY: dict[str, Expansion] = {}


def transform(urn: str, **fields: tuple[type, bool]):
    """Registers a builder (inputs..., **configuration) -> DataFrame under a name."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if urn in REGISTRY:
            raise ValueError(f"{urn} is registered already")
        REGISTRY[urn] = Expansion(urn, fields, build)
        return build

    return register


def discover() -> dict[str, dict[str, str]]:
    """The configuration of every registered transform, by name."""
    return {urn: {k: t.__name__ + ("" if needed else "?") for k, (t, needed) in e.fields.items()} for urn, e in REGISTRY.items()}


def expand(urn: str, config: dict, *inputs: DataFrame) -> DataFrame:
    """Builds a transform from its name, after checking the configuration against what it declares."""
    if urn not in REGISTRY:
        raise ValueError(f"unknown transform {urn}")
    e = REGISTRY[urn]
    if extra := set(config) - set(e.fields):
        raise ValueError(f"{urn} takes no {', '.join(sorted(extra))}")
    for name, (kind, needed) in e.fields.items():
        if name not in config:
            if needed:
                raise ValueError(f"{urn} needs {name}")
        elif not isinstance(config[name], kind):
            raise TypeError(f"{name} of {urn} must be {kind.__name__}")
    return e.build(*inputs, **config)


@transform("streamtable:top:v1", keys=(list, True), order=(str, True), n=(int, True))
def _top(df: DataFrame, keys: list, order: str, n: int) -> DataFrame:
    return grouping.top_per_key(df, keys, n, F.expr(order).desc(), *[F.col(c) for c in df.columns if c not in keys])


@transform("streamtable:filter:v1", predicate=(str, True))
def _filter(df: DataFrame, predicate: str) -> DataFrame:
    return core.filter_by(df, predicate)


@transform("streamtable:flatten:v1")
def _flatten(*dfs: DataFrame) -> DataFrame:
    return core.flatten(*dfs)


@transform("streamtable:combine:v1", keys=(list, True), combiner=(str, True), value=(str, False), name=(str, False))
def _combine(df: DataFrame, keys: list, combiner: str, value: str = "value", name: str = "value") -> DataFrame:
    return grouping.combine_per_key(df, keys, combiner, value, name)
