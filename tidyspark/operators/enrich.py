"""Lookups of one dimension in several roles.

The key must be unique in the dimension, else an inner join multiplies rows: ``sources.files.unique_key`` makes sure. The
default strategy leaves the choice to Spark, which broadcasts a dimension of known small size and shuffles a large one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAIRS = 250_000


def _role(dim: DataFrame, key: str, labels: dict[str, str], role: str) -> DataFrame:
    return dim.select(F.col(key).alias(f"_{role}_key"), *(F.col(c).alias(f"{role}_{as_}") for c, as_ in labels.items()))


def lookup(df: DataFrame, dim: DataFrame, on: str, key: str, labels: dict[str, str], role: str, strategy: str | None = None) -> DataFrame:
    """df with the labels of the dimension row that ``on`` names; rows without one go. strategy: a join hint, such as merge."""
    side = _role(dim, key, labels, role)
    side = side.hint(strategy) if strategy else side
    return df.join(side, F.col(f"`{on}`") == F.col(f"_{role}_key")).drop(f"_{role}_key")


def pair_dimension(dim: DataFrame, key: str, labels: dict[str, str], roles: tuple[str, str]) -> DataFrame:
    """Every pair of dimension rows, for at most ``MOST_PAIRS`` pairs."""
    n = dim.count()
    if n * n > MOST_PAIRS:
        raise ValueError(f"{n} dimension rows make too many pairs")
    return _role(dim, key, labels, roles[0]).crossJoin(_role(dim, key, labels, roles[1]))


def composite_lookup(df: DataFrame, dim: DataFrame, on: tuple[str, str], key: str, labels: dict[str, str], roles: tuple[str, str]) -> DataFrame:
    """Both roles by one join on both keys."""
    pairs = pair_dimension(dim, key, labels, roles)
    keys = [f"_{r}_key" for r in roles]
    return df.join(pairs, (F.col(f"`{on[0]}`") == F.col(keys[0])) & (F.col(f"`{on[1]}`") == F.col(keys[1]))).drop(*keys)
