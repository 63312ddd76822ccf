"""Small groups in Python, many per Arrow batch.

Rows are dealt out and sorted by their group, and a task walks through its groups one after another; groups are
bounded by the caller (capped neighbourhoods, subgraphs of groups), so a task holds one of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], Iterable[tuple]], schema: str, order: list[str] | None = None) -> DataFrame:
    """fn(key, rows of the group) -> tuples of schema."""
    names = [part.strip().split(" ")[0] for part in _split(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            if not len(batch):
                continue
            change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            cuts = sorted({0, *change, len(batch)})
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch[keys].iloc[a])
                if key != now:
                    if held:
                        out.extend(fn(now, pd.concat(held) if len(held) > 1 else held[0]))
                    now, held = key, []
                held.append(batch.iloc[a:b])
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            out.extend(fn(now, pd.concat(held) if len(held) > 1 else held[0]))
        yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def map_lists(df: DataFrame, keys: list[str], fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str, order: list[str] | None = None) -> DataFrame:
    """map_groups() for very many small groups: fn(key, rows as tuples of the columns that are no keys); missing numbers are nan."""
    names = [part.strip().split(" ")[0] for part in _split(schema)]
    rest = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, [], []
        for batch in batches:
            for key, row in zip(zip(*[batch[c].tolist() for c in keys]), zip(*[batch[c].tolist() for c in rest])):
                if key != now:
                    if held:
                        out.extend(fn(now, held))
                    now, held = key, []
                held.append(row)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            out.extend(fn(now, held))
        yield pd.DataFrame(out, columns=names)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def _split(schema: str) -> list[str]:
    """The columns of a DDL schema: commas inside <> don't separate."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]
