"""Groups out of partitions that are sorted by group, without one Python call and one data frame for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of consecutive rows of equal keys, as arrays by column.  A group is held whole, so it has to be bounded."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        b = b.reset_index(drop=True)
        new = np.zeros(len(b), bool)
        for k in keys:
            x = b[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        new[0] = bool(held) and any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys)
        cut = np.flatnonzero(new)
        if len(cut):
            held.append(b.iloc[: cut[0]])
            yield from _split(pd.concat(held) if len(held) > 1 else held[0], [])
            cols = {c: b[c].to_numpy() for c in b.columns}
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                yield {c: v[x:y] for c, v in cols.items()}
            held = [b.iloc[cut[-1] :]]
        else:
            held.append(b)
    if held:
        yield from _split(pd.concat(held), [])


def _split(b: pd.DataFrame, _: list) -> Iterator[dict[str, np.ndarray]]:
    if len(b):
        yield {c: b[c].to_numpy() for c in b.columns}
