"""Whole lists of an index, out of Arrow batches that are sorted by its keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_lists(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of batches anew, cut only where keys change. A list that goes over many batches is put together once."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy() for k in keys]
        last = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = int(len(batch) - last[::-1].argmin()) if not last.all() else 0
        if cut or held and any(held[-1][k].iat[-1] != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of two or more rows with equal keys."""
    changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(np.r_[True, changes])
    ends = np.r_[starts[1:], len(columns[0])]
    several = ends - starts > 1
    return list(zip(starts[several].tolist(), ends[several].tolist(), strict=True))
