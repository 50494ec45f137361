"""Comparison of documents within cells of similar subjects: whole blocks of parties are held against each other as matrices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

KINDS = ("pairs", "counts", "links")


def _incidence(lists: list[list[str]], number: dict[str, int]) -> np.ndarray:
    """A row for each list with 1 at the numbers of its values; values without a number are left out."""
    out = np.zeros((len(lists), max(1, len(number))), dtype=np.float32)
    for i, x in enumerate(lists):
        out[i, [number[t] for t in x if t in number]] = 1
    return out


def _meet(a: list[list[str]], b: list[list[str]], cover: float) -> np.ndarray:
    """Which rows of a and b have parties of which the smaller is covered by the other."""
    left, right = ({p: i for i, p in enumerate(dict.fromkeys(x for p in rows for x in p))} for rows in (a, b))
    of_left, of_right = ([p.split(" ") for p in x] for x in (left, right))
    words = {t: i for i, t in enumerate(dict.fromkeys(t for w in of_left for t in w))}  # others are shared with no party of a
    shared = _incidence(of_left, words) @ _incidence(of_right, words).T
    size = np.minimum(np.array([len(w) for w in of_left])[:, None], np.array([len(w) for w in of_right])[None, :])
    match = (shared.astype(float) / size >= cover).astype(np.float32)
    return (_incidence(a, left) @ match) @ _incidence(b, right).T > 0


def _links(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """(least, other) for every connected part of the hits between numbered left and right."""
    todo = set(np.flatnonzero(hits.any(axis=1)).tolist())
    while todo:
        rows = np.zeros(len(left), dtype=bool)
        rows[todo.pop()] = True
        while True:
            columns = hits[rows].any(axis=0)
            more = hits[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        todo -= set(np.flatnonzero(rows).tolist())
        nodes = np.unique(np.concatenate([left[rows], right[columns]]))
        for x in nodes[1:].tolist():
            yield int(nodes[0]), x


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("k", "ca", "cb", "own", "id", "j", "p")), strict=True)


def met(batches: Iterator[pa.RecordBatch], kind: str, cover: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of rows (k, ca, cb, own, id, j, p) in order of cells: pairs (src, dst, jaccard) with src < dst, their counts (src, n), or links (src, dst) that keep every component whole."""
    out: list[list] = [[] for _ in schema]

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
        for x in out:
            x.clear()
        return made

    for _, cell in groupby(_rows(batches), key=lambda r: r[:3]):
        rows = list(cell)
        a, b = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not a or not b:
            continue
        ids = sorted({r[4] for r in rows})
        number = {x: i for i, x in enumerate(ids)}
        left, right = (np.array([number[r[4]] for r in x]) for x in (a, b))
        hits = _meet([r[6] for r in a], [r[6] for r in b], cover)
        if kind == "links":
            for x, y in _links(hits, left, right):
                out[0].append(ids[x])
                out[1].append(ids[y])
        else:
            hits &= left[:, None] < right[None, :]
            if kind == "counts":
                n = hits.sum(axis=1)
                out[0] += [ids[x] for x in left[n > 0]]
                out[1] += n[n > 0].tolist()
            else:
                x, y = np.nonzero(hits)
                out[0] += [ids[i] for i in left[x]]
                out[1] += [ids[i] for i in right[y]]
                out[2] += [b[i][5] for i in y]
        if len(out[0]) > 100_000:
            yield flush()
    if out[0]:
        yield flush()
