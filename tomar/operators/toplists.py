"""Best records of each query, scored where the records are: no pair of a query and a record is ever a row.

Scores are exact, over all terms of a query. Records below a query's last place so far are left out before they are put in order, and
a batch is left out for a query only where no record of it could reach that place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .featured import tokenised

_MARGIN = 1e-8


class Small:
    """A small index as arrays: rows (term, id, idf, w, group), one a posting."""

    def __init__(self, rows: list) -> None:
        self.columns = sorted({(r["id"], r["group"]) for r in rows}, key=lambda x: (x[0], x[1] is None, x[1] or ""))
        self.term: dict[str, int] = {}
        at = np.array([self.term.setdefault(r["term"], len(self.term)) for r in rows], dtype=np.int64)
        self.idf = np.zeros(len(self.term))
        self.idf[at] = [r["idf"] for r in rows]
        place = {c: i for i, c in enumerate(self.columns)}
        order = np.argsort(at, kind="stable")
        self.posted = np.array([place[r["id"], r["group"]] for r in rows], dtype=np.int64)[order]
        self.weight = np.array([r["w"] for r in rows], dtype=float)[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.term) + 1))

    def best(self, text: str, n: int, saturation: float) -> list[dict]:
        """(rank, group, similarity) of the n groups with the best records, ties by the records' ids."""
        count = Counter(map(self.term.get, tokenised(text)))
        count.pop(None, None)
        if not count:
            return []
        terms = np.fromiter(count.keys(), dtype=np.int64, count=len(count))
        times = np.fromiter(count.values(), dtype=float, count=len(count))
        size = self.start[terms + 1] - self.start[terms]
        ends = np.cumsum(size)
        entry = np.repeat(self.start[terms] - (ends - size), size) + np.arange(ends[-1])
        score = np.bincount(self.posted[entry], np.repeat(times, size) * self.weight[entry], len(self.columns))
        able = np.flatnonzero(score > 0)
        s = np.round(np.minimum(1.0, score[able] / (saturation * self.idf[terms].sum())), 9)
        groups: dict = {}
        for j in np.argsort(-s, kind="stable"):
            groups.setdefault(self.columns[able[j]][1], float(s[j]))
            if len(groups) == n:
                break
        return [{"rank": i, "group": g, "similarity": x} for i, (g, x) in enumerate(groups.items(), 1)]


class Asked:
    """Queries as arrays: rows (qid, source, text, mass, terms, weights), weights being qtf x idf."""

    def __init__(self, rows: list) -> None:
        self.term: dict[str, int] = {}
        self.rows = []
        for r in rows:
            at = np.array([self.term.setdefault(t, len(self.term)) for t in r["terms"]], dtype=np.int64)
            self.rows.append((r["qid"], r["source"], r["text"], r["mass"], at, np.array(r["weights"], dtype=float)))


def _sortable(ids: pa.Array) -> np.ndarray:
    own = ids.to_numpy(zero_copy_only=False)
    return np.unique(own, return_inverse=True)[1] if own.dtype == object else own


def best(batches: Iterator[pa.RecordBatch], asked: Asked, avgdl: float, n: int, k1: float, b: float, saturation: float, least: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(qid, id, source, group, similarity): for each query the best records of the n best groups among batches(id, source, group, text, tokens)."""
    width = len(asked.term)
    found: list[dict] = [{} for _ in asked.rows]  # group -> (-similarity, id, source)
    bound = [least] * len(asked.rows)
    for batch in batches:
        lists = batch.column("tokens").combine_chunks() if isinstance(batch.column("tokens"), pa.ChunkedArray) else batch.column("tokens")
        length = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            continue
        known = np.array([asked.term.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        rows = np.repeat(np.arange(len(length)), length)[known >= 0]
        key, tf = np.unique(rows * width + known[known >= 0], return_counts=True)
        row, col = key // width, key % width
        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avgdl))
        by_term = np.argsort(col, kind="stable")
        posted, weight = row[by_term], w[by_term]
        start = np.searchsorted(col[by_term], np.arange(width + 1))
        most = np.zeros(width)
        np.maximum.at(most, col, w)
        ids, order_id = batch.column("id"), _sortable(batch.column("id"))
        source, group, text = (batch.column(c) for c in ("source", "group", "text"))
        for i, (_, q_source, q_text, mass, terms, weights) in enumerate(asked.rows):
            full = saturation * mass
            size = start[terms + 1] - start[terms]
            ends = np.cumsum(size)
            if not ends[-1] or weights @ most[terms] < (bound[i] - _MARGIN) * full:
                continue
            entry = np.repeat(start[terms] - (ends - size), size) + np.arange(ends[-1])
            score = np.bincount(posted[entry], np.repeat(weights, size) * weight[entry], len(length))
            c = np.flatnonzero(score >= (bound[i] - _MARGIN) * full)
            s = np.round(np.minimum(1.0, score[c] / full), 9)
            keep = s >= bound[i]
            c, s = c[keep], s[keep]
            mine = found[i]
            for share in (64, len(c)):
                if len(c) > share:
                    some = s >= np.partition(s, len(s) - share)[len(s) - share]
                    cc, ss = c[some], s[some]
                else:
                    cc, ss = c, s
                here: set = set()
                for j in np.lexsort((order_id[cc], -ss)):
                    r = int(cc[j])
                    src, txt = source[r].as_py(), text[r].as_py()
                    if txt is None or txt == q_text or (src and src == q_source):
                        continue
                    g = group[r].as_py()
                    if g in here:
                        continue
                    here.add(g)
                    new = (-float(ss[j]), ids[r].as_py(), src)
                    if g not in mine or new[:2] < mine[g][:2]:
                        mine[g] = new
                    if len(here) == n:
                        break
                if len(here) == n or len(cc) == len(c):
                    break
            if len(mine) >= n:
                mine = found[i] = dict(sorted(mine.items(), key=lambda x: x[1][:2])[:n])
                if len(mine) == n:
                    bound[i] = max(least, -max(x[0] for x in mine.values()))
    out = [(q[0], x[1], x[2], g, -x[0]) for q, mine in zip(asked.rows, found, strict=True) for g, x in mine.items()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
