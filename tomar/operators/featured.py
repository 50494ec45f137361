"""Features of tokenised documents counted in the Arrow batch, so that no row of a document and a feature is shuffled.

Texts are tokenised here too, as in ``tomar.functions.text.tokens``: each token of a task is looked at once. The features of a token are
the token and its boundary-marked 3-grams, as in ``tomar.functions.text.features``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tomar.functions.text import STOP_WORDS, TOKEN

#: Tokens that are counted at once, and features that a task keeps numbered.
_TOKENS, _KEPT = 200_000, 500_000
_TOKEN = re.compile(TOKEN.removesuffix("+") + "{2,}")


def tokenised(text: str) -> list[str]:
    """The tokens of a text with the stop-words, which have no features."""
    return _TOKEN.findall(text.replace("İ", "i").replace("I", "ı").lower())


class Numbered:
    """Features by number, with the numbers of each token's features."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.of: dict[str, list[int]] = {w: [] for w in STOP_WORDS}

    def features(self, token: str) -> list[int]:
        own = self.of.get(token)
        if own is None:
            marked = f"<{token}>"
            names = [token, *("c3:" + marked[i : i + 3] for i in range(len(token)))]
            own = self.of[token] = [self.number.setdefault(x, len(self.number)) for x in names]
            self.names += [x for x in dict.fromkeys(names) if self.number[x] >= len(self.names)]
        return own


def _counts(texts: pa.Array, numbered: Numbered) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, feature, tf) by document, in blocks of whole documents; a document is its place in texts."""
    lists = [tokenised(t or "") for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))])
    coded = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
    code = coded.indices.to_numpy()
    own = [numbered.features(t) for t in coded.dictionary.to_pylist()]
    size = np.array([len(x) for x in own], dtype=np.int64)
    flat, start = np.fromiter(chain.from_iterable(own), dtype=np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]) if len(own) else size
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _TOKENS, side="right")) - 1)
        tokens = code[offsets[first] : offsets[last]]
        able = size[tokens] > 0
        if able.any():
            doc, tokens = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))[able], tokens[able]
            pair, times = np.unique(doc * len(own) + tokens, return_counts=True)
            token = pair % len(own)
            n = size[token]
            ends = np.cumsum(n)
            feature = flat[np.repeat(start[token] - (ends - n), n) + np.arange(ends[-1])]
            key = np.repeat(pair // len(own), n) * len(numbered.names) + feature
            order = np.argsort(key)
            key = key[order]
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tf = np.add.reduceat(np.repeat(times, n)[order], begins)
            yield key[begins] // len(numbered.names), key[begins] % len(numbered.names), tf
        first = last


def learned(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(class, feature, df, s): documents and sums of 1 + ln tf by class and feature, for each batch(class, text)."""
    numbered = Numbered()
    for batch in batches:
        coded = batch.column("class").dictionary_encode()
        kind, kinds = coded.indices.to_numpy(), len(coded.dictionary)
        keys, weights = [], []
        for doc, feature, tf in _counts(batch.column("text"), numbered):
            keys.append(feature * kinds + kind[doc])
            weights.append(1 + np.log(tf))
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            w = np.bincount(at, np.concatenate(weights))
            names = [numbered.names[i] for i in key // kinds]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key % kinds)).cast(schema.field(0).type), pa.array(names, pa.string()), pa.array(np.bincount(at)), pa.array(w)], schema=schema)
        if len(numbered.names) > _KEPT:
            numbered = Numbered()


def weighed(batches: Iterator[pa.RecordBatch], names: list[str], idf: np.ndarray, more: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, mass, more, rest) of batches(id, text): sums over the features of names, and the other features with their tf."""
    hot = {x: i for i, x in enumerate(names)}
    numbered, place = Numbered(), np.zeros(0, dtype=np.int64)
    for batch in batches:
        mass, sums = np.zeros(len(batch)), np.zeros((len(batch), more.shape[1]))
        docs, rest, times = [], [], []
        for doc, feature, tf in _counts(batch.column("text"), numbered):
            if len(place) < len(numbered.names):
                place = np.concatenate([place, np.array([hot.get(x, -1) for x in numbered.names[len(place) :]], dtype=np.int64)])
            at = place[feature]
            known = at >= 0
            w = (1 + np.log(tf[known])) * idf[at[known]]
            mass += np.bincount(doc[known], w, len(batch))
            for c in range(more.shape[1]):
                sums[:, c] += np.bincount(doc[known], w * more[at[known], c], len(batch))
            docs.append(doc[~known])
            rest += [numbered.names[i] for i in feature[~known]]
            times.append(tf[~known])
        n = np.bincount(np.concatenate(docs), minlength=len(batch)) if docs else np.zeros(len(batch), dtype=np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(np.concatenate(times) if times else [], pa.int64())], names=["feature", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * more.shape[1], pa.int32()), pa.array(sums.ravel()))
        columns = [batch.column("id"), pa.array(mass), lists, pa.ListArray.from_arrays(offsets, pairs)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        if len(numbered.names) > _KEPT:
            numbered, place = Numbered(), np.zeros(0, dtype=np.int64)
