"""Problem 7: passages of held-out items in the corpus.

Method: q-gram lemma filtering. Documents and items are folded (letter case, accents, punctuation, line
breaks and quote marks don't count) and cut into overlapping character q-grams. A passage of ``LEAST``
words of an item, one word in ten of which may be replaced, keeps at least T of its q-grams: its length less
q - 1, less what the longest words that may be replaced can destroy. T is computed over every such
window of every item, and q is the largest power of two for which no item's T falls below ``FLOOR``. Shared q-grams are
counted in overlapping diagonal bands of (document, item); the bands that reach the item's T are
verified by a banded alignment of words.

Diagonals of one passage drift apart where a replaced word is longer or shorter: bands are ``BAND`` characters wide and start every
half, so every drift up to half a band (42 characters for each of three words) is within one band.

Items of at most ``BLOCK`` characters in all are sent to every task, and one pass over the documents finds everything. Larger sets
never leave the cluster: q-grams of documents that pass a bitmap of the items' q-grams (of ``BITS`` bits at most) are joined with the
items' q-grams by shuffle. Of every window of an item only the (q-grams - T + 1) rarest are joined, by their counts in the corpus;
a passage that keeps T q-grams keeps one of them, so common phrases aren't expanded and nothing is lost. The pairs found are
counted in bands and verified as above. Both ways give the same rows.

Defined cases: null and empty texts hold nothing; items of fewer than ``LEAST`` words can't be found; repeated
documents are found each under its own id; repeated items each under their own; extra columns are ignored; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import checked_broadcast, cut, spread, table

from .folding import squeezed
from .rows import flat_map

LEAST = 30
SHARE = 10
BAND = 256
FLOOR = 8
BITS = 27
BLOCK = 2_000_000
SLACK = 3
#: The lengths of q-grams to choose from, powers of two.
SIZES = (32, 16, 8, 4)

_BASE = 0x9E3779B97F4A7C15


def _hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, q a power of two."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power, width = _BASE, 1
    while width < q:
        h = h[: max(0, len(h) - width)] * np.uint64(power) + h[width:]
        h ^= h >> np.uint64(31)
        power = (power * power + 2 * width + 1) & (2**64 - 1)
        width *= 2
    return h


def losses(sizes: np.ndarray, q: int, share: int = SHARE) -> int:
    """The q-grams that the longest words of a window take with them if as many as may be are replaced."""
    own = np.sort(sizes)
    return int((own[len(own) - len(own) // share :] + q - 1).sum())


def threshold(words: list[str], q: int, least: int = LEAST, share: int = SHARE) -> int:
    """The q-grams that any passage of the least length keeps, whichever words of it are replaced."""
    if len(words) < least:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(np.array([len(w) for w in words]), least)
    budget = least // share
    lost = np.partition(windows, least - budget, axis=1)[:, least - budget :].sum(axis=1) + budget * (q - 1)
    return int((windows.sum(axis=1) + least - 1 - (q - 1) - lost).min())


def chosen_q(items: list[list[str]]) -> int:
    """The largest q for which no item's threshold falls below the floor."""
    return next((q for q in SIZES if items and min(threshold(w, q) for w in items) >= FLOOR), SIZES[-1])


class Items:
    """The q-gram index of items, each an id and its words."""

    def __init__(self, items: list[tuple[int, list[str]]], q: int | None = None):
        items = [(i, w) for i, w in items if len(w) >= LEAST]
        self.ids, self.words = [i for i, _ in items], [w for _, w in items]
        self.q = q or chosen_q(self.words)
        self.least = np.array([max(1, threshold(w, self.q)) for w in self.words], dtype=np.int64)
        hashes = [_hashes(" ".join(w), self.q) for w in self.words]
        number = np.concatenate([np.full(len(h), i) for i, h in enumerate(hashes)] or [np.zeros(0, int)])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, int)])
        every = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.number, self.place = number[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.bits = min(22, max(10, int(len(self.keys)).bit_length() + 3))
        self.present = np.zeros(1 << self.bits, bool)
        self.present[self.keys >> np.uint64(64 - self.bits)] = True
        self.places: dict[int, _Places] = {}

    def passages(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(text, item) of the texts, each its words, that hold a passage of an item."""
        done: set[tuple[int, int]] = set()
        last, starts = -1, np.zeros(0)
        for t, i, d in sorted(self.candidates([" ".join(w) for w in texts])):
            if (t, i) in done:
                continue
            if t != last:
                last, starts = t, _starts(texts[t])
            places = self.places.get(i)
            if places is None:
                places = self.places[i] = _Places(self.words[i])
            # The character diagonal as word diagonals: that of each shared word near it.
            if any(holds(texts[t], self.words[i], o) for o in places.offsets(texts[t], starts, d)):
                done.add((t, i))
        return sorted(done)

    def candidates(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, character diagonal) of the bands that hold enough shared q-grams."""
        if not len(self.keys):
            return []
        h = _hashes("\n".join(texts), self.q)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = np.flatnonzero(self.present[h >> np.uint64(64 - self.bits)])
        found = np.searchsorted(self.keys, h[at])
        found[found == len(self.keys)] = 0
        same = self.keys[found] == h[at]
        at, found = at[same], found[same]
        if not len(at):
            return []
        n = self.count[found]
        ends = np.cumsum(n)
        entry = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[found], n)
        text = np.repeat(np.searchsorted(starts, at, side="right") - 1, n)
        item = self.number[entry]
        diagonal = np.repeat(at, n) - starts[text] - self.place[entry] + (1 << 20)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for shift in (0, BAND // 2):
            key = (text << 42) | (item << 26) | ((diagonal + shift) // BAND)
            found_keys, counts = np.unique(key, return_counts=True)
            enough = counts >= self.least[(found_keys >> 26) & 0xFFFF]
            for k in found_keys[enough]:
                k = int(k)
                d = (k & ((1 << 26) - 1)) * BAND - shift - (1 << 20) + BAND // 2
                out[k >> 42, (k >> 26) & 0xFFFF, d // (BAND // 2)] = d
        return [(t, i, d) for (t, i, _), d in out.items()]


def _passage(match: list[bool]) -> bool:
    """Whether some run of at least LEAST words, begun and ended by a right one, has one in SHARE wrong at most."""
    highest, wrong, before = None, 0, []
    for j, right in enumerate(match):
        before.append((SHARE * wrong - j, right))
        wrong += not right
        first = j - LEAST + 1
        if first >= 0 and before[first][1]:
            highest = before[first][0] if highest is None else max(highest, before[first][0])
        if right and highest is not None and SHARE * wrong - (j + 1) <= highest:
            return True
    return False


def holds(document: list[str], item: list[str], offset: int) -> bool:
    """Banded alignment: whether the document holds a passage of the item near the word diagonal ``offset``."""
    n = len(document)
    straight = [0 <= i + offset < n and document[i + offset] == w for i, w in enumerate(item)]
    if _passage(straight):
        return True
    width = 2 * SLACK + 1
    cost = [0] * width
    back: list[list[int]] = []
    for i, w in enumerate(item):
        new, moves = [0] * width, [0] * width
        for k in range(width):
            j = i + offset + k - SLACK
            right = 0 <= j < n and document[j] == w
            choice, move = cost[k] + (not right), 0
            if k + 1 < width and cost[k + 1] + 1 < choice:  # the item's word is missing in the document
                choice, move = cost[k + 1] + 1, 1
            new[k], moves[k] = choice, move
        for k in range(1, width):  # the document has a word more
            if new[k - 1] + 1 < new[k]:
                new[k], moves[k] = new[k - 1] + 1, 2
        cost = new
        back.append(moves)
    k, i, match = min(range(width), key=cost.__getitem__), len(item) - 1, []
    while i >= 0:
        move = back[i][k]
        if move == 2:
            k -= 1
            match.append(False)
            continue
        j = i + offset + k - SLACK
        match.append(move == 0 and 0 <= j < n and document[j] == item[i])
        k += move == 1
        i -= 1
    return _passage(match[::-1])


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, test_id): documents(doc_id, text) that hold a passage of items(test_id, metin)."""
    documents, items = documents.select("doc_id", "text").where("text is not null"), items.select("test_id", "metin").where("metin is not null")
    if (items.agg(F.sum(F.length("metin"))).first()[0] or 0) > block:
        return leaks_by_shuffle(documents, items)
    shared = documents.sparkSession.sparkContext.broadcast([(r.test_id, r.metin) for r in items.orderBy("test_id").collect()])

    def make():
        index = Items([(i, squeezed(text)) for i, text in shared.value])

        def run(rows):
            for t, i in index.passages([squeezed(r["text"]) for r in rows]):
                yield rows[t]["doc_id"], index.ids[i]

        return run

    return flat_map(documents, make, "doc_id bigint, test_id int").distinct()


def rarest(words: list[str], q: int, counts: np.ndarray) -> np.ndarray:
    """The places of the q-grams of an item of which any passage keeps one: of each window the rarest, so many that T can't avoid them."""
    size = np.array([len(w) for w in words])
    start = np.cumsum([0, *(size + 1)])
    kept = np.zeros(len(counts), bool)
    for a in range(len(words) - LEAST + 1):
        first, last = int(start[a]), int(start[a + LEAST]) - q
        if last <= first:
            continue
        own = counts[first:last]
        n = min(len(own), losses(size[a : a + LEAST], q) + 1)
        kept[first + np.argsort(own, kind="stable")[:n]] = True
    return np.flatnonzero(kept)


def _signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def leaks_by_shuffle(documents: DataFrame, items: DataFrame, bits: int = BITS) -> DataFrame:
    """The same as leaks, for items of any number: see the module."""

    def read():
        def run(rows):
            for r in rows:
                own = squeezed(r["metin"] or "")
                if len(own) >= LEAST:
                    yield r["test_id"], own, [threshold(own, q) for q in SIZES]

        return run

    own = cut(flat_map(items, read, "test_id int, kelimeler array<string>, esik array<int>"))
    lowest = own.agg(*[F.min(F.col("esik")[i]).alias(f"t{q}") for i, q in enumerate(SIZES)]).first()
    q = next((q for q in SIZES if (lowest[f"t{q}"] or 0) >= FLOOR), SIZES[-1])

    def item_grams():
        def run(rows):
            for r in rows:
                for at, h in enumerate(_signed(_hashes(" ".join(r["kelimeler"]), q))):
                    yield h, r["test_id"], at

        return run

    grams = cut(flat_map(own.select("test_id", "kelimeler"), item_grams, "h bigint, test_id int, yer int"))
    bits = min(bits, max(16, int(grams.count()).bit_length() + 3))
    slot = grams.select(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
    words = slot.selectExpr("shiftright(slot, 6) as s", "shiftleft(1L, cast(slot & 63 as int)) as b").groupBy("s").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << bits >> 6, np.uint64)
    bitmap[words["s"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def document_grams():
        present = shared.value

        def run(rows):
            for r in rows:
                h = np.unique(_hashes(" ".join(squeezed(r["text"] or "")), q))
                at = h >> np.uint64(64 - bits)
                for value in _signed(h[(present[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]):
                    yield value, r["doc_id"]

        return run

    held = cut(flat_map(documents, document_grams, "h bigint, doc_id bigint"))
    counts = held.groupBy("h").agg(F.count("*").alias("n"))
    weighed = grams.join(counts, "h").groupBy("test_id").agg(F.collect_list(F.struct("yer", "h", "n")).alias("gramlar"))

    def choose():
        def run(rows):
            for r in rows:
                n = np.zeros(max(0, len(" ".join(r["kelimeler"])) - q + 1), np.int64)
                for g in r["gramlar"]:
                    n[g["yer"]] = g["n"]
                hashes = {g["yer"]: g["h"] for g in r["gramlar"]}
                # A q-gram that no document has is among the rarest and joins with nothing.
                for h in {hashes[at] for at in rarest(r["kelimeler"], q, n).tolist() if at in hashes}:
                    yield h, r["test_id"]

        return run

    able = flat_map(own.select("test_id", "kelimeler").join(weighed, "test_id"), choose, "h bigint, test_id int").distinct()
    pairs = cut(held.join(able, "h").select("doc_id", "test_id").distinct())
    both = documents.join(checked_broadcast(pairs), "doc_id").join(own.select("test_id", "kelimeler"), "test_id")

    def verify():
        known: dict[int, Items] = {}

        def run(rows):
            for r in rows:
                index = known.get(r["test_id"])
                if index is None or index.words[0] != r["kelimeler"]:
                    if len(known) > 500:
                        known.clear()
                    index = known[r["test_id"]] = Items([(r["test_id"], r["kelimeler"])], q)
                if index.passages([squeezed(r["text"])]):
                    yield r["doc_id"], r["test_id"]

        return run

    return flat_map(both.select("doc_id", "text", "test_id", "kelimeler"), verify, "doc_id bigint, test_id int").distinct()


def _starts(words: list[str]) -> np.ndarray:
    return np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]


class _Places:
    """Where each word of an item stands."""

    def __init__(self, words: list[str]):
        self.number: dict[str, int] = {}
        own = np.array([self.number.setdefault(w, len(self.number)) for w in words])
        self.order = np.argsort(own, kind="stable")
        self.first, self.count = np.searchsorted(own[self.order], np.arange(len(self.number) + 1)), np.bincount(own)
        self.starts = _starts(words)

    def offsets(self, document: list[str], starts: np.ndarray, diagonal: int) -> list[int]:
        """Word diagonals near a character diagonal, those with the most equal words first."""
        own = np.array([self.number.get(w, -1) for w in document])
        at = np.flatnonzero(own >= 0)
        n = self.count[own[at]]
        if n.sum() < LEAST - LEAST // SHARE:
            return []
        ends = np.cumsum(n)
        i = self.order[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.first[own[at]], n)]
        j = np.repeat(at, n)
        near = np.abs(starts[j] - self.starts[i] - diagonal) <= 2 * BAND
        if not near.any():
            return []
        found = (j - i)[near]
        low = int(found.min()) - SLACK
        votes = np.bincount(found - low, minlength=int(found.max()) - low + 1 + SLACK)
        # A passage has that many right words within the band of its diagonal.
        around = np.convolve(votes, np.ones(2 * SLACK + 1, int), "same")
        able = np.flatnonzero((around >= LEAST - LEAST // SHARE) & (votes > 0))
        return (able[np.argsort(-votes[able], kind="stable")] + low).tolist()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items of each document."""
    return leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "test_maddeleri"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it and the smallest of them."""
    return p7_found(spark, sf_dir).groupBy("test_id").agg(F.count("*").alias("belge_sayisi"), F.min("doc_id").alias("ilk_doc_id"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
