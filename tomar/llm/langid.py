"""Problem 9: the language of each document and of each stretch of a mixed one.

Method: nearest-centroid classification. Texts become normalised TF-IDF vectors of hashed character
3-grams; each language has several centroids, clustered by spherical k-means from sentences of
labelled documents in two forms (as written, and without accents, so that such texts have a centroid of their own); a
sentence goes to the language of the centroid with the highest cosine, and is rejected where that cosine is
below what all but a small share of the training sentences reach. Sentences of a document are then joined
to stretches by the best path that pays for each change of language.

The classifier is fitted on at most ``SAMPLE`` labelled documents a language (chosen by hash, whole texts of at most ``LONGEST`` characters, which
bounds the sample in bytes too); labels may be wrong: documents whose nearest centroid speaks against their label are dropped and the fit is
repeated. Everything else runs over all documents.

Defined cases: null, empty and letterless texts have no language and give no stretch; a text without a whole
sentence is one stretch; a missing label is null, blank or a placeholder; labels are compared by language, not by notation;
repeated rows are handled alike; extra columns are ignored; without any labelled row there is no language and the result is empty;
a stretch that is rejected has no language, and a document without any accepted stretch is reported as ``und`` with what its nearest
language is sure by. The languages are those that the labels name: a notation below, or any other two- or three-letter code.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomar.session import spread, table

from .rows import flat_map

#: Labelled documents a language that the classifier is fitted on, at most.
SAMPLE = 200
#: Characters of a text of that sample, at most; longer documents are not sampled, but classified like all.
LONGEST = 20_000
CLUSTERS = 4
BITS = 16
GRAM = 3
#: Sentences that are weighed at once, which bounds the memory.
SLICE = 1000
#: The code of documents in no known language.
UNKNOWN = "und"
REJECT_SHARE = 0.005
CHANGE = 2.5
SHARPNESS = 25.0

#: Notations of the labels, in lower case without region.
NOTATIONS = {
    "tr": "tr tur türkçe turkce turkish türkisch turc turco",
    "en": "en eng english ingilizce englisch anglais inglés ingles",
    "de": "de deu ger deutsch german almanca allemand alemán aleman",
    "fr": "fr fra fre français francais french fransızca fransizca französisch francés frances",
    "es": "es spa español espanol spanish castellano ispanyolca spanisch espagnol",
    "az": "az aze azb azj azərbaycanca azerbaycanca azərbaycan azerbaijani azeri azerice aserbaidschanisch",
}
_BY_NOTATION = {word: code for code, words in NOTATIONS.items() for word in words.split()}
_LETTERS = (("ı", "i"), ("İ", "i"), ("ẞ", "ss"), ("’", " "), ("'", " "))
_BARE = str.maketrans({"ə": "e", "ß": "s", "æ": "a", "œ": "o"})
_NOT_LETTERS = re.compile(r"(?:[^\w\n]|[\d_])+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+(?=[\"“«'(\[¿¡]*[^\W\d_a-zçğıöşüəéèàâêîôûäñáíóú]|[\"“«'(\[¿¡]*\d)|\n+|\f")
_END = re.compile(r"[.!?…][\"”»')\]]*\s*$")


def label(column):
    """The language code that a label names, or null; the region and the letter case don't count. Unknown short codes name themselves."""
    plain = F.lower(F.trim(F.translate(column, "İI", "iı")))
    plain = F.when(plain.contains("-") | plain.contains("_"), F.regexp_extract(plain, "^([^-_]+)[-_]", 1)).otherwise(plain)
    undotted = F.translate(plain, "ı", "i")
    names = F.create_map(*[x for word, code in _BY_NOTATION.items() for x in (F.lit(word), F.lit(code))])
    code = F.when(undotted.rlike("^[a-z]{2,3}$") & ~missing(column), undotted)
    return F.coalesce(F.element_at(names, plain), F.element_at(names, undotted), code)


def missing(column):
    """Whether a label is null, blank or a placeholder such as '-', '?', 'und' or 'unknown'."""
    plain = F.lower(F.trim(column))
    return column.isNull() | (F.regexp_replace(plain, r"[^\p{L}]", "") == "") | plain.rlike(
        r"^[^\p{L}]*(und|unk|unknown|undefined|none|null|nan|na|n/a|mul|zxx|mis|xx|xxx|other|bilinmiyor|bilinmeyen|belirsiz|yok|diğer|diger)[^\p{L}]*$"
    )


def plains(texts: list[str]) -> list[str]:
    """Of each text the letters in lower case, with single spaces between words and one at either end."""
    joined = "\n".join([t.replace("\n", " ") for t in texts])
    for old, new in _LETTERS:
        joined = joined.replace(old, new)
    joined = unicodedata.normalize("NFC", joined.lower().replace("i\u0307", "i"))
    return [f" {t.strip()} " for t in _NOT_LETTERS.sub(" ", joined).split("\n")]


def bare(text: str) -> str:
    """The same without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.translate(_BARE)) if not "̀" <= c <= "ͯ")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed gram, count) of the character n-grams of plain texts, ordered by text."""
    units = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(units):
        return (np.zeros(0, np.int64),) * 3
    number = np.cumsum(units == 10).astype(np.int64)
    n = len(units) - GRAM + 1
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(GRAM if n > 0 else 0):
        code = code * np.uint64(0xD6E8FEB86659FD93) + units[i : i + n]
        code ^= code >> np.uint64(29)
    whole = (number[:n] == number[GRAM - 1 :]) & (units[:n] != 10) if n > 0 else np.zeros(0, bool)
    hashed = ((code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)
    found, counts = np.unique(((number[: len(code)] << BITS) | hashed)[whole], return_counts=True)
    return found >> BITS, found & ((1 << BITS) - 1), counts


class Centroids:
    """Clustered centroids per language over TF-IDF vectors."""

    def __init__(self, idf: np.ndarray, matrix: np.ndarray, languages: list[str], floor: float = 0.0):
        self.idf, self.matrix, self.languages, self.floor = idf.astype(np.float32), matrix.astype(np.float32), languages, floor
        self.codes = sorted(set(languages))
        self.columns = [[i for i, x in enumerate(languages) if x == c] for c in self.codes]

    def weights(self, texts: list[str], counted=None):
        number, gram, count = counted or grams(texts)
        w = (1 + np.log(count)).astype(np.float32) * self.idf[gram]
        norm = np.sqrt(np.bincount(number, w * w, len(texts))).astype(np.float32)
        norm[norm == 0] = 1
        return number, gram, w / norm[number]

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text with each centroid, for a slice of the texts at a time."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        for at in range(0, len(texts), SLICE):
            own = texts[at : at + SLICE]
            number, gram, w = self.weights(own)
            if len(number):
                starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                out[at + number[starts]] = np.add.reduceat(self.matrix[gram] * w[:, None], starts, axis=0)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The best cosine of each text for each language."""
        cosines = self.cosines(texts)
        return np.stack([cosines[:, c].max(axis=1) for c in self.columns], axis=1) if self.codes else np.zeros((len(texts), 0))


def fit(rows: list[tuple[str, str]], clusters: int = CLUSTERS, rounds: int = 8) -> Centroids:
    """Centroids from (language, text) rows whose labels may be wrong."""
    samples: list[tuple[str, str, int]] = []
    for n, (language, text) in enumerate(rows):
        for p in plains(sentences(text)[0]):
            if len(p) > 25:
                samples += [(language, p, n), (language, bare(p), n)]
    model = _fit(samples, clusters, rounds)
    for _ in range(2):
        if not model.codes:
            break
        total: dict[int, np.ndarray] = {}
        for (_, _, n), s in zip(samples, model.scores([p for _, p, _ in samples])):
            total[n] = total.get(n, 0) + s
        kept = {n for n, s in total.items() if model.codes[int(s.argmax())] == rows[n][0]}
        samples = [x for x in samples if x[2] in kept]
        model = _fit(samples, clusters, rounds)
    if samples:
        best = model.scores([p for _, p, _ in samples]).max(axis=1)
        model.floor = float(np.quantile(best, REJECT_SHARE)) * 0.8
    return model


def _fit(samples: list[tuple[str, str, int]], clusters: int, rounds: int) -> Centroids:
    size = 1 << BITS
    if not samples:
        return Centroids(np.zeros(size), np.zeros((size, 0)), [])
    counted = []
    for at in range(0, len(samples), SLICE):
        number, gram, count = grams([p for _, p, _ in samples[at : at + SLICE]])
        counted.append(((number + at).astype(np.int32), gram.astype(np.int32), count.astype(np.int32)))
    number, gram, count = (np.concatenate(x) for x in zip(*counted))
    df = np.bincount(gram, minlength=size)
    model = Centroids(np.log((1 + len(samples)) / (1 + df)), np.zeros((size, 1)), [""])
    number, gram, w = model.weights([p for _, p, _ in samples], (number, gram, count))
    language = np.array([x for x, _, _ in samples])
    columns, languages = [], []
    for code in sorted(set(language)):
        own = np.flatnonzero(language == code)
        place = np.full(len(samples), -1)
        place[own] = np.arange(len(own))
        here = place[number] >= 0
        rows_, g, v = place[number[here]], gram[here], w[here]
        k = min(clusters, len(own))
        # Deterministic start: samples as written and without accents alternate, so both forms seed clusters.
        assigned = np.arange(len(own)) % k
        for _ in range(rounds):
            centre = np.stack([np.bincount(g[assigned[rows_] == c], v[assigned[rows_] == c], size) for c in range(k)], axis=1)
            centre /= np.maximum(np.linalg.norm(centre, axis=0), 1e-9)
            sims = np.zeros((len(own), k))
            starts = np.flatnonzero(np.r_[True, rows_[1:] != rows_[:-1]])
            for c in range(k):
                sims[rows_[starts], c] = np.add.reduceat(centre[g, c] * v, starts)
            new = sims.argmax(axis=1)
            if (new == assigned).all():
                break
            assigned = new
        columns.append(centre)
        languages += [str(code)] * k
    return Centroids(model.idf, np.concatenate(columns, axis=1), languages)


def sentences(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The sentences and lines of a text, and where they stand."""
    spans, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            spans.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        spans.append((at, len(text)))
    return [text[a:b] for a, b in spans], spans


def stretches(spans, whole, scores: np.ndarray, floor: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, language number or -1, whole sentences, confidence) along the best path over the sentences."""
    usable = [i for i in range(len(spans)) if whole[i]] or list(range(len(spans)))
    s = scores[usable]
    n, k = s.shape
    if not n or not k:
        return []
    first = s.argmax(axis=1)
    cost = np.zeros(k)
    back = np.zeros((n, k), int)
    # One language that is best everywhere is the best path.
    for i in range(n) if (first != first[0]).any() else ():
        best = int(cost.argmax())
        move = cost[best] - CHANGE > cost
        back[i] = np.where(move, best, np.arange(k))
        cost = np.where(move, cost[best] - CHANGE, cost) + SHARPNESS * s[i]
    path = [int(cost.argmax())] if cost.any() else first.tolist()
    for i in range(n - 1, 0, -1) if len(path) < n else ():
        path.append(int(back[i][path[-1]]))
    path = path[::-1]
    out: list[list] = []
    for i, lang in enumerate(path):
        if out and out[-1][0] == lang:
            out[-1][1].append(i)
        else:
            out.append([lang, [i]])
    result = []
    for number, (lang, own) in enumerate(out):
        mean = s[own].mean(axis=0)
        e = np.exp(SHARPNESS * (mean - mean.max()))
        confidence = float(e[lang] / e.sum())
        start = 0 if number == 0 else spans[usable[own[0]]][0]
        end = spans[-1][1] if number == len(out) - 1 else spans[usable[out[number + 1][1][0]]][0]
        count = sum(1 for i in own if whole[usable[i]])
        result.append((start, end, lang if mean[lang] >= floor else -1, count, confidence))
    return result


def train(documents: DataFrame, sample: int = SAMPLE) -> Centroids:
    """A classifier from a bounded sample of the labelled documents."""
    known = documents.select("doc_id", "text", label(F.col("lang")).alias("dil")).where("dil is not null and text is not null").where(F.length("text") <= LONGEST)
    order = Window.partitionBy("dil").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).collect()
    return fit(sorted((r.dil, r.text) for r in rows))


def segments(documents: DataFrame, model: Centroids | None = None) -> DataFrame:
    """Stretches of one language in documents(doc_id, text): place, language (null: rejected), confidence."""
    trained = model or train(documents)
    shared = documents.sparkSession.sparkContext.broadcast((trained.idf, trained.matrix, trained.languages, trained.floor))

    def make():
        m = Centroids(*shared.value)

        def run(rows):
            parts = [(r["doc_id"], r["text"], *sentences(r["text"])) for r in rows]
            every = plains([s for _, _, own, _ in parts for s in own])
            scores, at = m.scores(every), 0
            for doc_id, text, own, spans in parts:
                mine = every[at : at + len(own)]
                s = scores[at : at + len(own)]
                at += len(own)
                keep = [i for i, p in enumerate(mine) if p.strip()]
                whole = [bool(_END.search(own[i])) and mine[i].count(" ") > 4 for i in keep]
                found = stretches([spans[i] for i in keep], whole, s[keep], m.floor)
                for n, (a, b, lang, count, confidence) in enumerate(found, 1):
                    yield doc_id, n, a, b, m.codes[lang] if lang >= 0 else None, count, confidence

        return run

    schema = "doc_id bigint, sira int, bas int, son int, dil string, cumle int, guven double"
    return flat_map(documents.select("doc_id", "text").where("text is not null"), make, schema)


def languages(found: DataFrame) -> DataFrame:
    """(doc_id, dil, guven): the languages a document holds, each in at least two whole sentences, or else its main one, or ``und``."""
    by = found.groupBy("doc_id", F.coalesce("dil", F.lit(UNKNOWN)).alias("dil")).agg(
        F.sum("cumle").alias("cumle"), (F.sum(F.col("guven") * (F.col("son") - F.col("bas"))) / F.sum(F.col("son") - F.col("bas"))).alias("guven"), F.sum(F.col("son") - F.col("bas")).alias("boy")
    )
    per = by.groupBy("doc_id").agg(F.collect_list(F.struct("cumle", "boy", "dil", "guven")).alias("own"))
    known = F.filter("own", lambda x: x.dil != UNKNOWN)
    several = F.filter("own", lambda x: (x.cumle >= 2) & (x.dil != UNKNOWN))
    main = F.slice(F.sort_array(F.when(F.size(known) > 0, known).otherwise(F.col("own")), asc=False), 1, 1)
    return per.select("doc_id", F.explode(F.when(F.size(several) > 0, several).otherwise(main)).alias("x")).select("doc_id", "x.dil", F.round("x.guven", 4).alias("guven"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of each document with its language and confidence."""
    return segments(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the languages it holds."""
    return languages(p9_segments(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of documents without a label, with a wrong one, or with several languages."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = languages(segments(documents)).where(F.col("dil") != UNKNOWN).groupBy("doc_id").agg(F.collect_set("dil").alias("diller"))
    known = label(F.col("lang"))
    wrong = missing(F.col("lang")) | (F.size("diller") > 1) | known.isNull() | ~F.array_contains("diller", F.coalesce(known, F.lit("")))
    labels = documents.select("doc_id", "lang").distinct()
    return held.join(labels, "doc_id").where(wrong).select("doc_id", F.explode("diller").alias("dil")).distinct()


QUERIES = {"p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents}
SQL: dict[str, str] = {}
