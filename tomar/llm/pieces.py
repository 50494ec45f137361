"""Problem 5: items above a size limit, cut at natural boundaries.

Method: structure-tree packing. The marks of a text (markdown headings, book, part and chapter lines, articles, Roman, capital,
decimal, bracketed and letter items, bullets by their indent) have ranks; a mark opens a node that reaches to the next mark of the same
or a lower rank, which nests the nodes to a tree. Below the last marks a node divides into paragraphs, lines, sentences, words and
characters. A node within the limit stays whole; of a larger one the children are packed: sibling subtrees are merged in order as long as they
fit, only an oversized child is descended into, and its pieces are not merged with its parent's other children. A heading stays with
what follows it. The cores of the pieces partition the text; a piece is its core preceded by the last ``overlap`` characters before it, so
consecutive pieces overlap by exactly that many characters and the cores joined give the text again.

Defined cases: a null or empty text gives no piece; a text within the limit gives one piece, itself; a text
without any boundary (one endless word) is cut between characters, never between a letter and its combining
mark unless a run of marks exceeds the limit itself; repeated rows give repeated pieces; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomar.session import table

from .rows import flat_map

#: Characters of a piece at most, and of the overlap, by field.
LIMITS = {"raw_text": (4000, 200), "legislation_matches": (1200, 100)}

# The marks that open a node, with their ranks from the outermost; decimal numbers add their depth, bullets their indent.
_MARKS = re.compile(
    r"""
    (?:^|(?<=\s))(?=(?P<article>(?:(?:GEÇİCİ\ |EK\ )?MADDE|Madde)\s+\d+\s*[-–.:]))
    | ^(?=[ \t]*(?:
        (?P<hash>\#{1,6})\s
      | (?:[^\W\d_]+|\d{1,3}\.)\ (?P<part>KİTAP|KISIM|BÖLÜM|AYIRIM)\b
      | (?P<roman>[IVXLC]{1,7})[.)]\s
      | (?P<capital>[A-ZÇĞİÖŞÜ])[.)]\s
      | (?P<decimal>\d{1,3}(?:\.\d{1,3}){0,4})[.)]\s
      | (?P<bracket>\(\d{1,3}\))\s
      | (?P<letter>[a-zçğıöşü])\)\s
      | [-•*–]\s(?!\s*\d+\s*[-–])
    ))""",
    re.M | re.X,
)
_PARTS = {"KİTAP": 7, "KISIM": 8, "BÖLÜM": 9, "AYIRIM": 10}
# Below the marks, from the coarsest to the finest boundary; a cut falls where a match ends.
_LEVELS = (
    re.compile(r"\n[ \t\r]*\n\s*|\f\s*"),
    re.compile(r"\n+"),
    re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+(?=[\"“«'(\[]?[A-ZÇĞİÖŞÜÂÎÛ0-9])|(?<=;)\s+"),
    re.compile(r"\s+"),
)
_PARAGRAPHS, _LINES = 0, 1


def marks(text: str) -> list[tuple[int, int]]:
    """(place, rank) of the marks of a text in order; a lower rank is further out."""
    out = []
    for m in _MARKS.finditer(text):
        if m["hash"]:
            rank = len(m["hash"])
        elif m["part"]:
            rank = _PARTS[m["part"]]
        elif m["article"]:
            rank = 11
        elif m["roman"] or m["capital"]:
            rank = 12 if m["roman"] else 13
        elif m["decimal"]:
            rank = 14 + m["decimal"].count(".")
        elif m["bracket"] or m["letter"]:
            rank = 19 if m["bracket"] else 20
        else:
            line = text[m.start() : m.start() + 40]
            rank = 21 + min(8, (len(line) - len(line.lstrip())) // 2)
        out.append((m.start(), rank))
    return out


def _heading(text: str) -> bool:
    """Whether the first child of a node is only its heading: one short line that ends no sentence."""
    line = text.strip()
    return 0 < len(line) <= 120 and "\n" not in line and (line[0] == "#" or line[-1] not in ".;,!?…")


def _characters(text: str, start: int, end: int, room: int) -> list[tuple[int, int]]:
    """Runs of at most room characters, not ending before a combining mark where that can be helped."""
    out = []
    while end - start > room:
        cut = start + room
        while cut > start + 1 and unicodedata.combining(text[cut]):
            cut -= 1
        if cut == start + 1:
            cut = start + room
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def _tree(text: str, start: int, end: int, own: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Spans of at most room characters that partition the node text[start:end] with the marks own inside it."""
    if end - start <= room:
        return [(start, end)]
    own = [m for m in own if m[0] > start]
    if not own:
        return _plain(text, start, end, _PARAGRAPHS, room)
    outer = min(rank for _, rank in own)
    cuts = [start, *(at for at, rank in own if rank == outer), end]
    spans: list[tuple[int, int]] = []
    merged = False
    first = 0
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        inside = []
        while first < len(own) and own[first][0] < b:
            inside.append(own[first])
            first += 1
        if spans and merged and n == 1 and _heading(text[slice(*spans[-1])]):
            a, merged = spans.pop()[0], False  # a heading goes with the first child
        if b - a > room:
            spans += _tree(text, a, b, [m for m in inside if m[0] > cuts[n]], room)
            merged = False
        elif merged and b - spans[-1][0] <= room:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
            merged = True
    return spans


def _plain(text: str, start: int, end: int, level: int, room: int) -> list[tuple[int, int]]:
    """The same for a node without marks, from a level of boundaries on."""
    if end - start <= room:
        return [(start, end)]
    if level == len(_LEVELS):
        return _characters(text, start, end, room)
    cuts = [start, *(m.end() for m in _LEVELS[level].finditer(text, start, end) if start < m.end() < end), end]
    spans: list[tuple[int, int]] = []
    merged = False
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if level <= _LINES and spans and merged and n == 1 and _heading(text[slice(*spans[-1])]):
            a, merged = spans.pop()[0], False
        if merged and b - spans[-1][0] <= room:
            spans[-1] = (spans[-1][0], b)
            continue
        own = _plain(text, a, b, level + 1, room)
        # Words of a long sentence may share a piece with the next sentence; paragraphs keep to themselves.
        if level > _LINES and spans and own[0][1] - spans[-1][0] <= room:
            spans[-1] = (spans[-1][0], own.pop(0)[1])
        spans += own
        merged = level > _LINES or b - a <= room
    return spans


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start of the piece, start of its core, end) of each piece of a text; see the module."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    return [(max(0, a - overlap), a, b) for a, b in _tree(text, 0, len(text), marks(text), limit - overlap)]


def split_items(items: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Pieces of items(alan, evrak_id, sira, metin): one row for each, numbered from 1 as parca."""

    def make():
        def run(rows):
            for r in rows:
                limit, overlap = limits[r["alan"]]
                spans = pieces(r["metin"], limit, overlap)
                for n, (a, core, b) in enumerate(spans, 1):
                    yield r["alan"], r["evrak_id"], r["sira"], n, len(spans), a, core, b, r["metin"][a:b]

        return run

    schema = "alan string, evrak_id bigint, sira int, parca int, parca_sayisi int, bas int, cekirdek int, son int, metin string"
    return flat_map(items.select("alan", "evrak_id", "sira", "metin"), make, schema)


def items(state: DataFrame) -> DataFrame:
    """The items that have a size limit: whole texts, and each legislation summary by its place."""
    texts = state.select(F.lit("raw_text").alias("alan"), "evrak_id", F.lit(0).alias("sira"), F.col("raw_text").alias("metin"))
    cited = state.select("evrak_id", F.posexplode("legislation_matches").alias("at", "m")).select(
        F.lit("legislation_matches").alias("alan"), "evrak_id", (F.col("at") + 1).cast("int").alias("sira"), F.col("m.icerik_ozeti").alias("metin")
    )
    return texts.unionByName(cited).where("metin is not null")


def _limit():
    case = F.when(F.lit(False), F.lit(0))
    for name, (limit, _) in LIMITS.items():
        case = case.when(F.col("alan") == name, F.lit(limit))
    return case


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the items above their limit."""
    return split_items(items(table(spark, sf_dir, "agent_state")).where(F.length("metin") > _limit()))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as numbered pieces within its limit; an item within it is one piece."""
    return split_items(items(table(spark, sf_dir, "agent_state")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items above the limit: those that the operator cuts."""
    return oversized(spark, sf_dir).where("parca = 1 and parca_sayisi > 1").select("alan", "evrak_id", "sira").distinct()


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": """
        select distinct 'raw_text' as alan, evrak_id, 0 as sira from agent_state where length(raw_text) > 4000
        union
        select distinct 'legislation_matches', evrak_id, cast(i as integer) from (
            select evrak_id, legislation_matches as m, unnest(range(1, len(legislation_matches) + 1)) as i from agent_state
        ) where length(m[i].icerik_ozeti) > 1200
    """
}
