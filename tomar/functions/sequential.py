"""Text logic that goes from word to word or character to character, as Arrow functions over columns."""

from __future__ import annotations

import random
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("dr av prof doç yrd uzm öğr arş sn mah sk sok cad cd bulv blv apt no kat vb vs vd bkz örn md hk tel".split())
_LOWER = str.maketrans("İIÇÖÜŞĞ", "iıçöüşğ")
_CAPITALS = re.compile(r"(?:[A-ZÇĞİÖŞÜ]\.)*[A-ZÇĞİÖŞÜ]")
#: Fixed value: a piece of this length or less is no sentence.
SHORT = 10


def split_sentences(text: str | None) -> list[str]:
    """The sentences of a text; ordinals, abbreviations and initials don't end one. None and empty text have none."""
    done: list[str] = []
    for piece in re.split(r"(?<=[.!?])\s+", text or ""):
        piece = piece.strip()
        if not piece:
            continue
        if done and _continues(done[-1], piece):
            done[-1] = f"{done[-1]} {piece}"
        else:
            done.append(piece)
    return [s for s in done if len(s) > SHORT]


def _continues(before: str, piece: str) -> bool:
    """Whether the full stop of the piece before only abbreviates or counts."""
    word = before.rsplit(None, 1)[-1]
    if len(word) < 2 or word[-1] != ".":
        return False
    last = word[:-1].strip("(\"'“”‘’")
    if last.isdigit():
        return len(last) <= 2 or not (piece[0].isalpha() and piece[0] == piece[0].upper())
    return last.translate(_LOWER).lower() in ABBREVIATIONS or bool(_CAPITALS.fullmatch(last))


def osa(a: str, b: str, cap: int | None = None) -> int:
    """Edit distance with swaps of neighbours, each letter edited once; cap + 1 where it exceeds the cap."""
    if cap is not None and abs(len(a) - len(b)) > cap:
        return cap + 1
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if cap is not None and min(new) > cap:
            return cap + 1
        older, row = row, new
    return row[-1]


def similarity(a: str | None, b: str | None) -> float | None:
    """1 - distance / longer length; 1 for two empty texts, null for null."""
    if a is None or b is None:
        return None
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - osa(a, b) / longest


def rouge_l(candidate: str | None, reference: str | None) -> float:
    """F1 of the longest common subsequence of words; 0 where either has none."""
    a, b = (candidate or "").split(), (reference or "").split()
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    if not row[-1]:
        return 0.0
    precision, recall = row[-1] / len(a), row[-1] / len(b)
    return round(2 * precision * recall / (precision + recall), 4)


def spans(text: str | None, value: str | None) -> list[dict]:
    """Every place of a literal in a text, not overlapping."""
    if not text or not value:
        return []
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(re.escape(value), text)]


PERTURBATIONS = ("diakritik", "bosluk", "yazim", "ocr", "noktalama")
_MARKS = str.maketrans("çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")
#: Letters that scans exchange.
_SWAPS = {"l": "1", "o": "0", "O": "0", "I": "1", "S": "5", "B": "8"}


def perturbed(text: str, kind: str, seed: int) -> str:
    """A text with one kind of damage that keeps its meaning; the same seed gives the same text."""
    rng = random.Random(seed)
    if kind == "diakritik":
        return text.translate(_MARKS)
    if kind == "bosluk":
        return "".join(c + " " * rng.randint(1, 2) if c == " " and rng.random() < 0.15 else c for c in text)
    if kind == "yazim":
        own = list(text)
        for i in range(len(own) - 1):
            if own[i].isalpha() and own[i + 1].isalpha() and rng.random() < 0.01:
                own[i], own[i + 1] = own[i + 1], own[i]
        return "".join(own)
    if kind == "ocr":
        return "".join(_SWAPS[c] if c in _SWAPS and rng.random() < 0.05 else c for c in text)
    if kind == "noktalama":
        return "".join("" if c in ",;:" and rng.random() < 0.2 else c for c in text)
    raise ValueError(f"no such perturbation: {kind}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences)


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def osa_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_l_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
def literal_spans(texts: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([spans(t, v) for t, v in zip(texts, values)])


def variants(kinds: tuple[str, ...] = PERTURBATIONS, seed: int = 1234):
    """A column function: array of (kind, text) variants of each text; seeds follow from the text's kind."""

    @F.pandas_udf(T.ArrayType(T.StructType().add("tur", T.StringType()).add("metin", T.StringType())))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"tur": k, "metin": perturbed(t, k, seed + n)} for n, k in enumerate(kinds)])

    return run


def evaluate(expression: str | None) -> float | None:
    """The value of an arithmetic expression (+ - * / % **, brackets); null for anything else or too large powers."""
    import ast
    import operator as op

    able = {ast.Add: op.add, ast.Sub: op.sub, ast.Mult: op.mul, ast.Div: op.truediv, ast.Mod: op.mod, ast.Pow: op.pow}

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in able:
            left, right = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(right) > 64 or abs(left) > 1e6):
                raise ValueError
            return able[type(node.op)](left, right)
        raise ValueError

    try:
        return float(value(ast.parse((expression or "").strip(), mode="eval").body)) if expression and len(expression) <= 200 else None
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, TypeError):
        return None


@F.pandas_udf(T.DoubleType())
def arithmetic(texts: pd.Series) -> pd.Series:
    return pd.Series([evaluate(t) for t in texts], dtype="float64")
