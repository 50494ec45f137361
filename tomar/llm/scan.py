"""The layout of scanned texts: page numbers, running lines and divided words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_DIGITS = str.maketrans({"l": "1", "I": "1", "ı": "1", "|": "1", "i": "1", "!": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2", "z": "2"})
_N = r"[0-9lIıi|!OoSBZz]{1,4}"
# Named notations of a page number that stands alone on its line.
_NUMBER_LINES = [
    ("word", re.compile(rf"(?:[sS5][aα@4][yv][fFt][aα@4]|[pP][aA][gG][eE]|[sS][hH]|[pP][gG]|[sS5])\s*[.:]?\s*(?:[nN][oO]\s*[.:]?\s*)?({_N})(?:\s*[/\\]\s*({_N}))?\.?", re.I)),
    ("of", re.compile(rf"({_N})\s*[/\\]\s*({_N})")),
    ("boxed", re.compile(rf"[\[({{|]\s*({_N})\s*[\])}}|]")),
    ("dashed", re.compile(rf"[-–—~_=.*]+\s*({_N})\s*[-–—~_=.*]+")),
    ("bare", re.compile(rf"({_N})")),
]
_STRONG = {"word"}
_NOT_PLAIN = re.compile(r"[\W_]+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬­][ \t]*$")


@dataclass
class Layout:
    """Lines of a text as [start, end) and the numbers of those that belong to the page, not to the text."""

    lines: list[tuple[int, int]] = field(default_factory=list)
    numbers: set[int] = field(default_factory=set)
    running: set[int] = field(default_factory=set)


def _value(text: str) -> int | None:
    digits = text.translate(_DIGITS)
    return int(digits) if digits.isdigit() else None


def number_line(line: str) -> tuple[str, int] | None:
    """The notation and the number of a line that can only be, or may be, a page number."""
    line = line.strip()
    if not line or len(line) > 24:
        return None
    for name, pattern in _NUMBER_LINES:
        m = pattern.fullmatch(line)
        if m and any(c.isdigit() for c in line.translate(_DIGITS)):
            n = _value(m[1])
            last = _value(m[2]) if m.lastindex == 2 and m[2] else None
            if n is not None and (last is None or 0 < n <= last) and (any(c.isdigit() for c in line) or name in ("word", "of", "boxed", "dashed")):
                return name, n
    return None


def _similar(a: str, b: str, share: int = 5) -> bool:
    """Whether two lines are the same but for misread characters: one in ``share`` at most."""
    if a == b:
        return True
    long = max(len(a), len(b))
    if not a or not b or abs(len(a) - len(b)) * share > long:
        return False
    # With fewer edits than blocks of that many characters, one block is whole in the other line.
    return any(a[i : i + share] in b for i in range(0, len(a) - share + 1, share)) and edits(a, b) * share <= long


def edits(a: str, b: str) -> int:
    """The edit distance of two strings, a whole column of the table at a time as the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        hit = places.get(c, 0)
        flat = (((hit & up) + up) ^ up) | hit | down
        right, left = down | (full & ~(flat | up)), up & flat
        distance += bool(right & top) - bool(left & top)
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (full & ~(flat | right)), right & flat
    return distance


def layout(text: str) -> Layout:
    """Which lines of a text are page numbers and running lines.

    Page numbers are lines in one of the usual notations whose numbers follow each other through the text;
    a notation without a word counts only in a sequence or beside a form feed. Running lines stand at a page's
    edge and recur, misread forms included, at the edges of at least two pages.
    """
    out = Layout()
    at, page, page_of = 0, 0, []
    feeds = []
    for part in text.split("\f"):
        for line in part.split("\n"):
            out.lines.append((at, at + len(line)))
            page_of.append(page)
            at += len(line) + 1
        page += 1
        feeds.append(len(out.lines))
    feeds.pop()
    filled = [i for i, (a, b) in enumerate(out.lines) if text[a:b].strip()]
    if not filled:
        return out
    place = {i: k for k, i in enumerate(filled)}
    by_name: dict[str, list[tuple[int, int]]] = {}
    for i in filled:
        a, b = out.lines[i]
        if b - a <= 40:
            found = number_line(text[a:b])
            if found:
                by_name.setdefault(found[0], []).append((i, found[1]))
    edge = {i for f in feeds for i in _around(filled, f, 1)} | {filled[0], filled[-1]}
    for name, own in by_name.items():
        chain = _sequence(own)
        if len(chain) >= 2 or (name in _STRONG and chain) or (chain and chain[0] in edge and feeds):
            out.numbers |= set(chain)
        elif name in ("of", "boxed", "dashed") and chain and chain[0] == filled[-1]:
            out.numbers |= set(chain)
    # The edges of the pages: at form feeds, and at page numbers where the text has no form feeds.
    breaks = sorted({*feeds, *((i + 1 if not _first_on_page(i, filled, out.numbers, feeds) else i) for i in (out.numbers if not feeds else ()))})
    body = [i for i in filled if i not in out.numbers]
    if not body:
        return out
    plain = {i: _NOT_PLAIN.sub("", text[slice(*out.lines[i])]) for i in body}
    if not breaks:
        out.running |= _recurring(text, out.lines, body, plain)
        return _spread(out, body, plain)
    heads, feet = [], []
    marks = [0, *breaks, len(out.lines)]
    for a, b in zip(marks, marks[1:]):
        own = [i for i in body if a <= i < b]
        if own:
            heads.append(own[0])
            if own[-1] != own[0]:
                feet.append(own[-1])
    for side in (heads, feet):
        best: list[int] = []
        for i in side:
            group = [j for j in side if _similar(plain[i], plain[j])]
            if len(group) > len(best):
                best = group
        if len(best) >= 2 and 2 * len(best) >= len(side) and all(plain[i] for i in best):
            out.running |= set(best)
    return _spread(out, body, plain)


def _spread(out: Layout, body: list[int], plain: dict[int, str]) -> Layout:
    """The lines that are like a running line, or like the first line, wherever they stand below the letterhead."""
    seeds = {plain[i] for i in out.running}
    first = plain[body[0]]
    if len(first) >= 6 and any(_similar(first, plain[i]) for i in body[5:]):
        seeds.add(first)
        out.running.add(body[0])
    if seeds:
        out.running |= {i for k, i in enumerate(body) if (k == 0 or k > 4) and any(_similar(s, plain[i]) for s in seeds)}
    return out


def _recurring(text: str, lines: list[tuple[int, int]], body: list[int], plain: dict[int, str]) -> set[int]:
    """Running lines of a text without page breaks: whole lines that recur far apart and end no sentence."""
    able = []
    for k, i in enumerate(body):
        line = text[slice(*lines[i])].strip()
        if 8 <= len(line) <= 120 and line[-1] not in ".,;:!?)¬-" and ":" not in line and line[0].isupper() and (k == 0 or k > 4):
            able.append((k, i))
    out: set[int] = set()
    for k, i in able:
        if i in out:
            continue
        group = [(n, j) for n, j in able if _similar(plain[i], plain[j])]
        if len(group) >= 2 and min(b[0] - a[0] for a, b in zip(group, group[1:])) >= 6:
            out |= {j for _, j in group}
        elif len(group) == 1 and k > 4 and len(plain[i]) > 10 and any(_similar(plain[i], plain[j]) for j in body[1:5]):
            out.add(i)  # the letterhead once more
    return out


def _around(filled: list[int], at: int, n: int) -> list[int]:
    before = [i for i in filled if i < at][-n:]
    after = [i for i in filled if i >= at][:n]
    return before + after


def _first_on_page(i: int, filled: list[int], numbers: set[int], feeds: list[int]) -> bool:
    """Whether page numbers stand at the top: the text begins with one."""
    return filled[0] in numbers


def _sequence(own: list[tuple[int, int]]) -> list[int]:
    """The lines of the longest run of numbers that go up by one (gaps of unread numbers allowed)."""
    best: list[int] = []
    for start in range(len(own)):
        if own[start][1] > 2 and start:
            continue
        chain, n = [own[start][0]], own[start][1]
        for i, v in own[start + 1 :]:
            if n < v <= n + 2:
                chain.append(i)
                n = v
        if len(chain) > len(best):
            best = chain
    return best


def body_lines(text: str, found: Layout) -> list[tuple[int, int]]:
    """The lines that belong to the text, blank ones included."""
    return [line for i, line in enumerate(found.lines) if i not in found.numbers and i not in found.running]


def divided(left: str, right: str) -> tuple[str, str] | None:
    """(left part, right part) of a word divided between two lines."""
    m = _HYPHEN.search(left)
    if not m:
        return None
    head = re.search(r"[^\W\d_]+$", left[: m.start()])
    tail = re.match(r"\s*([^\W\d_]+)", right)
    if not head or not tail:
        return None
    before = left[: head.start()]
    if before and before[-1] in "-@._/0123456789":
        return None
    if tail[1][0].isupper() and not (head[0].isupper() and len(head[0]) > 1):
        return None  # a name after a real hyphen, unless all is in capitals
    return head[0], tail[1]


def continuous(text: str) -> str:
    """The text without page numbers and running lines, divided words joined; for comparisons."""
    if "\n" not in text:
        return text
    paged = "\f" in text or text.count("\n") > 24 or _MAY_BE_PAGED.search(text)
    if not paged and not _DIVIDED.search(text):
        return text
    lines = [text[a:b] for a, b in body_lines(text, layout(text))] if paged else text.split("\n")
    out: list[str] = []
    last = -1
    for line in lines:
        if not line.strip():
            continue
        if last >= 0 and out[last].rstrip()[-1:] in _HYPHENS and divided(out[last], line):
            out[last] = _HYPHEN.sub("", out[last]) + line.lstrip()
        else:
            out.append(line)
            last = len(out) - 1
    return "\n".join(out)


_HYPHENS = tuple("-‐‑¬­")
_DIVIDED = re.compile(r"[-‐‑¬­][ \t]*\n")
_MAY_BE_PAGED = re.compile(rf"^[ \t]*(?:[^\W\d_]{{1,5}}\s*[.:]?\s*)?[\[({{|–—~_=.*-]*\s*{_N}\s*(?:/\s*{_N}\s*)?[\])}}|–—~_=.*-]*[ \t]*$", re.M)
