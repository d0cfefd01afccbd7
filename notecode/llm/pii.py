"""Personal data in disguise: offset-preserving transducers before the detectors.

Three transducers rewrite a text, one after the other: homoglyphs to ASCII, spelled digits to digits,
at/dot disguises to ``@`` and ``.``. Each hands on, for every character it writes, the place in the
source it came from. Detectors then read the rewritten text, and a span found there is mapped back to
the source characters it came from. The plain text is searched as well, and its spans always stay.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecode.llm.texts import map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),  # a match cannot start inside digits, nor end there
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGITS = re.compile(r"[0-9]")
_HINTS = {"ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]")}


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping addresses, found from each at-sign to both sides in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        size = at - last - len(text[last:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if size else None
        last = at + 1
        if domain:
            yield at - size, domain.end()
            last = domain.end()
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = "".join(_DIGITS.findall(found))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def detect(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test."""
    spans = [("email", i, j) for i, j in emails(text)]
    for kind in KINDS[1:]:
        if _HINTS[kind].search(text):
            spans += [(kind, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m.group())]
    return spans


class Tape:
    """A rewritten text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace ``[i, j)`` by a text for each edit in order; its characters stand for all of ``[i, j)``."""
        if not edits:
            return self
        parts, starts, ends, last = [], [], [], 0
        for i, j, new in edits:
            parts += [self.text[last:i], new]
            starts += [self.start[last:i], np.full(len(new), self.start[i])]
            ends += [self.end[last:i], np.full(len(new), self.end[j - 1])]
            last = j
        parts.append(self.text[last:])
        return Tape("".join(parts), np.concatenate([*starts, self.start[last:]]), np.concatenate([*ends, self.end[last:]]))

    def source(self, span: Span) -> Span:
        kind, i, j = span
        return kind, int(self.start[i]), int(self.end[j - 1])


# Letters of other scripts that look like ASCII letters.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһᴀΑΒΕΖΗΙΚΜΝΟΡΤΥΧοиⅼⅰ",
        "ABESIJKMHOPCTYXaesijopcyxdqwhaABEZHIKMNOPTYXouli",
    )
)
# Signs that stand for others, and signs without width.
SIGNS = {"∙": ".", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "➕": "+"}
WIDTHLESS = "­​‌‍⁠﻿"
# Digits in words, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_glyphs: dict[int, str | None] = {}


def _glyph(sign: str) -> str | None:
    """The ASCII text that a non-ASCII character stands for, or None."""
    code = ord(sign)
    if code not in _glyphs:
        if sign in WIDTHLESS:
            new: str | None = ""
        elif sign in LOOKALIKES or sign in SIGNS:
            new = LOOKALIKES.get(sign) or SIGNS.get(sign)
        else:
            plain = unicodedata.normalize("NFKC", sign)
            digit = unicodedata.digit(sign, None)
            new = plain if plain.isascii() and plain.strip() else str(digit) if digit is not None else None
        _glyphs[code] = new
    return _glyphs[code]


_NOT_ASCII = re.compile(r"[^\x00-\x7f\u00c0-\u024f]")  # accented Latin letters stand for themselves


def plain_glyphs(tape: Tape) -> Tape:
    """Homoglyphs, full-width and styled characters to ASCII; characters without width vanish."""
    if tape.text.isascii():
        return tape
    edits = []
    for m in _NOT_ASCII.finditer(tape.text):
        new = _glyph(m.group())
        if new is not None:
            edits.append((m.start(), m.end(), new))
    return tape.rewrite(edits)


_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD}|[0-9]+)(?:[\x20,.-]{{1,3}}(?:{_WORD}|[0-9]+))+(?![^\W_])", re.IGNORECASE)
_ONE_WORD = re.compile(rf"(?<![^\W_]){_WORD}(?![^\W_])", re.IGNORECASE)
_BETWEEN = re.compile(r"[\x20,-]+")
MIN_SPELLED = 3  # spelled digits in a row before they are read as a number


def plain_digits(tape: Tape) -> Tape:
    """Runs with at least ``MIN_SPELLED`` spelled digits to digits.

    Blanks, commas and hyphens between them go; "double" and "triple" are left alone.
    """
    words = tape.text.lower().replace(",", " ").replace(".", " ").replace("-", " ").split()
    if sum(map(DIGIT_WORDS.__contains__, words)) < MIN_SPELLED:
        return tape
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = [w for w in _ONE_WORD.finditer(tape.text, m.start(), m.end())]
        if len(words) < MIN_SPELLED:
            continue
        last = None
        for w in words:
            if last is not None and _BETWEEN.fullmatch(tape.text, last, w.start()):
                edits.append((last, w.start(), ""))
            edits.append((w.start(), w.end(), DIGIT_WORDS[w.group().lower()]))
            last = w.end()
    return tape.rewrite(edits)


_IN_BRACKETS = r"\s{0,2}[\[({<]\s?(?i:%s)\s?[\])}>]\s{0,2}"
_AT = f"(?:{_IN_BRACKETS % 'at|arroba|@'})"
_DOT = f"(?:{_IN_BRACKETS % r'dot|punkt|point|punto|\.'})"
_AT_WORD, _DOT_WORD = "(?i:at|arroba)", "(?i:dot|punkt|point|punto)"
_WIDE_AT = rf"(?:\x20{{1,2}}{_AT_WORD}\x20{{1,2}}|\x20{{0,2}}@\x20{{0,2}}|[-_]{_AT_WORD}[-_])"
_WIDE_DOT = rf"(?:\x20{{1,2}}{_DOT_WORD}\x20{{1,2}}|[-_]{_DOT_WORD}[-_])"
# names stop before a disguised sign, and repeats give nothing back: a text is cut in one way only
_NAME = rf"(?:(?![-_](?:{_AT_WORD}|{_DOT_WORD})[-_])[A-Za-z0-9._%+-])++"
_PART = rf"(?:(?![-_]{_DOT_WORD}[-_])[A-Za-z0-9-])++"
# a bracketed sign is a disguise by itself; the bare word "at" only together with a bare or bracketed "dot"
_DISGUISED = [
    re.compile(rf"(?<![A-Za-z0-9._%+-])({_NAME}(?:(?:{_DOT}|{_WIDE_DOT}){_NAME})*+)({_AT}|\s?@\s?)({_PART}(?:(?:{_DOT}|{_WIDE_DOT}|\.){_PART})++)"),
    re.compile(rf"(?<![A-Za-z0-9._%+-])({_NAME}(?:(?:{_DOT}|{_WIDE_DOT}){_NAME})*+)({_WIDE_AT})({_PART}(?:(?:\.{_PART})*+(?:{_DOT}|{_WIDE_DOT}){_PART})++(?:\.{_PART})*+)"),
]
_DOTS = re.compile(f"{_DOT}|{_WIDE_DOT}")
_DISGUISE_HINT = re.compile(r"[\[({<]\s?(?:at|arroba|@|dot|punkt|point|punto|\.)\s?[\])}>]|[\x20_-](?:dot|punkt|point|punto)[\x20_-]|\s@|@\s", re.IGNORECASE)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT}|{_WIDE_DOT})(?=[0-9])")
NEAR = 400  # characters on each side of a hint that are searched for a disguise, and on to the next white space
_SPACE = re.compile(r"\s")


def _windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text around the hints of a disguise, cut at white space."""
    parts: list[tuple[int, int]] = []
    for m in _DISGUISE_HINT.finditer(text):
        i, j = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if parts and i <= parts[-1][1]:
            if j > parts[-1][1]:
                parts[-1] = (parts[-1][0], j)
        else:
            parts.append((i, j))
    for k, (i, j) in enumerate(parts):
        low, space = parts[k - 1][1] if k else 0, _SPACE.search(text, j)
        while i > low and not text[i - 1].isspace():
            i -= 1
        parts[k] = (i, space.start() if space else len(text))
    return parts


def plain_marks(tape: Tape) -> Tape:
    """At and dot disguises to ``@`` and ``.`` where they make up an address or join numbers."""
    edits: dict[int, tuple[int, int, str]] = {}
    for i, j in _windows(tape.text):
        for pattern in _DISGUISED:
            for m in pattern.finditer(tape.text, i, j):
                marks = [(m.start(2), m.end(2), "@")]
                for group in (1, 3):
                    marks += [(d.start(), d.end(), ".") for d in _DOTS.finditer(tape.text, m.start(group), m.end(group))]
                if len(marks) == 1 and tape.text[marks[0][0] : marks[0][1]] == "@":
                    continue
                edits.update((a, (a, b, new)) for a, b, new in marks)
        edits.update((m.start(), (m.start(), m.end(), ".")) for m in _NUMBER_DOT.finditer(tape.text, i, j))
    chosen, last = [], 0
    for a in sorted(edits):
        if a >= last:
            chosen.append(edits[a])
            last = edits[a][1]
    return tape.rewrite(chosen)


_BARE_DOT = r"\x20{1,2}(?:dot|punkt|point|punto)\x20{1,2}|[-_]dot[-_]"
_TRIAL_DOT = re.compile(rf"(?<=[0-9])(?:{_DOT}|{_BARE_DOT})(?=[0-9])", re.IGNORECASE)
_DIGIT_TOKEN = re.compile(rf"(?<![^\W_])(?:{_WORD}|[0-9]+)(?![^\W_])", re.IGNORECASE)
_GAP = re.compile(r"[\x20,-]{1,3}")


def trial_numbers(tape: Tape) -> list[Tape]:
    """Trial tapes on which every spelled digit is a digit and dot words between numbers are dots.

    However short a run is, the detectors' own tests decide. Gaps go between spelled digits on the
    first tape, also between those and figures on the second.
    """
    if not _ONE_WORD.search(tape.text):
        return []
    tapes = []
    for all_gaps in (False, True):
        edits, last, spelled = [], None, False
        for m in _DIGIT_TOKEN.finditer(tape.text):
            digit = DIGIT_WORDS.get(m.group().lower())
            joined = (spelled or digit is not None) if all_gaps else (spelled and digit is not None)
            if last is not None and joined and _GAP.fullmatch(tape.text, last, m.start()):
                edits.append((last, m.start(), ""))
            if digit is not None:
                edits.append((m.start(), m.end(), digit))
            last, spelled = m.end(), digit is not None
        trial = tape.rewrite(edits)
        tapes.append(trial.rewrite([(m.start(), m.end(), ".") for m in _TRIAL_DOT.finditer(trial.text)]))
    return tapes


TRANSDUCERS: tuple[Callable[[Tape], Tape], ...] = (plain_glyphs, plain_digits, plain_marks)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the plain text, and all spans.

    A disguised span that meets a plain one gives way, unless it strictly contains it; then both stay.
    Of disguised spans of a kind that meet, the longest stays.
    """
    base = detect(text)
    # one sign that no detector takes stands for each plain span, so that what lies beside it is found as well
    known, last = [], 0
    for i, j in sorted((i, j) for _, i, j in base):
        if i >= last:
            known.append((i, j, "\0"))
            last = j
    plain = Tape(text)
    found: set[Span] = set()
    for start in (plain, plain.rewrite(known)) if known else (plain,):
        tape = start
        for step in TRANSDUCERS:
            tape = step(tape)
        if tape is not start:
            found |= {tape.source(s) for s in detect(tape.text)}
        for trial in trial_numbers(plain_glyphs(start)):
            found |= {trial.source(s) for s in detect(trial.text) if s[0] != "email"}
            marked = plain_marks(trial)
            if marked is not trial:
                found |= {marked.source(s) for s in detect(marked.text) if s[0] == "email"}
    new: list[Span] = []
    plain_of = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}  # none overlap within a kind
    new_of: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}

    def meeting(held: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int]]:
        low = bisect_right(held, (i, i))
        low -= low > 0 and held[low - 1][1] > i
        return held[low : bisect_left(held, (j, j))]

    for kind, i, j in sorted(found, key=lambda s: (s[1] - s[2], s)):
        while i < j and text[i].isspace():
            i += 1
        while i < j and text[j - 1].isspace():
            j -= 1
        meets = meeting(plain_of[kind], i, j)
        if all(i <= a and b <= j and (i, j) != (a, b) for a, b in meets) and not meeting(new_of[kind], i, j):
            insort(new_of[kind], (i, j))
            new.append((kind, i, j))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return base, sorted([*base, *new], key=lambda s: (order[s[0]], s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{i}:{j}" for kind, i, j in spans)


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)`` for each input row, both arrays of ``(kind, start, end)``.

    Offsets are code points of the source, end exclusive; ``base`` has the spans of the plain text,
    ``spans`` these and the disguised ones, by kind and start. Null and empty texts have none. Null
    ids and repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    name = docs.schema[id_col].dataType.simpleString()
    kind = "array<struct<kind:string,start:long,end:long>>"

    def search(batch):
        found = [find(text or "") for text in batch.column(1).to_pylist()]
        as_rows = lambda spans: [{"kind": k, "start": i, "end": j} for k, i, j in spans]
        yield {"doc_id": batch.column(0), "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]}

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), search, f"doc_id {name}, base {kind}, spans {kind}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with each span of personal data replaced by its kind in angle brackets."""
    name = docs.schema[id_col].dataType.simpleString()

    def clean(batch):
        out = []
        for text in batch.column(1).to_pylist():
            parts, last = [], 0
            for kind, i, j in sorted(find(text)[1], key=lambda s: (s[1], -s[2])) if text else ():
                if i >= last:
                    parts += [text[last:i], f"<{kind}>"]
                last = max(last, j)
            out.append(text if text is None else "".join([*parts, text[last:]]))
        yield {"doc_id": batch.column(0), "text": out}

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), clean, f"doc_id {name}, text string")
