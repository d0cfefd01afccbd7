"""Cleaning and tokenising of note texts and label titles, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Administrative phrases removed from notes, in the order of removal. Order matters,
# since an earlier removal can split or create a later phrase.
ADMIN_PHRASES = (
    "Admission Date",
    "Discharge Date",
    "Date of Birth",
    "Phone",
    "Date/Time",
    "ID",
    "Completed by",
    "Dictated By",
    "Attending",
    "Provider: ",
    "Provider",
    "Primary",
    "Secondary",
    " MD Phone",
    " M.D. Phone",
    " MD",
    " PHD",
    " X",
    " IV",
    " VI",
    " III",
    " II",
    " VIII",
    "JOB#",
    "JOB#: cc",
    "# Code",
    "Metoprolol Tartrate 25 mg Tablet Sig",
    ")",
    "000 unit/mL Suspension Sig",
    "0.5 % Drops ",
    "   Status: Inpatient DOB",
    "Levothyroxine 50 mcg Tablet Sig",
    "0.5 % Drops Sig",
    "Lidocaine 5 %(700 mg/patch) Adhesive Patch",
    "Clopidogrel Bisulfate 75 mg Tablet Sig",
    "Levofloxacin 500 mg Tablet Sig",
    "Albuterol 90 mcg/Actuation Aerosol ",
    "None Tech Quality: Adequate Tape #",
    "000 unit/mL Solution Sig",
    " x",
    " am",
    " pm",
)

# Patterns of code headings, e.g. "1. INFECTIONS (001-139)" and "001.0 Cholera".
CHAPTER_PATTERN = r"^(\d+\.\s*)?([\-\d\w\s\,\.]*)\s*\((\w?\d+)(-(\w?\d+)\))?"
SECTION_PATTERN = r"^()([\-\d\w\s\,\.]*)\s*\((\w?\d+)(-(\w?\d+)\))?"
SINGLE_CODE_PATTERN = r"^\s*(\w?\d+(\.\d*)?)\s+(.*)"

# All characters that count as white space in Unicode text; plain \s is ASCII only.
SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]"

REGEX_SIGNS = set(".^$*+?{}[]\\|()")


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def strip_deid(text: Column) -> Column:
    """Remove ``[...]`` spans, shortest first, never across a line break."""
    return F.regexp_replace(text, r"(?d)\[.*?\]", "")


def strip_phrases(text: Column, phrases: Sequence[str] = ADMIN_PHRASES, mode: str = "regex") -> Column:
    """Remove phrases one after the other, also inside words.

    In ``regex`` mode a phrase of several characters is a pattern, so a dot matches any character
    and parentheses group; in ``literal`` mode it stands for itself. Phrases without pattern signs
    always use the cheaper literal replacement.
    """
    if mode not in ("regex", "literal"):
        raise ValueError(f"mode must be 'regex' or 'literal', not {mode!r}")
    for phrase in phrases:
        if mode == "regex" and len(phrase) > 1 and REGEX_SIGNS & set(phrase):
            text = F.regexp_replace(text, "(?d)" + phrase, "")
        else:
            text = F.replace(text, F.lit(phrase), F.lit(""))
    return text


def normalise_text(text: Column) -> Column:
    """Line breaks to spaces, ``w/`` to ``with``, no ``_``, ``#`` or digits, single spaces, trimmed."""
    text = single_line(text)
    text = F.replace(text, F.lit("w/"), F.lit("with"))
    text = F.replace(F.replace(text, F.lit("_"), F.lit("")), F.lit("#"), F.lit(""))
    text = F.regexp_replace(text, r"\p{Nd}+", "")
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def clean_note(text: Column, mode: str = "regex") -> Column:
    return normalise_text(strip_phrases(strip_deid(text), mode=mode))


def single_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def clean_label(title: Column) -> Column:
    """Turn each run of punctuation (not parentheses or hyphens) into one space and trim."""
    return strip_spaces(F.regexp_replace(title, r"[,.:;\\'/@#?!\[\]&$_*]+", " "))


def code_prefix(code: Column, procedure: bool = False) -> Column:
    """The category of a code: its first three characters, for procedures with a dot after two."""
    if procedure:
        return F.concat(F.substring(code, 1, 2), F.lit("."), F.substring(code, 3, 1))
    return F.substring(code, 1, 3)


def split_codes(codes: Column) -> Column:
    return F.split(codes, ",")


def join_codes(codes: Column) -> Column:
    return F.array_join(codes, ",")


def tokenize_words(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(tokens: Column, longest: int = 1, shortest: int = 1) -> Column:
    """All runs of ``shortest`` to ``longest`` neighbouring tokens, joined by a space."""
    runs = []
    grams = tokens
    for n in range(1, longest + 1):
        if n > 1:
            # lengthen each run by the token behind it; the lambda sees elements only, so the cost is linear
            k = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
            grams = F.zip_with(F.slice(grams, 1, k), F.slice(tokens, n, k), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= shortest:
            runs.append(grams)
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def extract_ranged_code(text: Column, pattern: str = CHAPTER_PATTERN) -> Column:
    """Struct (code, descr) of a heading such as ``Title (001-139)``; both null without a match."""
    start, end = F.regexp_extract(text, pattern, 3), F.regexp_extract(text, pattern, 5)
    code = F.when(end != "", F.concat(start, F.lit("-"), end)).otherwise(start)
    return F.struct(
        F.when(start != "", code).alias("code"),
        F.when(start != "", F.regexp_extract(text, pattern, 2)).alias("descr"),
    )


def extract_single_code(text: Column, pattern: str = SINGLE_CODE_PATTERN) -> Column:
    """Struct (code, descr) of a heading such as ``001.0 Title``; both null without a match."""
    code = F.regexp_extract(text, pattern, 1)
    return F.struct(
        F.when(code != "", code).alias("code"),
        F.when(code != "", F.regexp_extract(text, pattern, 3)).alias("descr"),
    )
