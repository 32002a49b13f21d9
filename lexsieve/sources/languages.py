"""The catalogue of term lists by language code.

One short English list of mild words comes with the package. Full lists are data that
the caller owns: a folder with <code>.json or <code>.pack files, named by use_folder() or by
LEXSIEVE_LISTS.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexsieve.sources.documents import Term, TermList, read_list

DEFAULT = "en"

# Mild words of the list that comes with the package (text, severity, whole word).
MILD = (
    ("damn", 1, False), ("hell", 1, True), ("crap", 1, True), ("dang", 1, True), ("darn", 1, True), ("heck", 1, True),
    ("stupid", 1, True), ("idiot", 1, False), ("moron", 2, True), ("loser", 1, True), ("dumb", 1, True), ("jerk", 1, True),
    ("scum", 2, True), ("trash", 1, True), ("bloody", 1, True), ("bugger", 2, False), ("git", 1, True), ("goddamn", 2, False),
)
# Words that hold one of them and are harmless.
HARMLESS = ("looser", "idiotypic", "debugger", "damnify")

# The languages that lists are made for, by code.
NAMES = {
    "ar": "Arabic", "de": "German", "en": "English", "es": "Spanish", "fa": "Persian", "fr": "French", "hi": "Hindi",
    "it": "Italian", "ko": "Korean", "nl": "Dutch", "pl": "Polish", "ru": "Russian", "th": "Thai", "vi": "Vietnamese", "zh": "Chinese",
}

_folder: Path | None = None


def use_folder(path: str | os.PathLike | None) -> None:
    global _folder
    _folder = None if path is None else Path(path)


def folder() -> Path | None:
    if _folder is not None:
        return _folder
    named = os.environ.get("LEXSIEVE_LISTS")
    return Path(named) if named else None


def _files() -> dict[str, Path]:
    place = folder()
    if place is None or not place.is_dir():
        return {}
    return {p.stem.lower(): p for p in sorted(place.iterdir()) if p.suffix in (".json", ".pack")}


def available() -> tuple[str, ...]:
    return tuple(sorted({DEFAULT, *_files()}))


def has(code: str) -> bool:
    return code.lower() in available()


def read(code: str) -> TermList:
    code = code.lower()
    path = _files().get(code)
    if path is not None:
        return read_list(path.read_bytes() if path.suffix == ".pack" else path.read_text("utf-8"))
    if code != DEFAULT:
        raise ValueError(f"there is no list for '{code}'; there are {', '.join(available())}")
    return TermList(tuple(Term(t, "profanity", s, w) for t, s, w in MILD), HARMLESS)


def table(spark: SparkSession) -> DataFrame:
    """The catalogue: code, name, carried (there is a list), vetted (it was made here), n_terms, n_allow."""
    rows = []
    for code in sorted({*NAMES, *available()}):
        found = read(code) if has(code) else TermList(())
        rows.append((code, NAMES.get(code, code), has(code), has(code) and code not in _files(), len(found.terms), len(found.allow)))
    return spark.createDataFrame(rows, "code string, name string, carried boolean, vetted boolean, n_terms int, n_allow int")
