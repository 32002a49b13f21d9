"""What to report and how to mask and score it."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from enum import StrEnum

from lexsieve.sources import typed
from lexsieve.sources.typed import DocumentError


class Category(StrEnum):
    OTHER = "other"
    PROFANITY = "profanity"
    SEXUAL = "sexual"
    HATE = "hate"
    VIOLENCE = "violence"
    DRUG = "drug"

    @classmethod
    def find(cls, name: str | None) -> Category | None:
        return next((c for c in cls if c.value == name), None)

    @classmethod
    def parse(cls, name: str | None) -> Category:
        """An unknown name is OTHER."""
        return cls.find(name) or cls.OTHER


class ScoreMode(StrEnum):
    TOTAL = "total"
    MAX = "max"


@dataclass(frozen=True)
class Policy:
    """categories: None reports all, an empty set none. mask_token replaces a masked stretch;
    without it each UTF-16 unit becomes mask_char."""

    min_severity: int = 1
    categories: frozenset[Category] | None = None
    mask_char: str = "*"
    mask_token: str | None = None
    repeat_tolerance: bool = True
    collapse_contained: bool = True
    score_mode: ScoreMode = ScoreMode.TOTAL

    def __post_init__(self) -> None:
        if self.categories is not None:
            object.__setattr__(self, "categories", frozenset(Category(c) for c in self.categories))
        object.__setattr__(self, "score_mode", ScoreMode(self.score_mode))
        if not 1 <= self.min_severity <= 5:
            raise ValueError(f"minSeverity must be 1 to 5, not {self.min_severity}")
        if len(self.mask_char) != 1 or ord(self.mask_char) > 0xFFFF:
            raise ValueError("maskChar must be exactly one character")
        if self.mask_token == "":
            raise ValueError("maskToken must not be empty")

    def replace(self, **changes: object) -> Policy:
        return replace(self, **changes)

    def allows(self, category: Category, severity: int) -> bool:
        return severity >= self.min_severity and (self.categories is None or category in self.categories)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        return cls.from_object(typed.parse_object(text, "The options"))

    @classmethod
    def from_object(cls, found: dict) -> Policy:
        floor = typed.whole(found, "minSeverity", 1)
        if not 1 <= floor <= 5:
            raise DocumentError(f"'minSeverity' must be 1 to 5, not {floor}")
        char = typed.string(found, "maskChar", "*")
        if len(char.encode("utf-16-le")) != 2:
            raise DocumentError(f"'maskChar' must be exactly one character, not '{char}'")
        token = typed.string(found, "maskToken", None)
        if token == "":
            raise DocumentError("'maskToken' must not be empty; without it every character is masked")
        repeat = typed.flag(found, "repeatTolerance", True)
        collapse = typed.flag(found, "collapseContained", True)
        mode = typed.string(found, "scoreMode", None)
        if mode not in (None, *ScoreMode):
            raise DocumentError(f"'scoreMode' must be 'total' or 'max', not '{mode}'")
        names = found.get("categories")
        if names is not None and not isinstance(names, list):
            raise DocumentError(f"'categories' must be an array of names, not {typed.type_name(names)}")
        for name in names or ():
            if not isinstance(name, str) or Category.find(name) is None:
                raise DocumentError(f"'categories' holds '{name}', which this build does not know; it knows {', '.join(Category)}")
        chosen = None if names is None else frozenset(map(Category, names))
        return cls(floor, chosen, char, token, repeat, collapse, ScoreMode(mode or "total"))

    def to_object(self) -> dict:
        out: dict = {
            "minSeverity": self.min_severity,
            "maskChar": self.mask_char,
            "maskToken": self.mask_token,
            "repeatTolerance": self.repeat_tolerance,
            "collapseContained": self.collapse_contained,
            "scoreMode": str(self.score_mode),
        }
        if self.categories is not None:
            out["categories"] = [str(c) for c in Category if c in self.categories]
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_object(), ensure_ascii=False)
