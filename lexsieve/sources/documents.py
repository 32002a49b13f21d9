"""Term lists and presets as JSON documents, as packs, or as packs in base64."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from lexsieve.functions.fold import PROFILE
from lexsieve.plans.policy import Category, Policy
from lexsieve.sources import pack, typed
from lexsieve.sources.typed import DocumentError

SCHEMA = 1


@dataclass(frozen=True)
class Term:
    """word: only matches as a whole word."""

    text: str
    category_name: str = "other"
    severity: int = 1
    word: bool = False

    @property
    def category(self) -> Category:
        return Category.parse(self.category_name)


@dataclass(frozen=True)
class TermList:
    terms: tuple[Term, ...]
    allow: tuple[str, ...] = ()


def check_pins(members: dict, what: str) -> None:
    schema = typed.whole(members, "schema", None)
    if schema not in (None, SCHEMA):
        raise DocumentError(f"{what}: 'schema' must be {SCHEMA}, not {schema}")
    profile = typed.string(members, "profile", None)
    if profile not in (None, PROFILE):
        raise DocumentError(f"{what}: 'profile' must be '{PROFILE}', not '{profile}'")


def read_entry(entry: object, default_severity: int) -> Term:
    if not isinstance(entry, dict):
        raise DocumentError("an item of 'entries' must be an object")
    text = entry.get("t")
    if not isinstance(text, str) or not text:
        raise DocumentError("an item of 'entries' must hold a non-empty string 't'")
    category = typed.string(entry, "cat", "other")
    severity = typed.whole(entry, "sev", default_severity)
    if not 1 <= severity <= 5:
        raise DocumentError(f"'sev' must be 1 to 5, not {severity}, for '{text}'")
    return Term(text, category, severity, typed.flag(entry, "w", False))


def read_seed(text: str) -> TermList:
    members = typed.parse_object(text, "The term list")
    check_pins(members, "The term list")
    entries = members.get("entries")
    if not isinstance(entries, list):
        raise DocumentError("'entries' must be an array")
    return TermList(tuple(read_entry(e, 1) for e in entries), tuple(typed.strings(members, "allow")))


def read_list(source: str | bytes, key: bytes = pack.KEY) -> TermList:
    """A term list from JSON, from pack bytes, or from a pack in base64; told apart by how it begins."""
    if isinstance(source, bytes):
        return _of_pack(pack.decode(source, key))
    start = source.lstrip("﻿ \t\r\n\f\v")
    if start.startswith("{"):
        return read_seed(start)
    data = pack.from_text(source)
    if data is None:
        raise DocumentError("The term list is neither a JSON object nor a pack in base64")
    return _of_pack(pack.decode(data, key))


def _of_pack(found: dict) -> TermList:
    return TermList(tuple(Term(*e) for e in found["entries"]), tuple(found["allow"]))


@dataclass(frozen=True)
class Preset:
    """A whole policy as one document."""

    name: str | None = None
    description: str | None = None
    languages: tuple[str, ...] = ()
    policy: Policy = field(default_factory=Policy)
    entries: tuple[Term, ...] = ()
    allow: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str, carried: tuple[str, ...] | None = None) -> Preset:
        """carried: the language codes that can be served, if that is to be checked here."""
        members = typed.parse_object(text, "The preset")
        check_pins(members, "The preset")
        entries = members.get("entries")
        if entries is not None and not isinstance(entries, list):
            raise DocumentError(f"'entries' must be an array, not {typed.type_name(entries)}")
        terms = tuple(read_entry(e, 3) for e in entries or ())
        options = members.get("options")
        if options is not None and not isinstance(options, dict):
            raise DocumentError(f"'options' must be a JSON object, not {typed.type_name(options)}")
        name, description = typed.string(members, "name", None), typed.string(members, "description", None)
        languages = tuple(typed.strings(members, "languages"))
        for code in languages:
            if not (2 <= len(code) <= 8 and code.isascii() and code.isalpha() and code.islower()):
                raise DocumentError(f"'languages' holds '{code}'; a code is 2 to 8 lower-case letters")
            if carried is not None and code not in carried:
                raise DocumentError(f"'languages' holds '{code}'; there are {', '.join(carried)}")
        policy = Policy.from_object(options or {})
        return cls(name, description, languages, policy, terms, tuple(typed.strings(members, "allow")), tuple(typed.strings(members, "remove")))

    def to_json(self) -> str:
        out: dict = {"schema": SCHEMA, "profile": PROFILE}
        out |= {k: v for k, v in (("name", self.name), ("description", self.description)) if v is not None}
        entries = [{"t": t.text, "cat": t.category_name, "sev": t.severity} | ({"w": True} if t.word else {}) for t in self.entries]
        out |= {"languages": list(self.languages), "options": self.policy.to_object(), "entries": entries}
        return json.dumps(out | {"allow": list(self.allow), "remove": list(self.remove)}, ensure_ascii=False)
