"""Strict reading of JSON members: no conversions; a missing member equals an explicit null."""

from __future__ import annotations

import json
from typing import Any


class DocumentError(ValueError):
    """A document that can't be used; the message names the member at fault."""


def type_name(value: Any) -> str:
    if value is None:
        return "null"
    names = {bool: "true or false", int: "a number", float: "a number", str: "a string", list: "an array", dict: "an object"}
    return names[type(value)]


def parse_object(text: str, what: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError as error:
        raise DocumentError(f"{what} is not valid JSON: {error}") from error
    if not isinstance(found, dict):
        raise DocumentError(f"{what} must be a JSON object, not {type_name(found)}")
    return found


def whole(members: dict, name: str, default: int | None) -> int | None:
    value = members.get(name)
    if value is None:
        return default
    if type(value) is not int or not -(2**31) <= value < 2**31:
        raise DocumentError(f"'{name}' must be a whole number, not {json.dumps(value)}")
    return value


def flag(members: dict, name: str, default: bool) -> bool:
    value = members.get(name)
    if value is not None and not isinstance(value, bool):
        raise DocumentError(f"'{name}' must be true or false, not {type_name(value)}")
    return default if value is None else value


def string(members: dict, name: str, default: str | None) -> str | None:
    value = members.get(name)
    if value is not None and not isinstance(value, str):
        raise DocumentError(f"'{name}' must be a string, not {type_name(value)}")
    return default if value is None else value


def strings(members: dict, name: str) -> list[str]:
    value = members.get(name)
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise DocumentError(f"'{name}' must be an array of strings")
    return [x for x in value if x]
