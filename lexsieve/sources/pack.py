"""Packs: term lists as masked binary records.

Layout: "VPK1", then masked by a key stream: schema, flags (bit 0: words to allow
follow), profile, category names, terms with one byte for category (4 bits), whole word (1 bit) and
severity (3 bits), words to allow. Texts are UTF-8 behind their length; numbers are
unsigned LEB128 of at most 31 bits.
"""

from __future__ import annotations

import base64
import binascii

from lexsieve.functions.fold import PROFILE
from lexsieve.sources.typed import DocumentError

MAGIC = b"VPK1"
#: The key of our own packs; those of other tools are read with theirs.
KEY = b"lexsieve"
SCHEMA, HAS_ALLOW, MOST_CATEGORIES, MOST = 1, 1, 16, 2**31 - 1


def masked(data: bytes, key: bytes) -> bytes:
    """data under the RC4 key stream; twice gives data again. It hides words from a casual reader, no more."""
    state = list(range(256))
    j = 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) % 256
        state[i], state[j] = state[j], state[i]
    out = bytearray()
    j = 0
    for n, byte in enumerate(data, 1):
        i = n % 256
        j = (j + state[i]) % 256
        state[i], state[j] = state[j], state[i]
        out.append(byte ^ state[(state[i] + state[j]) % 256])
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > self.left:
            raise DocumentError("The pack ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        value = 0
        for k in range(5):
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << 7 * k
            if byte < 0x80:
                if value > MOST:
                    break
                return value
        raise DocumentError("The pack holds a number of more than 31 bits")

    def text(self) -> str:
        try:
            return self.take(self.number()).decode()
        except UnicodeDecodeError as error:
            raise DocumentError("The pack holds bytes that are not UTF-8") from error

    def count(self, least: int) -> int:
        """How many items follow, of at least so many bytes each."""
        n = self.number()
        if n * least > self.left:
            raise DocumentError("The pack ends before the items it announces")
        return n


def decode(data: bytes, key: bytes = KEY) -> dict:
    """{"entries": [(text, category, severity, whole word)], "allow": [words]}"""
    if not data.startswith(MAGIC):
        raise DocumentError("The pack does not begin as a pack")
    r = _Reader(masked(data[len(MAGIC) :], key))
    if (schema := r.take(1)[0]) != SCHEMA:
        raise DocumentError(f"The pack's schema must be {SCHEMA}, not {schema}")
    flags = r.take(1)[0]
    if (profile := r.text()) != PROFILE:
        raise DocumentError(f"The pack's profile must be '{PROFILE}', not '{profile}'")
    names = [r.text() for _ in range(r.count(1))]
    entries = []
    for _ in range(r.count(3)):
        text, byte = r.text(), r.take(1)[0]
        number, severity = byte >> 4, byte & 7
        if not text:
            raise DocumentError("The pack holds an empty term")
        if number >= len(names):
            raise DocumentError("The pack holds a term of no category")
        if not 1 <= severity <= 5:
            raise DocumentError(f"The pack holds a severity of {severity}")
        entries.append((text, names[number], severity, bool(byte & 8)))
    allow = [r.text() for _ in range(r.count(1))] if flags & HAS_ALLOW else []
    if r.left:
        raise DocumentError("The pack goes on after its last item")
    return {"entries": entries, "allow": [w for w in allow if w]}


def number(value: int) -> bytes:
    if not 0 <= value <= MOST:
        raise DocumentError("a number must have at most 31 bits")
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def encode(entries: list[tuple[str, str, int, bool]], allow: list[str] = [], key: bytes = KEY) -> bytes:  # noqa: B006
    def text(value: str) -> bytes:
        return number(len(value.encode())) + value.encode()

    names = sorted({e[1] for e in entries})
    if len(names) > MOST_CATEGORIES:
        raise DocumentError(f"a pack holds at most {MOST_CATEGORIES} categories")
    if any(not 1 <= e[2] <= 5 or not e[0] for e in entries):
        raise DocumentError("a term needs a text and a severity from 1 to 5")
    body = bytes([SCHEMA, HAS_ALLOW if allow else 0]) + text(PROFILE)
    body += number(len(names)) + b"".join(map(text, names)) + number(len(entries))
    body += b"".join(text(t) + bytes([names.index(c) << 4 | w << 3 | s]) for t, c, s, w in entries)
    if allow:
        body += number(len(allow)) + b"".join(map(text, allow))
    return MAGIC + masked(body, key)


def from_text(text: str) -> bytes | None:
    """The pack in a base64 text (blanks, a leading mark, URL letters and lost padding are fine), else None."""
    plain = "".join(text.removeprefix("﻿").split()).replace("-", "+").replace("_", "/").rstrip("=")
    try:
        data = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return data if data.startswith(MAGIC) else None


def to_text(data: bytes) -> str:
    return base64.b64encode(data).decode()
