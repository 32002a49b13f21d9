"""Term lists from JSON to packs and back: python -m lexsieve.sources.convert LIST [-o FILE] [--text | --show]."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lexsieve.functions.fold import PROFILE
from lexsieve.sources import pack
from lexsieve.sources.documents import SCHEMA, TermList, read_list, read_seed
from lexsieve.sources.typed import DocumentError


def to_pack(document: str) -> bytes:
    """The pack of a JSON list, which must name its profile; it is read back first."""
    found = read_seed(document)
    if json.loads(document).get("profile") is None:
        raise DocumentError(f"a list to pack must name its 'profile', which is '{PROFILE}'")
    data = pack.encode([(t.text, t.category_name, t.severity, t.word) for t in found.terms], list(found.allow))
    if read_list(data) != TermList(found.terms, found.allow):
        raise DocumentError("the list would not read back as it is")
    return data


def to_document(source: bytes | str) -> str:
    """The JSON list of a pack in bytes or in base64, or of a JSON list."""
    found = read_list(source)
    entries = [{"t": t.text, "cat": t.category_name, "sev": t.severity} | ({"w": True} if t.word else {}) for t in found.terms]
    return json.dumps({"schema": SCHEMA, "profile": PROFILE, "entries": entries, "allow": list(found.allow)}, ensure_ascii=False, indent=1)


def main(words: list[str]) -> int:
    told = argparse.ArgumentParser(prog="convert", description=__doc__)
    told.add_argument("source", type=Path)
    told.add_argument("-o", "--out", type=Path, help="file to write; else base64 or JSON is printed")
    told.add_argument("--text", action="store_true", help="base64 in place of bytes")
    told.add_argument("--show", action="store_true", help="a pack as JSON")
    asked = told.parse_args(words)
    try:
        raw = asked.source.read_bytes()
        if asked.show:
            made: bytes = to_document(raw if raw.startswith(pack.MAGIC) else raw.decode()).encode()
        else:
            made = to_pack(raw.decode())
            if asked.text or asked.out is None:
                made = pack.to_text(made).encode()
    except (DocumentError, UnicodeDecodeError) as fault:
        print(f"{asked.source}: {fault}", file=sys.stderr)
        return 1
    if asked.out is None:
        print(made.decode())
    else:
        asked.out.write_bytes(made)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
