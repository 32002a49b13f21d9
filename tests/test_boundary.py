"""Nothing outside the llm subpackage needs it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_module_outside_imports_it():
    for path in (ROOT / "lexsieve").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) lexsieve\.llm|^\s*from lexsieve import .*\bllm\b", path.read_text(), re.M), path
