"""Nothing outside the corpus subpackage depends on it."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_only_the_entry_names_the_corpus_operators():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tessera\.llm|from \.+llm|corpus_pipeline", path.read_text()), path
