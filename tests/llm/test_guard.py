"""The rest of the library does not need the text operators."""

import pathlib
import re


def test_nothing_else_imports_the_text_operators():
    top = pathlib.Path(__file__).parents[2]
    files = [p for p in (top / "centflow").rglob("*.py") if "llm" not in p.relative_to(top).parts] + list((top / "tests").glob("*.py"))
    assert files and not [p for p in files if re.search(r"centflow\.llm|corpus_pipeline", p.read_text())]
