"""A name that is defined twice in a module hides the first function."""

import ast
from collections import Counter
from pathlib import Path

import pytest

import convolake

MODULES = sorted(Path(convolake.__path__[0]).rglob("*.py"))


@pytest.mark.parametrize("path", MODULES, ids=lambda p: f"{p.parent.name}.{p.stem}")
def test_names_are_defined_once(path):
    names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and n.name != "_")
    assert [n for n, times in names.items() if times > 1] == []
