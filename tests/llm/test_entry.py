"""The entry lists the training operators, and doesn't hide a module that one of them lacks."""

from __future__ import annotations

import importlib
import sys

import pytest


def test_all_are_listed():
    entry = importlib.import_module("__spark_entry__")
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{i}" for i in range(1, 11)} | {"pipeline"} <= names


def test_a_missing_part_is_an_error(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("sievelake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sievelake.llm._graph", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)
