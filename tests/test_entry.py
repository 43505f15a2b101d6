import importlib

from groundswell.plans import catalog


def test_registry_is_sound():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(catalog.QUERIES) <= names and set(entry.oracle_sql()) <= names


def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


def test_core_never_imports_the_optional_part():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"import.*\bllm\b", f.read_text()), f
