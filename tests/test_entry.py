import sys
from pathlib import Path


def test_entry_and_names(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names = e.queries()
    assert len(names) > 100
    assert set(e.oracle_sql()) <= set(names)


def test_library_does_not_import_llm():
    root = Path(__file__).resolve().parents[1] / "tidemark"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "llm" not in file.read_text(), file
