"""The entry module without the text operators."""

import importlib.util

import __spark_entry__ as entry
from evenfold.checks import catalog


def test_queries_without_the_text_package(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, package=None: None if name.startswith("evenfold.llm") else real(name, package))
    assert entry.queries().keys() == catalog.QUERIES.keys() and entry.oracle_sql().keys() == catalog.SQL.keys()


def test_queries_without_the_folder(tmp_path):
    """A checkout whose text package is gone, with or without its pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(entry.__file__).parent
    shutil.copytree(here / "evenfold", tmp_path / "evenfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    if (here / "corpus_pipeline.py").exists():
        shutil.copy(here / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(s) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
