"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "path", "is_first"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_corpus_operators():
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 80 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for file in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "llm" not in file.read_text(), file
