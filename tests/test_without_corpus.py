"""The rest of the repository works without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_them(tmp_path):
    shutil.copytree(ROOT / "seamline", tmp_path / "seamline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'basket_jaccard' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "seamline").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "seamline.llm" not in p.read_text(), p
