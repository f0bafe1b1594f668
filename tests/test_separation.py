"""Nothing outside the optional subpackage imports it, and the entry module works without it."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("lectern/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from lectern\.llm", path.read_text()), path


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'preprocess_pipeline' in e.queries() and not any(k.startswith('p1_') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
