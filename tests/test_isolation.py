import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
OPTIONAL = ("cleaveset/llm", "tests/llm", "corpus_pipeline.py")


@pytest.mark.parametrize("gone", [OPTIONAL, OPTIONAL[:2], OPTIONAL[:1]])
def test_the_rest_stands_without_the_optional_parts(tmp_path, gone):
    """The queries of the catalogue are all there, and only they, once the optional folders are deleted."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.txt", "*.json"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import json, __spark_entry__ as e; from cleaveset.plans import catalogue; print(json.dumps([sorted(e.queries()) == sorted(catalogue.QUERIES), sorted(e.oracle_sql()) == sorted(catalogue.ORACLES), len(e.queries())]))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    same, oracles, n = json.loads(said.stdout.strip().splitlines()[-1])
    assert same and oracles and n > 100
    used = [p for p in copy.rglob("*.py") if "cleaveset.llm" in p.read_text() and p.name not in ("__spark_entry__.py", "corpus_pipeline.py", "test_isolation.py") and "llm" not in p.parts]
    assert not used
