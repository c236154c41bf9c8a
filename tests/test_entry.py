import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from textloom import plans

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"


@pytest.mark.parametrize("gone", [["textloom/llm", "tests/llm"], ["textloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, check=True, timeout=120)
    assert out.stdout.split() == [str(len(plans.QUERIES)), str(len(plans.ORACLES))]
    assert subprocess.run([sys.executable, "-c", "import bench"], cwd=copy, capture_output=True, timeout=120).returncode == 0


def test_a_missing_package_leaves_the_operators_out(tmp_path):
    show = "import sys; sys.modules['public_tokenizers'] = None; " + SHOW
    out = subprocess.run([sys.executable, "-c", show], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    assert out.stdout.split() == [str(len(plans.QUERIES)), str(len(plans.ORACLES))]
