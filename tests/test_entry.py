import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left_out", [["llm", "corpus_pipeline.py"], ["llm"]])
def test_entry_without_the_training_part(tmp_path, left_out):
    keep = shutil.ignore_patterns(*left_out, ".git", "__pycache__", "*.md")
    shutil.copytree(REPO, tmp_path / "repo", ignore=keep)
    code = "import __spark_entry__ as e; assert 'relocation_plan' in e.queries() and 'pipeline' not in e.queries(); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert done.returncode == 0, done.stderr


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
