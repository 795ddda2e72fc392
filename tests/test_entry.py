"""The driver's entry points, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAID = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'score_overall' in q, any(k.startswith('op1_') or k == 'pipeline' for k in q))"


def said(folder):
    run = subprocess.run([sys.executable, "-c", SAID], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def copy(folder):
    ignored = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    return shutil.copytree(REPO, folder, ignore=ignored)


def test_without_the_llm_folders(tmp_path):
    there = copy(tmp_path / "a")
    shutil.rmtree(there / "quizloom" / "llm", ignore_errors=True)
    n, core, llm = said(there)
    assert int(n) > 40 and core == "True" and llm == "False"
    (there / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said(there) == [n, core, llm]


def test_an_import_error_elsewhere_is_raised(tmp_path):
    there = copy(tmp_path / "b")
    with open(there / "quizloom" / "plans" / "catalogue.py", "a") as f:
        f.write("\nimport no_such_module\n")
    run = subprocess.run([sys.executable, "-c", SAID], cwd=there, capture_output=True, text=True)
    assert run.returncode != 0 and "no_such_module" in run.stderr
