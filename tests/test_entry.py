"""The driver's entry: queries can be listed without a session, and without the corpus operators."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); print(*sorted(q))"


def listed(cwd):
    run = subprocess.run([sys.executable, "-c", LIST], cwd=cwd, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(cwd)}, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split(), run.stderr


def copy_to(path):
    shutil.copytree(f"{ROOT}/tracklight", path / "tracklight", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", path / name)


def test_queries_are_listed_in_a_fresh_interpreter_without_a_session():
    names, _ = listed(ROOT)
    assert "discovery_scores" in names and len(names) > 100
    if os.path.isdir(f"{ROOT}/tracklight/llm"):
        assert {*(f"op{i}_" for i in range(1, 14))} == {m[0] for n in names if (m := re.match(r"op\d+_", n))} and "pipeline" in names


def test_the_rest_is_listed_when_the_corpus_operators_are_gone_or_broken(tmp_path):
    copy_to(tmp_path)
    (tmp_path / "tracklight" / "llm").mkdir(exist_ok=True)
    (tmp_path / "tracklight" / "llm" / "queries.py").write_text("raise AssertionError('broken')\n")
    (tmp_path / "tracklight" / "llm" / "__init__.py").touch()
    names, said = listed(tmp_path)
    assert "discovery_scores" in names and not any(re.match(r"op\d+_", n) for n in names) and "broken" in said
    shutil.rmtree(tmp_path / "tracklight" / "llm")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    names, said = listed(tmp_path)
    assert "discovery_scores" in names and "pipeline" not in names and "cannot be imported" not in said
