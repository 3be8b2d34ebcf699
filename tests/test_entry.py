"""The entry points, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone, left", [(("llm",), ()), (("llm", "corpus_pipeline.py"), ()), (("corpus_pipeline.py",), ("op2_url_filters",))])
def test_imports_without_the_subpackage(tmp_path, gone, left):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = f"import __spark_entry__ as e; q = e.queries(); assert 'overlap_topk' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q) and all(x in q for x in {left!r})"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_a_broken_import_is_not_an_absent_one(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    if not (tmp_path / "r/foliant/llm").exists():
        pytest.skip("without the subpackage")
    with open(tmp_path / "r/foliant/session.py", "a") as out:
        out.write("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode != 0 and "no_such_module" in said.stderr


def test_settled_tables(spark):
    from foliant.session import forget, settle, shared_folder

    one = settle(spark.range(3), "one")
    assert one.count() == 3 and one._settled.startswith(shared_folder(spark))
    forget(one)
    assert not os.path.exists(one._settled.removeprefix("file:"))
