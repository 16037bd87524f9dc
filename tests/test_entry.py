"""The driver's contract, also without the corpus subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_corpus_modules(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text(open(os.path.join(ROOT, name)).read())
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'daylark.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 80 and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, check=True, timeout=120)
