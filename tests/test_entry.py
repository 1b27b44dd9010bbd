"""The driver's contract."""

import os
import subprocess
import sys

import __spark_entry__ as entry_module

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "doc_id" and df.count() == 200


def test_sql_has_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_library_stands_without_the_corpus_subpackage(tmp_path):
    """A copy without it imports, and still has the library's queries."""
    script = f"cp -r {ROOT}/folioscope {ROOT}/__spark_entry__.py {tmp_path} && rm -rf {tmp_path}/folioscope/llm && cd {tmp_path} && {sys.executable} -c \"import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))\""
    out = subprocess.run(["bash", "-c", script], capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[-1] == "False", out.stderr


def test_nothing_else_imports_the_corpus_subpackage():
    found = []
    for base, _, names in os.walk(os.path.join(ROOT, "folioscope")):
        if "llm" not in base.split(os.sep):
            found += [n for n in names if n.endswith(".py") and "folioscope.llm" in open(os.path.join(base, n), encoding="utf-8").read()]
    assert not found
