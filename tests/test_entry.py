import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_has_twins():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    core = {k for k in e.queries() if not k.startswith("op") and k != "pipeline"} | {"ops_log_latest"}
    assert core <= set(e.oracle_sql())


def test_core_does_not_import_llm():
    code = "import sys, quillgraph.registry, quillgraph.facade, quillgraph.cli, quillgraph.streaming.ingest; assert not [m for m in sys.modules if m.startswith('quillgraph.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).columns[0] == "seq"
