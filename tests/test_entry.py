"""The driver's entry, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and q; print(sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    """Whether the pipeline's file is still there or not, the other queries are."""
    for pipeline in (True, False):
        at = tmp_path / str(pipeline)
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
        assert not (at / "weftmap" / "llm").exists()
        told = subprocess.run([sys.executable, "-c", ASK], cwd=at, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=False)
        assert told.returncode == 0, told.stderr
        assert told.stdout.strip() == "0"


def test_tables_that_are_cut_are_removed(spark):
    import glob

    from weftmap.session import cut, scratch, shared_dir

    with scratch(spark):
        df = cut(spark.range(5), "thrown-away")
        assert df.count() == 5 and glob.glob(f"{shared_dir(spark)}/weftmap/thrown-away-*")
    assert not glob.glob(f"{shared_dir(spark)}/weftmap/thrown-away-*")
