import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_need_no_path(tmp_path):
    """A driver in another folder, without PYTHONPATH: the package reaches the workers."""
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as entry
        spark.range(3).selectExpr("id AS file_id", "'a/b.rs' AS path", "'rust' AS lang").write.parquet({str(tmp_path)!r} + "/files.parquet")
        spark.range(3).selectExpr("id AS file_id", "'fn f() {{ g() }}' AS content").write.parquet({str(tmp_path)!r} + "/sources.parquet")
        print("ROWS", entry.queries()["parse_sources"](spark, {str(tmp_path)!r}).collect())
        assert set(entry.oracle_sql()) <= set(entry.queries())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS [Row(lang='rust', kind='fn', chunks=3)]" in done.stdout, done.stderr[-2000:]
