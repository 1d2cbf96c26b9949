"""Operators whose functions run in Python workers must work when the
driver runs outside the repository (workers cannot import the package)."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_python_worker_functions_ship_by_value(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        from corvid.operators import balance, lexicon
        pts = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(20)], "id long, v array<double>")
        assert balance.knn(pts, "id", "v", k=2, block_size=4).count() == 40
        e = lexicon.PhraseKey("o", ("aa",), ("baa",))
        df = spark.createDataFrame([("baaa",), ("aaa",)], "t string")
        print("flags", [r.o for r in lexicon.phrase_flags(df, "t", (e,)).collect()])
        spark.stop()
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "flags [" in out.stdout
