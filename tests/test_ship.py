import os
import subprocess
import sys
import textwrap


def test_workers_find_the_package_from_another_folder(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(
        textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {top!r})
        from tidemark.session import local_session, ship
        from tidemark.operators.series import despike
        spark = local_session("ship", "2", 2)
        ship(spark)
        rows = spark.createDataFrame([(1, 1, i, i % 3 * 100) for i in range(9)], "s int, run int, i int, v int")
        print("rows", despike(rows, ["s", "run"], ["i"], "v").count())
        """)
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 9" in done.stdout, done.stderr[-2000:]
