"""All operators on workers that hold no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

import llm_paths  # noqa: F401

ROOT = Path(__file__).resolve().parent.parent.parent

JOB = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from broadsheet.llm import catalog
from broadsheet.session import build_session

spark = build_session("local[4]", "shipping", {{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": {folder!r}}})
spark.sparkContext.setLogLevel("OFF")


def seen(batches):
    import importlib.util
    for batch in batches:
        batch["id"] = int(importlib.util.find_spec("broadsheet") is not None)
        yield batch


assert not any(r.id for r in spark.range(4).mapInPandas(seen, "id long").collect()), "workers hold the package"
for name in [*catalog.QUERIES, "pipeline"]:
    if name in entry.queries():
        try:
            entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
            print("DONE", name, flush=True)
        except Exception as error:
            print("LOST", name, str(error)[-2000:], flush=True)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    from broadsheet.llm import catalog

    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    job = tmp_path / "job.py"
    job.write_text(JOB.format(root=str(ROOT), folder=str(tmp_path / "shared")))
    done = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "LOST" not in done.stdout and done.returncode == 0, done.stdout + done.stderr[-2000:]
    assert {line.split()[1] for line in done.stdout.splitlines() if line.startswith("DONE")} >= set(catalog.QUERIES)
