import subprocess
import sys

from pyspark import cloudpickle

from photofold.config import SimilarityConfig
from photofold.operators import similarity


def test_worker_code_needs_no_installed_package(tmp_path):
    shipped = cloudpickle.dumps(
        [similarity._resolve_block, similarity._match_sorted, SimilarityConfig()]
    )
    done = subprocess.run(
        [sys.executable, "-I", "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"],
        input=shipped, cwd=tmp_path, capture_output=True, timeout=120,
    )
    assert done.returncode == 0, done.stderr.decode()


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
