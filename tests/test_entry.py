"""The driver's entry points with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def test_entry_survives_without_the_corpus_folders(tmp_path):
    shutil.copytree(HERE, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"

    def names():
        done = subprocess.run([sys.executable, "-B", "-c", ask], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
        return set(done.stdout.split())

    whole = names()
    shutil.rmtree(tmp_path / "r" / "isospark" / "llm", ignore_errors=True)
    left = names()  # the pipeline is still there, but cannot be imported
    assert "tss_peaks" in left and not any(n == "pipeline" or n.startswith("op") and n[2:3].isdigit() for n in left)
    (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names() == left <= whole


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from isospark.session import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session())
