"""The registry, with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["item_id", "doc_id", "rank", "score"] and out.count() > 0


def test_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (tmp_path / "repo/tidemark/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_nothing_outside_names_the_optional_folder():
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tidemark.llm" not in p.read_text(), p
