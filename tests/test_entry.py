import subprocess
import sys

from conftest import ROOT


def test_the_entry_module_imports_without_a_session_and_without_the_optional_parts(tmp_path):
    import shutil

    for part in ("cellweave", "__spark_entry__.py"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op') or k == 'pipeline'] and len(q) > 30 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "HOME": str(tmp_path)}, check=True, timeout=120)


def test_entry_gives_the_live_cells(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 684
