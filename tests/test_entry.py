import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and all(callable(f) for f in names.values())


def test_works_without_the_llm_folders(tmp_path):
    import re
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert "with_index" in said.stdout and not re.search(r"\bop\d|pipeline", said.stdout)
