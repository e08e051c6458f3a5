"""The library without its corpus part: nothing else imports it, and the entry still works."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_only_the_entry_names_the_corpus_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "leadloom")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"leadloom\.llm|corpus_pipeline", f.read()), name


def test_entry_without_the_corpus_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "leadloom"), tmp_path / "leadloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
