import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("absent", ["mergetide.llm", "corpus_pipeline"])
def test_without_the_training_data_operators(absent):
    code = f"import sys; sys.modules['{absent}'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()) and len(e.queries()) > 60 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "mergetide").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
