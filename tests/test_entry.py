import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows_and_names_agree(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    hidden = "import builtins, importlib.abc, sys\nclass F(importlib.abc.MetaPathFinder):\n  def find_spec(self, name, path, target=None):\n    if name in ('corpus_pipeline', 'quillstone.llm'): raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, F())\n"
    done = subprocess.run([sys.executable, "-c", hidden + code.split("; ", 2)[2]], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(done.stdout) > 60
