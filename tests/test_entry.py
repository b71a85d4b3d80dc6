"""The contract also holds where the training-data subpackage and its pipeline are not there."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r} or any(name.startswith(f"{{x}}.") for x in {gone!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as contract
names = contract.queries().keys()
assert names == contract.oracle_sql().keys() and "refresh_all" in names, names
assert not any(n.startswith("op") or n == "pipeline" for n in names)
print("fine")
"""


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stdout.strip()


def test_without_the_subpackage():
    assert run(WITHOUT.format(gone=("cohortry.llm", "corpus_pipeline"))) == "fine"


def test_without_the_subpackage_but_with_the_pipeline():
    assert run(WITHOUT.format(gone=("cohortry.llm",))) == "fine"


def test_a_library_that_only_the_subpackage_needs():
    assert run(WITHOUT.format(gone=("public_tokenizers",))) == "fine"


def test_a_missing_module_of_the_engine_is_not_hidden():
    assert run("import sys\nsys.modules['cohortry.plans'] = None\nimport __spark_entry__\nprint('fine')") == ""
