"""What the driver loads, and what is left of it when something is missing."""

import subprocess
import sys

CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "ahocorasick":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
q = e.queries()
print(len(q), len(e.oracle_sql()), any(k.startswith("op") for k in q), "pipeline" in q)
"""


def test_core_queries_load_without_what_the_rest_needs():
    out = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 2)[0]).stdout.split()
    assert int(out[0]) > 150 and int(out[1]) > 150 and out[2:] == ["False", "False"]
