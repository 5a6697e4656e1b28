import subprocess
import sys


def test_the_entry_can_be_imported_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) > 0, set(e.oracle_sql()) <= set(e.queries()))"
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert ran.stdout.split() == ["True", "True"], ran.stderr
