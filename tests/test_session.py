"""The shared folder and the intermediate tables."""

import os

import pytest

from tessera import session


def test_unset_folder_is_an_error_off_local_masters():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_cuts_are_written_and_dropped(spark):
    df = session.cut_lineage(spark.range(10))
    folder = session.cuts_dir(spark).removeprefix("file:")
    assert df.count() == 10 and any(x.startswith("cut-") for x in os.listdir(folder))
    session.drop_cuts(spark)
    assert not os.path.exists(folder)
    session.drop_cuts(spark)  # nothing there: nothing to do


def test_entry_works_without_a_package_of_the_llm_part():
    import subprocess
    import sys

    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'A1_flow_payment_by_statement_month' in q and not any(x.startswith('op') for x in q), list(q)")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
