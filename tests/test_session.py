import os
import re

from pyspark.sql import functions as F

from rowloom import session as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_tables_go_to_the_folder_that_the_session_names(spark, tmp_path, monkeypatch):
    class Named:
        """A session whose spark.checkpoint.dir is set, which a running one's cannot be."""

        conf = {"spark.checkpoint.dir": f"file://{tmp_path}/"}

    assert S.shared_dir(Named) == f"file://{tmp_path}"
    own = S.shared_dir(spark)
    assert own and own == S.shared_dir(spark)
    monkeypatch.setattr(S, "shared_dir", lambda _: f"file://{tmp_path}")
    df = S.cut_lineage(spark.range(5).withColumn("x", F.array(F.col("id"))), "numbers")
    assert df.count() == 5 and df.columns == ["id", "x"] and os.listdir(tmp_path / "rowloom")[0].startswith("numbers-")


def test_nothing_outside_imports_the_training_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "rowloom")):
        if os.path.relpath(folder, ROOT).startswith(os.path.join("rowloom", "llm")):
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"rowloom\.llm|from rowloom import llm", open(os.path.join(folder, f)).read()), f


def test_entry_lists_queries_with_their_oracles(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() > 0
