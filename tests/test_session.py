from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from codestrata.session import clear_shared, materialise, shared_dir


def test_materialise_and_clear(spark):
    df = materialise(spark.range(5), "t")
    own = Path(shared_dir(spark).removeprefix("file://")) / "codestrata" / spark.sparkContext.applicationId
    assert df.count() == 5 and list(own.glob("t-*"))
    clear_shared(spark)
    assert not own.exists()


def test_nothing_but_the_entry_point_imports_the_llm_folder():
    root = Path(__file__).resolve().parents[1]
    for p in (root / "codestrata").rglob("*.py"):
        if "llm" not in p.parts:
            assert "codestrata.llm" not in p.read_text(), p
    code = "import sys; sys.modules['codestrata.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p3_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_every_query_has_rows_or_a_schema(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["snapshot_id", "path", "change"]
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("p1_found", "p6_found", "known_set_latest", "guard_stats_sets", "suggest_top3"):
        queries[name](spark, sf).limit(1).collect()
