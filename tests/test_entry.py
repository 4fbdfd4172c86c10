import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_stable_schema(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("vector_topk_l2", "bm25_search", "merge_ranges", "merkle_root", "policy_category"):
        a, b = queries[name](spark, SMALL), queries[name](spark, SMALL)
        assert a.schema == b.schema
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "textloom"):
        os.system(f"cp -r {ROOT}/{name} {tmp_path}/")
    os.system(f"rm -r {tmp_path}/textloom/llm")
    code = "import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
