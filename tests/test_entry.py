import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from textward import cases

SF = "/root/testdata/sf0.001"
CHECKED = ["pii_email_mask", "secrets_hmac", "reading_time_truncate", "allowed_tools", "url_items", "toxicity_threshold", "decision", "history_fit", "token_roundtrip", "terms_join", "tool_result_text", "chunk_whole", *cases.QUERIES]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    with duckdb.connect() as c:
        for t in os.listdir(SF):
            c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
        want = c.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_imports_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import shutil, sys
shutil.copytree({root!r} + '/textward', 'textward', ignore=shutil.ignore_patterns('llm', '__pycache__'))
shutil.copy({root!r} + '/__spark_entry__.py', '.')
sys.path.insert(0, '.')
import __spark_entry__ as e
assert 'decision' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
