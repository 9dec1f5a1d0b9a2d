"""The registered queries against their SQL in DuckDB, on tables of a few rows, and without the training-data subpackage."""

import datetime
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lodestone.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(2)
    vocabulary = ["the", "cat", "dog", "of", "la", "que", "outdoor", "2023", "photo", "not", "Über", "mat,", "rare"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(8)) for i in range(12)]
    docs = [(i, (text(int(rng.integers(1, 40))) + (f" {items[i % 12][1]}" if i % 5 == 0 else "")), str(rng.choice(["en", "fr", "de"])), f"src{i % 20}", int(rng.integers(1, 9000))) for i in range(90)]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    put("documents", docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    put("benchmark", items, "item_id bigint, text string")
    put("embeddings", [(i, rng.normal(size=64).astype(np.float32).tolist(), int(i % 4)) for i in range(80)], "vec_id bigint, embedding array<float>, label int")
    put("labels", [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    put("conversations", [(i // 4, i % 4, "user", text(5)) for i in range(30)], "conv_id bigint, turn bigint, role string, text string")
    put("events", [(i, datetime.datetime(2024, 1, 1), i % 5, ["view", "click"][i % 2], float(rng.integers(1, 99)), f'{{"k": {i}}}') for i in range(50)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    put("pages", [(i, f"http://h{i % 7}/p{i % 9}.html", "<p>") for i in range(40)], "page_id bigint, url string, html string")
    return str(path)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "labels", "conversations", "events", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet/*.parquet'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got or name == "filter_conjunction"
    if name in catalog.oracle_sql():
        found = duck.sql(catalog.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_without_the_training_data_operators(tmp_path):
    """The entry module imports and keeps its other queries where the subpackage, its tests and the pipeline are gone, and the other tests are found."""
    for p in ("lodestone", "tests", "__spark_entry__.py", "bench.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lodestone/llm"), str(tmp_path / "tests/llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[-2]) == len(catalog.queries()) and said[-1] == "False"
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert "test_entry.py" in found and "llm" not in found.replace("test_without_the_training_data_operators", "")


def test_an_operator_that_lacks_a_library_is_not_hidden(tmp_path):
    """Only the absence of the subpackage or the pipeline itself leaves their queries out."""
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library")
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]; import __spark_entry__"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert said.returncode and "no_such_library" in said.stderr
