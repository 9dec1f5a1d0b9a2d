"""The pipeline's stages against plain versions of their decisions."""

import re
import sys
import threading
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from lodestone.llm import secrets
from lodestone.llm.common import discard, folders_since, made

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_brute_force import fingerprint  # noqa: E402


def test_stages(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    texts = {i: t for i, t, *_ in rows[0]}
    assert set(kept[0]) == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    assert 100 not in kept[1] and 101 not in kept[1] and 3 in kept[1]
    prints = [fingerprint(texts[i]) for i in kept[1]]
    assert all((a ^ b).bit_count() > 3 for n, a in enumerate(prints) for b in prints[n + 1 :])
    assert set(kept[1]) - set(kept[2]) == {120, 121, 122} & set(kept[1])
    assert set(kept[3]) == set(kept[2]) and all(r["text"] == secrets.redacted(texts[i]) for i, r in kept[3].items())
    assert "hunter2hunter2x9" not in kept[3][140]["text"]
    assert set(kept[4]) == set(kept[3])


def test_run(spark, sf_dir):
    """Of all that is stored on the way only the rows that the last stage reads are left, and the caller can delete them."""
    with made() as folders:
        found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 50
    left = set(folders) & set(folders_since())
    assert len(left) == 1
    discard(*left)
    assert not set(folders) & set(folders_since())


def test_runs_side_by_side(spark, sf_dir):
    """Neither two runs at once nor tables that another thread stores meanwhile lose anything."""
    rows, stop = sorted(spark.range(10).collect()), threading.Event()

    def store():
        kept = []
        while not stop.is_set():
            kept.append(corpus_pipeline.stored(spark.range(10)))
        return [sorted(df.collect()) for df in kept]

    with ThreadPoolExecutor(3) as pool:
        others = pool.submit(store)
        runs = [pool.submit(lambda: sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))) for _ in range(2)]
        try:
            first, second = (r.result() for r in runs)
        finally:
            stop.set()
        assert first == second and first
        assert len(others.result()) > 3 and all(r == rows for r in others.result())
