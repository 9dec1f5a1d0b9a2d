"""Files, pictures, clients, charts, the page, and indexes that another session reads."""

import hashlib
import io
import json
import subprocess
import sys
import tarfile
import threading
import urllib.error
import urllib.request
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.functions import images
from lodestone.operators import bm25, dense, services
from lodestone.operators.ann import graph
from lodestone.operators.ann.index import VectorIndex
from lodestone.operators.retrieve import Retriever
from lodestone.plans import experiments, requests
from lodestone.serve import page, server
from lodestone.session import shared_folder, spread
from lodestone.sources import captions, download, embeddings, sinks

ROOT = str(Path(__file__).resolve().parent.parent)


def test_fetch_and_extract(tmp_path):
    source = tmp_path / "source.txt"
    source.write_text("one")
    digest = hashlib.sha256(b"one").hexdigest()
    got = download.fetch(source.as_uri(), str(tmp_path / "got/file.txt"), digest)
    assert got.read_text() == "one"
    source.write_text("two")
    assert download.fetch(source.as_uri(), str(got)).read_text() == "one"  # it is there
    with pytest.raises(ValueError):
        download.fetch(source.as_uri(), str(tmp_path / "other.txt"), digest)
    with pytest.raises(urllib.error.URLError):
        download.fetch((tmp_path / "nothing").as_uri(), str(tmp_path / "x"))
    assert not (tmp_path / "other.txt").exists() and not (tmp_path / "x").exists()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.txt", "a")
    with tarfile.open(tmp_path / "b.tgz", "w:gz") as t:
        t.add(source, "b.txt")
    found = download.fetch_corpus({"a.zip": (tmp_path / "a.zip").as_uri(), "b.tgz": (tmp_path / "b.tgz").as_uri()}, str(tmp_path / "corpus"))
    assert set(found) == {"a.zip", "b.tgz"} and (tmp_path / "corpus/images/in/a.txt").read_text() == "a" and (tmp_path / "corpus/images/b.txt").exists()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        download.extract(str(tmp_path / "bad.zip"), str(tmp_path / "bad"))


def test_pictures(spark, tmp_path):
    black = images.black_png(3, 2)
    assert images.is_image(black) and not images.is_image(b"text") and not images.is_image(None)
    (tmp_path / "a.png").write_bytes(black)
    (tmp_path / "b.jpg").write_bytes(b"no picture")
    (tmp_path / "c.txt").write_bytes(b"left out")
    found = captions.images(spark, str(tmp_path))
    assert sorted(r["name"] for r in found.collect()) == ["a.png", "b.jpg"]
    rows = spark.createDataFrame([("x/a.png",), ("x/b.jpg",), ("x/gone.jpg",), ("x/a.png",), (None,)], "image_path string")
    got = {r["image_path"]: (r["replaced"], r["embedding"]) for r in embeddings.extract_images(rows, found, services.HashingImageEmbedder(16)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"x/a.png": False, "x/b.jpg": True, "x/gone.jpg": True}
    assert got["x/b.jpg"][1] == got["x/gone.jpg"][1] and np.linalg.norm(got["x/a.png"][1]) == pytest.approx(1, abs=1e-5)


def test_batches(spark):
    df = spark.range(150).select("id", F.col("id").cast("string").alias("caption"), F.array("id").alias("xs")).coalesce(1)
    found = captions.batches(df, 64).collect()
    assert [len(r["id"]) for r in found] == [64, 64, 22] and found[2]["caption"][-1] == "149" and found[0]["xs"][5] == [5]


def test_generator_client():
    class Handler(BaseHTTPRequestHandler):
        def _say(self, body, status=200):
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._say({"data": [{"id": "m"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            if asked == "fail":
                return self._say({}, 500)
            return self._say({"choices": [{"message": {"content": "" if asked == "nothing" else f" said {asked} "}}]} if asked != "odd" else {"choices": []})

        def log_message(self, *_):
            pass

    running = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    try:
        client = services.generator(Config(generator_url=f"http://127.0.0.1:{running.server_port}/", generator_model="m"))
        assert client.connected() and not services.HttpGenerator(client.url, "other").connected()
        got = client.generate(["hello", "nothing", "fail", "odd"])
        assert got[:2] == [("ok", "said hello"), ("empty", "")] and [s for s, _ in got[2:]] == ["error", "error"] and "500" in got[2][1]
    finally:
        running.shutdown()
    late = services.HttpGenerator("http://127.0.0.1:1", "m", timeout=1, attempts=1, budget=0.0)
    assert late.generate(["x", "y"]) == [("error", "out of time")] * 2
    gone = services.HttpGenerator("http://127.0.0.1:1", "m", timeout=1, attempts=1)
    assert not gone.connected() and gone.generate(["x"])[0][0] == "error"
    assert isinstance(services.generator(Config(generator_url="")), services.TemplateGenerator)
    with pytest.raises(ValueError):
        services.encoder(Config(encoder_model="other"))


@pytest.mark.parametrize("kind", ["bars", "lines", "points"])
def test_charts(spark, tmp_path, kind):
    from xml.dom.minidom import parseString

    df = spark.createDataFrame([("<a>", 1.0, 0.5), ("b&", 4.0, None), ("c", 2.0, 0.9)], "index string, ms double, recall double")
    text = sinks.svg(df, "index", ["ms", "recall"], str(tmp_path / "x.svg"), kind, "ms & recall")
    parsed = parseString(text)
    assert (tmp_path / "x.svg").read_text() == text and len(parsed.getElementsByTagName({"bars": "rect", "lines": "polyline", "points": "circle"}[kind])) == {"bars": 5, "lines": 2, "points": 2}[kind]
    with pytest.raises(ValueError):
        sinks.svg(df, "index", ["ms"], str(tmp_path / "y.svg"), "pie")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, 400)] + 0.4 * rng.normal(size=(400, 16))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>").repartition(3).cache()


@pytest.mark.parametrize("kind", ["flat", "ivfpq", "hnsw", "lsh", "forest"])
def test_indexes_are_read_by_another_session(spark, vectors, tmp_path, kind):
    asked = vectors.where("id % 10 = 0").withColumnRenamed("id", "q_id")
    index = VectorIndex.build(vectors, kind, f"{tmp_path}/index", **{"lsh": {"tables": 16, "bits": 4}, "forest": {"trees": 20}}.get(kind, {}))
    own = [tuple(r) for r in index.search(asked, 5).orderBy("q_id", "rank").collect()]
    exact = {(r["q_id"], r["id"]) for r in dense.exact_topk(asked, vectors, 5).collect()}
    assert len(exact & {(q, i) for q, i, *_ in own}) >= 0.9 * len(exact) and index.memory_mb() == pytest.approx(400 * 16 * 4 / 2**20)
    asked.write.parquet(f"{tmp_path}/asked")
    code = f"""
from lodestone.session import build_session
from lodestone.operators.ann.index import VectorIndex
spark = build_session("again", "local[2]", "1g", 2, **{{"spark.ui.enabled": "false"}})
rows = VectorIndex(spark, "{tmp_path}/index").search(spark.read.parquet("{tmp_path}/asked"), 5).orderBy("q_id", "rank").collect()
print("FOUND", [tuple(r) for r in rows])
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=300).stdout
    again = eval(said[said.index("FOUND ") + 6 :])  # noqa: S307
    assert [r[:2] for r in again] == [r[:2] for r in own]


def test_widths_are_checked(spark, vectors):
    odd = vectors.unionByName(spark.createDataFrame([(999, [1.0, 2.0])], "id bigint, embedding array<float>"))
    with pytest.raises(Exception, match="width"):
        VectorIndex.build(odd.orderBy("id"), "flat")
    index = VectorIndex.build(vectors, "flat")
    with pytest.raises(Exception, match="width"):
        index.search(spark.createDataFrame([(0, [1.0, 2.0])], "q_id bigint, embedding array<float>")).collect()
    with pytest.raises(ValueError):
        VectorIndex.build(vectors, "other")
    with pytest.raises(ValueError):
        dense.similarity(np.ones((1, 2)), np.ones((1, 3)), "dot")


def test_blocks_keep_their_bounds(spark, monkeypatch):
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 100)
    df = spark.range(1050).select(F.col("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v")).coalesce(1)
    sizes = [len(r["ids"]) for r in dense._packed(df, 100, ("ids", "m")).collect()]
    assert sizes == [100] * 10 + [50]


def test_many_queries_are_not_sent(spark, vectors, monkeypatch):
    asked = vectors.where("id % 10 = 0").withColumnRenamed("id", "q_id")
    few = dense.exact_topk(asked, vectors, 5).orderBy("q_id", "rank").collect()
    monkeypatch.setattr(dense, "SENT_QUERIES", 3)
    many = dense.exact_topk(asked, vectors, 5)
    assert "CartesianProduct" in many._jdf.queryExecution().toString() and many.orderBy("q_id", "rank").collect() == few


def test_ties_at_the_cut_go_by_id():
    s = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [0.0, -np.inf, np.nan, 5.0, 0.0]])
    ids = np.array([5, 9, 3, 7, 1])
    row, at = dense.best(s, ids, 2)
    assert list(zip(row.tolist(), ids[at].tolist(), strict=True)) == [(0, 3), (0, 7), (1, 7), (1, 1)]
    assert [len(x) for x in dense.best(s, ids, 9)] == [8, 8]


def test_filled_and_inserted_graphs_find_the_same(vectors):
    x = np.array([r["embedding"] for r in vectors.orderBy("id").collect()], float)
    levels = [graph.level_of(i, 0.5) for i in range(len(x))]
    at_once, one_by_one = graph.Graph(x), graph.Graph(x)
    at_once.fill(levels, 100)
    for node, level in enumerate(levels):
        one_by_one.insert(node, level, 100)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for g in (at_once, one_by_one):
        assert max(len(own) for own in g.links[0].values()) <= 32 and all(max(map(len, level.values())) <= 16 for level in g.links[1:])
        hits = sum(len({n for _, n in g.search(x[q], 5, 50)} & set(np.argsort(-(unit @ unit[q]))[:5].tolist())) for q in range(0, 400, 10))
        assert hits >= 0.95 * 5 * 40


def test_scans_of_one_row_group_are_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(8).write.parquet(f"{tmp_path}/many")
    one, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 1000
    assert spread(many) is many or spread(many).count() == 1000


def test_gold_by_runs_of_words(spark):
    texts = {0: "xx one two  three\nfour fivexx and more", 1: "one two three four five", 2: "short", 3: "a one two  three\nfour five", 4: None, 5: "one two  three\nfour"}
    asked = {0: "one two  three\nfour five", 1: "short", 2: "a b c d e f", 3: None}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    found = experiments.verbatim_gold(docs, spark.createDataFrame(list(asked.items()), "q_id bigint, text string"))
    assert {tuple(r) for r in found.collect()} == {(q, i) for q, a in asked.items() for i, t in texts.items() if a and t and a in t} == {(0, 0), (0, 3), (1, 2)}


def test_requests(spark, tmp_path):
    texts = {0: "a red bus in the street", 1: "two dogs in the park", 2: "a cat on a mat"}
    items = spark.createDataFrame(list(texts.items()), "id bigint, caption string")
    embedder = services.HashingEmbedder(32)
    vectors = services.embedded(items, embedder, "caption", "id").unionByName(spark.createDataFrame([(77, [1.0] * 32)], "id bigint, embedding array<float>"))
    index = bm25.build(items.withColumnsRenamed({"id": "doc_id", "caption": "text"}))
    asked = spark.createDataFrame([(0, "dogs park"), (1, "cat mat")], "q_id bigint, text string")
    found = {r["q_id"]: r for r in requests.of_texts(Retriever(vectors, index), asked, items, embedder, services.TemplateGenerator(), 4).collect()}
    assert [found[q]["results"][0]["id"] for q in (0, 1)] == [1, 2] and all(77 not in [x["id"] for x in r["results"]] for r in found.values())
    assert found[0]["status"] == "ok" and "two dogs" in found[0]["answer"] and "cat mat" in found[1]["prompt"]
    pictures = spark.createDataFrame([(0, images.black_png(2, 2)), (1, None), (2, images.black_png(9, 5))], "q_id bigint, content binary")
    known = services.embedded_images(pictures.where("q_id <> 1"), services.HashingImageEmbedder(16), "q_id").select(F.col("q_id").alias("id"), "embedding")
    told = spark.createDataFrame([(0, 0, "black"), (0, 1, "small"), (2, 0, "wide")], "id bigint, pos bigint, caption string")
    found = {r["q_id"]: r for r in requests.of_images(pictures, known, told, services.HashingImageEmbedder(16), services.TemplateGenerator()).collect()}
    assert found[0]["results"][0]["caption"] == "black" and found[2]["results"][0]["caption"] == "wide" and "black" in found[0]["answer"] and found[1]["status"] == "ok"


def test_page():
    seen = []

    def search(text, strategy, k):
        seen.append((text, strategy, k))
        return {"results": [{"id": 1, "score": 0.5, "caption": "<b>x</b>"}], "answer": "a & b"}

    running = server(search, 0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    try:
        get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{running.server_port}{path}", timeout=10).read().decode()  # noqa: E731, S310
        assert "&lt;b&gt;x" in get("/?q=red+bus&strategy=pure_sparse&k=3") and seen == [("red bus", "pure_sparse", 3)]
        assert json.loads(get("/search?q=cat"))["answer"] == "a & b" and json.loads(get("/search"))["results"] == []
        for bad in ("/?q=x&strategy=other", "/?q=x&k=many", "/nothing"):
            with pytest.raises(urllib.error.HTTPError):
                get(bad)
    finally:
        running.shutdown()
    assert "selected>multi_stage" in page('"q"', "multi_stage", 5, None) and "&quot;q&quot;" in page('"q"', "multi_stage", 5, None)


def test_storage_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Cluster)


def test_key_is_sent(monkeypatch):
    """With every call: the one that is given, else the process's own."""
    seen = []

    class Reply(io.BytesIO):
        pass

    def opened(request, timeout):
        seen.append(request.get_header("Authorization"))
        return Reply(b'{"choices": [{"message": {"content": "yes"}}]}')

    monkeypatch.setattr(services.urllib.request, "urlopen", opened)
    monkeypatch.delenv("LLM_API_KEY", raising=False)
    assert services.HttpGenerator("http://x", "m").generate(["a"]) == [("ok", "yes")]
    services.HttpGenerator("http://x", "m", key="mine").generate(["a"])
    monkeypatch.setenv("LLM_API_KEY", "own")
    services.HttpGenerator("http://x", "m").generate(["a"])
    assert seen == [None, "Bearer mine", "Bearer own"]


def test_replies_are_kept(spark, tmp_path, monkeypatch):
    class Noting:
        """Answers with the prompt's length and leaves a file for each call; prompts with an x fail where the path says so."""

        def __init__(self, path, fails=False):
            self.path, self.fails = str(path), fails

        def generate(self, prompts):
            for p in prompts:
                with open(f"{self.path}/calls", "a") as f:
                    f.write(f"{p}\n")
            return [("error", "no") if self.fails and "x" in p else ("ok", str(len(p))) for p in prompts]

    monkeypatch.setattr(services, "CHUNK", 3)
    rows = [(i, ["a", "bb", "x1", "x22", None, "ccc", "dddd", "a"][i]) for i in range(8)]
    prompts, table = spark.createDataFrame(rows, "q_id bigint, prompt string"), str(tmp_path / "replies")
    calls = lambda: sorted((tmp_path / "calls").read_text().splitlines())
    first = {r["q_id"]: (r["status"], r["answer"]) for r in services.answered_once(prompts, Noting(tmp_path, True), table).collect()}
    assert first == {i: ("error", "no") if "x" in (p or "") else ("ok", str(len(p or ""))) for i, p in rows}
    assert calls() == sorted({p or "" for _, p in rows})
    (tmp_path / "calls").unlink()
    second = {r["q_id"]: (r["status"], r["answer"]) for r in services.answered_once(prompts, Noting(tmp_path), table).collect()}
    assert second == {i: ("ok", str(len(p or ""))) for i, p in rows} and calls() == ["x1", "x22"]
