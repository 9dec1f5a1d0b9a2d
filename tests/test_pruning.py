"""A search reads what the asked terms need of a stored BM25 index."""

import pytest

from lodestone.operators import bm25


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bm25"))
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('the w', id % 700, ' w', id % 31, ' x', id) AS text").repartition(3)
    bm25.build(docs).save(path)
    return docs, bm25.Bm25Index.load(spark, path)


def scans(df):
    """Name of the table, files read, rows read and pushed filters of every scan that has run."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            metric = lambda k: node.metrics().get(k).get().value()
            place = node.relation().location().rootPaths().head().toString().rsplit("/", 1)[-1]
            found.append((place, metric("numFiles"), metric("numOutputRows"), node.verboseStringWithOperatorId()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "q_id bigint, text string")


def test_few_terms_read_few_buckets(spark, index):
    docs, stored = index
    assert stored.buckets == 16 and len(stored.postings.inputFiles()) == 16
    read = [s for s in scans(bm25.scores(stored, ask(spark, "w5 x17"))) if s[0] == "postings"]
    assert read and all(files <= 2 and "PartitionFilters: [bucket" in told and "In(term, [w5,x17])" in told for _, files, _, told in read)
    assert sum(s[2] for s in read) < 3000 * 4 / 5


def test_same_scores_as_before_storing(spark, index):
    docs, stored = index
    asked = ask(spark, "the w5", "x17 x18 w3 w3 nothing", "", "unknown", " ".join(f"x{i}" for i in range(bm25.FEW_TERMS + 50)))
    rows = lambda df: sorted((r["q_id"], r["id"], round(r["score"], 9)) for r in df.collect())
    whole = rows(bm25.scores(bm25.build(docs), asked))
    assert rows(bm25.scores(stored, asked)) == whole and {r[0] for r in whole} == {0, 1, 4}
    assert bm25.scores(stored, ask(spark, "", " ")).collect() == []


def test_an_index_is_stored_again(spark, index, tmp_path):
    _, stored = index
    stored.save(str(tmp_path))
    again = bm25.Bm25Index.load(spark, str(tmp_path))
    columns = ["term", "doc_id", "tf", "dl"]
    assert again.postings.select(columns).exceptAll(stored.postings.select(columns)).isEmpty() and again.postings.count() == stored.postings.count()
    assert again.terms.select("term", "df").exceptAll(stored.terms.select("term", "df")).isEmpty()


def test_one_term_of_all_documents_is_many_tasks():
    assert bm25.layout(0) == (16, 1) and bm25.layout(10**7) == (64, 1)
    buckets, parts = bm25.layout(10**13)
    assert buckets == bm25.BUCKETS and 10**13 / (buckets * parts) <= bm25.TASK_WORDS
