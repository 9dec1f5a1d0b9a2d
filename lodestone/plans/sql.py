"""DuckDB SQL for the catalog, put together from named parts. Nothing here is shared with the Spark plans but constants."""

from __future__ import annotations

from lodestone.operators import router as R


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def share(key: str) -> str:
    return f"CAST('0x' || substr(md5({key} || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


CLEAN = r"SELECT doc_id, caption FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-zA-Z0-9一-鿿\s.,!?'']', '', 'g') AS caption FROM documents) WHERE length(caption) > 5"

_SPLIT = r"unnest(regexp_split_to_array(lower(text), '\s+'))"
TOKENS = f"tok AS (SELECT * FROM (SELECT doc_id, {_SPLIT} AS term FROM documents) WHERE term <> '')"
INDEX = f"""{TOKENS},
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id),
dl AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, st)"""
BENCHMARK_TERMS = f"qt AS (SELECT q_id, term, count(*) AS qtf FROM (SELECT item_id AS q_id, {_SPLIT} AS term FROM benchmark) WHERE term <> '' GROUP BY q_id, term)"
REPEATS = "(VALUES (0, 'the the'), (1, 'the of the of of'), (2, 'que la la'), (3, 'zzzunknown the'), (4, '')) t(q_id, text)"
BM25 = "bm AS (SELECT q_id, doc_id AS id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY q_id, doc_id)"


def terms_of(rows: str) -> str:
    return f"qt AS (SELECT CAST(q_id AS BIGINT) AS q_id, term, count(*) AS qtf FROM (SELECT q_id, {_SPLIT} AS term FROM {rows}) WHERE term <> '' GROUP BY q_id, term)"


def ranked(name: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name}"


def top(name: str, k: int, extra: str = "") -> str:
    return f"SELECT q_id, id, round(score, 6) AS score, rank{', ' + extra if extra else ''} FROM ({ranked(name)}) WHERE rank <= {k}"


V = "CAST(embedding AS DOUBLE[])"
_VV = f"vv AS (SELECT vec_id AS id, {V} AS v, sqrt(list_inner_product({V}, {V})) AS n, label FROM embeddings)"
_COSINE = "list_inner_product(a.v, b.v) / ((a.n + 1e-10) * (b.n + 1e-10))"
VECTORS = f"""{_VV}, sims AS (SELECT a.id AS q_id, b.id, {_COSINE} AS cosine, list_inner_product(a.v, b.v) AS dot, -list_distance(a.v, b.v) AS euclidean,
-list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) AS manhattan FROM vv a, vv b WHERE a.id % 20 = 0)"""

# Filters, routing. Queries whose parses and classes are known, with the numbers that the Spark side gives them.
SPOKEN = [
    "a peaceful sunset over the ocean", "outdoor photos from 2023", "outdoor photos of golden retrievers from 2023", "indoor image in 2024 without people",
    "a photo before 1999", "室内 照片", "the last picture of a street in the city not the beach", "from twenty", "within 2021 outdoor indoor", "no",
]
_VALUES = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(SPOKEN))
SPOKEN_ONLY = f"asked AS (SELECT CAST(q_id AS BIGINT) AS q_id, text FROM (VALUES {_VALUES}) t(q_id, text))"
EVERYTHING = f"asked AS (SELECT CAST(q_id AS BIGINT) AS q_id, text FROM (VALUES {_VALUES}) t(q_id, text) UNION ALL SELECT item_id + 1000, text FROM benchmark)"
BENCHMARK_ASKED = "asked AS (SELECT item_id AS q_id, text FROM benchmark)"
PARSED = r"""parsed AS (
SELECT q_id, 'year' AS field, 'eq' AS op, regexp_extract(lower(text), '(from|in|since|before|after)\s+([0-9]{4})', 2) AS value FROM asked WHERE regexp_matches(lower(text), '(from|in|since|before|after)\s+([0-9]{4})')
UNION ALL SELECT q_id, 'scene', 'eq', 'outdoor' FROM asked WHERE lower(text) LIKE '%outdoor%' OR text LIKE '%室外%'
UNION ALL SELECT q_id, 'scene', 'eq', 'indoor' FROM asked WHERE lower(text) LIKE '%indoor%' OR text LIKE '%室内%')"""
META = """items AS (SELECT doc_id AS id, CAST(2020 + doc_id % 6 AS VARCHAR) AS year, CASE doc_id % 3 WHEN 0 THEN 'outdoor' WHEN 1 THEN 'indoor' END AS scene FROM documents),
meta AS (SELECT a.q_id, i.id, CASE WHEN count(*) FILTER (WHERE p.field IS NOT NULL AND (CASE p.field WHEN 'year' THEN i.year ELSE i.scene END) IS DISTINCT FROM p.value) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS meta
FROM asked a CROSS JOIN items i LEFT JOIN parsed p ON p.q_id = a.q_id GROUP BY a.q_id, i.id)"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


ROUTER = rf"""words AS (SELECT q_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS words FROM asked),
qidf AS (SELECT q_id, avg(idf) AS avg_idf FROM (SELECT q_id, unnest(words) AS term FROM words) JOIN idf USING (term) GROUP BY q_id),
feat AS (SELECT q_id, len(words) AS query_length, CAST(list_has_any(words, {_list(R.TEMPORAL)}) AS BIGINT) AS has_temporal, CAST(list_has_any(words, {_list(R.LOCATION)}) AS BIGINT) AS has_location,
 CAST(list_has_any(words, {_list(R.CATEGORY)}) AS BIGINT) AS has_category, CAST(list_has_any(words, {_list(R.NEGATION)}) AS BIGINT) AS has_negation, coalesce(avg_idf, 0) AS avg_idf FROM words LEFT JOIN qidf USING (q_id)),
raw AS (SELECT *, has_temporal + has_location + has_category AS f,
 0.6::DOUBLE - CASE WHEN avg_idf > 4 THEN 0.1 ELSE 0 END - 0.05 * f + CASE WHEN query_length > 6 THEN 0.1 ELSE 0 END - 0.1 * has_negation AS d,
 0.25::DOUBLE + CASE WHEN avg_idf > 4 THEN 0.15 ELSE 0 END - 0.05 * f - CASE WHEN query_length > 6 THEN 0.05 ELSE 0 END + 0.1 * has_negation AS s,
 0.15::DOUBLE - CASE WHEN avg_idf > 4 THEN 0.05 ELSE 0 END + 0.1 * f - CASE WHEN query_length > 6 THEN 0.05 ELSE 0 END AS m FROM feat),
routed AS (SELECT q_id, CASE WHEN f >= 1 AND avg_idf >= 3 THEN 'hybrid' WHEN f >= 1 THEN 'metadata' WHEN avg_idf >= 3 THEN 'keyword' ELSE 'semantic' END AS query_type,
 greatest(d / (d + s + m), 0) AS w_dense, greatest(s / (d + s + m), 0) AS w_sparse, greatest(m / (d + s + m), 0) AS w_meta FROM raw)"""

# Fusion.
HYBRID = f"{_VV}, hs AS (SELECT item_id AS q_id, b.id, {_COSINE} AS cosine FROM benchmark JOIN vv a ON a.id = item_id, vv b), hc AS (SELECT q_id, id, cosine AS score FROM hs)"


def _sides(n: int) -> str:
    return f"dn AS (SELECT * FROM ({ranked('hc')}) WHERE rank <= {n}), sn AS (SELECT * FROM ({ranked('bm')}) WHERE rank <= {n} AND q_id IN (SELECT q_id FROM hc))"


def aligned(n: int) -> str:
    return f"{_sides(n)}, al AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.id, b.id) AS id, coalesce(a.score, 0) AS dense, coalesce(b.score, 0) AS sparse FROM dn a FULL JOIN sn b ON a.q_id = b.q_id AND a.id = b.id)"


def _minmax(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-10 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


def normal(source: str) -> str:
    meta = f", {_minmax('meta')} AS nmeta" if source == "am" else ""
    return f"nm AS (SELECT q_id, id, {_minmax('dense')} AS nd, {_minmax('sparse')} AS ns{meta} FROM {source} WINDOW w AS (PARTITION BY q_id))"


NORMAL = normal("al")


def _z(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER w < 1e-10 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END"


ZSCORE = f"zm AS (SELECT q_id, id, {_z('dense')} AS zd, {_z('sparse')} AS zs FROM al WINDOW w AS (PARTITION BY q_id))"


def rrf(n: int) -> str:
    return f"{_sides(n)}, rr AS (SELECT q_id, id, sum(1e0 / (60 + rank)) AS score FROM (SELECT q_id, id, rank FROM dn UNION ALL SELECT q_id, id, rank FROM sn) GROUP BY q_id, id)"


# Evaluation.
def _measures(preds: str, gold: str, prefix: str = "") -> str:
    p = prefix
    return f"""{p}rel AS (SELECT p.q_id, p.rank, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS rel FROM {preds} p LEFT JOIN {gold} g ON g.q_id = p.q_id AND g.id = p.id),
{p}run AS (SELECT *, sum(rel) OVER (PARTITION BY q_id ORDER BY rank) / rank AS prec FROM {p}rel),
{p}want AS (SELECT q_id, count(*) AS wanted FROM {gold} GROUP BY q_id),
{p}per_query AS (SELECT w.q_id, CAST(coalesce(sum(rel) FILTER (WHERE rank <= 1), 0) AS BIGINT) AS hits1, CAST(coalesce(sum(rel) FILTER (WHERE rank <= 5), 0) AS BIGINT) AS hits5, CAST(coalesce(sum(rel) FILTER (WHERE rank <= 10), 0) AS BIGINT) AS hits10,
 coalesce(1e0 / min(rank) FILTER (WHERE rel = 1), 0) AS rr, coalesce(sum(prec * rel), 0) / greatest(coalesce(sum(rel), 0), 1) AS ap_retrieved, coalesce(sum(prec * rel), 0) / wanted AS ap_all FROM {p}want w LEFT JOIN {p}run r USING (q_id) GROUP BY w.q_id, wanted),
{p}summary AS (SELECT count(*) AS n_queries, avg(CASE WHEN hits1 > 0 THEN 1e0 ELSE 0 END) AS recall_1, avg(CASE WHEN hits5 > 0 THEN 1e0 ELSE 0 END) AS recall_5, avg(CASE WHEN hits10 > 0 THEN 1e0 ELSE 0 END) AS recall_10,
 avg(hits1) AS precision_1, avg(hits5 / 5e0) AS precision_5, avg(hits10 / 10e0) AS precision_10, avg(ap_retrieved) AS map_retrieved, avg(ap_all) AS map_all, avg(rr) AS mrr FROM {p}per_query)"""


_LABELS = "gold AS (SELECT a.id AS q_id, b.id FROM vv a JOIN vv b USING (label) WHERE a.id % 20 = 0 AND a.id <> b.id)"
_OTHERS = "others AS (SELECT q_id, id, cosine AS score FROM sims WHERE q_id <> id)"
EVALUATION = f"{VECTORS}, {_LABELS}, {_OTHERS}, preds AS (SELECT * FROM ({ranked('others')}) WHERE rank <= 10), {_measures('preds', 'gold')}"
LATENCY = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms,
round(quantile_cont(value, 0.99), 6) AS p99_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms FROM events GROUP BY event_type"""


def scale_recall(sizes: tuple[int, ...]) -> str:
    """Each size below the table's, and the table's own, which is one more than its greatest id."""
    whole = "(SELECT max(id) + 1 FROM vv)"
    named = {**{f"{n}": f"{n}" for n in sizes}, "all": whole}
    parts = [f"s{i} AS (SELECT q_id, id, cosine AS score FROM sims WHERE id < {n}), g{i} AS (SELECT * FROM gold WHERE id < {n}), p{i} AS (SELECT * FROM ({ranked(f's{i}')}) WHERE rank <= 10), {_measures(f'p{i}', f'g{i}', f'm{i}_')}" for i, n in named.items()]
    rows = " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS size, n_queries, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr FROM m{i}_summary WHERE {n} < {whole} OR {n == whole}" for i, n in named.items())
    return f"WITH {VECTORS}, {_LABELS}, {', '.join(parts)} {rows}"


def _ablation() -> str:
    fixed, adaptive = "0.6 * nd + 0.4 * ns", "w_dense * nd + w_sparse * ns"
    runs = {"pure_dense": "hc", "pure_sparse": "bq", "fixed_weight": "fx", "adaptive": "ad"}
    head = f"WITH {INDEX}, {BENCHMARK_TERMS}, {BM25}, {HYBRID}, {aligned(200)}, {NORMAL}, {BENCHMARK_ASKED}, {ROUTER}, gold AS (SELECT item_id AS q_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE item_id IN (SELECT id FROM vv))"
    head += f", bq AS (SELECT * FROM bm WHERE q_id IN (SELECT q_id FROM hc)), fx AS (SELECT q_id, id, {fixed} AS score FROM nm), ad AS (SELECT q_id, id, {adaptive} AS score FROM nm JOIN routed USING (q_id))"
    parts = [f"p_{s} AS (SELECT * FROM ({ranked(t)}) WHERE rank <= 10), {_measures(f'p_{s}', 'gold', f'{s}_')}" for s, t in runs.items()]
    rows = " UNION ALL ".join(f"SELECT '{s}' AS strategy, n_queries, round(recall_1, 6) AS recall_1, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr FROM {s}_summary" for s in runs)
    return f"{head}, {', '.join(parts)} {rows}"


ABLATION = _ablation()

# Context and judgements.
CONTEXT = f"""{INDEX}, {BENCHMARK_TERMS}, {BM25}, hits AS (SELECT * FROM ({ranked('bm')}) WHERE rank <= 5),
lines AS (SELECT q_id, rank, '[' || rank || '] (Score: ' || printf('%.3f', score) || ')' || coalesce(' Caption: ' || text, '') AS line FROM hits LEFT JOIN documents ON doc_id = id),
ctx AS (SELECT q_id, string_agg(line, chr(10) ORDER BY rank) AS context FROM lines GROUP BY q_id)"""
JUDGED = "judged AS (SELECT doc_id, quality, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 1 + doc_id % 5 END AS relevance, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 1 + (doc_id + 1) % 5 END AS accuracy, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 1 + (doc_id + 2) % 5 END AS usefulness FROM labels)"
_GRADES = ("relevance", "accuracy", "usefulness")
JUDGE_SUMMARY = (
    "SELECT quality, count(*) FILTER (WHERE relevance > 0) AS n_valid, count(*) FILTER (WHERE relevance <= 0) AS n_failed, "
    + ", ".join(f"round(avg({g}) FILTER (WHERE relevance > 0), 2) AS {g}_mean" for g in _GRADES)
    + ", round(avg((relevance + accuracy + usefulness) / 3e0) FILTER (WHERE relevance > 0), 2) AS overall_mean, "
    + ", ".join(f"count(*) FILTER (WHERE relevance > 0 AND {g} = {i}) AS {g}_{i}" for g in _GRADES for i in range(1, 6))
    + " FROM judged GROUP BY quality"
)


def filled(template: str, **values: str) -> str:
    out = quoted(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


FILLED = f"""WITH {INDEX}, {terms_of(REPEATS)}, {BM25}, every AS (SELECT CAST(t.q_id AS BIGINT) AS q_id, d.doc_id AS id FROM {REPEATS} CROSS JOIN documents d),
bz AS (SELECT q_id, id, coalesce(score, 0) AS score FROM every LEFT JOIN bm USING (q_id, id)) {top('bz', 10)}"""
HYBRID_FILLED = f"""WITH {INDEX}, {BENCHMARK_TERMS}, {BM25.replace('bm AS', 'hit AS')}, bm AS (SELECT item_id AS q_id, doc_id AS id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN hit ON hit.q_id = item_id AND hit.id = doc_id),
{HYBRID}, {aligned(200)}, {NORMAL}, s AS (SELECT q_id, id, 0.6 * nd + 0.25 * ns AS score FROM nm) {top('s', 10)}"""


def _summaries(name: str, **prefixes: str) -> str:
    return " UNION ALL ".join(f"SELECT '{value}' AS {name}, n_queries, round(recall_1, 6) AS recall_1, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr FROM {prefix}_summary" for prefix, value in prefixes.items())


DIRECTIONS = f"""WITH {_VV}, met AS (SELECT a.id AS text_id, b.id AS image_id, {_COSINE} AS score, a.label = b.label AS pair FROM vv a JOIN vv b ON a.id % 2 = 0 AND b.id % 2 = 1),
t AS (SELECT text_id AS q_id, image_id AS id, score FROM met), i AS (SELECT image_id AS q_id, text_id AS id, score FROM met),
tg AS (SELECT text_id AS q_id, image_id AS id FROM met WHERE pair), ig AS (SELECT image_id AS q_id, text_id AS id FROM met WHERE pair),
tp AS (SELECT * FROM ({ranked('t')}) WHERE rank <= 10), ip AS (SELECT * FROM ({ranked('i')}) WHERE rank <= 10), {_measures('tp', 'tg', 'x_')}, {_measures('ip', 'ig', 'y_')}
{_summaries('direction', x='text_to_image', y='image_to_text')}"""
_BEST = f"s AS (SELECT q_id, id, w_dense * nd + w_sparse * ns AS score FROM nm JOIN routed USING (q_id)), best AS (SELECT * FROM ({ranked('s')}) WHERE rank = 1)"
ANSWERS = f"""WITH {INDEX}, {BENCHMARK_TERMS}, {BM25}, {HYBRID}, {aligned(100)}, {BENCHMARK_ASKED}, {ROUTER}, {NORMAL}, {_BEST}
SELECT q_id, 'ok' AS status, 'Best match: [1] (Score: ' || printf('%.3f', score) || ')' || coalesce(' Caption: ' || string_split(text, chr(10))[1], '') AS answer FROM best LEFT JOIN documents ON doc_id = id"""
DEMO = """SELECT n AS image_id, 'images/' || lpad(CAST(n AS VARCHAR), 5, '0') || '.jpg' AS image_path, caption, scene, 2021 + n % 4 AS year, ['flickr', 'unsplash', 'pexels'][n % 3 + 1] AS source FROM (
SELECT row_number() OVER (ORDER BY s, p, i) - 1 AS n, scene, subjects[i] || ' ' || places[p] AS caption FROM (VALUES
(1, 'outdoor', ['a runner', 'a red bus', 'two dogs', 'a market', 'a kite'], ['in the park', 'by the street']),
(2, 'indoor', ['a reader', 'a laptop', 'a sleeping cat', 'a guitar', 'a lamp'], ['in the kitchen', 'near the window']),
(3, 'nature', ['a heron', 'a waterfall', 'a pine forest', 'a fox', 'a storm'], ['in the hills', 'at the lake'])) t(s, scene, subjects, places), range(1, 3) a(p), range(1, 6) b(i))"""


def lsh(tables: int, bits: int) -> str:
    part = lambda at: f"(CAST('0x' || substr(md5(t || ':' || b || ':' || d || ':42'), {at}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"""planes AS (SELECT t, b, list(sqrt(-2 * ln({part(1)})) * cos(2 * pi() * ({part(9)})) ORDER BY d) AS p
FROM range({tables}) a(t), range({bits}) c(b), range(64) e(d) GROUP BY t, b),
sig AS (SELECT vec_id AS id, t AS table_id, string_agg(CASE WHEN list_inner_product({V}, p) > 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS signature FROM embeddings, planes GROUP BY vec_id, t)"""


COMPARISON = f"""WITH {lsh(16, 6)}, {VECTORS}, {_LABELS}, ex AS (SELECT q_id, id, cosine AS score FROM sims),
met AS (SELECT DISTINCT a.id AS q_id, b.id FROM sig a JOIN sig b USING (table_id, signature) WHERE a.id % 20 = 0), lh AS (SELECT q_id, id, cosine AS score FROM met JOIN sims USING (q_id, id)),
pe AS (SELECT * FROM ({ranked('ex')}) WHERE rank <= 10), pl AS (SELECT * FROM ({ranked('lh')}) WHERE rank <= 10), {_measures('pe', 'gold', 'x_')}, {_measures('pl', 'gold', 'y_')}
{_summaries('index', x='exact', y='lsh')}"""


# Lists whose first centres are the vectors that hash lowest, after rounds over all vectors.
def lists(k: str, rounds: int) -> str:
    near = lambda c: f"""(SELECT id, min(far) AS far, arg_min(list, (far, list)) AS list FROM (SELECT vv.id, list, list_sum(list_transform(list_zip(vv.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS far FROM vv, {c} c) GROUP BY id)"""
    steps = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS list, v FROM vv QUALIFY row_number() OVER (ORDER BY md5(id || ':42'), id) <= {k})"]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED {near(f'c{i}')}, m{i} AS (SELECT list, pos, avg(x) AS x FROM (SELECT list, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vv JOIN a{i} USING (id)) GROUP BY list, pos)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT list, coalesce(n.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT list, list(x ORDER BY pos) AS v FROM m{i} GROUP BY list) n USING (list))")
    return f"{_VV}, {', '.join(steps)}, near AS MATERIALIZED {near(f'c{rounds}')}"


def probed(tables: int, bits: int, flips: int) -> str:
    """Every query's own signatures and those with one of the bits turned whose planes are nearest to it."""
    head = lsh(tables, bits)
    sides = f"sides AS (SELECT vec_id AS id, t, b, list_inner_product({V}, p) AS x FROM embeddings, planes WHERE vec_id % 20 = 0)"
    turned = f"turned AS (SELECT id, t, b FROM sides QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY abs(x), b) <= {flips})"
    probes = "probes AS (SELECT id, table_id, signature FROM sig WHERE id % 20 = 0 UNION ALL SELECT id, table_id, substr(signature, 1, CAST(b AS INTEGER)) || CASE WHEN signature[CAST(b AS INTEGER) + 1] = '1' THEN '0' ELSE '1' END || substr(signature, CAST(b AS INTEGER) + 2) FROM sig JOIN turned USING (id) WHERE t = table_id)"
    return f"{head}, {sides}, {turned}, {probes}, met AS (SELECT DISTINCT p.id AS q_id, s.id FROM probes p JOIN sig s USING (table_id, signature))"


def vocabulary(most: int, least: int) -> str:
    return f"{TOKENS}, voc AS (SELECT term, count(*) AS n FROM tok GROUP BY term HAVING count(*) >= {least} ORDER BY n DESC, term LIMIT {most})"


def company(most: int, least: int, window: int) -> str:
    """Pairs of known words at most so many words apart, and the logarithm of how much oftener they meet than by chance, if it is above 0."""
    lines = r"SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS words FROM documents"
    return f"""{vocabulary(most, least)}, lines AS ({lines}),
line AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM lines),
known AS (SELECT doc_id, term, pos FROM line JOIN voc USING (term)),
steps AS (SELECT unnest(range(-{window}, {window} + 1)) AS step),
pair AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM (SELECT *, pos + step AS other FROM known, steps WHERE step <> 0) x JOIN known y ON y.doc_id = x.doc_id AND y.pos = x.other GROUP BY x.term, y.term),
side AS (SELECT a, sum(n) AS all_n FROM pair GROUP BY a), total AS (SELECT sum(n) AS t FROM pair),
cell AS (SELECT pair.a, pair.b, n, CASE WHEN CAST(n AS DOUBLE) * t > CAST(s.all_n AS DOUBLE) * r.all_n THEN ln(CAST(n AS DOUBLE) * t / (CAST(s.all_n AS DOUBLE) * r.all_n)) END AS value
FROM pair JOIN side s ON s.a = pair.a JOIN side r ON r.a = pair.b, total)"""


def trusted(k: int) -> str:
    """ranked: the rank among all vectors of each query's k nearest by the first two components."""
    return f"""{VECTORS}, flat AS (SELECT q_id, s.id, round(-euclidean, 9) AS far, -sqrt((a.v[1] - b.v[1]) ** 2 + (a.v[2] - b.v[2]) ** 2) AS score
FROM sims s JOIN vv a ON a.id = s.q_id JOIN vv b ON b.id = s.id WHERE s.id <> s.q_id),
near AS (SELECT * FROM ({ranked('flat')}) WHERE rank <= {k}),
ranked AS (SELECT near.q_id, near.id, 1 + count(flat.id) AS rank FROM near LEFT JOIN flat ON flat.q_id = near.q_id AND flat.far < near.far GROUP BY near.q_id, near.id)"""
