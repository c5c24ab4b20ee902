"""Registry of the engine's queries on the embeddings table and their DuckDB oracles.

Row-wise functions pair every vector with the next one by id. Searches take as queries
every row whose id is divisible by 100, against all rows, unless a query says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vector as V
from vectide.operators import cluster, evaluate, exact, ivf
from vectide.operators.graph import descent, index, kernel
from vectide.operators.lineage import cut as table
from vectide.types import BuildParams, SearchParams

def base(spark, sf_dir: str) -> DataFrame:
    """Float vectors (id, vec)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def codes(spark, sf_dir: str, chunk: int = 1, signed: bool = False) -> DataFrame:
    """Scalar codes (id, vec); with chunk 2 unpacked again, in sixteenths."""
    c = V.quantize("vec", chunk, signed)
    return base(spark, sf_dir).select("id", (V.unpack4(c, signed) if chunk == 2 else c).alias("vec"))


def queries_of(df: DataFrame) -> DataFrame:
    """The stated query set."""
    return df.where(F.col("id") % 100 == 0)


# ---- row-wise functions: name -> (column over v, w, codes) and its SQL -------------------------

_MATRIX = [[((j * 7 + i * 13) % 11 - 5) / 8.0 for i in range(64)] for j in range(16)]
_BIAS = [j / 4.0 for j in range(16)]

_Q8 = "list_transform({0}, lambda v: greatest(least(CAST(trunc(CAST(v + 1::FLOAT AS DOUBLE) * 0.5 * 255) AS INTEGER), 255), 0))"
_I8 = f"list_transform({_Q8}, lambda t: t - 128)"
_U4 = f"list_transform({_Q8}, lambda t: (t // 16) * 16)"
_I4 = f"list_transform({_Q8}, lambda t: (t // 16 - 8) * 16)"
_DBL = "CAST({0} AS DOUBLE[])"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _r(x: Column) -> Column:
    return F.round(x, 6)


def _each(v: Column) -> Column:
    """A checkable digest of a float vector: the weighted sum of its rounded components."""
    return F.aggregate(F.transform(v, lambda x, i: F.round(x, 6) * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


_EACH = "list_sum(list_transform(list_zip({0}, range(1, len({0}) + 1)), lambda z: round(z[1], 6) * z[2]))"
_A, _B = _DBL.format("a"), _DBL.format("b")
_PACK = f"list_transform(range(1, 33), lambda i: ({_Q8.format('a')})[2 * i - 1] // 16 + (({_Q8.format('a')})[2 * i] // 16) * 16)"


def _digest(sql: str) -> str:
    return f"(SELECT {_EACH.format('t.x')} FROM (SELECT {sql} AS x) t)"


_M_SQL = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in r) + "]" for r in _MATRIX) + "]"

FUNCTIONS = {
    "v_l2sq_u8": (lambda a, b: V.l2sq(V.quantize(a), V.quantize(b), True), f"CAST({_l2(_Q8.format('a'), _Q8.format('b'))} AS BIGINT)"),
    "v_l2sq_i8": (lambda a, b: V.l2sq(V.quantize(a, 1, True), V.quantize(b, 1, True), True), f"CAST({_l2(_I8.format('a'), _I8.format('b'))} AS BIGINT)"),
    "v_l2sq_f32": (lambda a, b: _r(V.l2sq(a, b)), f"round({_l2(_A, _B)}, 6)"),
    "v_l2sq_u4": (lambda a, b: V.l2sq(V.unpack4(V.quantize(a, 2)), V.unpack4(V.quantize(b, 2)), True), f"CAST({_l2(_U4.format('a'), _U4.format('b'))} AS BIGINT)"),
    "v_l2sq_i4": (lambda a, b: V.l2sq(V.unpack4(V.quantize(a, 2, True), True), V.unpack4(V.quantize(b, 2, True), True), True), f"CAST({_l2(_I4.format('a'), _I4.format('b'))} AS BIGINT)"),
    "v_neg_ip_u8": (lambda a, b: V.neg_ip(V.quantize(a), V.quantize(b), True), f"CAST(-{_ip(_Q8.format('a'), _Q8.format('b'))} AS BIGINT)"),
    "v_neg_ip_i8": (lambda a, b: V.neg_ip(V.quantize(a, 1, True), V.quantize(b, 1, True), True), f"CAST(-{_ip(_I8.format('a'), _I8.format('b'))} AS BIGINT)"),
    "v_neg_ip_u4": (lambda a, b: V.neg_ip(V.unpack4(V.quantize(a, 2)), V.unpack4(V.quantize(b, 2)), True), f"CAST(-{_ip(_U4.format('a'), _U4.format('b'))} AS BIGINT)"),
    "v_neg_ip_i4": (lambda a, b: V.neg_ip(V.unpack4(V.quantize(a, 2, True), True), V.unpack4(V.quantize(b, 2, True), True), True), f"CAST(-{_ip(_I4.format('a'), _I4.format('b'))} AS BIGINT)"),
    "v_neg_ip_f32": (lambda a, b: _r(V.distance(a, b, "mips")), f"round(-{_ip(_A, _B)}, 6)"),
    "v_dot": (lambda a, b: _r(V.dot(a, b)), f"round({_ip(_A, _B)}, 6)"),
    "v_norm": (lambda a, b: _r(V.norm(V.scale(a, 3.0))), f"round(sqrt({_ip(_A, _A)}) * 3, 6)"),
    "v_rms": (lambda a, b: _r(V.rms(a)), f"round(sqrt({_ip(_A, _A)} / len(a) + 1e-6), 6)"),
    "v_add_feat": (lambda a, b: _r(_each(V.axpy(a, b, 0.5))), f"round({_digest(f'list_transform(list_zip({_A}, {_B}), lambda z: z[1] + 0.5::DOUBLE * z[2])')}, 6)"),
    "v_add_feat_square": (lambda a, b: _r(_each(V.axpy_square(a, b, 2.0))), f"round({_digest(f'list_transform(list_zip({_A}, {_B}), lambda z: z[1] + 2::DOUBLE * z[2] * z[2])')}, 6)"),
    "v_add_feat_sparse": (
        lambda a, b: _r(_each(V.axpy_sparse(a, F.array(F.lit(1), F.lit(5), F.lit(40)), F.array(F.lit(1.0), F.lit(-2.0), F.lit(3.0)), 0.25))),
        f"round({_digest(f'list_transform(list_zip({_A}, range(0, 64)), lambda z: z[1] + CASE z[2] WHEN 1 THEN 0.25::DOUBLE WHEN 5 THEN -0.5::DOUBLE WHEN 40 THEN 0.75::DOUBLE ELSE 0::DOUBLE END)')}, 6)",
    ),
    "v_add": (lambda a, b: _r(_each(V.axpy(a, b, 1.0))), f"round({_digest(f'list_transform(list_zip({_A}, {_B}), lambda z: z[1] + z[2])')}, 6)"),
    "v_scale": (lambda a, b: _r(_each(V.divide(V.scale(a, 5.0), 4.0))), f"round({_digest(f'list_transform({_A}, lambda x: x * 5::DOUBLE / 4::DOUBLE)')}, 6)"),
    "v_sub_vector": (lambda a, b: _r(V.l2sq(V.part(a, 16, 8), V.part(b, 16, 8))), f"round({_l2(f'({_A})[17:24]', f'({_B})[17:24]')}, 6)"),
    "v_zeros": (lambda a, b: _r(V.l2sq(V.zeros(64), b)), f"round({_ip(_B, _B)}, 6)"),
    "v_widen": (lambda a, b: _r(_each(V.quantize(a).cast("array<float>").cast("array<double>"))), f"round({_digest(f'CAST({_Q8.format(chr(97))} AS DOUBLE[])')}, 6)"),
    "v_matmul": (
        lambda a, b: _r(_each(V.project(a, _MATRIX, _BIAS))),
        f"round({_digest(f'list_transform(list_zip({_M_SQL}, range(0, 16)), lambda r: r[2] / 4::DOUBLE + list_sum(list_transform(list_zip(r[1], {_A}), lambda z: z[1] * z[2])))')}, 6)",
    ),
    "v_quantize_u8": (lambda a, b: _text(V.quantize(a)), f"array_to_string({_Q8.format('a')}, ',')"),
    "v_quantize_i8": (lambda a, b: _text(V.quantize(a, 1, True)), f"array_to_string({_I8.format('a')}, ',')"),
    "v_quantize_u4": (lambda a, b: _text(V.quantize(a, 2)), f"array_to_string({_PACK}, ',')"),
    "v_pack_u4": (lambda a, b: _text(V.u8_to_u4(V.quantize(a))), f"array_to_string({_PACK}, ',')"),
    "v_unpack_u4": (lambda a, b: _text(V.unpack4(V.quantize(a, 2))), f"array_to_string({_U4.format('a')}, ',')"),
    "v_unpack_i4": (lambda a, b: _text(V.unpack4(V.quantize(a, 2, True), True)), f"array_to_string({_I4.format('a')}, ',')"),
    "v_fbin_to_u8": (lambda a, b: _text(V.to_u8(V.quantize(a).cast("array<float>"))), f"array_to_string({_Q8.format('a')}, ',')"),
    "v_cosine_at_p": (
        lambda a, b: _r(V.cosine_at_p(V.dot(a, a), V.l2sq(a, b), V.dot(b, b))),
        f"(SELECT CASE WHEN pa <= 0 OR pb <= 0 THEN 1.0 ELSE round((pa + pb - ab) / (2 * sqrt(pa) * sqrt(pb)), 6) END FROM (SELECT {_ip(_A, _A)} AS pa, {_l2(_A, _B)} AS pb, {_ip(_B, _B)} AS ab) t)",
    ),
    "v_pruned_by_distance": (lambda a, b: V.pruned_by_distance(V.l2sq(V.quantize(a), V.quantize(b), True), V.dot(V.quantize(b), V.quantize(b), True) / 150, 1.1), f"1.1::DOUBLE * ({_ip(_Q8.format('b'), _Q8.format('b'))} / 150::DOUBLE) <= {_l2(_Q8.format('a'), _Q8.format('b'))}"),
    "v_relu": (lambda a, b: _r(_each(V.relu(a))), f"round({_digest(f'list_transform({_A}, lambda x: greatest(x, 0::DOUBLE))')}, 6)"),
    "v_rms_norm": (lambda a, b: F.round(_each(V.rms_norm(a)), 3), f"round((SELECT {_EACH.format('t.x')} FROM (SELECT list_transform(list_zip({_A}, list_transform({_A}, lambda k: s.r)), lambda z: z[1] / z[2]) AS x FROM (SELECT sqrt({_ip(_A, _A)} / len(a) + 1e-6) AS r) s) t), 3)"),
}


def _pairs(spark, sf_dir: str) -> DataFrame:
    e = base(spark, sf_dir)
    return e.select("id", F.col("vec").alias("a")).join(e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("b")), "id")


def _function(make):
    def query(spark, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("id", make(F.col("a"), F.col("b")).alias("value"))

    return query


_PAIR_SQL = "SELECT x.vec_id AS id, {0} AS value FROM (SELECT l.vec_id, l.embedding AS a, r.embedding AS b FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1) x"

# ---- searches ---------------------------------------------------------------------------------


def _knn_sql(code: str, k: int, dist: str, cast: str = "CAST({0} AS BIGINT)", where: str = "q.id % 100 = 0") -> str:
    return f"""SELECT qid, CAST(rnk AS INTEGER) AS rnk, id, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rnk FROM (
    SELECT q.id AS qid, b.id, {cast.format(dist)} AS dist
    FROM (SELECT vec_id AS id, {code} AS c FROM embeddings) q, (SELECT vec_id AS id, {code} AS c FROM embeddings) b WHERE {where}))
WHERE rnk <= {k}"""


_C8, _C4, _CF = _Q8.format("embedding"), _U4.format("embedding"), _DBL.format("embedding")
_L2, _IP = _l2("q.c", "b.c"), _ip("q.c", "b.c")
_RND = "round({0}, 6)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


def exact_knn_u8(spark, sf_dir):
    """Exact top-10 on 8-bit codes."""
    c = codes(spark, sf_dir)
    return exact.knn_join(c, queries_of(c), 10, exact=True)


def exact_knn_u8_sql(spark, sf_dir):
    """The same as a broadcast nested-loop join in SQL functions."""
    c = codes(spark, sf_dir)
    return exact.knn_sql(c, queries_of(c), 10, exact=True)


def exact_knn_u4(spark, sf_dir):
    """Exact top-10 on 4-bit codes."""
    c = codes(spark, sf_dir, 2)
    return exact.knn_join(c, queries_of(c), 10, exact=True)


def exact_knn_f32(spark, sf_dir):
    """Exact top-10 on float vectors."""
    e = base(spark, sf_dir)
    return _rounded(exact.knn_join(e, queries_of(e), 10))


def exact_knn_mips(spark, sf_dir):
    """Exact top-10 by inner product on vectors scaled by (id % 7 + 1)."""
    e = base(spark, sf_dir).select("id", F.transform(F.col("vec").cast("array<double>"), lambda x: x * (F.col("id") % 7 + 1)).alias("vec"))
    return _rounded(exact.knn_join(e, queries_of(e), 10, "mips"))


def rerank_u4_f32(spark, sf_dir):
    """Top-40 on 4-bit codes, then top-10 of them on floats."""
    c, e = codes(spark, sf_dir, 2), base(spark, sf_dir)
    cand = exact.knn_join(c, queries_of(c), 40, exact=True)
    return _rounded(exact.rerank(cand, e, queries_of(e), 10))


def _rerank_sql(first: int) -> str:
    return f"""WITH c AS ({_knn_sql(_C4, first, _L2)}), p AS (
  SELECT c.qid, c.id, round({_l2("CAST(q.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])")}, 6) AS dist, {_l2("CAST(q.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])")} AS d
  FROM c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings b ON b.vec_id = c.id)
SELECT qid, CAST(rnk AS INTEGER) AS rnk, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rnk FROM p) WHERE rnk <= 10"""


_RERANK = _rerank_sql(40)


def fetch_by_position(spark, sf_dir):
    """Vectors of all ids in descending order, by list position."""
    e = base(spark, sf_dir)
    n = e.agg(F.max("id")).first()[0]
    ids = e.select((F.lit(n) - F.col("id")).alias("pos"), "id")
    return exact.fetch(e, ids).select("pos", "id", _r(F.element_at("vec", 1).cast("double")).alias("head"))


def recall_u4(spark, sf_dir):
    """Tie-aware recall@10 of 4-bit codes against float truth."""
    e, c = base(spark, sf_dir), codes(spark, sf_dir, 2)
    truth = exact.knn_join(e, queries_of(e), 50)
    return evaluate.recall(exact.knn_join(c, queries_of(c), 10, exact=True), truth, 10).select("queries", "hits", F.round("recall", 6).alias("recall"))


def recall_ties(spark, sf_dir):
    """Tie-aware recall of coarse codes against themselves ranked from the highest id."""
    c = codes(spark, sf_dir).select("id", F.transform("vec", lambda x: F.floor(x / 64).cast("int")).alias("vec"))
    truth = exact.knn_join(c, queries_of(c), 60, exact=True)
    w = Window.partitionBy("qid").orderBy("dist", F.desc("id"))
    worst = truth.withColumn("rnk", F.row_number().over(w)).where("rnk <= 10")
    return evaluate.recall(worst, truth, 10).select("queries", "hits", F.round("recall", 6).alias("recall"))


_COARSE = f"list_transform({_C8}, lambda x: x // 64)"
_RECALL_TIES = f"""WITH t AS ({_knn_sql(_COARSE, 60, _L2)}),
bar AS (SELECT qid, max(dist) AS bar FROM t WHERE rnk <= 10 GROUP BY qid),
w AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id DESC) AS r FROM t) WHERE r <= 10)
SELECT (SELECT count(*) FROM bar) AS queries, count(*) AS hits, round(count(*) / ((SELECT count(*) FROM bar) * 10.0::DOUBLE), 6) AS recall
FROM w JOIN t USING (qid, id) JOIN bar USING (qid) WHERE t.dist <= bar"""
_RECALL_U4 = f"""WITH t AS ({_knn_sql(_CF, 50, _L2, "{0}")}), c AS ({_knn_sql(_C4, 10, _L2)}),
bar AS (SELECT qid, max(dist) AS bar FROM t WHERE rnk <= 10 GROUP BY qid)
SELECT (SELECT count(*) FROM bar) AS queries, count(*) AS hits, round(count(*) / ((SELECT count(*) FROM bar) * 10.0::DOUBLE), 6) AS recall
FROM c JOIN (SELECT t.qid, t.id FROM t JOIN bar USING (qid) WHERE t.dist <= bar) USING (qid, id)"""


def recall_at_u8(spark, sf_dir):
    """Recall 10@20 of 8-bit codes cut to 32 dimensions, the compressed-vector test."""
    e = base(spark, sf_dir)
    c = codes(spark, sf_dir).select("id", V.part("vec", 0, 32).alias("vec"))
    got = evaluate.recall_at(exact.knn_join(c, queries_of(c), 20, exact=True), exact.knn_join(e, queries_of(e), 10), 10, 20)
    return got.select("k", "n", "hits", F.round("recall", 6).alias("recall"))


_RECALL_AT = f"""WITH t AS ({_knn_sql(_CF, 10, _L2, "{0}")}), c AS ({_knn_sql(f"({_C8})[1:32]", 20, _L2)})
SELECT CAST(10 AS INTEGER) AS k, CAST(20 AS INTEGER) AS n, count(c.id) AS hits, round(count(c.id) / count(*)::DOUBLE, 6) AS recall FROM t LEFT JOIN c USING (qid, id)"""


# ---- edges of the exact 8-neighbour graph on codes --------------------------------------------


def knn_edges(spark, sf_dir, k: int = 8) -> DataFrame:
    """Edges (src, dst, dist) of every vector to its k nearest others, on 8-bit codes."""
    c = codes(spark, sf_dir)
    return exact.knn_join(c, c, k, exact=True, others=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist", F.col("rnk").alias("pos"))


_EDGES = f"""e AS (SELECT qid AS src, id AS dst, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS pos
  FROM ({_knn_sql(_C8, 9, _L2, where="true")}) WHERE qid <> id QUALIFY pos <= 8)"""


def knn_graph(spark, sf_dir):
    """The exact 8-neighbour graph as edges."""
    return knn_edges(spark, sf_dir)


def group_values(spark, sf_dir):
    """Vectors of each label, sorted."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id")
    return exact.grouped(e, "label", "vec_id").select("label", F.array_join(F.transform("vec_ids", lambda x: x.cast("string")), ",").alias("members"))


def reverse_edges(spark, sf_dir):
    """Incoming edges, the 5 nearest a node."""
    return exact.reverse_edges(knn_edges(spark, sf_dir), 5)


def merged_edges(spark, sf_dir):
    """Own and reversed edges, the 8 nearest a node."""
    e = table(knn_edges(spark, sf_dir))
    return exact.merge_edges(e, exact.reverse_edges(e, 140), 8)


def graph_degrees(spark, sf_dir):
    """Degree statistics of the undirected graph of at most 12 edges a node."""
    e = index.undirect(table(knn_edges(spark, sf_dir)), 12)
    g = evaluate.degree_stats(index.adjacency(e))
    return g.select("nodes", "edges", F.round("avg_degree", 6).alias("avg_degree"), "max_degree")


_UNDIRECT = f"""{_EDGES}, u AS (SELECT src, dst, dist FROM e UNION SELECT dst, src, dist FROM e),
g AS (SELECT src, dst, dist, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS pos FROM u QUALIFY pos <= {{0}})"""


def graph_popularity(spark, sf_dir):
    """Incoming edges as visits: counts, log popularity and the pruning factor from it."""
    e = table(knn_edges(spark, sf_dir))
    pop = evaluate.popularity(e.select(F.col("dst").alias("id")), base(spark, sf_dir))
    stats = pop.agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("pop")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return pop.crossJoin(F.broadcast(stats)).select("id", "visits", _r(F.col("pop")).alias("pop"), F.round(1.0 + share * 0.1, 6).alias("alpha"))


_POP = f"""WITH {_EDGES}, v AS (SELECT vec_id AS id, count(dst) AS visits FROM embeddings LEFT JOIN e ON dst = vec_id GROUP BY vec_id),
p AS (SELECT id, visits, ln(1 + visits) AS pop FROM v)
SELECT id, visits, round(pop, 6) AS pop, round(1.0::DOUBLE + (max(pop) OVER () - pop) / (max(pop) OVER () - min(pop) OVER ()) * 0.1::DOUBLE, 6) AS alpha FROM p"""


def graph_reachability(spark, sf_dir):
    """Nodes reachable from vector 0 in the exact 3-neighbour graph."""
    e = knn_edges(spark, sf_dir).where("pos <= 3").select("src", "dst")
    return index.reach(table(e), 0)


_REACH = f"""WITH RECURSIVE {_EDGES}, r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN e ON e.src = r.id AND e.pos <= 3) SELECT id FROM r"""


def graph_prune_violations(spark, sf_dir):
    """Pairs of neighbours that break the pruning rule after pruning exact 20-neighbour lists; none."""
    e = base(spark, sf_dir)
    near = exact.knn_join(e, e, 20, others=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    kept = index.pruned(near, e, 8, 1.2)
    a = kept.select("c", F.posexplode("c").alias("pa", "a")).select("a", F.explode(F.slice("c", F.col("pa") + 2, 8)).alias("b"))
    return a.where(V.l2sq("a.vec", "b.vec") * 1.2 <= F.col("b.dist") * (1 - 1e-9)).agg(F.count("*").alias("violations"))


def _index(method: str, **kw):
    params = BuildParams(**({"R": 16, "L": 32, "VL": 64, "num_split": 4} | kw))

    def query(spark, sf_dir):
        e = base(spark, sf_dir)
        g = table(index.build(e, method, params))
        n = e.count()
        return _rounded(index.search(g, e, queries_of(e), SearchParams(k=10, beam=max(10, n)), hier_beam=params.hier_beam))

    return query


def graph_search_codes_rerank(spark, sf_dir):
    """Search a graph on 4-bit codes with a beam of all rows, rank the first 400 by floats."""
    c, e = codes(spark, sf_dir, 2), base(spark, sf_dir)
    g = table(index.build(c, "flat", BuildParams(R=16, L=32, VL=64, num_split=0, num_passes=1)))
    n = c.count()
    got = index.search_rerank(g, c, e, queries_of(c), queries_of(e), SearchParams(k=10, beam=n, mode="rerank", rerank_factor=40))
    return _rounded(got)


def graph_search_quality(spark, sf_dir):
    """Recall@10 at narrow beams with held-out queries (never inserted): beam, whether recall reaches 0.9."""
    e = base(spark, sf_dir)
    q, b = queries_of(e), e.where(F.col("id") % 100 != 0)
    g = table(index.build(b, "flat", BuildParams(R=24, L=50, VL=100, num_split=0)))
    truth = exact.knn_join(b, q, 10)
    out = None
    for beam in (50, 100):
        r = evaluate.recall(index.search(g, b, q, SearchParams(k=10, beam=beam)), truth, 10).select(F.lit(beam).alias("beam"), (F.col("recall") >= 0.9).alias("useful"))
        out = r if out is None else out.unionByName(r)
    return out


def graph_query_stats(spark, sf_dir):
    """Mean, 99th percentile and deviation of nodes visited with a beam of all rows."""
    e = base(spark, sf_dir)
    g = table(index.build(e, "flat", BuildParams(R=16, L=32, VL=64, num_split=0, num_passes=1)))
    c = index.search(g, e, queries_of(e), SearchParams(k=10, beam=e.count()), visits=True)
    return evaluate.statistics(c, "visited").select("avg", "tail", F.round("std", 6).alias("std"))


def counter_stats(spark, sf_dir):
    """The same statistics of every node's number of incoming edges."""
    e = table(knn_edges(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("n")))
    return evaluate.statistics(e, "n").select("avg", "tail", F.round("std", 6).alias("std"))


_STATS = f"""WITH {_EDGES}, c AS (SELECT count(*) AS n FROM e GROUP BY dst)
SELECT CAST(floor(avg(n)) AS BIGINT) AS avg, list_sort(list(n))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS tail, round(stddev_pop(n), 6) AS std FROM c"""


def popular_nodes(spark, sf_dir):
    """The tenth of nodes of lowest and highest degree in the undirected graph."""
    g = index.adjacency(index.undirect(table(knn_edges(spark, sf_dir)), 64))
    return index.popular_nodes(g, 0.1).select("id", F.col("degree").cast("long").alias("degree"), "side")


_POPULAR = f"""WITH {_UNDIRECT.format(64)}, d AS (SELECT src AS id, count(*) AS degree FROM g GROUP BY src),
n AS (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) AS n FROM d)
SELECT id, degree, 'low' AS side FROM d QUALIFY row_number() OVER (ORDER BY degree, id) <= (SELECT n FROM n)
UNION ALL SELECT id, degree, 'high' AS side FROM d QUALIFY row_number() OVER (ORDER BY degree DESC, id) <= (SELECT n FROM n)"""


def neighbour_descent(spark, sf_dir):
    """Neighbour descent: whether at least 0.9 of the exact 10 neighbours are found."""
    e = base(spark, sf_dir)
    got = descent.descend(e, keep=20, rounds=6, most=24, trees=4, leaf=40)
    truth = exact.knn_join(e, e, 11).where("qid <> id")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    truth = truth.withColumn("rnk", F.row_number().over(w)).where("rnk <= 10")
    r = evaluate.recall_at(got.select(F.col("id").alias("qid"), F.col("nbr").alias("id"), "rnk"), truth, 10, 20)
    return r.select((F.col("recall") >= 0.9).alias("reached"))


def descent_pruned_search(spark, sf_dir):
    """A neighbour-descent graph, one pruning pass from mirror nodes over it, exhaustive search."""
    e = base(spark, sf_dir)
    near = descent.descend(e, keep=16, rounds=4, most=16, trees=3, leaf=32)
    first = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr"))).alias("x"))
    given = first.select("id", F.lit(0).alias("level"), F.col("x.nbr").alias("nbr_ids"), F.col("x.dist").alias("nbr_dists"))
    g = table(index.build(e, "flat", BuildParams(R=16, L=32, VL=64, num_split=0, num_passes=1, rand_sp=True), given=given))
    return _rounded(index.search(g, e, queries_of(e), SearchParams(k=10, beam=e.count())))


def leaf_all_pairs(spark, sf_dir):
    """All pairs inside label groups, the 5 nearest a row."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    leaves = raw.select(F.lit(0).alias("tree"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("leaf"))
    c = codes(spark, sf_dir)
    return cluster.leaf_neighbours(c, leaves, 5).select("id", "nbr", F.col("dist").cast("long").alias("dist"), "rnk")


_LEAF = f"""SELECT id, nbr, dist, CAST(rnk AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rnk FROM (
  SELECT q.id, b.id AS nbr, CAST({_L2} AS BIGINT) AS dist FROM (SELECT vec_id AS id, label, {_C8} AS c FROM embeddings) q
  JOIN (SELECT vec_id AS id, label, {_C8} AS c FROM embeddings) b ON q.label = b.label AND q.id <> b.id)) WHERE rnk <= 5"""


# ---- inverted file ----------------------------------------------------------------------------


def _ivf(spark, sf_dir, r: int = 3, **kw):
    c = codes(spark, sf_dir)
    cent = ivf.random_centroids(c)
    return c, cent, ivf.build(c, cent, r, exact=True, **kw)


_CENT = "substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) < '28f6'"
_POST = f"""b AS (SELECT vec_id AS id, {_C8} AS c FROM embeddings), q AS (SELECT vec_id AS id, {_C8} AS c FROM embeddings WHERE {_CENT}),
p AS (SELECT centroid_id, vec_id, dist, CAST(rnk AS INTEGER) AS rnk FROM (
  SELECT b.id AS vec_id, q.id AS centroid_id, CAST({_L2} AS BIGINT) AS dist, row_number() OVER (PARTITION BY b.id ORDER BY CAST({_L2} AS BIGINT), q.id) AS rnk FROM b, q)
  WHERE rnk <= 3 AND (vec_id NOT IN (SELECT id FROM q) OR vec_id = centroid_id))"""


def ivf_assign(spark, sf_dir):
    """Posting rows: every vector in its 3 nearest lists, centroids in their own."""
    return _ivf(spark, sf_dir)[2]


def ivf_sizes(spark, sf_dir):
    """List sizes."""
    return ivf.sizes(_ivf(spark, sf_dir)[2])


def ivf_lists(spark, sf_dir):
    """Lists as sorted ids."""
    return ivf.lists(_ivf(spark, sf_dir)[2]).select("centroid_id", F.array_join(F.transform("vec_ids", lambda x: x.cast("string")), ",").alias("members"))


def ivf_invert(spark, sf_dir):
    """Inverted lists: the lists of each vector."""
    return ivf.invert(ivf.lists(_ivf(spark, sf_dir)[2])).select("vec_id", F.array_join(F.transform("centroid_ids", lambda x: x.cast("string")), ",").alias("members"))


def ivf_capped(spark, sf_dir):
    """Lists cut to 12 members besides first choices."""
    return _ivf(spark, sf_dir, max_size=12)[2]


def ivf_inlined(spark, sf_dir):
    """Posting rows with the member's vector, checked by its component sum."""
    c, _, p = _ivf(spark, sf_dir)
    return ivf.inline(p, c).select("centroid_id", "vec_id", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def ivf_filter_lists(spark, sf_dir):
    """Lists that hold an id divisible by 100, one row a hit."""
    return ivf.in_lists(_ivf(spark, sf_dir)[2], F.col("vec_id") % 100 == 0)


def ivf_probe_partial(spark, sf_dir):
    """Search the 8 nearest lists."""
    c, cent, p = _ivf(spark, sf_dir)
    return ivf.probe(queries_of(c), cent, ivf.inline(p, c), 10, 8, exact=True)


def ivf_probe_all(spark, sf_dir):
    """Search all lists, which is exact."""
    c, cent, p = _ivf(spark, sf_dir, whole=True)
    return ivf.probe(queries_of(c), cent, ivf.inline(p, c), 10, max(1, cent.count()), exact=True)


def ivf_probe_rerank(spark, sf_dir):
    """Search 16 lists on 8-bit codes for 40 candidates, then the 10 nearest on floats."""
    c, cent, p = _ivf(spark, sf_dir)
    e = base(spark, sf_dir)
    return _rounded(exact.rerank(ivf.probe(queries_of(c), cent, ivf.inline(p, c), 40, 16, exact=True), e, queries_of(e), 10))


def _probe_sql(nprobe: int, k: int) -> str:
    return f"""n AS (SELECT b.id AS qid, q.id AS centroid_id, row_number() OVER (PARTITION BY b.id ORDER BY {_L2}, q.id) AS r FROM b, q WHERE b.id % 100 = 0),
d AS (SELECT DISTINCT qid, vec_id FROM n JOIN p USING (centroid_id) WHERE r <= {nprobe}),
s AS (SELECT qid, vec_id AS id, CAST({_l2('x.c', 'y.c')} AS BIGINT) AS dist FROM d JOIN b x ON x.id = qid JOIN b y ON y.id = vec_id),
t AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rnk, id, dist FROM s QUALIFY rnk <= {k})"""


_PROBE_RERANK = f"""WITH {_POST}, {_probe_sql(16, 40)}, f AS (
  SELECT t.qid, t.id, {_l2("CAST(x.embedding AS DOUBLE[])", "CAST(y.embedding AS DOUBLE[])")} AS d FROM t JOIN embeddings x ON x.vec_id = t.qid JOIN embeddings y ON y.vec_id = t.id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, id) AS INTEGER) AS rnk, id, round(d, 6) AS dist FROM f QUALIFY rnk <= 10"""


# ---- clustering and product codes -------------------------------------------------------------


def kmeans_step(spark, sf_dir):
    """One Lloyd update from the sampled centroids: component sums of the new means."""
    e = base(spark, sf_dir)
    cent = ivf.random_centroids(e, 1 / 16)
    m = cluster.means(e, cluster.assign(e, cent))
    return m.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.element_at("vec", 1), 5).alias("head"))


_CENT16 = "substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) < '1000'"
_ASSIGN = f"""b AS (SELECT vec_id AS id, {_CF} AS c FROM embeddings), q AS (SELECT vec_id AS id, {_CF} AS c FROM embeddings WHERE {_CENT16}),
a AS (SELECT b.id, q.id AS cid, {_L2} AS dist FROM b, q QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY {_L2}, q.id) = 1)"""
_KMEANS = f"""WITH {_ASSIGN}, x AS (SELECT cid, unnest(c) AS v, unnest(range(1, 65)) AS pos FROM a JOIN b USING (id)),
m AS (SELECT cid, pos, sum(v) / (count(*) + 1e-5::DOUBLE) AS v FROM x GROUP BY cid, pos)
SELECT cid AS id, round(sum(v ORDER BY pos), 5) AS total, round(max(CASE WHEN pos = 1 THEN v END), 5) AS head FROM m GROUP BY cid"""


def medoids(spark, sf_dir):
    """The member nearest to each sampled centroid after a shift of all its components."""
    e = base(spark, sf_dir)
    cent = ivf.random_centroids(e, 1 / 16)
    got = cluster.assign(e, cent)
    moved = cent.select("id", F.transform("vec", lambda x: x + 0.01).alias("vec"))
    return cluster.medoids(e, got, moved).select("centroid_id", "medoid_id", _r(F.col("dist")).alias("dist"))


_MEDOIDS = f"""WITH {_ASSIGN}, n AS (SELECT vec_id AS cid, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 0.01::DOUBLE) AS m FROM embeddings WHERE {_CENT16}),
d AS (SELECT a.cid, a.id, {_l2('b.c', 'n.m')} AS d FROM a JOIN b USING (id) JOIN n ON n.cid = a.cid)
SELECT cid AS centroid_id, id AS medoid_id, round(d, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY cid ORDER BY d, id) = 1"""


def farthest_point(spark, sf_dir):
    """The row farthest from its nearest sampled centroid, on codes."""
    c = codes(spark, sf_dir).select("id", F.col("vec").cast("array<float>").alias("vec"))
    return cluster.farthest(c, ivf.random_centroids(c, 1 / 16)).select("id", F.col("dist").cast("long").alias("dist"))


_FARTHEST = f"""WITH b AS (SELECT vec_id AS id, {_C8} AS c FROM embeddings), q AS (SELECT vec_id AS id, {_C8} AS c FROM embeddings WHERE {_CENT16}),
m AS (SELECT b.id, min(CAST({_L2} AS BIGINT)) AS dist FROM b, q GROUP BY b.id) SELECT id, dist FROM m ORDER BY dist DESC, id LIMIT 1"""


def cluster_tree(spark, sf_dir):
    """A tree of leaves of at most 64: rows, leaves, whether every leaf is within bounds."""
    e = base(spark, sf_dir)
    t = cluster.hierarchical(e, k=8, most=64)
    s = t.groupBy("leaf").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("rows"), (F.max("n") <= 64).alias("bounded"))


def pq_codes(spark, sf_dir):
    """Product codes with 8 chunks of 16 words."""
    e = base(spark, sf_dir)
    got = ivf.pq_encode(e, ivf.codebook(e, 8, 16), 8)
    return got.select("id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


_BOOK = """w AS (SELECT embedding AS e, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS code FROM embeddings QUALIFY code < 16),
k AS (SELECT c AS chunk, code, CAST(e[c * 8 + 1:c * 8 + 8] AS DOUBLE[]) AS word FROM w, range(8) t(c))"""
_PQ = f"""{_BOOK}, s AS (SELECT vec_id AS id, c AS chunk, CAST(embedding[c * 8 + 1:c * 8 + 8] AS DOUBLE[]) AS part FROM embeddings, range(8) t(c)),
a AS (SELECT id, s.chunk, code FROM s JOIN k USING (chunk) QUALIFY row_number() OVER (PARTITION BY id, s.chunk ORDER BY {_l2('part', 'word')}, code) = 1),
o AS (SELECT id, list(code ORDER BY chunk) AS codes FROM a GROUP BY id)"""


def pq_adc(spark, sf_dir):
    """Top-10 by asymmetric distances to product codes."""
    e = base(spark, sf_dir)
    book = ivf.codebook(e, 8, 16)
    return _rounded(ivf.pq_search(queries_of(e), ivf.pq_encode(e, book, 8), book, 8, 10))


_ADC = f"""WITH {_PQ}, l AS (SELECT s.id AS qid, s.chunk, code, {_l2('part', 'word')} AS d FROM s JOIN k USING (chunk) WHERE s.id % 100 = 0),
d AS (SELECT l.qid, a.id, sum(l.d ORDER BY l.chunk) AS dist FROM a JOIN l ON l.chunk = a.chunk AND l.code = a.code GROUP BY l.qid, a.id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS INTEGER) AS rnk, id, round(dist, 6) AS dist FROM d QUALIFY rnk <= 10"""


# ---- plans and reports ------------------------------------------------------------------------


def batch_ranges(spark, sf_dir):
    """Insert batches of the base: prefix doubling, then windows of a fiftieth."""
    n = base(spark, sf_dir).count()
    rows = kernel.batch_ranges(n, max(1, min(int(0.02 * n), 1_000_000)))
    return spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(rows)], "batch int, lo long, hi long")


_BATCHES = """WITH RECURSIVE n AS (SELECT count(*) AS n, greatest(1, CAST(floor(0.02 * count(*)) AS BIGINT)) AS m FROM embeddings),
r(batch, lo, hi) AS (SELECT 0, CAST(0 AS BIGINT), least(1, n) FROM n
  UNION ALL SELECT batch + 1, CASE WHEN CAST(2 ** least(batch + 1, 40) AS BIGINT) <= m THEN CAST(2 ** least(batch + 1, 40) AS BIGINT) - 1 ELSE hi END,
    least(n, CASE WHEN CAST(2 ** least(batch + 1, 40) AS BIGINT) <= m THEN CAST(2 ** least(batch + 2, 41) AS BIGINT) - 1 ELSE hi + m END) FROM r, n WHERE hi < n)
SELECT CAST(batch AS INTEGER) AS batch, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM r"""


def search_bucket_report(spark, sf_dir):
    """Best run per recall bucket; the runs are probes of 1 to 64 lists with work as inverse throughput."""
    c, cent, p = _ivf(spark, sf_dir)
    inl = table(ivf.inline(p, c))
    truth = table(exact.knn_join(c, queries_of(c), 10, exact=True))
    runs = None
    for nprobe in (1, 2, 4, 8, 16, 32, 64):
        r = evaluate.recall(ivf.probe(queries_of(c), cent, inl, 10, nprobe, exact=True), truth, 10)
        r = r.select(F.lit(nprobe).alias("beam"), F.col("recall"), (F.lit(1000.0) / nprobe).alias("qps"))
        runs = r if runs is None else runs.unionByName(r)
    got = evaluate.bucket_report(table(runs))
    return got.select("bucket", "level", "beam", F.round("recall", 6).alias("recall"), "qps")


def _report_sql() -> str:
    levels = ", ".join(f"({i}, {lo}::DOUBLE, {evaluate.LEVELS[i + 1] if i + 1 < len(evaluate.LEVELS) else 2.0}::DOUBLE)" for i, lo in enumerate(evaluate.LEVELS))
    return f"""WITH {_POST}, n AS (SELECT b.id AS qid, q.id AS centroid_id, row_number() OVER (PARTITION BY b.id ORDER BY {_L2}, q.id) AS r FROM b, q WHERE b.id % 100 = 0),
d AS (SELECT DISTINCT np, qid, vec_id FROM n JOIN p USING (centroid_id), (VALUES (1), (2), (4), (8), (16), (32), (64)) t(np) WHERE r <= np),
s AS (SELECT np, qid, vec_id AS id, CAST({_l2('x.c', 'y.c')} AS BIGINT) AS dist FROM d JOIN b x ON x.id = qid JOIN b y ON y.id = vec_id),
t AS (SELECT np, qid, id FROM s QUALIFY row_number() OVER (PARTITION BY np, qid ORDER BY dist, id) <= 10),
g AS ({_knn_sql(_C8, 10, _L2)}),
u AS (SELECT np AS beam, count(*) / ((SELECT count(DISTINCT qid) FROM g) * 10.0::DOUBLE) AS recall, 1000.0::DOUBLE / np AS qps FROM t SEMI JOIN g USING (qid, id) GROUP BY np),
k(bucket, lo, hi) AS (VALUES {levels})
SELECT bucket, lo AS level, beam, round(recall, 6) AS recall, qps FROM u JOIN k ON recall >= lo AND recall <= hi
QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY qps DESC, beam) = 1"""


_EXACT_F = _knn_sql(_CF, 10, _L2, "{0}")
_EXACT_FR = f"SELECT qid, rnk, id, round(dist, 6) AS dist FROM ({_EXACT_F})"

#: name -> (query, oracle or None)
QUERIES = {
    "exact_knn_u8": (exact_knn_u8, _knn_sql(_C8, 10, _L2)),
    "exact_knn_u8_sql": (exact_knn_u8_sql, _knn_sql(_C8, 10, _L2)),
    "exact_knn_u4": (exact_knn_u4, _knn_sql(_C4, 10, _L2)),
    "exact_knn_f32": (exact_knn_f32, _EXACT_FR),
    "exact_knn_mips": (exact_knn_mips, f"SELECT qid, rnk, id, round(dist, 6) AS dist FROM ({_knn_sql('list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 7 + 1))', 10, '-' + _IP, '{0}')})"),
    "rerank_u4_f32": (rerank_u4_f32, _RERANK),
    "fetch_by_position": (fetch_by_position, "SELECT (SELECT max(vec_id) FROM embeddings) - vec_id AS pos, vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS head FROM embeddings"),
    "recall_u4": (recall_u4, _RECALL_U4),
    "recall_ties": (recall_ties, _RECALL_TIES),
    "recall_at_u8": (recall_at_u8, _RECALL_AT),
    "knn_graph": (knn_graph, f"WITH {_EDGES} SELECT * FROM e"),
    "group_values": (group_values, "SELECT label, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM embeddings GROUP BY label"),
    "reverse_edges": (reverse_edges, f"WITH {_EDGES} SELECT dst, CAST(row_number() OVER (PARTITION BY dst ORDER BY dist, src) AS INTEGER) AS rnk, src, dist FROM e QUALIFY rnk <= 5"),
    "merged_edges": (merged_edges, f"WITH {_UNDIRECT.format(8)} SELECT * FROM g"),
    "graph_degrees": (graph_degrees, f"WITH {_UNDIRECT.format(12)}, n AS (SELECT count(*) AS n FROM g GROUP BY src) SELECT count(*) AS nodes, CAST(sum(n) AS BIGINT) AS edges, round(avg(n), 6) AS avg_degree, max(n) AS max_degree FROM n"),
    "graph_popularity": (graph_popularity, _POP),
    "graph_reachability": (graph_reachability, _REACH),
    "graph_prune_violations": (graph_prune_violations, "SELECT CAST(0 AS BIGINT) AS violations"),
    "graph_search_exhaustive": (_index("flat", num_split=0, num_passes=1), _EXACT_FR),
    "graph_warmup_exhaustive": (_index("flat", num_split=4, num_passes=2), _EXACT_FR),
    "graph_dynamic_prune_exhaustive": (_index("flat", num_split=4, num_passes=2, dynamic_prune=True, min_alpha=1.05), _EXACT_FR),
    "graph_max_angle_exhaustive": (_index("flat", num_split=0, num_passes=1, max_angle_prune=4, max_cos_angle=0.9), _EXACT_FR),
    "graph_split_merge_exhaustive": (_index("split_merge"), _EXACT_FR),
    "graph_hierarchical_exhaustive": (_index("hierarchical", R=8, hier_beam=1), _EXACT_FR),
    "graph_search_codes_rerank": (graph_search_codes_rerank, _rerank_sql(400)),
    "graph_search_quality": (graph_search_quality, "SELECT CAST(beam AS INTEGER) AS beam, true AS useful FROM (VALUES (50), (100)) t(beam)"),
    "graph_query_stats": (graph_query_stats, "SELECT count(*) AS avg, count(*) AS tail, 0.0::DOUBLE AS std FROM embeddings"),
    "counter_stats": (counter_stats, _STATS),
    "popular_nodes": (popular_nodes, _POPULAR),
    "neighbour_descent": (neighbour_descent, "SELECT true AS reached"),
    "descent_pruned_search": (descent_pruned_search, _EXACT_FR),
    "leaf_all_pairs": (leaf_all_pairs, _LEAF),
    "ivf_assign": (ivf_assign, f"WITH {_POST} SELECT * FROM p"),
    "ivf_sizes": (ivf_sizes, f"WITH {_POST} SELECT centroid_id, count(*) AS size FROM p GROUP BY centroid_id"),
    "ivf_lists": (ivf_lists, f"WITH {_POST} SELECT centroid_id, array_to_string(list(vec_id ORDER BY vec_id), ',') AS members FROM p GROUP BY centroid_id"),
    "ivf_invert": (ivf_invert, f"WITH {_POST} SELECT vec_id, array_to_string(list(centroid_id ORDER BY centroid_id), ',') AS members FROM p GROUP BY vec_id"),
    "ivf_capped": (ivf_capped, f"WITH {_POST} SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY centroid_id ORDER BY dist, vec_id) <= 12 OR rnk = 1"),
    "ivf_inlined": (ivf_inlined, f"WITH {_POST} SELECT centroid_id, vec_id, CAST(list_sum(b.c) AS BIGINT) AS total FROM p JOIN b ON b.id = vec_id"),
    "ivf_filter_lists": (ivf_filter_lists, f"WITH {_POST} SELECT centroid_id, vec_id FROM p WHERE vec_id % 100 = 0"),
    "ivf_probe_partial": (ivf_probe_partial, f"WITH {_POST}, {_probe_sql(8, 10)} SELECT * FROM t"),
    "ivf_probe_all": (ivf_probe_all, _knn_sql(_C8, 10, _L2)),
    "ivf_probe_rerank": (ivf_probe_rerank, _PROBE_RERANK),
    "kmeans_step": (kmeans_step, _KMEANS),
    "medoids": (medoids, _MEDOIDS),
    "farthest_point": (farthest_point, _FARTHEST),
    "cluster_tree": (cluster_tree, "SELECT count(*) AS rows, true AS bounded FROM embeddings"),
    "pq_codes": (pq_codes, f"WITH {_PQ} SELECT id, array_to_string(codes, ',') AS codes FROM o"),
    "pq_adc": (pq_adc, _ADC),
    "batch_ranges": (batch_ranges, _BATCHES),
    "search_bucket_report": (search_bucket_report, _report_sql()),
}


def queries():
    """Name -> callable(spark, sf_dir)."""
    return {**{k: _function(f) for k, (f, _) in FUNCTIONS.items()}, **{k: f for k, (f, _) in QUERIES.items()}}


def oracle_sql():
    """Name -> DuckDB SQL."""
    return {**{k: _PAIR_SQL.format(s) for k, (_, s) in FUNCTIONS.items()}, **{k: s for k, (_, s) in QUERIES.items() if s}}
