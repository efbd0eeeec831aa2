"""Queries of embeddings and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import ann as A
from corpusmill.operators import embedding as E
from corpusmill.operators import index_store as I
from corpusmill.operators import retrieval as R
from corpusmill.plans.bindings import kept, questions, stored_index, table

QUERIES, ORACLES = {}, {}
DIM = 256


def query(name, sql):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


TOKENS = """flatten([flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda t: list_concat([t], list_filter(string_split(t, '_'), lambda p: p <> '' AND p <> t)))),
  list_filter(list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p)), lambda p: length(p) > 1)])"""


def tokens_sql(c: str) -> str:
    return TOKENS.format(c)


@query("e1_code_tokens", f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) SELECT doc_id, len(t) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM t")
def e1(spark, d):
    t = C.code_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


VOCAB = f"vocab AS (SELECT DISTINCT token FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents))"
GRAMS = """grams AS (SELECT token, gram, count(*) AS times FROM (SELECT token, unnest(list_transform(range(1, length(token) + 3 - n + 1), lambda i: substring('^' || token || '$', i, n))) AS gram FROM {0}, (VALUES (3), (4), (5)) v(n) WHERE length(token) >= 3) GROUP BY token, gram)"""


@query("e2_char_ngrams", f"WITH {VOCAB}, {GRAMS.format('vocab')} SELECT token, count(*) AS kinds, sum(times)::BIGINT AS grams, min(gram) AS low, max(gram) AS high FROM grams GROUP BY token")
def e2(spark, d):
    vocabulary = E.tokens(table(spark, d, "documents"), "doc_id", "text").select("token").distinct()
    return E.gram_table(vocabulary).groupBy("token").agg(F.count(F.lit(1)).alias("kinds"), F.sum("times").alias("grams"), F.min("gram").alias("low"), F.max("gram").alias("high"))


FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substring({0}, i, 1))::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("e3_fnv1a_bucket", f"WITH {VOCAB}, f AS (SELECT 'w:' || token AS feature FROM vocab), h AS (SELECT feature, {FNV.format('feature')} AS h FROM f) SELECT feature, h, h % {DIM} AS bucket, CASE WHEN (h & 65536) = 0 THEN 1 ELSE -1 END AS sign FROM h")
def e3(spark, d):
    f = E.tokens(table(spark, d, "documents"), "doc_id", "text").select(F.concat(F.lit("w:"), "token").alias("feature")).distinct()
    return f.withColumn("h", C.fnv1a(F.col("feature"))).select("feature", "h", (F.col("h") % DIM).alias("bucket"), C.hash_sign(F.col("h")).alias("sign"))


def embed_sql(source: str, key: str, text: str, dim: int = DIM) -> str:
    """CTEs that end in sums(key, bucket, value), from the table source."""
    return f"""tok AS (SELECT {key}, {tokens_sql(text)} AS t FROM {source}), w AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest(t) AS token FROM tok) GROUP BY {key}, token),
  pr AS (SELECT {key}, pair, count(*) AS n FROM (SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS pair FROM tok WHERE len(t) > 1) GROUP BY {key}, pair),
  vocab AS (SELECT DISTINCT token FROM w), {GRAMS.format('vocab')}, g AS (SELECT {key}, gram, sum(n * times) AS n FROM w JOIN grams USING (token) GROUP BY {key}, gram),
  feats AS (SELECT {key}, 'w:' || token AS feature, n * 20 AS weight FROM w UNION ALL SELECT {key}, 'b:' || pair, n * 12 FROM pr UNION ALL SELECT {key}, 'c:' || gram, n * 7 FROM g),
  hashed AS (SELECT feature, {FNV.format('feature')} AS h FROM (SELECT DISTINCT feature FROM feats)),
  sums AS (SELECT {key}, h % {dim} AS bucket, sum(weight * CASE WHEN (h & 65536) = 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM feats JOIN hashed USING (feature) GROUP BY {key}, h % {dim} HAVING sum(weight * CASE WHEN (h & 65536) = 0 THEN 1 ELSE -1 END) <> 0)"""


@query("e4_hash_embed", f"WITH {embed_sql('documents', 'doc_id', 'text')} SELECT doc_id, bucket, value FROM sums")
def e4(spark, d):
    return E.bucket_sums(table(spark, d, "documents"), "doc_id", "text", DIM)


@query("e5_l2_normalize", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * (label + 1) / nullif(sqrt(list_sum(list_transform(embedding, lambda y: (y::DOUBLE * (label + 1)) ** 2))), 0), 5)) AS unit FROM embeddings")
def e5(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    unit = F.when(F.exists(scaled, lambda x: x != 0), C.l2_normalize(scaled)).otherwise(F.transform(scaled, lambda x: F.lit(None).cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(unit, lambda x: C.rounded(x, 5)).alias("unit"))


@query("e6_quantize_vector", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round(round(x::DOUBLE * pow(10, 5 - floor(log10(abs(x::DOUBLE))))) / pow(10, 5 - floor(log10(abs(x::DOUBLE)))), 9) END) AS quantized FROM embeddings")
def e6(spark, d):
    digits = F.transform("embedding", lambda x: C.six_digits(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.transform(digits, lambda x: C.rounded(x, 9)).alias("quantized"))


COS = "list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def vectors(spark, d):
    """The questions, every 20th vector, and all vectors."""
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


DENSE = f"dense AS (SELECT query_id, chunk_id, similarity, rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, {COS} AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 12) DESC, c.vec_id) AS INTEGER) AS rank FROM embeddings c, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"


@query("r1_dense_topk", f"WITH {DENSE} SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM dense")
def r1(spark, d):
    q, c = vectors(spark, d)
    return R.dense_topk(q, c, 10).withColumn("similarity", F.round("similarity", 6))


def _expand(q: str) -> str:
    all_terms = f"flatten([flatten(list_transform(list_filter(regexp_extract_all(lower({q}), '[a-z0-9_]+'), lambda t: length(t) >= 2), lambda t: list_concat([t], list_filter(string_split(t, '_'), lambda p: length(p) >= 2)))), list_transform(regexp_extract_all({q}, '[A-Z]?[a-z]{{2,}}|[0-9]{{2,}}'), lambda p: lower(p))])"
    return all_terms


EXPANDED = f"""raw AS (SELECT item_id AS query_id, {_expand('text')} AS ts FROM benchmark), placed AS (SELECT query_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM raw),
  ordered AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS n FROM placed GROUP BY query_id, term), expanded AS (SELECT query_id, term, n FROM ordered WHERE n <= 40)"""


@query("r2_expand_query_terms", f"WITH {EXPANDED} SELECT query_id, term, n - 1 AS pos FROM expanded")
def r2(spark, d):
    return questions(spark, d).select("query_id", F.posexplode(C.query_terms(F.col("question"))).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


STEM = "CASE WHEN regexp_matches({0}, '[^ea]ies$') THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, '[^aeo]es$') THEN regexp_replace({0}, 'es$', 'e') WHEN regexp_matches({0}, '[^us]s$') THEN regexp_replace({0}, 's$', '') ELSE {0} END"


# Common English stop words, letters only.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
LETTERS_ONLY = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
POSTINGS = f"""words AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS raw, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9_]+')))) AS pos FROM documents),
  postings AS (SELECT chunk_id, {STEM.format('raw')} AS term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM words WHERE raw NOT IN {LETTERS_ONLY} GROUP BY chunk_id, {STEM.format('raw')})"""
ASKED = f"{EXPANDED}, asked AS (SELECT DISTINCT query_id, {STEM.format('term')} AS term FROM expanded WHERE term NOT IN {LETTERS_ONLY})"


def doc_chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("repo_id"))


def doc_index(spark, d):
    return stored_index(spark, d, DIM, STOP)


def doc_postings(spark, d):
    return R.postings(doc_chunks(spark, d), "text", list(STOP))


@query("r3_build_postings", f"WITH {POSTINGS} SELECT chunk_id, term, tf, array_to_string(positions, ',') AS positions FROM postings")
def r3(spark, d):
    return doc_postings(spark, d).withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


@query("r4_normalize_vocab", f"WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS raw FROM documents) SELECT raw, {STEM.format('raw')} AS term FROM v")
def r4(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]+"), F.lit(0))).alias("raw")).distinct()
    return words.withColumn("term", C.stem(F.col("raw")))


LEX = f"{POSTINGS}, {ASKED}, lexical AS (SELECT query_id, chunk_id, sum(tf) / 10.0::DOUBLE AS score FROM postings JOIN asked USING (term) GROUP BY query_id, chunk_id)"
LEX_TOP = "lextop AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM lexical) WHERE rank <= 40)"


def doc_terms(spark, d):
    return R.question_terms(questions(spark, d), list(STOP))


@query("r5_lexical_match_rank", f"WITH {LEX} SELECT query_id, chunk_id, round(score, 6) AS score FROM lexical")
def r5(spark, d):
    return I.scores(doc_terms(spark, d), doc_index(spark, d)).withColumn("score", F.round("score", 6))


@query("r6_lexical_topk", f"WITH {LEX}, {LEX_TOP} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lextop")
def r6(spark, d):
    return doc_lexical(spark, d).withColumn("score", F.round("score", 6))


@query("r7_bm25_rank", f"""WITH {POSTINGS}, {ASKED}, dl AS (SELECT chunk_id, sum(tf) AS dl FROM postings GROUP BY chunk_id), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  s AS (SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM postings JOIN asked USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id)
  SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 40""")
def r7(spark, d):
    return I.topk(doc_terms(spark, d), doc_index(spark, d), R.PER_ARM, bm25=True).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# The dense arm of the hybrid: hashed embeddings of questions and documents, with exact integer dot products.
EMBEDDED = embed_sql("(SELECT doc_id AS k, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)", "k", "text")
DOC_DENSE = f"""{EMBEDDED}, norm AS (SELECT k, sqrt(sum(value::DOUBLE * value)) AS norm FROM sums GROUP BY k), dots AS (SELECT -1 - q.k AS query_id, c.k AS chunk_id, q.k AS qk, sum(q.value * c.value) AS dot FROM sums q JOIN sums c USING (bucket) WHERE q.k < 0 AND c.k >= 0 GROUP BY q.k, c.k),
  sims AS (SELECT query_id, chunk_id, round(dot / (a.norm * b.norm), 9) AS similarity FROM dots JOIN norm a ON a.k = qk JOIN norm b ON b.k = chunk_id),
  densetop AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank FROM sims) WHERE rank <= 40)"""
FUSED = "fused AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, d.rank AS dense_rank, l.rank AS lex_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS rrf FROM densetop d FULL OUTER JOIN lextop l ON d.query_id = l.query_id AND d.chunk_id = l.chunk_id)"
HYBRID = f"{DOC_DENSE}, {LEX}, {LEX_TOP}, {FUSED}, hybrid AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS INTEGER) AS rank FROM fused) WHERE rank <= 12)"


def doc_dense(spark, d, k=R.PER_ARM):
    """The dense arm: whole-number vectors, so that products are exact, in blocks of questions."""
    q = E.bucket_vectors(questions(spark, d), "query_id", "question", DIM)
    return R.top(R.nearest(q, doc_index(spark, d).vectors, k, overlapping=True, places=9), "similarity", k)


def doc_lexical(spark, d):
    return I.topk(doc_terms(spark, d), doc_index(spark, d), R.PER_ARM)


def doc_hybrid(spark, d, keep=R.KEEP):
    return R.hybrid(doc_dense(spark, d), doc_lexical(spark, d), doc_chunks(spark, d), keep)


@query("r8_rrf_fuse", f"WITH {DOC_DENSE}, {LEX}, {LEX_TOP}, {FUSED} SELECT query_id, chunk_id, dense_rank, lex_rank, round(rrf, 9) AS rrf FROM fused")
def r8(spark, d):
    return R.rrf_fuse(doc_dense(spark, d), doc_lexical(spark, d)).withColumn("rrf", F.round("rrf", 9))


@query("r9_hybrid_retrieve", f"WITH {HYBRID} SELECT query_id, chunk_id, rank, dense_rank, lex_rank, round(rrf, 9) AS rrf, source || '/' || lang || '/' || doc_id AS path FROM hybrid JOIN documents ON doc_id = chunk_id")
def r9(spark, d):
    return doc_hybrid(spark, d).select("query_id", "chunk_id", "rank", "dense_rank", "lex_rank", F.round("rrf", 9).alias("rrf"), "path")


SCOPED = "scoped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lexical JOIN documents ON doc_id = chunk_id WHERE lower(source || '/' || lang || '/' || doc_id) LIKE '%/en/%')"


@query("r10_path_scope", f"WITH {LEX}, {SCOPED} SELECT query_id, chunk_id, rank FROM scoped WHERE rank <= 40")
def r10(spark, d):
    scoped = R.path_scope(doc_chunks(spark, d), "/EN/")
    terms = doc_terms(spark, d)
    run = I.topk(terms, doc_index(spark, d), R.PER_ARM, within=scoped)
    return run.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("r11_rerank_fusion_order", f"WITH {HYBRID} SELECT query_id, chunk_id, rank, round(rrf, 9) AS score FROM hybrid WHERE rank <= 8")
def r11(spark, d):
    return R.rerank_fusion_order(doc_hybrid(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


@query("r12_rerank_blend", f"""WITH {HYBRID}, rel AS (SELECT query_id, chunk_id, (chunk_id % 7) / 7.0::DOUBLE AS relevance FROM hybrid WHERE chunk_id % 3 <> 0),
  b AS (SELECT h.query_id, h.chunk_id, round(0.8 * coalesce(relevance, 0) + 0.2 * rrf / greatest(max(rrf) OVER (PARTITION BY h.query_id), 1e-9), 9) AS score FROM hybrid h LEFT JOIN rel r ON h.query_id = r.query_id AND h.chunk_id = r.chunk_id)
  SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b) WHERE rank <= 8""")
def r12(spark, d):
    run = doc_hybrid(spark, d)
    relevance = run.where("chunk_id % 3 <> 0").select("query_id", "chunk_id", (F.col("chunk_id") % 7 / F.lit(7.0)).alias("relevance"))
    return R.rerank_blend(run, relevance).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


WIDE = HYBRID.replace("WHERE rank <= 12)", "WHERE rank <= 18)")


@query("r13_search_code", f"WITH {WIDE} SELECT query_id, chunk_id, rank, round(rrf, 4) AS score, CASE WHEN length(text) > 1200 THEN left(text, 1200) || chr(10) || '…' ELSE text END AS snippet FROM hybrid JOIN documents ON doc_id = chunk_id WHERE rank <= 6")
def r13(spark, d):
    found = R.search_code(doc_dense(spark, d), doc_lexical(spark, d), doc_chunks(spark, d).withColumnRenamed("text", "content"), 6)
    return found.select("query_id", "chunk_id", "rank", "score", "snippet")


RAW_ASKED = f"asked AS (SELECT DISTINCT query_id, {STEM.format('raw')} AS term FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) > 2)) AS raw FROM benchmark) WHERE raw NOT IN {LETTERS_ONLY})"


@query("r14_single_arms", f"""WITH {DOC_DENSE}, {POSTINGS}, {RAW_ASKED}, lexical AS (SELECT query_id, chunk_id, sum(tf) AS score FROM postings JOIN asked USING (term) GROUP BY query_id, chunk_id), l AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM lexical)
  SELECT 'dense' AS config, query_id, chunk_id, rank FROM densetop WHERE rank <= 10 UNION ALL SELECT 'lexical', query_id, chunk_id, rank FROM l WHERE rank <= 10""")
def r14(spark, d):
    one = doc_dense(spark, d, 10).select(F.lit("dense").alias("config"), "query_id", "chunk_id", "rank")
    terms = R.raw_terms(questions(spark, d), list(STOP))
    two = I.topk(terms, doc_index(spark, d), 10)
    return one.unionByName(two.select(F.lit("lexical").alias("config"), "query_id", "chunk_id", "rank"))


@query("r15_ivf_topk", None)
def r15(spark, d):
    q, c = vectors(spark, d)
    index = kept(spark, d, "embeddings", ("ivf", 10), lambda at: A.build_ivf(c, at, 10))
    return A.ivf_topk(q, index, 10).withColumn("similarity", F.round("similarity", 6))


@query("r16_lsh_topk", None)
def r16(spark, d):
    q, c = vectors(spark, d)
    index = kept(spark, d, "embeddings", ("lsh", 10), lambda at: A.build_lsh(c, at, 10))
    return A.lsh_topk(q, index, 10).withColumn("similarity", F.round("similarity", 6))
