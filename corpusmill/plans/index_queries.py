"""Queries of index maintenance, catalog, cache, telemetry, evaluation and rate limiting."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import answering as A
from corpusmill.operators import cache as K
from corpusmill.operators import catalog as Q
from corpusmill.operators import chunk_store as P
from corpusmill.operators import evaluation as V
from corpusmill.operators import indexing as S
from corpusmill.operators import observability as O
from corpusmill.operators import ratelimit as W
from corpusmill.operators import retrieval as R
from corpusmill.operators import text as X
from corpusmill.plans.bindings import QUERY_LOG, query_log, questions, table, work_dir, written
from corpusmill.plans.corpus_queries import TO_CHUNKS, chunks
from corpusmill.plans.search_queries import DIM, HYBRID, WIDE, doc_chunks, doc_dense, doc_lexical
from corpusmill.plans.text_queries import CLEAN, GUARDED, REASON, guarded, summary_sql

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


# Two states of an index: chunks whose hash starts with some digits are edited, gone or only there now.
STORED = "stored AS (SELECT repo_id, path, start_line, CASE WHEN left(content_hash, 1) IN ('0', '1') THEN 'old' || substring(content_hash, 4) ELSE content_hash END AS content_hash FROM chunks WHERE left(content_hash, 1) NOT IN ('2', '3'))"
INCOMING = "incoming AS (SELECT repo_id, path, start_line, content_hash FROM chunks WHERE left(content_hash, 1) NOT IN ('4', '5') AND repo_id <> 'src1')"


def states(spark, d, content=False):
    c = chunks(spark, d).select("repo_id", "path", F.col("start_line").cast("long").alias("start_line"), "content_hash", *(["content"] if content else []))
    c = (P.staged if content else written)(c, f"{work_dir(spark, 'chunks')}/all")  # cut once, read for both states
    digit = F.substring("content_hash", 1, 1)
    stored = c.where(~digit.isin("2", "3")).withColumn("content_hash", F.when(digit.isin("0", "1"), F.concat(F.lit("old"), F.substring("content_hash", 4, 100))).otherwise(F.col("content_hash")))
    return stored, c.where(~digit.isin("4", "5") & (F.col("repo_id") != "src1"))


REPOS = """repos AS (SELECT s_suppkey || '' AS id, 'acme' AS owner, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'm1' ELSE 'm2' END AS embed_model, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS indexed_at, s_nationkey AS created_at, 'ready' AS status FROM supplier)"""


def repos(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("string").alias("id"), F.lit("acme").alias("owner"), F.col("s_name").alias("name"), F.when(k % 3 == 1, "m1").when(k % 3 == 2, "m2").alias("embed_model"), F.when(k % 5 > 0, F.col("s_acctbal")).alias("indexed_at"), F.col("s_nationkey").alias("created_at"), F.lit("ready").alias("status"))


@query("s6_insert_chunks", f"""{TO_CHUNKS}, {STORED}, {INCOMING}, twice AS (SELECT *, 1 AS pass FROM incoming UNION ALL SELECT repo_id, path, start_line + 1, content_hash, 2 FROM incoming)
  SELECT repo_id, path, start_line, content_hash, pass FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, content_hash ORDER BY pass, path, start_line) AS n FROM twice) t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.repo_id = t.repo_id AND s.content_hash = t.content_hash)""")
def s6(spark, d):
    stored, incoming = states(spark, d)
    twice = incoming.withColumn("pass", F.lit(1)).unionByName(incoming.withColumn("start_line", F.col("start_line") + 1).withColumn("pass", F.lit(2)))
    store = P.ChunkStore(spark, f"{work_dir(spark, 'store')}/chunks", twice.schema)
    store.append(stored.withColumn("pass", F.lit(0)))
    store.insert(twice, ["pass", "path", "start_line"])
    return store.read().where("pass > 0")


@query("s7_upsert_repos", f"WITH {REPOS}, n AS (SELECT c_custkey || '' AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'error' END AS status FROM customer WHERE c_custkey % 7 = 0) SELECT coalesce(n.id, r.id) AS id, owner, coalesce(n.name, r.name) AS name, embed_model, indexed_at, created_at, coalesce(n.status, r.status) AS status FROM repos r FULL OUTER JOIN n ON r.id = n.id")
def s7(spark, d):
    new = table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "error").alias("status"))
    held = repos(spark, d)
    store = P.RepoStore(spark, f"{work_dir(spark, 'store')}/repos", held.schema)
    store.append(held)
    store.upsert(new)
    return store.read()


DIFF = """diff AS (SELECT coalesce(s.repo_id, n.repo_id) AS repo_id, coalesce(s.content_hash, n.content_hash) AS content_hash, CASE WHEN s.content_hash IS NULL THEN 'new' WHEN n.content_hash IS NULL THEN 'pruned' ELSE 'reused' END AS action
  FROM (SELECT DISTINCT repo_id, content_hash FROM stored) s FULL OUTER JOIN (SELECT DISTINCT repo_id, content_hash FROM incoming) n ON s.repo_id = n.repo_id AND s.content_hash = n.content_hash),
  actions AS (SELECT * FROM diff WHERE action <> 'pruned' OR repo_id IN (SELECT repo_id FROM incoming))"""
TO_DIFF = f"{TO_CHUNKS}, {STORED}, {INCOMING}, {DIFF}"


@query("s8_reindex_diff", f"{TO_DIFF} SELECT repo_id, content_hash, action FROM actions")
def s8(spark, d):
    return S.reindex_diff(*states(spark, d))


MODELS = "models AS (SELECT DISTINCT repo_id AS id, CASE WHEN length(repo_id) % 2 = 0 THEN 'old-model' WHEN length(repo_id) % 3 = 0 THEN 'model' END AS embed_model FROM chunks)"


@query("s9_model_change_invalidation", f"{TO_DIFF}, {MODELS} SELECT repo_id, content_hash, CASE WHEN action = 'reused' AND embed_model IS NOT NULL AND embed_model <> 'model' THEN 'replaced' ELSE action END AS action FROM actions LEFT JOIN models ON id = repo_id")
def s9(spark, d):
    stored, incoming = states(spark, d)
    n = F.length("repo_id")
    models = stored.unionByName(incoming).select("repo_id").distinct().select(F.col("repo_id").alias("id"), F.when(n % 2 == 0, "old-model").when(n % 3 == 0, "model").alias("embed_model"))
    return S.with_model_change(S.reindex_diff(stored, incoming), models, "model")


PASS = """fresh AS (SELECT i.* FROM incoming i WHERE EXISTS (SELECT 1 FROM actions a WHERE a.action = 'new' AND a.repo_id = i.repo_id AND a.content_hash = i.content_hash)), nth AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_line, content_hash) AS n FROM fresh)"""


@query("s10_budgeted_pass", f"{TO_DIFF}, {PASS}, r AS (SELECT repo_id, greatest(max(n) - 25, 0) AS remaining FROM nth GROUP BY repo_id) SELECT i.repo_id, coalesce(remaining, 0) AS remaining, CASE WHEN remaining > 0 THEN 'indexing' ELSE 'ready' END AS status, (SELECT count(*) FROM nth WHERE nth.repo_id = i.repo_id AND n <= 25) AS embedded FROM (SELECT DISTINCT repo_id FROM incoming) i LEFT JOIN r ON r.repo_id = i.repo_id")
def s10(spark, d):
    """One pass that embeds and appends what is new; what it says of each repository."""
    store, incoming, at = passes(spark, d)
    return P.index_pass(store, incoming, "model", 25, DIM, f"{at}/1").select("repo_id", "remaining", "status", "embedded")


def passes(spark, d):
    """A store with the stored chunks, the incoming ones, and a folder for what the passes tell."""
    stored, incoming = states(spark, d, content=True)
    at = work_dir(spark, "passes")
    store = P.ChunkStore(spark, f"{at}/chunks")
    store.append(stored.withColumn("embed_model", F.lit("model")).withColumn("embedding", F.lit(None).cast("array<float>")), together=True)
    return store, incoming, at


@query("s15_resumed_passes", f"""{TO_DIFF}, fresh AS (SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.repo_id = i.repo_id AND s.content_hash = i.content_hash)),
  firsts AS (SELECT repo_id, path, start_line, content_hash, 'new' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, content_hash ORDER BY path, start_line) AS n FROM fresh) WHERE n = 1)
  SELECT * FROM firsts UNION ALL SELECT repo_id, path, start_line, content_hash, 'stored' FROM stored s WHERE repo_id NOT IN (SELECT repo_id FROM incoming) OR EXISTS (SELECT 1 FROM incoming i WHERE i.repo_id = s.repo_id AND i.content_hash = s.content_hash)""")
def s15(spark, d):
    """The store after passes that stop at their budget and go on by hash until every repository is ready."""
    store, incoming, at = passes(spark, d)
    P.index_all(store, incoming, "model", 400, DIM, f"{at}/told")
    return store.read().select("repo_id", "path", "start_line", "content_hash", F.when(F.col("embedding").isNull(), "stored").otherwise("new").alias("origin"))


@query("s11_delete_repo", f"{TO_CHUNKS} SELECT repo_id, path, start_line, content_hash FROM chunks WHERE repo_id NOT IN ('src2', 'pages')")
def s11(spark, d):
    rows = chunks(spark, d).select("repo_id", "path", F.col("start_line").cast("long").alias("start_line"), "content_hash")
    store = P.ChunkStore(spark, f"{work_dir(spark, 'store')}/chunks", rows.schema)
    store.append(rows)
    store.delete(spark.createDataFrame([("src2",), ("pages",)], "repo_id string"))
    return store.read()


@query("s12_append_query_log", "SELECT conv_id, turn, left(text, 500) AS question FROM conversations WHERE role = 'user'")
def s12(spark, d):
    return O.append_rows(table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")))


@query("s14_repo_status_counts", f"{TO_CHUNKS} SELECT repo_id, count(DISTINCT path) AS file_count, count(*) AS chunk_count FROM chunks GROUP BY repo_id")
def s14(spark, d):
    return S.repo_counts(chunks(spark, d))


LINES_BACK = """each AS (SELECT repo_id, path, start_line, unnest(range(len(string_split(content, chr(10))))) + start_line AS ln, unnest(string_split(content, chr(10))) AS line FROM chunks), one AS (SELECT repo_id, path, ln, arg_max(line, start_line) AS line FROM each GROUP BY repo_id, path, ln)"""


@query("q1_read_file", f"{TO_CHUNKS}, {LINES_BACK} SELECT repo_id, path, sha256(string_agg(line, chr(10) ORDER BY ln)) AS content FROM one GROUP BY repo_id, path")
def q1(spark, d):
    return Q.read_files(chunks(spark, d)).select("repo_id", "path", F.sha2("content", 256).alias("content"))


@query("q2_list_symbols", f"{TO_CHUNKS} SELECT repo_id, symbol, symbol_kind, path, start_line, nth FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY symbol, path, start_line) AS nth FROM chunks WHERE lower(symbol) LIKE '%part_1%') WHERE nth <= 50")
def q2(spark, d):
    return Q.list_symbols(chunks(spark, d), "part_1").select("repo_id", "symbol", "symbol_kind", "path", F.col("start_line").cast("long").alias("start_line"), F.col("nth").cast("long").alias("nth"))


@query("q3_language_distribution", f"{TO_CHUNKS}, e AS (SELECT repo_id, lang, count(*) AS n FROM chunks GROUP BY repo_id, lang) SELECT repo_id, lang, n, round(n / (max(n) OVER (PARTITION BY repo_id))::DOUBLE, 6) AS share FROM e")
def q3(spark, d):
    return Q.language_distribution(chunks(spark, d)).withColumn("share", F.round("share", 6))


@query("q4_top_files", f"{TO_CHUNKS}, e AS (SELECT repo_id, path, count(*) AS n FROM chunks GROUP BY repo_id, path) SELECT repo_id, path, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, path) AS nth FROM e) WHERE nth <= 10")
def q4(spark, d):
    return Q.top_files(chunks(spark, d)).select("repo_id", "path", "n")


@query("q5_repo_totals", f"{TO_CHUNKS} SELECT repo_id, count(DISTINCT path) AS files, count(*) AS chunks, count(DISTINCT content_hash) AS hashes FROM chunks GROUP BY repo_id")
def q5(spark, d):
    return chunks(spark, d).groupBy("repo_id").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.countDistinct("content_hash").alias("hashes"))


@query("q6_list_repos", f"WITH {REPOS} SELECT id, name, indexed_at, created_at FROM repos ORDER BY indexed_at DESC NULLS LAST, created_at DESC, id")
def q6(spark, d):
    return Q.list_repos(repos(spark, d)).select("id", "name", "indexed_at", "created_at")


@query("q7_stale_indexes", f"WITH {REPOS} SELECT id, embed_model FROM repos WHERE embed_model IS NOT NULL AND embed_model <> 'm1'")
def q7(spark, d):
    return Q.stale_indexes(repos(spark, d), "m1").select("id", "embed_model")


CACHE = """cached AS (SELECT vec_id AS id, label AS repo_id, CASE WHEN vec_id % 4 = 0 THEN 'a' ELSE 'b' END AS embed_model, 'q' || (vec_id % 9) AS question, 0 AS hits, embedding FROM embeddings WHERE vec_id % 2 = 0),
  asked AS (SELECT vec_id AS question_id, label AS repo_id, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS embed_model, embedding FROM embeddings WHERE vec_id % 2 = 1),
  near AS (SELECT question_id, id AS cached_id, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity FROM asked a JOIN cached c ON a.repo_id = c.repo_id AND a.embed_model = c.embed_model),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, cached_id) AS n FROM near) WHERE n = 1 AND similarity >= 0.3)"""


def cache_tables(spark, d):
    e, v = table(spark, d, "embeddings"), F.col("vec_id")
    cached = e.where(v % 2 == 0).select(v.alias("id"), F.col("label").alias("repo_id"), F.when(v % 4 == 0, "a").otherwise("b").alias("embed_model"), F.concat(F.lit("q"), (v % 9).cast("string")).alias("question"), F.lit(0).alias("hits"), "embedding")
    asked = e.where(v % 2 == 1).select(v.alias("question_id"), F.col("label").alias("repo_id"), F.when(v % 3 == 0, "a").otherwise("b").alias("embed_model"), "embedding")
    return cached, K.lookup(asked, cached, 0.3)


@query("k1_cache_lookup", f"WITH {CACHE} SELECT a.question_id, cached_id, round(similarity, 6) AS similarity, cached_id IS NOT NULL AS hit FROM asked a LEFT JOIN best b ON a.question_id = b.question_id")
def k1(spark, d):
    return cache_tables(spark, d)[1].select("question_id", "cached_id", F.round("similarity", 6).alias("similarity"), "hit")


@query("k2_cache_hit_update", f"WITH {CACHE}, n AS (SELECT repo_id, question, count(*) AS more FROM best JOIN cached ON cached_id = id GROUP BY repo_id, question) SELECT id, c.repo_id, c.question, hits + coalesce(more, 0) AS hits FROM cached c LEFT JOIN n ON c.repo_id = n.repo_id AND c.question = n.question")
def k2(spark, d):
    cached, found = cache_tables(spark, d)
    return K.count_hits(cached, found).select("id", "repo_id", "question", "hits")


@query("k3_cache_admission", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(trim(CASE WHEN conv_id % 9 = 0 THEN '  ' ELSE text END)) > 0 AND NOT turn > 2 AND NOT conv_id % 5 = 0")
def k3(spark, d):
    answers = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, "  ").otherwise(F.col("text")).alias("answer"), (F.col("turn") > 2).alias("has_history"), (F.col("conv_id") % 5 == 0).alias("degraded"))
    return K.admitted(answers).select("conv_id", "turn")


@query("o1_obs_totals", f"WITH {QUERY_LOG} SELECT count(*) AS queries, count_if(cache_hit) AS cache_hits, round(count_if(cache_hit) / count(*)::DOUBLE, 6) AS hit_rate, round(avg(latency_ms)) AS avg_latency_ms, round(sum(cost_usd), 6) AS cost_usd, count_if(injection) AS injections FROM query_log")
def o1(spark, d):
    return O.totals(query_log(spark, d)).withColumn("hit_rate", F.round("hit_rate", 6)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("o2_latency_p95", f"WITH {QUERY_LOG} SELECT round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM query_log")
def o2(spark, d):
    return O.latency_p95(query_log(spark, d)).withColumn("p95_latency_ms", F.round("p95_latency_ms", 6))


@query("o3_cost_saved", f"WITH {QUERY_LOG} SELECT round(coalesce(avg(CASE WHEN NOT cache_hit AND cost_usd > 0 THEN cost_usd END) * count_if(cache_hit), 0), 4) AS cost_saved_usd FROM query_log")
def o3(spark, d):
    return O.cost_saved(query_log(spark, d)).withColumn("cost_saved_usd", F.round("cost_saved_usd", 4))


@query("o4_recent_queries", f"WITH {QUERY_LOG} SELECT id, question, latency_ms FROM query_log ORDER BY created_at DESC, id DESC LIMIT 12")
def o4(spark, d):
    return O.recent(query_log(spark, d)).select("id", "question", "latency_ms")


@query("o5_weekly_sketches", """SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS queries, true AS latency_holds, true AS users_hold FROM events GROUP BY 1""")
def o5(spark, d):
    """Sketches of days merged into weeks, against the exact rows: the 95th percentile within 0.02 of its rank, the users within a tenth."""
    e = table(spark, d, "events").withColumnRenamed("ts", "created_at").withColumn("latency_ms", F.round(F.col("value") * 100).cast("long"))
    daily = written(O.sketches(e), f"{work_dir(spark, 'sketches')}/days")
    told = O.merged(daily).withColumnRenamed("users", "told_users")
    exact = e.join(told, F.date_trunc("week", "created_at") == F.col("start")).groupBy("start", "queries", "told_users").agg(F.avg((F.col("latency_ms") <= F.col("latency")).cast("double")).alias("upto"), F.avg((F.col("latency_ms") < F.col("latency")).cast("double")).alias("below"), F.count_distinct("user_id").alias("users"))
    return exact.select(F.col("start").cast("timestamp_ntz").alias("week"), "queries", ((F.col("upto") >= 0.93) & (F.col("below") <= 0.97)).alias("latency_holds"), (F.abs(F.col("told_users") - F.col("users")) <= 0.1 * F.col("users")).alias("users_hold"))


# Runs of three configurations over the benchmark; what is relevant is told from the ids, so these queries show the measures, not how good retrieval is.
RUNS = """runs AS (SELECT 'hybrid' AS config, query_id AS case_id, chunk_id % 400 AS path, rank FROM hybrid UNION ALL SELECT 'dense', query_id, chunk_id % 400, rank FROM densetop WHERE rank <= 10 UNION ALL SELECT 'lexical', query_id, chunk_id % 400, rank FROM lextop WHERE rank <= 10),
  cases AS (SELECT item_id AS case_id FROM benchmark), qrels AS (SELECT DISTINCT query_id AS case_id, chunk_id % 400 AS path FROM fused WHERE (query_id + chunk_id) % 4 = 0 AND query_id % 10 <> 0),
  clean AS (SELECT config, case_id, path, row_number() OVER (PARTITION BY config, case_id ORDER BY min(rank)) AS rank FROM runs GROUP BY config, case_id, path)"""
MEASURES = """rows_ AS (SELECT c.*, CASE WHEN q.path IS NULL THEN 0 ELSE 1 END AS rel FROM clean c LEFT JOIN qrels q ON c.case_id = q.case_id AND c.path = q.path),
  found AS (SELECT config, case_id, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS f5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS f10, count_if(rank <= 5) AS n5, min(CASE WHEN rel = 1 THEN rank END) AS best, sum(CASE WHEN rel = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, arg_min(path, rank) AS top_path FROM rows_ GROUP BY config, case_id),
  tot AS (SELECT case_id, count(*) AS total FROM qrels GROUP BY case_id),
  grid AS (SELECT g.config, c.case_id, coalesce(total, 0) AS total, coalesce(f5, 0) AS f5, coalesce(f10, 0) AS f10, coalesce(n5, 0) AS n5, best, coalesce(dcg, 0) AS dcg, top_path FROM (SELECT DISTINCT config FROM runs) g CROSS JOIN cases c LEFT JOIN tot t ON t.case_id = c.case_id LEFT JOIN found f ON f.config = g.config AND f.case_id = c.case_id),
  measures AS (SELECT config, case_id, CASE WHEN total > 0 THEN least(1.0, f5 / total::DOUBLE) ELSE 0.0 END AS recall_5, CASE WHEN total > 0 THEN least(1.0, f10 / total::DOUBLE) ELSE 0.0 END AS recall_10, CASE WHEN f5 > 0 THEN 1.0 ELSE 0.0 END AS hit_5, CASE WHEN n5 > 0 THEN f5 / n5::DOUBLE ELSE 0.0 END AS precision_5,
    coalesce(1 / best::DOUBLE, 0) AS rr, CASE WHEN total > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= total) ELSE 0.0 END AS ndcg_10, top_path FROM grid),
  averages AS (SELECT config, avg(recall_5) AS recall_5, avg(recall_10) AS recall_10, avg(hit_5) AS hit_5, avg(precision_5) AS precision_5, avg(ndcg_10) AS ndcg_10, avg(rr) AS mrr FROM measures GROUP BY config)"""
TO_RUNS = f"WITH {HYBRID}, {RUNS}"
TO_MEASURES = f"{TO_RUNS}, {MEASURES}"


def eval_tables(spark, d):
    """Runs by path, relevant paths and cases. Every arm runs once and is written, as what follows reads it several times."""
    at = work_dir(spark, "arms")
    dense, lexical = (written(df, f"{at}/{name}") for df, name in ((doc_dense(spark, d), "dense"), (doc_lexical(spark, d), "lexical")))
    fused = written(R.rrf_fuse(dense, lexical), f"{at}/fused")
    as_run = lambda df, name, k: df.where(F.col("rank") <= k).select(F.lit(name).alias("config"), F.col("query_id").alias("case_id"), (F.col("chunk_id") % 400).alias("path"), "rank")
    runs = as_run(R.top(fused, "rrf", 12), "hybrid", 12).unionByName(as_run(dense, "dense", 10)).unionByName(as_run(lexical, "lexical", 10))
    qrels = fused.where("(query_id + chunk_id) % 4 = 0 AND query_id % 10 <> 0").select(F.col("query_id").alias("case_id"), (F.col("chunk_id") % 400).alias("path")).distinct()
    cases = questions(spark, d).select(F.col("query_id").alias("case_id"))
    return V.dedupe_by_path(runs), qrels, cases


def measures(spark, d):
    run, qrels, cases = eval_tables(spark, d)
    return V.case_measures(run, qrels, cases)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("v1_dedupe_by_path", f"{TO_RUNS} SELECT config, case_id, path, rank FROM clean")
def v1(spark, d):
    return eval_tables(spark, d)[0].withColumn("rank", F.col("rank").cast("long"))


for _name, _cols in (("v2_recall", ["recall_5", "recall_10"]), ("v3_hit", ["hit_5"]), ("v4_precision", ["precision_5"]), ("v5_reciprocal_rank", ["rr"]), ("v6_ndcg", ["ndcg_10"])):

    @query(_name, f"{TO_MEASURES} SELECT config, case_id, {', '.join(f'round({c}, 6) AS {c}' for c in _cols)} FROM measures")
    def _measure(spark, d, cols=tuple(_cols)):
        return rounded(measures(spark, d).select("config", "case_id", *cols))


AVERAGES = ", ".join(f"round({c}, 6) AS {c}" for c in ("recall_5", "recall_10", "hit_5", "precision_5", "ndcg_10", "mrr"))


@query("v7_macro_average", f"{TO_MEASURES} SELECT config, {AVERAGES} FROM averages")
def v7(spark, d):
    return rounded(V.macro_average(measures(spark, d)))


@query("v8_per_case_report", f"{TO_MEASURES} SELECT config, case_id, hit_5, round(rr, 6) AS rr, top_path FROM measures")
def v8(spark, d):
    return rounded(measures(spark, d).select("config", "case_id", "hit_5", "rr", "top_path"))


@query("v9_ablation_compare", f"{TO_MEASURES} SELECT (SELECT config FROM averages ORDER BY mrr DESC, config DESC LIMIT 1) AS best, (SELECT mrr FROM averages WHERE config = 'hybrid') >= (SELECT max(mrr) FROM averages WHERE config <> 'hybrid') AS hybrid_holds")
def v9(spark, d):
    return V.ablation(V.macro_average(measures(spark, d)))


@query("v10_quality_gate", f"{TO_MEASURES}, gated AS (SELECT config, concat_ws(',', CASE WHEN recall_5 < 0.75 THEN 'recall_5' END, CASE WHEN mrr < 0.60 THEN 'mrr' END, CASE WHEN ndcg_10 < 0.65 THEN 'ndcg_10' END) AS failures FROM averages) SELECT config, failures = '' AS passed, failures FROM gated")
def v10(spark, d):
    return V.quality_gate(V.macro_average(measures(spark, d)))


DAY = 86_400_000_000


RATE = f"""WITH RECURSIVE r AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT id, key, t, n, true AS allowed, t + {DAY} AS reset, 1 AS cnt FROM r WHERE n = 1
    UNION ALL SELECT r.id, r.key, r.t, r.n, f.reset <= r.t OR f.cnt < 3, CASE WHEN f.reset <= r.t THEN r.t + {DAY} ELSE f.reset END, CASE WHEN f.reset <= r.t THEN 1 WHEN f.cnt < 3 THEN f.cnt + 1 ELSE f.cnt END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
  SELECT id, key, allowed, 3 - cnt AS remaining, reset - t AS reset_in_us FROM f"""


@query("w1_rate_limit", RATE)
def w1(spark, d):
    return W.replay(table(spark, d, "events"), 3, DAY, "user_id", "ts", "event_id", at=work_dir(spark, "rate-limit"))


BARE = "list_filter(list_transform(string_split(snippet, chr(10)), lambda l: regexp_replace(regexp_replace(l, '^\\s*[/*#-]+\\s?', ''), '^\\s+|\\s+$', '', 'g')), lambda l: regexp_matches(l, '(?i)[a-z]{4,}'))"
HITS = f"""snips AS (SELECT query_id, rank, round(rrf, 4) AS score, source || '/' || lang || '/' || doc_id AS path, CASE WHEN length(text) > 1200 THEN left(text, 1200) || chr(10) || '…' ELSE text END AS snippet FROM hybrid JOIN documents ON doc_id = chunk_id WHERE rank <= 6),
  foremost AS (SELECT query_id, left(array_to_string({BARE}, ' '), 600) AS prose, question, '**' || path || '** (lines 1–' || (1 + len(string_split(snippet, chr(10)))) || ')' AS place, '```text' || chr(10) || array_to_string(list_slice(string_split(snippet, chr(10)), 1, 18), chr(10)) || chr(10) || '```' AS excerpt FROM snips JOIN (SELECT item_id AS query_id, text AS question FROM benchmark) USING (query_id) WHERE rank = 1),
  listed AS (SELECT query_id, string_agg(rank || '. code in `' || path || ':1` [' || rank || '], scored ' || CAST(floor(score * 100 + 0.5) AS BIGINT) || ' of 100', chr(10) ORDER BY rank) AS list FROM snips GROUP BY query_id)"""


TO_TOLD = f"WITH {WIDE}, {HITS}, {summary_sql('foremost', 'query_id', 'prose', 'question', 2)}"
TOLD = f"""SELECT item_id AS query_id, coalesce('{X.BEST}' || place || ' [1].' || CASE WHEN length(summary) > 0 THEN ' ' || upper(left(summary, 1)) || substring(summary, 2, 1000) ELSE '' END || chr(10) || chr(10) || '{X.PLACES}' || chr(10) || chr(10) || list || chr(10) || chr(10) || '{X.EXCERPT}' || chr(10) || chr(10) || excerpt || chr(10) || chr(10) || '{X.FOOTER}', '{X.NO_ANSWER}') AS answer
  FROM benchmark LEFT JOIN foremost ON foremost.query_id = item_id LEFT JOIN listed ON listed.query_id = item_id LEFT JOIN summaries ON summaries.query_id = item_id"""


def told(spark, d):
    found = R.search_code(doc_dense(spark, d), doc_lexical(spark, d), doc_chunks(spark, d).withColumnRenamed("text", "content"), 6)
    run = found.withColumn("symbol", F.lit(None).cast("string")).withColumn("symbol_kind", F.lit(None).cast("string")).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(1) + F.size(F.split("snippet", "\n"))).withColumn("lang", F.lit("text"))
    run = written(run, f"{work_dir(spark, 'hits')}/all")
    return X.extractive_answer(questions(spark, d), run), run


@query("t12_extractive_answer", f"{TO_TOLD} {TOLD}")
def t12(spark, d):
    return told(spark, d)[0]


OWN_CACHE = CACHE.replace("asked AS", "ask AS").replace("FROM asked a", "FROM ask a").replace("near AS", "close AS").replace("FROM near)", "FROM close)").replace("best AS", "closest AS")


@query("a1_answer_batch", f"""{TO_TOLD}, {OWN_CACHE}, {GUARDED}, told AS ({TOLD}), hits AS (SELECT query_id, count(*) AS n FROM snips GROUP BY query_id), items AS (SELECT count(*) AS n FROM benchmark),
  screened AS (SELECT item_id, question, {REASON.replace('clean', CLEAN)} IS NOT NULL AS injection FROM guarded), posed AS (SELECT question_id, repo_id, item_id, question, injection, question_id % 5 = 0 AS has_history, question_id % 11 = 0 AS degraded FROM ask, items JOIN screened ON item_id = question_id % items.n),
  done AS (SELECT p.*, f.cached_id FROM posed p LEFT JOIN closest f ON f.question_id = p.question_id AND NOT p.has_history)
  SELECT question_id, repo_id, injection, CASE WHEN cached_id IS NULL THEN 'local' ELSE 'cache' END AS mode, cached_id IS NOT NULL AS cache_hit, cached_id, CASE WHEN cached_id IS NULL THEN coalesce(hits.n, 0) ELSE 0 END AS n_retrieved, CASE WHEN cached_id IS NULL THEN answer ELSE 'kept ' || cached_id END AS answer, cached_id IS NULL AND NOT has_history AND NOT degraded AND length(trim(answer)) > 0 AS stored
  FROM done JOIN told ON told.query_id = item_id LEFT JOIN hits ON hits.query_id = item_id""")
def a1(spark, d):
    """The odd vectors ask the benchmark's questions, some with a hidden instruction, of a cache that holds the even ones."""
    e, v = table(spark, d, "embeddings"), F.col("vec_id")
    cached = cache_tables(spark, d)[0].withColumn("answer", F.concat(F.lit("kept "), F.col("id").cast("string")))
    n = table(spark, d, "benchmark").count()
    posed = e.where(v % 2 == 1).select(v.alias("question_id"), F.col("label").alias("repo_id"), F.when(v % 3 == 0, "a").otherwise("b").alias("embed_model"), "embedding", (v % n).alias("item_id"), (v % 5 == 0).alias("has_history"), (v % 11 == 0).alias("degraded"))
    posed = posed.join(guarded(spark, d), "item_id")
    answers, run = told(spark, d)
    answers = answers.join(run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved")), "query_id", "left").withColumnRenamed("query_id", "item_id")
    by_question = posed.select("question_id", "item_id").join(answers, "item_id").drop("item_id")
    out = A.answer_batch(posed, cached, by_question, 0.3)
    return out.select("question_id", "repo_id", "injection", "mode", "cache_hit", "cached_id", "n_retrieved", "answer", "stored")
