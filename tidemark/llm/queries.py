"""The registered queries: thin calls of the operators on whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    op1_order_minhash, op2_packing, op3_sharding, op4_jaccard_join, op5_surrogates,
    op6_decontamination, op7_rollup, op8_quality, op9_language, op10_repeats, op11_url_filter,
    op12_prefix_trie, op13_clusters)
from tidemark.llm.common import documents, fold, shared_folder, text_or_empty, written

ORACLE_SQL: dict[str, str] = {}


def op1_order_minhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_order_minhash.compare_with_edits(documents(spark, sf_dir))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = op2_packing.pieces(documents(spark, sf_dir),
                             public_tokenizers.path("word_bpe_49k.json"))
    return op2_packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32",
                                        "sequence_id", "offset")


def op3_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_sharding.shard(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_t_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard_join.join(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id")


#: stands for a secret that a deployment keeps elsewhere
SURROGATE_KEY = "documents"


def op5_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_surrogates.replace(documents(spark, sf_dir).select("doc_id", "text"),
                                  SURROGATE_KEY, count="n_replaced")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_decontamination.report(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over ``documents``: all are loaded under two
    tokenizer versions, the load is replayed, later copies of a text are
    deleted, and counts are revised where licence lines go."""
    def counted(text: Column) -> Column:
        return F.array(
            F.struct(F.lit("words@1").alias("tokenizer"),
                     F.regexp_count(text, F.lit(op7_rollup.WORDS_1)).alias("tokens")),
            F.struct(F.lit("words@2").alias("tokenizer"),
                     F.regexp_count(text, F.lit(op7_rollup.WORDS_2)).alias("tokens")))

    text = text_or_empty()
    shorter = F.regexp_replace(text, op7_rollup.LICENCE, "")
    counts = written(documents(spark, sf_dir).select(
        "doc_id", "source", "lang", F.sha2(text.cast("binary"), 256).alias("key"),
        counted(text).alias("counts"),
        F.when(shorter != text, counted(shorter)).alias("revised")), "rollup-counts")
    first = written(counts.groupBy("key").agg(F.min("doc_id").alias("first")), "rollup-first")
    rows = counts.join(first, "key")
    rollup = op7_rollup.TokenRollup(
        spark, f"{shared_folder(spark)}/llm-rollup-{uuid.uuid4().hex}")
    column = F.col

    def each(df: DataFrame, op: str) -> DataFrame:
        df = df.select("source", "lang", F.explode("counts").alias("c"))
        return op7_rollup.change(df, op, column("source"), column("lang"),
                                 column("c.tokenizer"), column("c.tokens"))

    revised = (rows.filter("doc_id = first and revised is not null")
               .select("source", "lang", F.explode(F.arrays_zip("counts", "revised")).alias("c")))
    rollup.commit("load", each(counts, "insert"))
    rollup.commit("load", each(counts, "insert"))
    rollup.commit("copies", each(rows.filter("doc_id > first"), "delete"))
    rollup.commit("licences", op7_rollup.change(
        revised, "revise", column("source"), column("lang"), column("c.counts.tokenizer"),
        column("c.revised.tokens"), column("c.counts.tokens")))
    return rollup.totals()


ORACLE_SQL["op7_rollup_totals"] = r"""
WITH kept AS (
  SELECT source, lang,
         regexp_replace(coalesce(text, ''),
           '(?m)^(Licensed under|This work is licensed under)[^\n]*\n?', '', 'g') AS t
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents)
  WHERE doc_id = first),
counted AS (
  SELECT source, lang, 'words@1' AS tokenizer,
         len(regexp_extract_all(t, '[^ \t\n\r\f\x0B]+')) AS tokens FROM kept
  UNION ALL
  SELECT source, lang, 'words@2',
         len(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\x0B]')) FROM kept)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counted GROUP BY ALL
"""


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op8_quality.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return (op8_quality.score(docs.select("doc_id", "text", "n_chars"), model)
            .select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted")))


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = op9_language.fit(docs.filter(fold("doc_id", 4) != 2))
    return (op9_language.identify(docs, model)
            .withColumn("held_out", fold("doc_id", 4) == 2)
            .select("doc_id", "held_out", "lang_pred", "score"))


def op10_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_repeats.cut(documents(spark, sf_dir))


#: fixed policy of the url filter: verdict, host, path
URL_RULES = (
    op11_url_filter.Rule("allow", "org", "/"),
    op11_url_filter.Rule("block", "example.org", "/es/"),
    op11_url_filter.Rule("block", "example.org", "/en/1"),
    op11_url_filter.Rule("allow", "com", "/fr/"),
    op11_url_filter.Rule("block", "com", "/de/"))
URL_ROUNDS = 20


def op11_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES,
                                 URL_ROUNDS)


def _host_trust_sql() -> str:
    """The same graph walk with unions of sums, a CTE for each round."""
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    upper, lower = op11_url_filter.UPPER, op11_url_filter.LOWER
    rounds = []
    for k in range(URL_ROUNDS + 1):
        got = "" if k == 0 else f"""
    UNION ALL SELECT f.kind, f.dst, r.rank * 17 // (20 * d.n)
    FROM r{k - 1} r JOIN flow f USING (kind, host) JOIN degree d USING (kind, host)"""
        rounds.append(f"""r{k} AS MATERIALIZED (SELECT kind, host, CAST(sum(x) AS BIGINT) AS rank FROM (
    SELECT kind, host, seed * 3 // 20 AS x FROM seed{got}) GROUP BY ALL)""")
    return f"""
WITH cut AS (
  SELECT page_id, html, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') AS rest FROM pages),
found AS MATERIALIZED (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
rules(verdict, host, path) AS (VALUES {rules}),
ruled AS MATERIALIZED (
  SELECT page_id, f.host, f.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
         max_by(r.verdict, length(r.host || r.path)) AS ruled
  FROM (SELECT page_id, host, path, row_number() OVER () AS n FROM found) f LEFT JOIN rules r
    ON (f.host = r.host OR ends_with(f.host, '.' || r.host)) AND starts_with(f.path, r.path)
  GROUP BY n, page_id, f.host, f.path),
links AS MATERIALIZED (
  SELECT DISTINCT a, b FROM (
    SELECT host AS a, translate(unnest(regexp_extract_all(coalesce(html, ''),
      '(?i)<a[ \t\r\n\f][^<>]*?href[ \t\r\n\f]*=[ \t\r\n\f]*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^"''<>/?# \t\r\n\f]+)',
      1)), '{upper}', '{lower}') AS b FROM found WHERE host <> '') WHERE a <> b),
hosts AS (SELECT host FROM found WHERE host <> '' UNION SELECT b FROM links),
labels AS (SELECT string_split(host, '.') AS l FROM hosts
           WHERE NOT regexp_matches(host, '(^|\\.)[0-9]*(:[0-9]*)?$')),
up AS (SELECT DISTINCT list_aggregate(l[i:], 'string_agg', '.') AS a,
              list_aggregate(l[i + 1:], 'string_agg', '.') AS b
       FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels)),
edges AS (SELECT a, b FROM links UNION SELECT a, b FROM up UNION SELECT b, a FROM up),
flow AS MATERIALIZED (SELECT 'trust' AS kind, a AS host, b AS dst FROM edges
                      UNION ALL SELECT 'distrust', b, a FROM edges),
degree AS MATERIALIZED (SELECT kind, host, count(*) AS n FROM flow GROUP BY ALL),
shares AS (SELECT host, 1000000000 * count_if(ruled = 'allow') // count(*) AS trust,
                  1000000000 * count_if(ruled = 'block') // count(*) AS distrust
           FROM ruled WHERE ruled IS NOT NULL AND host <> '' GROUP BY host),
seed AS MATERIALIZED (
  SELECT 'trust' AS kind, host, CAST(trust AS BIGINT) AS seed FROM shares WHERE trust > 0
  UNION ALL SELECT 'distrust', host, CAST(distrust AS BIGINT) FROM shares WHERE distrust > 0),
{", ".join(rounds)},
ranks AS (SELECT host, CAST(coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust,
                 CAST(coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust
          FROM r{URL_ROUNDS} GROUP BY host)
SELECT page_id, p.host, path, rule,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block'
                            ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled p LEFT JOIN ranks r ON p.host = r.host
"""


ORACLE_SQL["op11_host_trust"] = _host_trust_sql()


def op12_ternary_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL["op12_ternary_trie"] = r"""
WITH turns AS (
  SELECT conv_id, turn, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS u
  FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (
  SELECT conv_id, list(u ORDER BY turn NULLS FIRST,
                       left(sha256(length(u.r) || ':' || u.r || u.t), 32)) AS s
  FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, s, (4294967295 - list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                            lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h
  FROM own),
rebuilt AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:h], a.s[h + 1:]) AS s
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
members AS (
  SELECT conv_id, d, s[1:d] AS path, len(s) AS n FROM (
    SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT row_number() OVER () AS id, path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY path, d),
linked AS MATERIALIZED (
  SELECT c.*, p.id AS up, p.conv_id AS parent_conv_id
  FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND p.path = c.path[1:c.d - 1]),
children AS (SELECT up AS id, count(*) AS n FROM linked WHERE up IS NOT NULL GROUP BY up),
above AS (
  WITH RECURSIVE a AS (
    SELECT l.id AS top, l.id AS at, c.n IS NULL AS leaf,
           CASE WHEN l.d = 0 THEN 0 ELSE (l.n_convs - 1) * length(l.path[l.d].t) END AS saved, l.up
    FROM linked l LEFT JOIN children c USING (id)
    UNION ALL
    SELECT l.id, a.at, a.leaf, a.saved, l.up FROM a JOIN linked l ON l.id = a.up)
  SELECT top, count_if(leaf) AS n_leaves, sum(saved) AS saved FROM a GROUP BY top)
SELECT l.conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs,
       coalesce(c.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked l JOIN above a ON a.top = l.id LEFT JOIN children c ON c.id = l.id
"""


def op13_laesa_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
        .alias("centroid_sha256"))


def _clusters_sql(rounds: int = 3) -> str:
    """Every distance to every centroid, in each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT id, q, min_by(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.id, v.q, m.c, list_sum(list_transform(range(1, 65),
             lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i]))) AS d
    FROM kept v, m{k} m) GROUP BY id, q)""")
        if k < rounds:
            steps.append(f"""m{k + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(n.q, m.q) AS q FROM m{k} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (
        SELECT c, unnest(range(1, 65)) AS i, unnest(q) AS x FROM a{k}) GROUP BY c, i)
    GROUP BY c) n ON n.c = m.c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q
  FROM kept QUALIFY c < 16),
{", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(list_transform(m.q, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (id) JOIN m{rounds} m ON m.c = a.c
"""


ORACLE_SQL["op13_laesa_clusters"] = _clusters_sql()


QUERIES = {f.__name__: f for f in (
    op1_order_minhash_edits, op2_best_two_fit, op3_karmarkar_karp, op4_t_occurrence,
    op5_keyed_surrogates, op6_spaced_seeds, op7_rollup_totals, op8_factorisation_machine,
    op9_cross_parsing, op10_prefix_free_parsing, op11_host_trust, op12_ternary_trie,
    op13_laesa_clusters)}
