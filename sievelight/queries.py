"""Queries over the driver's tables, one for each operator, with the SQL that checks them.

Documents are training rows (file: source, line: doc_id). Benchmark items are eval rows: whole as
questions, or split by words into passage, question and answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.config import PUNCTUATION, Options
from sievelight.functions import scoring, text
from sievelight.operators import clusters, compare, counts, index, normalize, review
from sievelight.plans import detect as plan
from sievelight.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("training_file"), F.col("doc_id").alias("training_line"))


#: How many of three parts of an item's words go before, into and after the question; "s": two words are the answer.
LAYOUTS = {"q": (0, 3), "qa": (0, 2), "qp": (1, 3), "qap": (1, 2), "s": (0, 0)}


def evals(spark: SparkSession, sf_dir: str, layout: str = "q") -> DataFrame:
    return evals_of(table(spark, sf_dir, "benchmark"), layout)


def evals_of(items: DataFrame, layout: str = "q") -> DataFrame:
    """Items (item_id, text) as eval rows."""
    words = F.split(text.clean_text(F.col("text")), " ")
    n, third = F.size("w"), F.floor(F.size("w") / 3).cast("int")
    a, b = LAYOUTS[layout]
    first = third * a
    last = n if b == 3 else F.greatest(n - 2, F.lit(0)) if layout == "s" else third * b
    part = lambda lo, hi: F.array_join(F.slice("w", lo + 1, F.greatest(hi - lo, F.lit(0))), " ")
    rows = items.select("item_id", words.alias("w"))
    return rows.select(
        F.col("item_id").alias("eval_id"), F.concat(F.lit("suite"), (F.col("item_id") % 3).cast("string")).alias("eval_key"), F.col("item_id").alias("eval_line"), F.col("item_id").alias("eval_instance_index"),
        F.lit("test").alias("split"), text.fingerprint(part(F.lit(0), first), part(first, last), part(last, n)).alias("fingerprint"), F.lit(True).alias("is_correct"), F.lit("benchmark").alias("reference_file"),
        part(first, last).alias("question"), F.when(last < n, part(last, n)).alias("answer"), F.when(first > 0, part(F.lit(0), first)).alias("passage"),
    )


def built(spark: SparkSession, sf_dir: str, layout: str = "q", **options) -> index.Index:
    return index.build_index(evals(spark, sf_dir, layout), Options(**options))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def clean_sql(column: str) -> str:
    marks = PUNCTUATION.replace("'", "''")
    return f"trim(regexp_replace(translate(lower({column}), '{marks}', '{' ' * len(PUNCTUATION)}'), '\\s+', ' ', 'g'))"


DOCS_SQL = f"""d AS (SELECT doc_id, source, {clean_sql("text")} AS clean FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, source, clean, string_split(clean, ' ') AS w FROM d WHERE clean <> '' AND len(string_split(clean, ' ')) >= 10),
g AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(list_slice(w, pos + 1, pos + 5), ' ') AS ngram FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS pos FROM t))"""


def evals_sql(layout: str = "q") -> str:
    a, b = LAYOUTS[layout]
    first = f"{a} * (len(w) // 3)"
    last = "len(w)" if b == 3 else "greatest(len(w) - 2, 0)" if layout == "s" else f"{b} * (len(w) // 3)"
    return f"""b AS (SELECT item_id AS eval_id, 'suite' || (item_id % 3) AS eval_key, string_split({clean_sql("text")}, ' ') AS w FROM benchmark),
p AS (SELECT eval_id, eval_key, w, list_slice(w, 1, {first}) AS pw, list_slice(w, {first} + 1, {last}) AS qw, list_slice(w, {last} + 1, len(w)) AS aw FROM b),
f AS (SELECT *, substr(sha256(array_to_string(pw, ' ') || array_to_string(qw, ' ') || array_to_string(aw, ' ')), 1, 16) AS fingerprint FROM p),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eval_key, fingerprint ORDER BY eval_id) AS n FROM f WHERE len(w) >= 20 AND len(list_distinct(w)) >= 4) WHERE n = 1 AND len(qw) > 0),
size AS (SELECT count(*) AS n FROM e),
post AS (SELECT DISTINCT eval_id, ngram FROM (SELECT eval_id, unnest(CASE WHEN len(qw) >= 5 THEN list_transform(range(1, len(qw) - 3), lambda i: array_to_string(list_slice(qw, i, i + 4), ' ')) ELSE [array_to_string(qw, ' ')] END) AS ngram FROM e)),
ndf AS (SELECT ngram, count(*) AS df, ln((SELECT n FROM size) / count(*)) AS idf FROM post GROUP BY ngram),
qs AS (SELECT eval_id, count(*) AS unique_ngrams, sum(idf) AS question_idf_sum FROM post JOIN ndf USING (ngram) GROUP BY eval_id)"""


HITS_SQL = """hits AS (SELECT g.doc_id, post.eval_id, g.pos, g.ngram, ndf.idf FROM g JOIN post USING (ngram) JOIN ndf USING (ngram)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, eval_id ORDER BY pos) AS cluster FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, eval_id ORDER BY pos) <= 11 THEN 0 ELSE 1 END AS fresh FROM hits)),
cl AS (SELECT doc_id, eval_id, cluster, min(lo) AS start, max(hi) AS "end", count(*) AS ngram_match_cnt, sum(idf) AS matched_idf
       FROM (SELECT doc_id, eval_id, cluster, ngram, min(pos) AS lo, max(pos) AS hi, min(idf) AS idf FROM isl GROUP BY ALL) GROUP BY doc_id, eval_id, cluster),
ov AS (SELECT cl.*, unique_ngrams, question_idf_sum, len(qw) AS question_tokens, eval_key, qw, aw, pw, CASE WHEN question_idf_sum > 0 THEN matched_idf / question_idf_sum ELSE 0 END AS idf_overlap, "end" + 5 - start AS cluster_tokens
       FROM cl JOIN qs USING (eval_id) JOIN e USING (eval_id))"""


def need_sql(length: str, target: str) -> str:
    return f"(CASE WHEN {length} <= 20 THEN 1.0 WHEN {length} >= 50 THEN {target} ELSE 1.0 - ({length} - 20) / 30.0 * (1 - {target}) END)"


def gates_sql(threshold: float = 0.8) -> str:
    least = max(0.0, (threshold - 0.3) / 0.7)
    return f"""gate AS (SELECT * FROM ov WHERE idf_overlap >= {least!r}::DOUBLE AND idf_overlap >= {need_sql("question_tokens", f"{least!r}::DOUBLE")} - 1e-9)"""


def grams_sql(name: str, column: str, n: int, least: int) -> str:
    return f"""{name}_g AS (SELECT DISTINCT eval_id, ngram FROM (SELECT eval_id, unnest(list_transform(range(1, len({column}) - {n - 2}), lambda i: array_to_string(list_slice({column}, i, i + {n - 1}), ' '))) AS ngram FROM e WHERE len({column}) >= {least})),
{name}_i AS (SELECT eval_id, ngram, ln((SELECT n FROM size) / count(*) OVER (PARTITION BY ngram)) AS idf FROM {name}_g),
{name}_t AS (SELECT eval_id, sum(idf) AS total FROM {name}_i GROUP BY eval_id)"""


# every candidate has a number, as positions are searched for each
ANSWERS_SQL = f"""{grams_sql("ag", "aw", 3, 4)},
tok AS (SELECT token, ln((SELECT n FROM size) / count(*)) AS idf FROM (SELECT eval_id, 'q', unnest(list_distinct(qw)) AS token FROM e UNION ALL SELECT eval_id, 'a', unnest(list_distinct(aw)) FROM e UNION ALL SELECT eval_id, 'p', unnest(list_distinct(pw)) FROM e) GROUP BY token),
sat AS (SELECT eval_id, sum(idf) AS total FROM (SELECT eval_id, unnest(list_distinct(aw)) AS token FROM e) JOIN tok USING (token) GROUP BY eval_id),
c AS (SELECT gate.*, t.w AS dw, row_number() OVER (ORDER BY doc_id, eval_id, cluster) AS k, greatest("end" + 4 - greatest(cluster_tokens - question_tokens, 0), 0) AS qend FROM gate JOIN t USING (doc_id)),
ah AS (SELECT k, eval_id, i, array_to_string(list_slice(dw, i + 1, i + 3), ' ') AS ngram FROM (SELECT *, unnest(range(qend + 1, least(qend + 1 + greatest(2 * len(aw), 100), len(dw)) - 2)) AS i FROM c WHERE len(aw) > 3)),
am AS (SELECT ah.k, ah.i, ah.ngram, ag_i.idf FROM ah JOIN ag_i USING (eval_id, ngram)),
ar AS (SELECT k, r, min(i) AS s, max(i) + 2 AS x FROM (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS r FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 5 THEN 0 ELSE 1 END AS fresh FROM am)) GROUP BY k, r),
ab AS (SELECT k, min(s) AS answer_start, max(x) AS answer_end, count(*) AS n_ranges FROM ar GROUP BY k),
ao AS (SELECT k, sum(idf) AS found FROM (SELECT DISTINCT k, ngram, idf FROM am) GROUP BY k),
sa AS (SELECT k, min(i) AS i FROM (SELECT k, aw, dw, unnest(range(qend + 1, least(qend + 50, len(dw) - len(aw)) + 1)) AS i FROM c WHERE len(aw) BETWEEN 1 AND 3) WHERE list_slice(dw, i + 1, i + len(aw)) = aw GROUP BY k),
ans AS (SELECT c.k, coalesce(sa.i, ab.answer_start) AS answer_start, coalesce(sa.i + len(aw) - 1, ab.answer_end) AS answer_end, CASE WHEN sa.i IS NOT NULL THEN 1 ELSE coalesce(n_ranges, 0) END AS n_ranges,
        CASE WHEN len(aw) = 0 THEN NULL WHEN sa.i IS NOT NULL THEN CASE WHEN sat.total > 0 THEN 1.0 ELSE 0.0 END WHEN ab.k IS NULL OR ag_t.total <= 0 THEN 0.0 ELSE ao.found / ag_t.total END AS answer_idf_overlap
        FROM c LEFT JOIN sa USING (k) LEFT JOIN ab USING (k) LEFT JOIN ao USING (k) LEFT JOIN ag_t USING (eval_id) LEFT JOIN sat USING (eval_id))"""

PASSAGES_SQL = f"""{grams_sql("pg", "pw", 4, 4)},
pz AS (SELECT k, eval_id, greatest(start - 1, 0) AS z, greatest(greatest(start - 1, 0) - greatest(2 * len(pw), 100), 0) AS y, dw FROM c WHERE len(pw) > 0),
ph AS (SELECT k, i, pg_i.idf, ngram FROM (SELECT k, eval_id, i, array_to_string(list_slice(dw, i + 1, i + 4), ' ') AS ngram FROM (SELECT *, unnest(range(y, z - 3)) AS i FROM pz)) JOIN pg_i USING (eval_id, ngram)),
pn AS (SELECT * FROM (SELECT *, sum(far) OVER (PARTITION BY k ORDER BY i DESC) AS away FROM (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY k ORDER BY i DESC) - i > 3 THEN 1 ELSE 0 END AS far FROM ph)) WHERE away = 0),
pb AS (SELECT k, min(i) AS passage_start, max(i) + 3 AS passage_end FROM pn GROUP BY k),
po AS (SELECT k, sum(idf) AS found FROM (SELECT DISTINCT k, ngram, idf FROM pn) GROUP BY k),
pas AS (SELECT c.k, passage_start, passage_end, CASE WHEN len(pw) = 0 THEN NULL WHEN pb.k IS NULL OR pg_t.total <= 0 THEN 0.0 ELSE po.found / pg_t.total END AS passage_idf_overlap
        FROM c LEFT JOIN pb USING (k) LEFT JOIN po USING (k) LEFT JOIN pg_t USING (eval_id))"""

SCORE_SQL = f"""w1 AS (SELECT c.*, answer_start, answer_end, n_ranges, answer_idf_overlap, passage_start, passage_end, passage_idf_overlap, len(list_distinct(aw)) AS answer_unique, len(pw) AS passage_total,
       CASE WHEN unique_ngrams < 20 THEN 0.5 + 0.5 * unique_ngrams / 20 ELSE 1.0 END AS cq, CASE WHEN len(list_distinct(aw)) < 4 THEN 0.5 + 0.5 * len(list_distinct(aw)) / 4 ELSE 1.0 END AS ca
       FROM c JOIN ans USING (k) JOIN pas USING (k)),
w2 AS (SELECT *, least(1.0, CASE
       WHEN len(aw) > 0 AND len(pw) > 0 AND (cq < 1 OR ca < 1) THEN idf_overlap * 0.7 * cq + answer_idf_overlap * (0.2 + 0.35 * (1 - cq)) * ca + passage_idf_overlap * (0.1 + 0.35 * (1 - cq) + (0.2 + 0.35 * (1 - cq)) * (1 - ca))
       WHEN len(aw) > 0 AND len(pw) > 0 THEN 0.7 * idf_overlap + 0.2 * answer_idf_overlap + 0.1 * passage_idf_overlap
       WHEN len(aw) > 0 THEN idf_overlap * 0.75 * cq + answer_idf_overlap * (1.0 - 0.75 * cq)
       WHEN len(pw) > 0 THEN idf_overlap * 0.85 * cq + passage_idf_overlap * (1.0 - 0.85 * cq) ELSE idf_overlap END) AS s,
       {need_sql("(question_tokens + answer_unique + passage_total)", "0.8")} AS need FROM w1),
sc AS (SELECT *, CASE WHEN need > 0.8 THEN s * 0.8 / need + CASE WHEN s >= 1 - 1e-6 THEN 1 - 0.8 / need ELSE 0 END ELSE s END AS contamination_score FROM w2),
det AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, eval_key, eval_id, start ORDER BY contamination_score DESC) AS place FROM sc WHERE contamination_score >= 0.8 - 1e-9) WHERE place = 1)"""


def with_sql(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def detect_sql(layout: str, select: str, threshold: float = 0.8) -> str:
    score = SCORE_SQL if threshold == 0.8 else SCORE_SQL.replace("contamination_score >= 0.8 - 1e-9", f"contamination_score >= {threshold} - 1e-9").replace('"0.8")', "").replace("need > 0.8", f"need > {threshold}").replace("s * 0.8 / need", f"s * {threshold} / need").replace("1 - 0.8 / need", f"1 - {threshold} / need").replace(need_sql("(question_tokens + answer_unique + passage_total)", "0.8"), need_sql("(question_tokens + answer_unique + passage_total)", str(threshold)))
    return with_sql(DOCS_SQL, evals_sql(layout), HITS_SQL, gates_sql(threshold), ANSWERS_SQL, PASSAGES_SQL, score, select=select)


# --- A: text


@query(f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS INTEGER) AS n_words, CAST(CASE WHEN c = '' THEN 0 ELSE len(list_distinct(string_split(c, ' '))) END AS INTEGER) AS n_unique FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents)")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.word_tokens(text.clean_text(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_words"), F.size(F.array_distinct(tokens)).alias("n_unique"))


@query(with_sql(DOCS_SQL, select="SELECT doc_id, pos, ngram FROM g"))
def ngram_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.training_ngrams(clusters.training_tokens(documents(spark, sf_dir), Options()), 5)


@query(f"SELECT doc_id, array_to_string(list_slice(string_split({clean_sql('text')}, ' '), 1, 1000), ' ') AS snippet FROM documents")
def snippet_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(text.clean_text(F.col("text"))).alias("snippet"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.page') = 'VARCHAR' THEN json_extract_string(props, '$.page') END AS page FROM events")
def nested_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.nested_text(F.col("props"), "page").alias("page"))


@query("SELECT conv_id, turn, substr(sha256(coalesce(role, '') || coalesce(text, '')), 1, 16) AS fingerprint FROM conversations")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fingerprint(F.col("role"), F.col("text"), F.lit(None)).alias("fingerprint"))


# --- B: index


@query(with_sql(evals_sql(), select="SELECT ngram, eval_id FROM post"))
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).postings.select("ngram", "eval_id")


@query(with_sql(evals_sql(), select="SELECT ngram, df, round(idf, 6) AS idf FROM ndf"))
def ngram_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(built(spark, sf_dir).postings.select("ngram", "df", "idf").distinct(), "idf")


@query(with_sql(evals_sql(), select="SELECT eval_id, unique_ngrams, round(question_idf_sum, 6) AS question_idf_sum FROM qs"))
def question_idf_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(built(spark, sf_dir).stats.select("eval_id", "unique_ngrams", "question_idf_sum"), "question_idf_sum")


@query(with_sql(evals_sql("qap"), ANSWERS_SQL.split("tok AS")[0].rstrip().rstrip(","), "tok AS" + ANSWERS_SQL.split("tok AS")[1].split("sat AS")[0].rstrip().rstrip(","), select="SELECT token, round(idf, 6) AS idf FROM tok"))
def token_df_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = built(spark, sf_dir, "qap")
    return rounded(index.token_idf(found.evals, found.size).select("token", "idf"), "idf")


@query(with_sql(evals_sql("qap"), grams_sql("ag", "aw", 3, 4), select="SELECT eval_id, ngram, round(idf, 6) AS idf FROM ag_i"))
def answer_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = built(spark, sf_dir, "qap").stats.select("eval_id", F.explode("answer_ngrams").alias("g"))
    return rounded(grams.select("eval_id", "g.ngram", "g.idf"), "idf")


@query(with_sql(evals_sql("qap"), grams_sql("pg", "pw", 4, 4), select="SELECT eval_id, CAST(count(*) AS INTEGER) AS n_ngrams, round(sum(idf), 6) AS passage_idf_sum FROM pg_i GROUP BY eval_id"))
def passage_idf_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = built(spark, sf_dir, "qap").stats.where("passage_idf_sum IS NOT NULL")
    return rounded(found.select("eval_id", F.size("passage_ngrams").alias("n_ngrams"), "passage_idf_sum"), "passage_idf_sum")


@query(with_sql(DOCS_SQL, select="SELECT ngram, count(DISTINCT doc_id) AS df FROM g GROUP BY ngram ORDER BY df DESC, ngram LIMIT 100"))
def hot_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return counts.hot_ngrams(docs, clusters.training_tokens(docs, Options()), 5)


@query(with_sql(DOCS_SQL, "x AS (SELECT ngram, count(DISTINCT doc_id) AS df FROM g GROUP BY ngram)", select="SELECT CASE WHEN df = 1 THEN '1' WHEN df <= 10 THEN '2-10' WHEN df <= 100 THEN '11-100' WHEN df <= 1000 THEN '101-1000' ELSE '>1000' END AS bucket, count(*) AS n_ngrams FROM x GROUP BY 1"))
def df_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return counts.df_histogram(docs, clusters.training_tokens(docs, Options()), 5)


@query(with_sql(evals_sql(), select="SELECT count(*) AS n_ngrams, avg(df) AS mean_df, list_sort(list(df))[count(*) // 2 + 1] AS median_df, max(df) AS max_df FROM ndf"))
def df_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.df_summary(built(spark, sf_dir).postings.select("ngram", "df").distinct())


@query(with_sql("c AS (SELECT conv_id, turn, role, text, substr(sha256(coalesce(text, '')), 1, 16) AS fingerprint FROM conversations)", select="SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, fingerprint ORDER BY conv_id, turn) AS n FROM c) WHERE n = 1"))
def eval_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("eval_id"), F.col("role").alias("eval_key"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("eval_line"), text.fingerprint(F.lit(None), F.col("text"), F.lit(None)).alias("fingerprint"), F.coalesce("text", F.lit("")).alias("question"),
    )
    options = Options(eval_min_token_length=0, eval_min_unique_word_count=0)
    return index.filtered_evals(rows.withColumn("question", F.concat(F.lit("q "), "question")), options).select(F.floor(F.col("eval_line") / 100_000).alias("conv_id"), (F.col("eval_line") % 100_000).alias("turn"))


@query(with_sql(f"c AS (SELECT conv_id, turn, string_split({clean_sql('text')}, ' ') AS w FROM conversations WHERE text IS NOT NULL)", select="SELECT conv_id, turn FROM c WHERE len(w) >= 20 AND len(list_distinct(w)) >= 4"))
def eval_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("eval_id"), F.col("text").alias("question"))
    return index.filtered_evals(rows, Options(eval_dedup=False)).select(F.floor(F.col("eval_id") / 100_000).alias("conv_id"), (F.col("eval_id") % 100_000).alias("turn"))


@query(with_sql(evals_sql(), select="SELECT (SELECT count(*) FROM f) AS examined, (SELECT count(*) FROM f WHERE len(w) < 20) AS skipped_few_tokens, (SELECT count(*) FROM f WHERE len(w) >= 20 AND len(list_distinct(w)) < 4) AS skipped_few_words, (SELECT count(*) FROM f WHERE len(w) >= 20 AND len(list_distinct(w)) >= 4) - (SELECT count(*) FROM e) AS skipped_duplicate, (SELECT count(*) FROM e) AS indexed"))
def index_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build_stats(evals(spark, sf_dir), Options())


# --- C: detection of questions


@query(with_sql(DOCS_SQL, evals_sql(), HITS_SQL, select="SELECT doc_id, eval_id, pos, ngram FROM hits"))
def ngram_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.probe(clusters.training_tokens(documents(spark, sf_dir), Options()), built(spark, sf_dir)).select("doc_id", "eval_id", "pos", "ngram")


@query(with_sql(DOCS_SQL, evals_sql(), select="SELECT doc_id, count(*) AS n_hits FROM g WHERE ngram IN (SELECT ngram FROM post) GROUP BY doc_id"))
def probe_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = built(spark, sf_dir)
    grams = clusters.training_ngrams(clusters.training_tokens(documents(spark, sf_dir), Options()), 5)
    return grams.join(found.near(found.postings.select("ngram").distinct()), "ngram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_hits"))


@query(with_sql(DOCS_SQL, evals_sql(), HITS_SQL, select='SELECT doc_id, eval_id, CAST(cluster AS BIGINT) AS cluster, start, "end", ngram_match_cnt, round(matched_idf, 6) AS matched_idf FROM cl'))
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = clusters.probe(clusters.training_tokens(documents(spark, sf_dir), Options()), built(spark, sf_dir))
    return rounded(clusters.gap_clusters(hits, Options()), "matched_idf")


@query(with_sql(DOCS_SQL, evals_sql(), HITS_SQL, select="SELECT doc_id, eval_id, start, round(idf_overlap, 6) AS idf_overlap, CAST(cluster_tokens AS INTEGER) AS cluster_tokens FROM ov"))
def question_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = built(spark, sf_dir)
    hits = clusters.probe(clusters.training_tokens(documents(spark, sf_dir), Options()), found)
    return rounded(plan.question_overlaps(clusters.gap_clusters(hits, Options()), found).select("doc_id", "eval_id", "start", "idf_overlap", "cluster_tokens"), "idf_overlap")


@query(with_sql(DOCS_SQL, evals_sql(), HITS_SQL, gates_sql(), select="SELECT doc_id, eval_id, start, round(idf_overlap, 6) AS idf_overlap FROM gate"))
def question_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plan.candidates(documents(spark, sf_dir), built(spark, sf_dir))[1].select("doc_id", "eval_id", "start", "idf_overlap"), "idf_overlap")


def matches(spark: SparkSession, sf_dir: str, layout: str = "q", **options) -> DataFrame:
    return plan.detect(documents(spark, sf_dir), built(spark, sf_dir, layout, **options))


@query(detect_sql("q", 'SELECT doc_id, eval_id, start, "end", round(contamination_score, 6) AS contamination_score FROM det'))
def detect_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents against whole benchmark items."""
    return rounded(matches(spark, sf_dir).select("doc_id", "eval_id", "start", "end", "contamination_score"), "contamination_score")


# conversations in place of documents, and their turns in place of benchmark items: n-grams that several items share, and items that compete
TURNS_SQL = """documents AS (SELECT conv_id AS doc_id, 'conversations' AS source, string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id),
benchmark AS (SELECT conv_id * 100000 + turn AS item_id, text FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, index.Index]:
    rows = table(spark, sf_dir, "conversations")
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda t: t["text"]), " ")
    docs = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(text_of.alias("text"))
    return docs, index.build_index(evals_of(rows.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("item_id"), "text")), Options())


@query(with_sql(TURNS_SQL, evals_sql(), select="SELECT ngram, df, round(idf, 6) AS idf FROM ndf"))
def shared_ngram_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(turns(spark, sf_dir)[1].postings.select("ngram", "df", "idf").distinct(), "idf")


@query(with_sql(TURNS_SQL, DOCS_SQL, evals_sql(), HITS_SQL, select="SELECT doc_id, eval_id, pos, ngram FROM hits"))
def shared_ngram_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = turns(spark, sf_dir)
    return clusters.probe(clusters.training_tokens(docs, Options()), found).select("doc_id", "eval_id", "pos", "ngram")


@query("WITH " + TURNS_SQL + ", " + detect_sql("q", 'SELECT doc_id, eval_id, start, "end", ngram_match_cnt, round(idf_overlap, 6) AS idf_overlap, round(contamination_score, 6) AS contamination_score FROM det').removeprefix("WITH "))
def detect_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations found in all conversations."""
    matches = plan.detect(*turns(spark, sf_dir)).select("doc_id", "eval_id", "start", "end", "ngram_match_cnt", "idf_overlap", "contamination_score")
    return rounded(matches, "idf_overlap", "contamination_score")


@query("SELECT n_chars, round(CASE WHEN n_chars <= 20 THEN 1.0 WHEN n_chars >= 50 THEN 0.8 ELSE 1.0 - (n_chars - 20) / 30.0 * 0.2 END, 6) AS need FROM (SELECT DISTINCT n_chars FROM documents)")
def threshold_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").select("n_chars").distinct()
    return rounded(lengths.withColumn("need", scoring.threshold_by_length(F.col("n_chars"), 20, 50, 0.8)), "need")


# --- D: answers and passages


def spans_of(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    found = built(spark, sf_dir, layout)
    tokens, passed = plan.candidates(documents(spark, sf_dir), found)
    return plan.scored(plan.with_passages(plan.with_answers(passed.join(tokens.select("doc_id", "tokens"), "doc_id"), found), found), found)


def answers(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    b = F.col("answer_boundaries")
    found = spans_of(spark, sf_dir, layout).select("doc_id", "eval_id", "start", F.element_at(b, 1)["start"].alias("answer_start"), F.element_at(b, -1)["end"].alias("answer_end"), F.coalesce(F.size(b), F.lit(0)).alias("n_ranges"), "answer_idf_overlap")
    return rounded(found, "answer_idf_overlap")


ANSWER_SELECT = "SELECT doc_id, eval_id, start, CAST(answer_start AS INTEGER) AS answer_start, CAST(answer_end AS INTEGER) AS answer_end, CAST(n_ranges AS INTEGER) AS n_ranges, round(answer_idf_overlap, 6) AS answer_idf_overlap FROM c JOIN ans USING (k)"


@query(detect_sql("qa", ANSWER_SELECT.replace("CAST(n_ranges", "CAST(ans.n_ranges")))
def answer_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir, "qa")


@query(detect_sql("s", ANSWER_SELECT))
def answer_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir, "s")


@query(detect_sql("qap", "SELECT doc_id, eval_id, start, CAST(passage_start AS INTEGER) AS passage_start, CAST(passage_end AS INTEGER) AS passage_end, round(passage_idf_overlap, 6) AS passage_idf_overlap FROM c JOIN pas USING (k)"))
def passage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(spark, sf_dir, "qap").select("doc_id", "eval_id", "start", F.col("passage.start").alias("passage_start"), F.col("passage.end").alias("passage_end"), "passage_idf_overlap")
    return rounded(found, "passage_idf_overlap")


def _scores(layout: str, name: str) -> None:
    def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(spans_of(spark, sf_dir, layout).select("doc_id", "eval_id", "start", "contamination_score"), "contamination_score")

    QUERIES[name] = scores
    ORACLE[name] = detect_sql(layout, "SELECT doc_id, eval_id, start, round(contamination_score, 6) AS contamination_score FROM sc")


for _layout, _name in (("qa", "score_qa"), ("qp", "score_qp"), ("qap", "score_qap"), ("s", "score_short_answer")):
    _scores(_layout, _name)


@query(detect_sql("qap", 'SELECT doc_id, eval_id, start, "end", round(contamination_score, 6) AS contamination_score FROM det'))
def detect_qap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matches(spark, sf_dir, "qap").select("doc_id", "eval_id", "start", "end", "contamination_score"), "contamination_score")


OVERLAP_SQL = """SELECT doc_id, eval_id, start, round(len(list_intersect(list_distinct(aw), CASE WHEN answer_start IS NULL THEN list_slice(dw, qend + 2, qend + 1 + greatest(2 * len(aw), 100)) ELSE coalesce(inside, []) END)) / len(list_distinct(aw)), 6) AS answer_overlap_ratio,
round(CASE WHEN passage_start IS NULL THEN 0 ELSE len(list_intersect(list_distinct(pw), list_slice(dw, passage_start + 1, passage_end + 1))) / len(list_distinct(pw)) END, 6) AS passage_overlap_ratio
FROM sc LEFT JOIN (SELECT k, flatten(list(list_slice(dw, s + 1, x + 1))) AS inside FROM ar JOIN c USING (k) GROUP BY k) USING (k)"""


@query(detect_sql("qap", OVERLAP_SQL))
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spans_of(spark, sf_dir, "qap").select("doc_id", "eval_id", "start", "answer_overlap_ratio", "passage_overlap_ratio"), "answer_overlap_ratio", "passage_overlap_ratio")


# --- E: sinks


def reports(spark: SparkSession, sf_dir: str, layout: str = "q", **options) -> DataFrame:
    found, docs = built(spark, sf_dir, layout, **options), documents(spark, sf_dir)
    return plan.report(plan.detect(docs, found), docs, found)


REPORT_SELECT = """SELECT source AS training_file, doc_id AS training_line, eval_key, eval_id AS eval_line, ngram_match_cnt, unique_ngrams AS eval_unique_ngrams, round(contamination_score, 6) AS contamination_score, round(idf_overlap, 6) AS idf_overlap,
CAST(start AS BIGINT) AS question_start_idx, CAST(CASE WHEN answer_start <= "end" + 4 AND cluster_tokens > question_tokens THEN answer_start - 1 ELSE "end" + 4 END AS BIGINT) AS question_end_idx, CAST(cluster_tokens - question_tokens AS INTEGER) AS token_length_delta,
CAST(answer_start AS BIGINT) AS answer_start_idx, CAST(answer_end AS BIGINT) AS answer_end_idx, fingerprint FROM det JOIN t USING (doc_id) JOIN (SELECT eval_id, fingerprint FROM e) USING (eval_id)"""


@query(detect_sql("qap", REPORT_SELECT))
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["training_file", "training_line", "eval_key", "eval_line", "ngram_match_cnt", "eval_unique_ngrams", "contamination_score", "idf_overlap", "question_start_idx", "question_end_idx", "token_length_delta", "answer_start_idx", "answer_end_idx", "fingerprint"]
    return rounded(reports(spark, sf_dir, "qap").select(*columns), "contamination_score", "idf_overlap")


@query(detect_sql("q", "SELECT doc_id, n_chars FROM documents ANTI JOIN det USING (doc_id)"))
def purified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.purify(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), matches(spark, sf_dir))


@query(detect_sql("q", "SELECT quality, toxic, count(DISTINCT doc_id) AS n_documents FROM det JOIN labels USING (doc_id) GROUP BY quality, toxic"))
def contaminated_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir).select("doc_id").distinct()
    return table(spark, sf_dir, "labels").join(found, "doc_id", "left_semi").groupBy("quality", "toxic").agg(F.count_distinct("doc_id").alias("n_documents"))


@query(detect_sql("q", "SELECT count(*) AS n_matches, count(DISTINCT doc_id) AS n_documents, count(DISTINCT source) AS n_files, (SELECT count(*) FROM t) AS documents_processed FROM det JOIN t USING (doc_id)"))
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, docs = built(spark, sf_dir), documents(spark, sf_dir)
    return plan.run_totals(docs, plan.detect(docs, found), found)


# --- F: review

REP = "rep AS (SELECT source AS training_file, doc_id AS training_line, eval_key, eval_id AS eval_line, ngram_match_cnt, contamination_score, fingerprint FROM det JOIN t USING (doc_id) JOIN (SELECT eval_id, fingerprint FROM e) USING (eval_id))"


def review_sql(select: str, threshold: float = 0.8) -> str:
    return detect_sql("q", "§", threshold).replace(" §", f", {REP} {select}")


@query(review_sql("SELECT eval_key, count(DISTINCT (training_file, training_line)) AS n_documents FROM rep GROUP BY eval_key"))
def suite_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.suite_documents(reports(spark, sf_dir))


@query(review_sql("SELECT eval_key, count(DISTINCT eval_line) AS n_instances FROM rep GROUP BY eval_key"))
def suite_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.suite_instances(reports(spark, sf_dir))


SUMMARY = "SELECT count(DISTINCT (training_file, training_line)) AS n_documents, count(*) AS n_matches, count(DISTINCT (eval_key, eval_line)) AS n_instances FROM rep"


@query(review_sql(SUMMARY))
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(reports(spark, sf_dir))


@query(review_sql(SUMMARY))
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.compare_summary(reports(spark, sf_dir))


@query(review_sql("SELECT min(ngram_match_cnt) AS min_ngrams, max(ngram_match_cnt) AS max_ngrams, list_sort(list(ngram_match_cnt))[count(*) // 2 + 1] AS median_ngrams, round(avg(ngram_match_cnt), 6) AS avg_ngrams FROM rep"))
def ngram_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.ngram_stats(reports(spark, sf_dir)), "avg_ngrams")


@query(review_sql("SELECT CASE WHEN n <= 10 THEN '1-10' WHEN n <= 20 THEN '11-20' WHEN n <= 30 THEN '21-30' WHEN n <= 50 THEN '31-50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' WHEN n <= 500 THEN '201-500' ELSE '>500' END AS bucket, count(*) AS n_rows FROM (SELECT ngram_match_cnt AS n FROM rep) GROUP BY 1"))
def ngram_match_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.ngram_histogram(reports(spark, sf_dir))


@query(review_sql("SELECT eval_key AS eval_dataset, eval_line, count(*) AS n_matches, array_to_string(list_slice(list_sort(list(DISTINCT training_file)), 1, 3), ',') AS files FROM rep GROUP BY ALL ORDER BY n_matches DESC, eval_dataset, eval_line LIMIT 10"))
def top_eval_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.top_examples(reports(spark, sf_dir)).select("eval_dataset", "eval_line", "n_matches", "files")


@query(review_sql("SELECT training_file AS training_dataset, count(DISTINCT training_line) AS n_removed FROM rep GROUP BY 1"))
def removals_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.removals(reports(spark, sf_dir))


@query(review_sql("SELECT training_line, eval_line FROM rep WHERE eval_key = 'suite1' AND contamination_score >= 0.9 AND ngram_match_cnt >= 25"))
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.filter_reports(reports(spark, sf_dir), eval_key="suite1", min_score=0.9, min_ngrams=25).select("training_line", "eval_line")


@query(review_sql("SELECT CASE WHEN s >= 1 THEN 'exact' WHEN s > 0.9 THEN 'very likely' WHEN s > 0.8 THEN 'likely' WHEN s > 0.7 THEN 'possible' ELSE 'unlikely' END AS assessment, count(*) AS n_rows FROM (SELECT round(contamination_score, 6) AS s FROM rep) GROUP BY 1"))
def assessment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.assessments(rounded(reports(spark, sf_dir), "contamination_score"))


@query(review_sql("SELECT training_line, eval_line, CAST(row_number() OVER (ORDER BY round(contamination_score, 6), training_file, training_line, eval_key, eval_line) AS INTEGER) AS place FROM rep"))
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ordered = rounded(reports(spark, sf_dir), "contamination_score")
    key = Window.orderBy("contamination_score", "training_file", "training_line", "eval_dataset", "eval_line")
    return ordered.select("training_line", "eval_line", F.row_number().over(key).alias("place"))


# --- G: comparison of a strict and a lax run


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reports of both, of items with answers and passages; the documents are searched once."""
    strict = built(spark, sf_dir, "qap")
    return reports_of(documents(spark, sf_dir), strict, replace(strict, options=Options(contamination_score_threshold=0.5)))


def reports_of(docs: DataFrame, *indexes: index.Index) -> tuple[DataFrame, ...]:
    """Reports of each index; the documents are searched once for all."""
    found = plan.search(docs, *indexes)
    return tuple(plan.report(plan.detect(docs, x, found=found), docs, x) for x in indexes)


def compare_sql(select: str, first: str = "qap") -> str:
    run = lambda layout, threshold: detect_sql(layout, "§", threshold).replace(" §", f", {REP} SELECT * FROM rep")
    return f"WITH one AS ({run(first, 0.8)}), two AS ({run('qap', 0.5)}), k1 AS (SELECT training_file, training_line, eval_key, eval_line, max(contamination_score) AS s FROM one GROUP BY ALL), k2 AS (SELECT training_file, training_line, eval_key, eval_line, max(contamination_score) AS s FROM two GROUP BY ALL) {select}"


@query(compare_sql("SELECT training_line, eval_line FROM k1 ANTI JOIN k2 USING (training_file, training_line, eval_key, eval_line)", "q"))
def only_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of whole items, what is not found of the same items with answers and passages."""
    both = reports_of(documents(spark, sf_dir), built(spark, sf_dir), built(spark, sf_dir, "qap", contamination_score_threshold=0.5))
    return compare.only_in(*both).select("training_line", "eval_line")


@query(compare_sql("SELECT training_line, eval_line, round(s, 6) AS contamination_score FROM k2 ANTI JOIN k1 USING (training_file, training_line, eval_key, eval_line)"))
def only_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = runs(spark, sf_dir)
    return rounded(compare.only_in(second, first).select("training_line", "eval_line", "contamination_score"), "contamination_score")


@query(compare_sql("SELECT training_line, eval_line, round(k1.s, 6) AS first_score, round(k2.s, 6) AS second_score FROM k1 JOIN k2 USING (training_file, training_line, eval_key, eval_line)"))
def common_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.in_both(*runs(spark, sf_dir)).select("training_line", "eval_line", "first_score", "second_score"), "first_score", "second_score")


@query(compare_sql("SELECT eval_key AS eval_dataset, coalesce(a, 0) AS n_first, coalesce(b, 0) AS n_second, coalesce(b, 0) - coalesce(a, 0) AS delta FROM (SELECT eval_key, count(*) AS a FROM one GROUP BY 1) FULL JOIN (SELECT eval_key, count(*) AS b FROM two GROUP BY 1) USING (eval_key)"))
def suite_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.suite_deltas(*runs(spark, sf_dir))


@query(compare_sql("SELECT count(*) FILTER (WHERE d <= -0.001) AS improved, count(*) FILTER (WHERE d >= 0.001) AS worsened, count(*) FILTER (WHERE abs(d) < 0.001) AS unchanged, round(avg(-d) FILTER (WHERE d <= -0.001), 6) AS mean_improvement, round(avg(d) FILTER (WHERE d >= 0.001), 6) AS mean_worsening FROM (SELECT k2.s - k1.s AS d FROM k1 JOIN k2 USING (training_file, training_line, eval_key, eval_line))"))
def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.score_changes(*runs(spark, sf_dir)), "mean_improvement", "mean_worsening")


@query(compare_sql("SELECT round(sum(contamination_score) / count(*), 6) AS avg_score FROM two"))
def average_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.average_score(runs(spark, sf_dir)[1]), "avg_score")


@query(compare_sql("SELECT fingerprint, count(*) AS n_rows, round(max(contamination_score), 6) AS best_score FROM two WHERE fingerprint NOT IN (SELECT fingerprint FROM one) GROUP BY 1"))
def fingerprints_only_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = runs(spark, sf_dir)
    return rounded(compare.fingerprints_only_in(second, first), "best_score")


@query(compare_sql("SELECT eval_key AS eval_dataset FROM one UNION SELECT eval_key FROM two"))
def all_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.all_suites(*runs(spark, sf_dir))


# --- H: normalization of eval sets


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text) AS question FROM conversations GROUP BY conv_id")
def concat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns.select("conv_id", normalize.concat_messages(F.col("messages")).alias("question"))


def _bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.split(text.clean_text(F.col("text")), " "), 1, 4).alias("choices"), (F.col("item_id") % 4).alias("at"))


BENCH_WORDS = f"bw AS (SELECT item_id, list_slice(string_split({clean_sql('text')}, ' '), 1, 4) AS choices, item_id % 4 AS pick FROM benchmark)"


@query(with_sql(BENCH_WORDS, select="SELECT item_id, CAST(i AS INTEGER) AS sub_index, choices[i + 1] AS answer, i = pick AS is_correct FROM (SELECT *, unnest(range(len(choices))) AS i FROM bw)"))
def expand_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bench_words(spark, sf_dir).withColumn("key", F.chr(F.col("at") + 65))
    return normalize.expand_choices(rows, "choices", "key").select("item_id", "sub_index", "answer", "is_correct")


@query(with_sql(BENCH_WORDS, select="SELECT item_id, choices[pick + 1] AS answer FROM bw"))
def indexed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.indexed(_bench_words(spark, sf_dir).withColumn("key", F.col("at").cast("string")), "choices", "key").select("item_id", "answer")


@query(with_sql(BENCH_WORDS, select="SELECT item_id, CAST(i AS INTEGER) AS sub_index, choices[i + 1] AS answer, i = pick AS is_correct FROM (SELECT *, unnest(range(4)) AS i FROM bw) WHERE choices[i + 1] IS NOT NULL"))
def expand_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bench_words(spark, sf_dir).select("item_id", *[F.try_element_at("choices", F.lit(i + 1)).alias(f"opt{i + 1}") for i in range(4)], F.col("at").alias("key"))
    return normalize.expand_prefix(rows, "opt", "key", "add_one").select("item_id", "sub_index", "answer", "is_correct")


@query(with_sql(BENCH_WORDS, select="SELECT item_id, CAST(i AS INTEGER) AS sub_index, choices[i + 1] AS question, list_reverse(choices)[i + 1] AS answer FROM (SELECT *, unnest(range(len(choices))) AS i FROM bw)"))
def parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bench_words(spark, sf_dir).withColumn("answers", F.reverse("choices"))
    return normalize.parallel_arrays(rows, "choices", "answers").select("item_id", "sub_index", "question", "answer")


@query("SELECT c_custkey, CAST(i AS INTEGER) AS sub_index, CASE WHEN i = 0 THEN c_name ELSE c_mktsegment END AS answer FROM customer, range(2) AS r(i) WHERE trim(CASE WHEN i = 0 THEN c_name ELSE c_mktsegment END) <> ''")
def answers_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.answers_by_field(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]).select("c_custkey", "sub_index", "answer")


@query("SELECT role AS eval_key, count(*) AS n_rows, count(s) AS n_question, min(s) AS min_question, round(avg(s), 6) AS avg_question, max(s) AS max_question FROM (SELECT role, CASE WHEN trim(coalesce(text, '')) <> '' THEN octet_length(encode(text)) END AS s FROM conversations WHERE trim(coalesce(role, '')) <> '') GROUP BY role")
def eval_stats_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("eval_key"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("passage"))
    return rounded(normalize.eval_length_stats(rows).select("eval_key", "n_rows", "n_question", "min_question", "avg_question", "max_question"), "avg_question")


@query("SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def eval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), none.alias("answer"), none.alias("passage"), F.lit("test").alias("split"))
    return normalize.with_ids(rows, ["item_id"]).select("item_id", "doc_id", "fingerprint")


# --- I: beyond SQL


@query()
def walked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the sampled walk."""
    found = built(spark, sf_dir)
    return rounded(clusters.walked_clusters(clusters.training_tokens(documents(spark, sf_dir), Options()), found), "matched_idf")


def _tokens(name: str) -> None:
    def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sievelight.functions.tokenizers import tokenize

        rows = table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))
        return rows.select("doc_id", tokenize(F.col("clean"), name).alias("tokens")).select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("digest"))

    QUERIES[f"{name}_tokens"] = tokens


for _name in ("r50k", "uniseg", "bytes"):
    _tokens(_name)

ORACLE["bytes_tokens"] = f"""WITH h AS (SELECT doc_id, hex(encode(coalesce({clean_sql("text")}, ''))) AS h FROM documents)
SELECT doc_id, CAST(length(h) // 2 AS INTEGER) AS n_tokens, sha256(array_to_string(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER)), ',')) AS digest FROM h"""


HIGHLIGHT_SQL = """, hl AS (SELECT k, doc_id, eval_id, dw, start AS q0, CASE WHEN answer_start <= "end" + 4 AND cluster_tokens > question_tokens THEN answer_start - 1 ELSE "end" + 4 END AS q1, passage_start AS p0, passage_end AS p1, answer_start, aw FROM det),
spans AS (SELECT k, s, x FROM ar UNION ALL SELECT sa.k, sa.i, sa.i + len(c.aw) - 1 FROM sa JOIN c USING (k)),
ends AS (SELECT k, max(x) AS a1 FROM spans GROUP BY k),
marked AS (SELECT k, s, string_agg(t, ' ' ORDER BY o) AS t FROM (
  SELECT k, s, 1 AS o, array_to_string(list_slice(dw, before + 2, s), ' ') AS t FROM (SELECT hl.k, dw, s, coalesce(lag(x) OVER (PARTITION BY hl.k ORDER BY s), q1) AS before FROM hl JOIN spans USING (k)) WHERE before + 1 < s
  UNION ALL SELECT k, s, 2, '⟦' || array_to_string(list_slice(dw, s + 1, x + 1), ' ') || '⟧' FROM hl JOIN spans USING (k)) GROUP BY k, s),
answers_marked AS (SELECT k, string_agg(t, ' ' ORDER BY s) AS t FROM marked GROUP BY k)
SELECT doc_id AS training_line, eval_id AS eval_line, concat_ws(' ',
  CASE WHEN greatest(q0 - 30, 0) < least(q0, coalesce(p0, q0)) THEN '... ' || array_to_string(list_slice(dw, greatest(q0 - 30, 0) + 1, least(q0, coalesce(p0, q0))), ' ') END,
  CASE WHEN p1 < q0 THEN '⟨' || array_to_string(list_slice(dw, p0 + 1, p1 + 1), ' ') || '⟩' END, CASE WHEN p1 + 1 < q0 THEN array_to_string(list_slice(dw, p1 + 2, q0), ' ') END,
  '【' || array_to_string(list_slice(dw, q0 + 1, q1 + 1), ' ') || '】', answers_marked.t,
  CASE WHEN coalesce(a1, q1) < least(coalesce(a1, q1) + 60, len(dw) - 1) THEN array_to_string(list_slice(dw, coalesce(a1, q1) + 2, least(coalesce(a1, q1) + 60, len(dw) - 1) + 1), ' ') || ' ...' END) AS training_overlap_text
FROM hl LEFT JOIN ends USING (k) LEFT JOIN answers_marked USING (k)"""


@query(detect_sql("qap", "§").replace(" §", HIGHLIGHT_SQL))
def highlight_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir, "qap").select("training_line", "eval_line", "training_overlap_text")


@query(detect_sql("q", 'SELECT doc_id, eval_id, start, "end", round(contamination_score, 6) AS contamination_score FROM det'))
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection as a stream over the documents' files, its reports read back."""
    import tempfile
    import uuid

    from sievelight.streaming.detect import detect_stream, read_folder

    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    root = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    docs = read_folder(spark, f"{sf_dir}/documents.parquet*", table(spark, sf_dir, "documents").schema)
    detect_stream(docs.select("doc_id", "text"), built(spark, sf_dir), f"{root}/reports", f"{root}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/reports").select("doc_id", "eval_id", "start", "end", "contamination_score"), "contamination_score")
