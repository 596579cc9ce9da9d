"""The evaluation index: filtered rows, postings, document frequencies, weights."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.config import Options
from sievelight.functions.matching import NgramSet
from sievelight.functions.scoring import idf
from sievelight.functions.text import clean_text, shingles
from sievelight.functions.tokenizers import blank_token, tokenize

#: Bytes of postings up to which they are broadcast; beyond, both sides of the probe are shuffled.
BROADCAST_BYTES = 256 << 20

EVAL_COLUMNS = {
    "eval_id": "long", "eval_key": "string", "eval_line": "long", "eval_instance_index": "long", "split": "string", "fingerprint": "string", "is_correct": "boolean",
    "reference_file": "string", "question": "string", "answer": "string", "passage": "string",
}


def eval_rows(raw: DataFrame) -> DataFrame:
    """Rows of any source in the columns of the index, the missing ones null."""
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EVAL_COLUMNS.items()])


def combined(options: Options) -> Column:
    """Cleaned passage, question and answer, joined by a blank, empty ones left out."""
    parts = ([F.col("c_passage")] if options.index_passages else []) + [F.col("c_question")] + ([F.col("c_answer")] if options.index_answers else [])
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in parts])


def cleaned_evals(raw: DataFrame, options: Options) -> DataFrame:
    """Rows in the columns of the index with their cleaned texts and all words of these."""
    rows = eval_rows(raw)
    for c in ("question", "answer", "passage"):
        rows = rows.withColumn(f"c_{c}", clean_text(F.coalesce(F.col(c), F.lit("")), options.punctuation_chars))
    return rows.withColumn("all_words", F.filter(F.split(combined(options), " "), lambda w: w != ""))


def enough_tokens(options: Options) -> Column:
    """Whether a row has enough tokens of the options' tokenizer, blanks alone not counted."""
    if not options.eval_min_token_length:
        return F.lit(True)
    size = F.size("all_words") if options.tokenizer == "word" else F.size(F.filter(tokenize(combined(options), options.tokenizer), lambda t: ~blank_token(t, options.tokenizer)))
    return size >= options.eval_min_token_length


def enough_words(options: Options) -> Column:
    return F.size(F.array_distinct("all_words")) >= options.eval_min_unique_word_count if options.eval_min_unique_word_count else F.lit(True)


def without_copies(rows: DataFrame) -> DataFrame:
    """The first row of each fingerprint of a suite; rows without a fingerprint are never copies: each is a group of its own."""
    place = Window.partitionBy("eval_key", "fingerprint", F.when(F.col("fingerprint").isNull(), F.col("eval_id"))).orderBy(F.col("reference_file").asc_nulls_first(), F.col("eval_line").asc_nulls_first(), "eval_id")
    return rows.withColumn("copy", F.row_number().over(place)).where("copy = 1 OR fingerprint IS NULL").drop("copy")


def filtered_evals(raw: DataFrame, options: Options) -> DataFrame:
    """Cleaned rows that pass the token and word filters, without repeated fingerprints, and with a question."""
    rows = cleaned_evals(raw, options).where(enough_tokens(options)).where(enough_words(options))
    if options.eval_dedup:
        rows = without_copies(rows)
    return rows.where("c_question <> ''").drop("all_words")


@dataclass
class Index:
    evals: DataFrame  # with q_tokens, a_tokens, p_tokens
    size: int  # indexed rows
    postings: DataFrame  # ngram, eval_id, idf, is_hot
    stats: DataFrame  # eval_id and its counts and sums
    options: Options
    small: bool  # whether postings may be broadcast

    def ngram_set(self, *others: Index) -> NgramSet:
        """The n-grams of the questions, and of those of other indexes with this n, on the driver: for small indexes only."""
        every = {id(x.evals): x for x in (self, *others)}.values()
        if not all(x.small for x in every):
            raise ValueError("the index is too large for the driver")
        lists = [x.evals.select("q_tokens").toArrow().column(0).combine_chunks() for x in every]
        return NgramSet.of(pa.concat_arrays([c for x in lists for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]), self.options.ngram_size)

    def release(self) -> None:
        """Give back what the index keeps in memory."""
        for df in (self.evals, self.postings, self.stats):
            df.unpersist()

    def near(self, df: DataFrame) -> DataFrame:
        """A side of a join that is broadcast if the index is small enough."""
        return F.broadcast(df) if self.small else df


def ngram_postings(evals: DataFrame, tokens: str, n: int, short: bool) -> DataFrame:
    return evals.select(F.explode(F.array_distinct(shingles(F.col(tokens), n, short))).alias("ngram"), "eval_id")


def with_df(postings: DataFrame, size: int) -> DataFrame:
    """The postings with df and idf of their n-grams, counted where they meet: a count that is joined back takes a second shuffle."""
    return postings.withColumn("df", F.count("*").over(Window.partitionBy("ngram"))).withColumn("idf", idf(F.lit(float(size)), F.col("df")))


def token_idf(evals: DataFrame, size: int) -> DataFrame:
    """token, df and idf, where a row counts once for each field that holds the token."""
    fields = [evals.select(F.explode(F.array_distinct(c)).alias("token")) for c in ("q_tokens", "a_tokens", "p_tokens")]
    return fields[0].unionAll(fields[1]).unionAll(fields[2]).groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", idf(F.lit(float(size)), F.col("df")))


def ordered_sum(values: Column) -> Column:
    """A sum whose last digits do not depend on the order of rows."""
    return F.aggregate(F.array_sort(F.collect_list(values)), F.lit(0.0), lambda a, x: a + x)


def hot_threshold(size: int, options: Options) -> int:
    return options.hot_threshold if options.hot_threshold is not None else max(2_000, 2 * int(size**0.5))


def tokenized(evals: DataFrame, options: Options) -> DataFrame:
    empty = F.lit("")
    return (
        evals.withColumn("q_tokens", tokenize(F.col("c_question"), options.tokenizer))
        .withColumn("a_tokens", tokenize(F.col("c_answer") if options.index_answers else empty, options.tokenizer))
        .withColumn("p_tokens", tokenize(F.col("c_passage") if options.index_passages else empty, options.tokenizer))
    )


def build_index(raw: DataFrame, options: Options | None = None) -> Index:
    options = options or Options()
    evals = tokenized(filtered_evals(raw, options), options).cache()
    size, text_bytes = evals.agg(F.count("*"), F.coalesce(F.sum(F.length("c_question") + F.length("c_answer") + F.length("c_passage")), F.lit(0))).first()
    own = ngram_postings(evals, "q_tokens", options.ngram_size, short=True)
    postings = with_df(own, max(size, 1)).select("ngram", "eval_id", "df", "idf", (F.col("df") > hot_threshold(size, options)).alias("is_hot")).cache()
    questions = postings.groupBy("eval_id").agg(F.count("*").alias("unique_ngrams"), ordered_sum(F.col("idf")).alias("question_idf_sum"))
    answers = _weighted(evals.where(F.size("a_tokens") > options.short_answer_token_threshold), "a_tokens", options.answer_ngram_size, max(size, 1), "answer")
    passages = _weighted(evals, "p_tokens", options.passage_ngram_size, max(size, 1), "passage")
    tokens = token_idf(evals, max(size, 1))
    short = evals.where((F.size("a_tokens") > 0) & (F.size("a_tokens") <= options.short_answer_token_threshold)).select("eval_id", F.explode(F.array_distinct("a_tokens")).alias("token"))
    short = short.join(tokens, "token").groupBy("eval_id").agg(ordered_sum(F.col("idf")).alias("short_answer_idf"))
    stats = evals.select(
        "eval_id", "eval_key", "eval_instance_index", "eval_line", "q_tokens", "a_tokens", "p_tokens",
        F.size("q_tokens").alias("question_tokens"), F.size("a_tokens").alias("answer_total"), F.size(F.array_distinct("a_tokens")).alias("answer_unique"), F.size("p_tokens").alias("passage_total"),
    )
    for part in (questions, answers, passages, short):
        stats = stats.join(part, "eval_id", "left")
    return Index(evals, size, postings, stats.cache(), options, 12 * text_bytes <= BROADCAST_BYTES)


def _weighted(evals: DataFrame, tokens: str, n: int, size: int, name: str) -> DataFrame:
    """eval_id with its n-grams of a field and their weights, and the sum of these."""
    own = ngram_postings(evals, tokens, n, short=False)
    return with_df(own, size).groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct("ngram", "idf"))).alias(f"{name}_ngrams"), ordered_sum(F.col("idf")).alias(f"{name}_idf_sum"))


def df_histogram(df: DataFrame) -> DataFrame:
    """Number of n-grams by size of their posting set."""
    return df_classes(df, F.count("*"))


def df_classes(df: DataFrame, total: Column) -> DataFrame:
    """A total of rows by class of df."""
    bucket = F.when(F.col("df") == 1, "1").when(F.col("df") <= 10, "2-10").when(F.col("df") <= 100, "11-100").when(F.col("df") <= 1000, "101-1000").otherwise(">1000")
    return df.groupBy(bucket.alias("bucket")).agg(total.alias("n_ngrams"))


def df_summary(df: DataFrame) -> DataFrame:
    """Count, mean, upper median and maximum of posting sizes."""
    return df.agg(F.count("*").alias("n_ngrams"), F.avg("df").alias("mean_df"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY df DESC)").cast("long").alias("median_df"), F.max("df").alias("max_df"))


def hot_ngrams(df: DataFrame, limit: int = 100) -> DataFrame:
    return df.orderBy(F.desc("df"), "ngram").limit(limit).select("ngram", "df")


def build_stats(raw: DataFrame, options: Options) -> DataFrame:
    """Rows examined, skipped for each reason, and indexed, counted in one pass."""
    judged = cleaned_evals(raw, options).select("eval_key", "fingerprint", (F.col("c_question") != "").alias("asks"), enough_tokens(options).alias("long"), enough_words(options).alias("rich"))
    fits = F.col("long") & F.col("rich")
    key = F.when(fits & F.col("fingerprint").isNotNull(), F.struct("eval_key", "fingerprint"))
    groups = judged.groupBy(key.alias("key")).agg(
        F.count("*").alias("examined"), F.count_if(F.col("asks") & ~F.col("long")).alias("few_tokens"), F.count_if(F.col("asks") & F.col("long") & ~F.col("rich")).alias("few_words"),
        F.count_if(F.col("asks") & fits).alias("fit"),
    )
    copies = F.when(F.col("key").isNotNull() & F.lit(options.eval_dedup), F.greatest(F.col("fit") - 1, F.lit(0))).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(
        total("examined").alias("examined"), total("few_tokens").alias("skipped_few_tokens"), total("few_words").alias("skipped_few_words"), total(copies).alias("skipped_duplicate"), total(F.col("fit") - copies).alias("indexed"),
    )
