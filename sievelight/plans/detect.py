"""Detection: clusters of hits, two early gates, answers and passages, the score, one match per place."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sievelight.config import Options
from sievelight.functions.scoring import base_score, final_score, threshold_by_length
from sievelight.functions.text import highlight_pieces, marked, snippet
from sievelight.functions.tokenizers import decode_each
from sievelight.operators import spans
from sievelight.operators.clusters import gap_clusters, hit_documents, hits_of, needed_hits, training_tokens, walked_clusters
from sievelight.operators.index import Index


#: Where documents with hits are kept, which clusters and answers read: what memory cannot hold is on disk.
HELD = StorageLevel.MEMORY_AND_DISK


def search(docs: DataFrame, *indexes: Index) -> DataFrame | None:
    """The documents with hits of small indexes with one tokenizer and n, kept until they are unpersisted; None if an index is not small."""
    if not all(x.small for x in indexes):
        return None
    return hit_documents(training_tokens(docs, indexes[0].options), *indexes).persist(HELD)


def observed(df: DataFrame, counters: dict[str, Observation] | None, name: str, **metrics: Column) -> DataFrame:
    """``df``, whose rows are counted as they pass if counters are asked for."""
    if counters is None:
        return df
    counters[name] = Observation(name)
    return df.observe(counters[name], *[m.alias(k) for k, m in metrics.items()])


def ratio(part: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, part / total).otherwise(0.0)


def question_overlaps(clusters: DataFrame, index: Index) -> DataFrame:
    """Clusters with their row's counts and the weighted share of its n-grams that matched."""
    o = index.options
    found = clusters.join(index.near(index.stats), "eval_id")
    length = F.col("end") + o.ngram_size - F.col("start")
    return found.withColumn("idf_overlap", ratio(F.col("matched_idf"), F.col("question_idf_sum"))).withColumn("cluster_tokens", length)


def gates(overlaps: DataFrame, index: Index) -> DataFrame:
    """The least weighted share first, then the one that the question's length asks for."""
    return overlaps.where(F.col("idf_overlap") >= index.options.minimum_question_idf).where(F.col("idf_overlap") >= needed_share(index.options))


def needed_share(o: Options) -> Column:
    """The weighted share that a question's length asks for, a little less for rounding."""
    return threshold_by_length(F.col("question_tokens"), o.perfect_match_decay_start, o.perfect_match_decay_end, o.minimum_question_idf) - 1e-9


def with_answers(found: DataFrame, index: Index) -> DataFrame:
    """Adds answer_boundaries and answer_idf_overlap, from the tokens after the cluster."""
    o = index.options
    tokens, total = F.col("tokens"), F.col("answer_total")
    excess = F.greatest(F.col("cluster_tokens") - F.col("question_tokens"), F.lit(0))
    question_end = F.greatest(F.col("end") + o.ngram_size - 1 - excess, F.lit(0))
    short = (total > 0) & (total <= o.short_answer_token_threshold)
    found = found.withColumn("answer_from", question_end)
    exact = spans.short_answer(tokens, F.col("a_tokens"), F.col("answer_from"), o)
    found = found.withColumn("answer_hits", F.when((total > o.short_answer_token_threshold) & (F.coalesce("answer_idf_sum", F.lit(0.0)) != 0), spans.long_answer_hits(tokens, F.col("answer_ngrams"), spans.answer_window(total, o), F.col("answer_from"), o)))
    found = found.withColumn("answer_boundaries", F.when(short, exact).when(F.size("answer_hits") > 0, spans.answer_ranges(F.col("answer_hits"), o.answer_ngram_size)))
    share = ratio(spans.weight_found(F.col("answer_ngrams"), spans.grams_at(tokens, F.col("answer_hits"), o.answer_ngram_size)), F.col("answer_idf_sum"))
    overlap = F.when(F.col("answer_boundaries").isNull(), 0.0).when(short, F.when(F.coalesce("short_answer_idf", F.lit(0.0)) > 0, 1.0).otherwise(0.0)).otherwise(share)
    inside = F.flatten(F.transform(F.coalesce("answer_boundaries", F.array().cast(spans.SPANS)), lambda s: F.slice(tokens, s["start"] + 1, s["end"] - s["start"] + 1)))
    window = F.slice(tokens, F.col("answer_from") + 2, spans.answer_window(total, o))
    display = spans.share_of(F.when(F.col("answer_boundaries").isNotNull(), inside).otherwise(window), F.col("a_tokens"))
    return found.withColumn("answer_idf_overlap", F.when(total > 0, overlap)).withColumn("answer_overlap_ratio", F.when(total > 0, display)).drop("answer_hits")


def with_passages(found: DataFrame, index: Index) -> DataFrame:
    """Adds passage (start, end) and passage_idf_overlap, from the tokens before the cluster."""
    o = index.options
    tokens, total = F.col("tokens"), F.col("passage_total")
    hits = F.when(F.coalesce("passage_idf_sum", F.lit(0.0)) != 0, spans.passage_hits(tokens, F.col("passage_ngrams"), spans.passage_window(total, o), F.col("start"), o))
    found = found.withColumn("passage_hits", hits)
    seen = F.size("passage_hits") > 0
    edge = F.struct(F.element_at("passage_hits", 1).alias("start"), (F.element_at("passage_hits", -1) + o.passage_ngram_size - 1).alias("end"))
    share = ratio(spans.weight_found(F.col("passage_ngrams"), spans.grams_at(tokens, F.col("passage_hits"), o.passage_ngram_size)), F.col("passage_idf_sum"))
    found = found.withColumn("passage", F.when(seen, edge)).withColumn("passage_idf_overlap", F.when(total > 0, F.when(seen, share).otherwise(0.0)))
    inside = F.when(seen, F.slice(tokens, F.col("passage.start") + 1, F.col("passage.end") - F.col("passage.start") + 1)).otherwise(F.array().cast("array<string>"))
    return found.withColumn("passage_overlap_ratio", F.when(total > 0, spans.share_of(inside, F.col("p_tokens")))).drop("passage_hits")


def scored(found: DataFrame, index: Index) -> DataFrame:
    o = index.options
    has_answer, has_passage = F.col("answer_total") > 0, F.col("passage_total") > 0
    base = base_score(F.col("idf_overlap"), F.col("answer_idf_overlap"), F.col("passage_idf_overlap"), F.col("unique_ngrams"), F.col("answer_unique"), has_answer, has_passage)
    length = F.col("question_tokens") + F.col("answer_unique") + F.col("passage_total")
    return found.withColumn("contamination_score", final_score(base, length, o.perfect_match_decay_start, o.perfect_match_decay_end, o.contamination_score_threshold))


def one_per_place(matches: DataFrame) -> DataFrame:
    """Of matches of one eval instance at one place of a document the best score, then the least row."""
    order = Window.partitionBy("doc_id", "eval_key", "eval_instance_index", "start").orderBy(F.desc("contamination_score"), "eval_id")
    return matches.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def candidates(docs: DataFrame, index: Index, walked: bool = False, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokens of the documents (of a small index, of those with hits), and clusters that pass both gates."""
    tokens = training_tokens(docs, index.options)
    if not index.small:
        return tokens, gates(question_overlaps(gap_clusters(needed_hits(tokens, index, needed_share(index.options)), index.options), index), index)
    found = search(docs, index) if found is None else found
    clusters = walked_clusters(tokens, index) if walked else gap_clusters(hits_of(found, index), index.options)
    return found, gates(question_overlaps(clusters, index), index)


def detect(docs: DataFrame, index: Index, *, walked: bool = False, counters: dict[str, Observation] | None = None, found: DataFrame | None = None) -> DataFrame:
    """Matches of ``docs`` (doc_id, text, ...) with all scores; the tokens that join back are those of documents with hits, shuffled once.

    ``counters`` gets observations, which have values once the matches are computed: of clusters that
    passed the gates, how many lack an answer or a passage that their row has, and of matches.
    ``found``: the documents with hits, if another run has them already.
    """
    tokens, passed = candidates(docs, index, walked, found)
    keyed = tokens.select("doc_id", "tokens")
    found = with_passages(with_answers(passed.join(keyed, "doc_id"), index), index)
    found = observed(
        found, counters, "candidates", n=F.count(F.lit(1)), no_answer=F.count_if((F.col("answer_total") > 0) & F.col("answer_boundaries").isNull()), no_passage=F.count_if((F.col("passage_total") > 0) & F.col("passage").isNull())
    )
    threshold = index.options.contamination_score_threshold
    matches = scored(found, index).where(F.col("contamination_score") >= threshold - 1e-9)
    return one_per_place(observed(matches, counters, "matches", n=F.count(F.lit(1))))


def report(matches: DataFrame, docs: DataFrame, index: Index) -> DataFrame:
    """Report rows: bounds, scores, texts and the eval row's metadata, joined late."""
    o = index.options
    begin, end = F.col("start"), F.col("end") + o.ngram_size - 1
    head = F.element_at("answer_boundaries", 1)["start"]
    question_end = F.when((head <= end) & (F.col("cluster_tokens") > F.col("question_tokens")), head - 1).otherwise(end)
    files = docs.select("doc_id", *[c for c in ("training_file", "training_line") if c in docs.columns])
    meta = index.evals.select("eval_id", "split", "reference_file", "fingerprint", "is_correct", *[snippet(F.col(f"c_{c}")).alias(f"eval_{c}_text") for c in ("question", "answer", "passage")])
    rows = matches.join(files, "doc_id").join(index.near(meta), "eval_id", "left")
    rows = rows.withColumn("pieces", highlight_pieces(F.col("tokens"), begin, question_end, F.col("passage"), F.col("answer_boundaries")))
    rows = rows.withColumn("piece_texts", decode_each(F.transform("pieces", lambda p: p["tokens"]), o.tokenizer))
    score = o.contamination_score_threshold
    return rows.select(
        *[F.col(c) for c in files.columns], F.col("eval_key").alias("eval_dataset"), "eval_key", "eval_line", "eval_instance_index", "split", "reference_file", F.lit("simple").alias("method"),
        F.col("ngram_match_cnt"), F.col("unique_ngrams").alias("eval_unique_ngrams"), "contamination_score",
        threshold_by_length(F.col("question_tokens"), o.perfect_match_decay_start, o.perfect_match_decay_end, score).alias("length_adjusted_question_threshold"), "idf_overlap",
        begin.cast("long").alias("question_start_idx"), question_end.cast("long").alias("question_end_idx"), F.col("cluster_tokens").cast("long").alias("cluster_token_length"), F.col("question_tokens").cast("long").alias("eval_token_length"),
        (F.col("cluster_tokens") - F.col("question_tokens")).alias("token_length_delta"), "answer_overlap_ratio", "answer_idf_overlap",
        head.cast("long").alias("answer_start_idx"), F.element_at("answer_boundaries", -1)["end"].cast("long").alias("answer_end_idx"),
        F.transform("answer_boundaries", lambda s: F.array(s["start"].cast("long"), s["end"].cast("long"))).alias("answer_boundaries"), "passage_overlap_ratio", "passage_idf_overlap",
        F.col("passage.start").cast("long").alias("passage_start_idx"), F.col("passage.end").cast("long").alias("passage_end_idx"),
        marked(F.col("pieces"), F.col("piece_texts"), " " if o.tokenizer == "word" else "").alias("training_overlap_text"),
        F.nullif("eval_question_text", F.lit("")).alias("eval_question_text"), F.nullif("eval_answer_text", F.lit("")).alias("eval_answer_text"), F.nullif("eval_passage_text", F.lit("")).alias("eval_passage_text"), "fingerprint", "is_correct",
    )


def purify(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents without a match."""
    return docs.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")


def run_totals(docs: DataFrame, matches: DataFrame, index: Index) -> DataFrame:
    """Matches, contaminated documents, sources with matches, and documents long enough to be searched."""
    files = docs.select("doc_id", "training_file")
    found = matches.join(files, "doc_id").agg(F.count("*").alias("n_matches"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("training_file").alias("n_files"))
    return found.crossJoin(training_tokens(docs, index.options).agg(F.count("*").alias("documents_processed")))  # one row each
