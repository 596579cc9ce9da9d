"""Eval rows from raw datasets: answers, choices, parallel arrays, messages, fingerprints, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import fingerprint


def meaningful(answer: Column) -> Column:
    return answer.isNotNull() & (F.trim(answer) != "")


def binary_to_bool(value: Column) -> Column:
    return F.when(value.cast("string").isin("1", "true", "True"), "true").when(value.cast("string").isin("0", "false", "False"), "false")


def date_answer(date: Column) -> Column:
    """"month day year" of a date's non-empty parts."""
    return F.nullif(F.concat_ws(" ", *[F.nullif(F.trim(date[k]), F.lit("")) for k in ("month", "day", "year")]), F.lit(""))


def answers_by_field(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row for every configured field that holds a meaningful answer; sub_index counts the fields."""
    every = F.array(*[F.col(c).cast("string") for c in fields])
    return rows.select("*", F.posexplode(every).alias("sub_index", "answer")).where(meaningful(F.col("answer")))


def label_index(key: Column) -> Column:
    """Index of a letter or number key."""
    text = F.upper(F.trim(key.cast("string")))
    return F.when(text.rlike("^[A-Z]$"), F.ascii(text) - 65).otherwise(text.try_cast("int"))


def expand_choices(rows: DataFrame, choices: str, key: str) -> DataFrame:
    """A row for each choice: sub_index, answer and is_correct, by a letter or number key."""
    return rows.select("*", F.posexplode(choices).alias("sub_index", "answer")).withColumn("is_correct", F.col("sub_index") == label_index(F.col(key)))


def expand_labelled(rows: DataFrame, choices: str, key: str) -> DataFrame:
    """As expand_choices, of a struct of texts and labels."""
    pairs = F.arrays_zip(F.col(f"{choices}.text").alias("text"), F.col(f"{choices}.label").alias("label"))
    out = rows.select("*", F.posexplode(pairs).alias("sub_index", "pair"))
    return out.withColumn("answer", F.col("pair.text")).withColumn("is_correct", F.col("pair.label") == F.col(key).cast("string")).drop("pair")


def expand_prefix(rows: DataFrame, prefix: str, key: str, transform: str = "numbers_to_letters") -> DataFrame:
    """A row for each column that starts with the prefix, in order of its suffix."""
    names = sorted(c for c in rows.columns if c.startswith(prefix))
    pairs = F.array(*[F.struct(F.lit(c.removeprefix(prefix)).alias("label"), F.col(c).cast("string").alias("text")) for c in names])
    k = F.col(key)
    wanted = {"numbers_to_letters": lambda: F.chr(k.cast("int") + 64), "index_to_letter": lambda: F.chr(k.cast("int") + 65), "add_one": lambda: (k.cast("int") + 1).cast("string"), "binary_to_bool": lambda: binary_to_bool(k), "none": lambda: k.cast("string")}[transform]()
    out = rows.select("*", F.posexplode(pairs).alias("sub_index", "pair")).where(meaningful(F.col("pair.text")))
    return out.withColumn("answer", F.col("pair.text")).withColumn("is_correct", F.upper("pair.label") == F.upper(wanted)).drop("pair")


def indexed(rows: DataFrame, choices: str, key: str) -> DataFrame:
    """The answer that a letter or number key picks from an array."""
    at = label_index(F.col(key))
    return rows.withColumn("answer", F.when((at >= 0) & (at < F.size(choices)), F.try_element_at(choices, (at + 1).cast("int"))))


def indexed_prefix(rows: DataFrame, prefix: str, key: str) -> DataFrame:
    """The answer in the column named by the prefix and the key."""
    out = F.lit(None).cast("string")
    for c in rows.columns:
        if c.startswith(prefix):
            out = F.when(F.col(key).cast("string") == c.removeprefix(prefix), F.col(c).cast("string")).otherwise(out)
    return rows.withColumn("answer", out)


def parallel_arrays(rows: DataFrame, prompts: str, answers: str) -> DataFrame:
    zipped = F.arrays_zip(F.col(prompts).alias("question"), F.col(answers).alias("answer"))
    return rows.select("*", F.posexplode(zipped).alias("sub_index", "z")).withColumn("question", F.col("z.question")).withColumn("answer", F.col("z.answer")).drop("z")


def concat_messages(messages: Column, append: Column | None = None) -> Column:
    """Contents of messages joined by a blank, and another text after them."""
    joined = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    return joined if append is None else F.concat_ws(" ", joined, append)


def with_ids(rows: DataFrame, order: list[str], no_answer_splits: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a question, answers hidden in some splits, fingerprints, and ids from 1 in the given order.

    The numbering sorts all rows in one place: eval sets are small by their nature.
    """
    kept = rows.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    if no_answer_splits:
        kept = kept.withColumn("answer", F.when(~F.coalesce(F.col("split").isin(*no_answer_splits), F.lit(False)), F.col("answer")))
    kept = kept.withColumn("fingerprint", fingerprint(F.col("passage"), F.col("question"), F.col("answer")))
    return kept.withColumn("doc_id", F.row_number().over(Window.orderBy(*order)))


def eval_length_stats(rows: DataFrame) -> DataFrame:
    """Per suite: numbers of non-blank texts and their least, mean and greatest size in bytes."""
    out = [F.count("*").alias("n_rows")]
    for c in ("question", "answer", "passage"):
        size = F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.octet_length(c))
        out += [F.count(size).alias(f"n_{c}"), F.min(size).cast("long").alias(f"min_{c}"), F.avg(size).alias(f"avg_{c}"), F.max(size).cast("long").alias(f"max_{c}")]
    return rows.where(F.trim(F.coalesce("eval_key", F.lit(""))) != "").groupBy("eval_key").agg(*out)
