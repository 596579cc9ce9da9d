"""Eval rows from raw datasets by a catalog of configurations.

An entry names the fields of prompt, passage and answers. Every way to get answers becomes an array
of candidates in a column expression; the arrays are concatenated and exploded, so a dataset is
made in one pass over its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.text import fingerprint
from sievelight.operators.normalize import date_answer

CANDIDATE = "struct<question:string,answer:string,sub_index:int,is_correct:boolean>"


class Field:
    """A value at a dotted path of a row, where a number is a place in an array."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    @staticmethod
    def of(schema: T.StructType, path: str | None) -> Field | None:
        """None if the rows have no such field."""
        found: Field | None = None
        for part in path.split(".") if path else []:
            if part.isdigit():
                if found is None or not isinstance(found.kind, T.ArrayType):
                    return None
                found = Field(F.get(found.column, int(part)), found.kind.elementType)
                continue
            inside = schema if found is None else found.kind
            if not isinstance(inside, T.StructType) or part not in inside.names:
                return None
            found = Field(F.col(f"`{part}`") if found is None else found.column[part], inside[part].dataType)
        return found

    def text(self) -> Column:
        return F.to_json(self.column) if isinstance(self.kind, (T.ArrayType, T.StructType, T.MapType)) else self.column.cast("string")

    def meaningful(self) -> Column:
        """Not null, not blank, and (of a struct) with some part that is not empty."""
        if isinstance(self.kind, T.StructType):
            parts = [F.coalesce(self.column[n].cast("string") if not isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.to_json(self.column[n]), F.lit("")) for n, f in zip(self.kind.names, self.kind.fields, strict=True)]
            return self.column.isNotNull() & (F.concat(F.lit(""), *parts) != "")
        return self.column.isNotNull() & (F.trim(self.text()) != "")


def _none() -> Column:
    return F.array().cast(f"array<{CANDIDATE}>")


def _candidate(answer: Column, *, question: Column | None = None, sub_index: Column | None = None, is_correct: Column | None = None) -> Column:
    null = F.lit(None)
    values = zip(("question", "answer", "sub_index", "is_correct"), (question, answer, sub_index, is_correct), ("string", "string", "int", "boolean"), strict=True)
    return F.struct(*[(null if v is None else v).cast(kind).alias(name) for name, v, kind in values])


def _if(condition: Column, answer: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_candidate(answer))).otherwise(_none())


def _whole(value: Field) -> Column:
    """A value as a whole number, null if it is none."""
    return value.text().try_cast("int")


def _place(key: Field) -> Column:
    """A place in an array by a letter or a number."""
    text = key.text()
    return F.when(text.rlike("^[A-Za-z]$"), F.ascii(F.upper(text)) - 65).otherwise(_whole(key))


def simple_answer(schema: T.StructType, path: str) -> Column:
    value = Field.of(schema, path)
    if value is None:
        return _none()
    if isinstance(value.kind, T.StructType) and "answer.date" in path:
        date = date_answer(value.column)
        return _if(date.isNotNull(), date)
    return _if(value.meaningful(), value.text())


def transformed_answer(schema: T.StructType, config: dict) -> Column:
    value = Field.of(schema, config["field"])
    if value is None:
        return _none()
    text = value.text()
    if config["transform"] == "binary_to_bool":
        number = _whole(value)
        text = F.when(number.isNull(), text).when(number == 1, "true").otherwise("false")
    return _if(value.meaningful(), text)


def every_choice(schema: T.StructType, config: dict) -> Column:
    """A candidate for each choice; is_correct by a label, a letter or a number."""
    choices, key = Field.of(schema, config.get("field")), Field.of(schema, config.get("correct_index"))
    if choices is None:
        return _none()
    if isinstance(choices.kind, T.StructType) and "text" in choices.kind.names:
        texts, labels = choices.column["text"], choices.column["label"] if "label" in choices.kind.names else None
        right = lambda i: (F.get(labels, i).cast("string") == key.text()) if key is not None and labels is not None else F.lit(None)
    elif isinstance(choices.kind, T.ArrayType):
        texts = choices.column
        numeric = key is not None and isinstance(key.kind, T.IntegralType)
        place = None if key is None else key.column if numeric else F.when(key.text().rlike("^[A-Za-z]$"), F.ascii(F.upper(key.text())) - 65)
        right = lambda i: i == place if place is not None else F.lit(None)
    else:
        return _none()
    return F.coalesce(F.transform(texts, lambda x, i: _candidate(x.cast("string"), is_correct=right(i))), _none())


def relabelled(key: Field, transform: str | None) -> Column:
    """A key as the suffix of a field name."""
    text, number = key.text(), _whole(key)
    ways = {
        "numbers_to_letters": F.when(number >= 1, F.chr(number + 64)), "index_to_letter": F.when(number >= 0, F.chr(number + 97)), "add_one": (number + 1).cast("string"),
        "binary_to_bool": F.when(number == 1, "true").when(number.isNotNull(), "false"),
    }
    return F.coalesce(ways[transform], text) if transform in ways else text


def indexed_answer(schema: T.StructType, config: dict) -> Column:
    """The answer that a key picks: from fields that share a prefix, or from an array."""
    key = Field.of(schema, config.get("key_field"))
    if key is None:
        return _none()
    if prefix := config.get("prefix"):
        wanted, out = relabelled(key, config.get("label_transform")), F.lit(None).cast("string")
        for name in schema.names:
            if name.startswith(prefix):
                out = F.when(wanted == name.removeprefix(prefix), Field.of(schema, name).text()).otherwise(out)
        return _if(F.trim(out) != "", out)
    choices = Field.of(schema, config.get("field"))
    if choices is None or not isinstance(choices.kind, T.ArrayType):
        return _none()
    place = _place(key)
    value = F.when(place >= 0, F.get(choices.column, place)).cast("string")
    return _if(F.trim(value) != "", value)


def every_prefix(schema: T.StructType, config: dict) -> Column:
    """A candidate for each field that starts with a prefix, in the order of what follows it."""
    prefix, key = config.get("prefix"), Field.of(schema, config.get("suffix_match_field"))
    names = sorted(n for n in schema.names if prefix and n.startswith(prefix) and n != prefix)
    if not names or not config.get("suffix_match_field"):
        return _none()
    wanted = relabelled(key, config.get("label_transform")) if key is not None else F.lit(None)
    made = [_candidate(Field.of(schema, n).text(), is_correct=F.lit(n.removeprefix(prefix)) == wanted) for n in names]
    return F.filter(F.array(*made), lambda x: x["answer"].isNotNull())


def answers_of(schema: T.StructType, item: str | dict) -> Column:
    """Candidates of one way to get answers."""
    if isinstance(item, str):
        return simple_answer(schema, item)
    if "field" in item and "transform" in item and "key_field" not in item:
        return transformed_answer(schema, item)
    for name, way in (("expand_choices", every_choice), ("indexed", indexed_answer), ("expand_prefix", every_prefix)):
        if name in item:
            return way(schema, item[name])
    if "field" in item:  # the older form: a field, or an array and the field of a key
        return indexed_answer(schema, item) if item.get("key_field") else simple_answer(schema, item["field"])
    return _none()


def parallel(schema: T.StructType, prompts: dict, answers: list) -> Column:
    """A candidate for each prompt of an array, with the answer at its place; sub_index counts the prompts."""
    questions = Field.of(schema, prompts["array"])
    if questions is None:
        return _none()
    found = next((Field.of(schema, a["array"]) for a in answers if isinstance(a, dict) and "array" in a), None)
    listed = lambda f: f.column if isinstance(f.kind, T.ArrayType) else F.array(f.column)
    given = listed(found) if found is not None else None
    each = F.transform(listed(questions), lambda q, i: _candidate(F.get(given, i).cast("string") if given is not None else F.lit(None), question=q.cast("string"), sub_index=i))
    return F.coalesce(F.filter(each, lambda x: F.trim(F.coalesce(x["question"], F.lit(""))) != ""), _none())


def prompt_of(schema: T.StructType, config: str | dict | None) -> Column:
    null = F.lit(None).cast("string")
    if isinstance(config, dict) and "concat_messages" in config:
        given = config["concat_messages"] or {}
        messages = Field.of(schema, given.get("field", "messages"))
        if messages is None or not isinstance(messages.kind, T.ArrayType):
            return null
        name = given.get("content_field", "content")
        contents = F.filter(F.transform(messages.column, lambda m: m[name].cast("string")), lambda c: c.isNotNull() & (c != ""))
        more = Field.of(schema, config.get("append_field"))
        return F.nullif(F.concat_ws(" ", F.nullif(F.array_join(contents, " "), F.lit("")), *([F.nullif(more.text(), F.lit(""))] if more else [])), F.lit(""))
    field = Field.of(schema, config.get("field") if isinstance(config, dict) else config)
    return field.text() if field is not None else null


def dataset_rows(raw: DataFrame, name: str, config: dict, split: str, index: str | None = None) -> DataFrame:
    """Eval rows of one split of a dataset; a row without any answer stays, without one. ``index``: a column that numbers the rows."""
    schema = raw.schema
    prompts, answers = config.get("prompts", config.get("prompt")), config.get("answers", config.get("answer")) or []
    answers = answers if isinstance(answers, list) else [answers]
    if isinstance(prompts, dict) and "array" in prompts:
        every, prompt = parallel(schema, prompts, answers), F.lit(None).cast("string")
    else:
        every, prompt = F.concat(_none(), *[answers_of(schema, a) for a in answers]), prompt_of(schema, prompts)
    passage = config.get("passage")
    passage = Field.of(schema, passage) if isinstance(passage, str) else None
    number = F.col(index) if index else F.monotonically_increasing_id()
    rows = raw.select(
        number.cast("long").alias("eval_instance_index"), prompt.alias("prompt"), (passage.text() if passage is not None else F.lit(None).cast("string")).alias("passage"),
        F.posexplode(F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(None).cast(CANDIDATE)))).alias("place", "x"),
    )
    hidden = F.lit(None).cast("string") if split in config.get("no_answer_splits", []) else F.col("x.answer")
    rows = rows.select(
        F.lit(name).alias("eval_key"), "eval_instance_index", F.lit(split).alias("split"), F.coalesce("x.question", "prompt").alias("question"), "passage", hidden.alias("answer"), F.lit(config.get("hf_config")).cast("string").alias("config"),
        "x.sub_index", "x.is_correct", "place",
    )
    rows = rows.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    return rows.withColumn("fingerprint", fingerprint(F.col("passage"), F.col("question"), F.col("answer")))


def load_catalog(path: str) -> dict[str, dict]:
    """Entries of a YAML catalog by name."""
    import yaml

    with open(path) as file:
        return (yaml.safe_load(file) or {}).get("evals", {})


def read_local(spark: SparkSession, config: dict, split: str) -> DataFrame | None:
    """A dataset of a local JSONL file, which has one split, train; None for others."""
    return spark.read.json(config["local_path"]) if "local_path" in config and split == "train" else None


def build_datasets(spark: SparkSession, catalog: dict[str, dict], write: Callable[[DataFrame, str, str], None], read: Callable[[SparkSession, dict, str], DataFrame | None] = read_local, bundled: str | None = None, path: str | None = None) -> dict[str, list[str]]:
    """Make every dataset of a catalog: ``write`` gets the rows, the name and the split; the splits made of each name.

    Entries whose local_path is ``bundled_evals/`` and a prefix name finished files: those under the
    folder ``bundled`` are copied below ``path``.
    """
    made: dict[str, list[str]] = {}
    for name, config in catalog.items():
        local = config.get("local_path", "")
        if local.startswith("bundled_evals/") and local.endswith("_"):
            made[name] = copy_bundled(spark, bundled, local.rpartition("/")[2], name, path) if bundled and path else []
            continue
        for split in config.get("splits", []):
            raw = read(spark, config, split)
            if raw is not None:
                write(dataset_rows(raw, name, config, split), name, split)
                made.setdefault(name, []).append(split)
    return made


def copy_bundled(spark: SparkSession, folder: str, prefix: str, name: str, path: str) -> list[str]:
    """Copy gzipped files that start with a prefix, which the dataset's name takes the place of."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    files, out = at(folder).getFileSystem(conf), []
    for status in files.listStatus(at(folder)) if files.exists(at(folder)) else []:
        file = status.getPath().getName()
        if file.startswith(prefix) and file.endswith(".jsonl.gz"):
            target = file if prefix == f"{name}_" else f"{name}_{file.removeprefix(prefix)}"
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, status.getPath(), at(path, target).getFileSystem(conf), at(path, target), False, conf)
            out.append(target)
    return sorted(out)
