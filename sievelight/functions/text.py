"""Cleaning, word tokens and shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.config import PUNCTUATION


def clean_text(text: Column, punctuation: str = PUNCTUATION) -> Column:
    """Lower case, punctuation to blanks, runs of Unicode white space to one blank, trimmed."""
    blank = F.translate(F.lower(text), punctuation, " " * len(punctuation))
    return F.trim(F.regexp_replace(blank, r"(?U)\s+", " "))


def word_tokens(clean: Column) -> Column:
    """Words of a cleaned text; none of an empty or null one."""
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(tokens: Column, n: int, short: bool = False) -> Column:
    """Every n consecutive tokens, as a text; ``short``: fewer tokens make one shingle of all."""
    every = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    less = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>")) if short else F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, every).otherwise(less)


def snippet(clean: Column, words: int = 1_000) -> Column:
    return F.array_join(F.slice(F.split(clean, " "), 1, words), " ")


def fingerprint(passage: Column, question: Column, answer: Column) -> Column:
    """First 16 hex digits of SHA-256 of the three texts end to end, nulls empty."""
    return F.substring(F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in (passage, question, answer)]), 256), 1, 16)


def nested_text(raw: Column, key: str) -> Column:
    """The string at a dotted path of a JSON text, where a number is a place in an array; null where there is none or it is no string."""
    path = "$" + "".join(f"[{k}]" if k.isdigit() else f".{k}" for k in key.split("."))
    value = F.try_variant_get(F.try_parse_json(raw), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(raw, path))


def nested_field(column: Column, path: str) -> Column:
    """The value at a dotted path of a struct or an array, where a number is a place in it, from 0; null past its end."""
    for k in path.split("."):
        column = F.get(column, int(k)) if k.isdigit() else column[k]
    return column


def thousands(number: Column) -> Column:
    """A count with a comma before every three digits."""
    return F.format_number(number, 0)


#: Brackets of highlights: of the passage, the question and an answer.
BRACKETS = {"passage": "⟨⟩", "question": "【】", "answer": "⟦⟧"}
#: Terminal colours that take their place.
COLOURS = {"passage": 34, "question": 31, "answer": 32}


def ansi_highlight(text: Column) -> Column:
    """A highlighted text for terminals: colours in place of the brackets."""
    for name, (opens, closes) in BRACKETS.items():
        text = F.replace(F.replace(text, F.lit(opens), F.lit(f"\033[{COLOURS[name]}m")), F.lit(closes), F.lit("\033[0m"))
    return text


def highlight_pieces(tokens: Column, start: Column, end: Column, passage: Column | None = None, answers: Column | None = None, before: int = 30, after: int = 60) -> Column:
    """Pieces (kind and tokens) around a match in their order: before it, the passage, what follows, the question, each answer after what is between, after it."""
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.slice(tokens, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int")).alias("tokens"))
    passage = F.lit(None).cast("struct<start:int,end:int>") if passage is None else passage
    answers = F.lit(None).cast("array<struct<start:int,end:int>>") if answers is None else answers
    ahead = passage.isNotNull() & (passage["end"] < start)
    first = F.when(passage.isNotNull(), F.least(passage["start"], start)).otherwise(start)
    spans = F.coalesce(answers, F.array().cast("array<struct<start:int,end:int>>"))
    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], end)
    lead, tail = F.greatest(start - before, F.lit(0)), F.least(last + after, F.size(tokens) - 1)
    heads = [F.when(lead < first, piece("before", lead, first)), F.when(ahead, piece("passage", passage["start"], passage["end"] + 1)), F.when(ahead, piece("between", passage["end"] + 1, start)), piece("question", start, end + 1)]
    ends = F.concat(F.array(end), F.transform(spans, lambda s: s["end"]))
    each = F.flatten(F.transform(spans, lambda s, i: F.array(piece("between", F.element_at(ends, i + 1) + 1, s["start"]), piece("answer", s["start"], s["end"] + 1))))
    pieces = F.concat(F.array(*heads), each, F.array(F.when(last < tail, piece("after", last + 1, tail + 1))))
    return F.filter(pieces, lambda p: p.isNotNull() & (F.size(p["tokens"]) > 0))


def highlight(tokens: Column, start: Column, end: Column, passage: Column | None = None, answers: Column | None = None, before: int = 30, after: int = 60) -> Column:
    """Words around a match: the passage in angle, the question in lenticular, answers in white square brackets."""
    pieces = highlight_pieces(tokens, start, end, passage, answers, before, after)
    return marked(pieces, F.transform(pieces, lambda p: F.array_join(p["tokens"], " ")), " ")


def marked(pieces: Column, texts: Column, glue: str) -> Column:
    """The pieces' texts with brackets around passage, question and answers, and dots where the document goes on."""

    def shown(kind: Column, text: Column) -> Column:
        out = F.when(kind == "before", F.concat(F.lit("... "), text)).when(kind == "after", F.concat(F.lit("" if glue else " "), text, F.lit(" ...")))
        for name, (opens, closes) in BRACKETS.items():
            out = out.when(kind == name, F.concat(F.lit(opens), text, F.lit(closes)))
        return out.otherwise(text)

    return F.array_join(F.zip_with(F.transform(pieces, lambda p: p["kind"]), texts, shown), glue)
