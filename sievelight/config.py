"""Detection options, with defaults, and a loader of flat YAML files."""

from __future__ import annotations

import string
from dataclasses import dataclass, fields, replace

#: ASCII punctuation and five typographic marks.
PUNCTUATION = string.punctuation + "\u2019\u201d\u201c\u2018\u2014"


@dataclass(frozen=True)
class Options:
    content_key: str = "text"
    tokenizer: str = "word"
    ngram_size: int = 5
    sample_every_m_tokens: int = 10
    question_max_consecutive_misses: int = 11
    contamination_score_threshold: float = 0.8
    perfect_match_decay_start: int | None = 20
    perfect_match_decay_end: int | None = 50
    short_answer_token_threshold: int = 3
    short_answer_window_length: int = 50
    answer_ngram_size: int = 3
    min_long_answer_window: int = 100
    min_passage_distance: int = 100
    passage_ngram_size: int = 4
    passage_max_consecutive_misses: int = 2
    eval_dedup: bool = True
    eval_min_token_length: int = 20
    eval_min_unique_word_count: int = 4
    index_passages: bool = True
    index_answers: bool = True
    punctuation_chars: str = PUNCTUATION
    purify: bool = False
    hot_threshold: int | None = None  # None: by the number of indexed rows

    def __post_init__(self):
        if self.sample_every_m_tokens < 1 or self.ngram_size < 1:
            raise ValueError("sampling interval and n-gram size must be positive")
        a, b = self.perfect_match_decay_start, self.perfect_match_decay_end
        if a is not None and b is not None and b < a:
            raise ValueError("perfect_match_decay_end is below perfect_match_decay_start")

    @property
    def minimum_question_idf(self) -> float:
        return max(0.0, (self.contamination_score_threshold - 0.3) / 0.7)


def load_options(path: str, **overrides) -> Options:
    """Options of a YAML file; unknown keys are ignored, arguments win."""
    import yaml

    with open(path) as file:
        given = yaml.safe_load(file) or {}
    given = {("tokenizer" if k == "tokenizer_str" else k): v for k, v in given.items()}
    known = {f.name for f in fields(Options)}
    return replace(Options(), **{k: v for k, v in {**given, **overrides}.items() if k in known and (v is not None or "decay" in k)})
