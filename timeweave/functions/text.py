"""Text expressions: tokens, answer normalisation, labels, keys, formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions.dates import group

# ---- Fixed values: stop words, articles, topic labels ------------------------------------
STOP_WORDS = ["the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were"]
STOP_WORDS_LONG = STOP_WORDS + [
    "be", "been", "being", "with", "by", "at", "from", "that", "this", "it", "as", "but", "if", "about", "into", "than",
    "then", "so", "such", "not", "no", "do", "does", "did",
]
ARTICLES = ["a", "an", "the", "and"]
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
TOPICS = [
    "personal_details", "family", "professional_details", "sports", "travel", "food", "music", "health", "technology",
    "hobbies", "fashion", "entertainment", "milestones", "user_preferences", "misc",
]
# -----------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def word_set(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Distinct words without stop words."""
    return F.array_except(words(text), F.array(*[F.lit(w) for w in stop_words]))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def normalize_answer(text: Column) -> Column:
    """Lower, drop punctuation, drop a/an/the/and as whole words, squeeze spaces."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    edge = r"[\p{L}\p{N}_]"
    return squeeze(F.regexp_replace(bare, rf"(?<!{edge})(?:{'|'.join(ARTICLES)})(?!{edge})", " "))


def answer_tokens(text: Column) -> Column:
    """Tokens of the normalised answer; an empty answer has none."""
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def bleu_tokens(text: Column) -> Column:
    """Words and single punctuation marks of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1)


def token_count(text: Column) -> Column:
    """Length in words and punctuation marks: the engine's stand-in for model tokens."""
    return F.size(bleu_tokens(text))


def topic_label(text: Column) -> Column:
    """Exact snake-case label, else the first label contained in the text, else misc."""
    low = F.lower(F.coalesce(text, F.lit("")))
    snake = F.regexp_replace(F.regexp_replace(F.trim(low), r"[^a-z_]+", "_"), r"_+", "_")
    snake = F.btrim(snake, F.lit("_"))
    inside = F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in TOPICS], F.lit("misc"))
    return F.when(snake.isin(*TOPICS), snake).otherwise(inside)


def clean_key(text: Column, keep: str = r"A-Za-z0-9_.\-", default: str = "default") -> Column:
    """Characters outside ``keep`` become one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(text), rf"[^{keep}]+", "_"), F.lit("")), F.lit(default))


def content_key(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def prediction_source(file_name: Column) -> Column:
    """``retrieval_X.jsonl`` -> X, else baseline / enhanced when named, else unknown."""
    stem = F.lower(F.regexp_replace(F.substring_index(file_name, "/", -1), r"\.[^.]*$", ""))
    return (
        F.when(stem.startswith("retrieval_"), F.regexp_replace(stem, "^retrieval_", ""))
        .when(stem.contains("baseline"), "baseline").when(stem.contains("enhanced"), "enhanced").otherwise("unknown")
    )


def session_number(session_id: Column, trailing: bool = False) -> Column:
    """``session_7`` -> 7 and ``7`` -> 7; ``trailing`` also reads ``c1_session7``."""
    pattern = r"(\d+)$" if trailing else r"^(?:session_)?(\d+)(?:_.*)?$"
    return group(session_id, pattern, 1).try_cast("int")


def retrieval_text(content: Column | None, topic: Column, descriptions: Column, first_n: int | None = None, topic_last: bool = False) -> Column:
    """Text a block is embedded by: content, topic keywords, first event descriptions.

    ``content=None`` leaves the content out; ``first_n`` keeps the first events only;
    ``topic_last`` is the order content, events, topic.
    """
    shown = F.filter(F.coalesce(descriptions, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    shown = shown if first_n is None else F.slice(shown, 1, first_n)
    events = F.array_join(shown, " | ")
    parts = [topic, events] if not topic_last else [events, topic]
    if content is not None:
        parts = [content, *parts]
    return F.trim(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def time_range(start: Column, end: Column) -> Column:
    """``a to b``, a single date, or an empty text."""
    s, e = F.trim(F.coalesce(start, F.lit(""))), F.trim(F.coalesce(end, F.lit("")))
    return F.when((s != "") & (e != "") & (s != e), F.concat_ws(" to ", s, e)).when(s != "", s).otherwise(e)


def time_meta(event_start: Column, event_end: Column, block_start: Column, block_end: Column, source: Column) -> Column:
    """``event_time=…`` or else ``observed_time=…``, then ``time_source=…``."""
    own, seen = time_range(event_start, event_end), time_range(block_start, block_end)
    when = F.when(own != "", F.concat(F.lit("event_time="), own)).when(seen != "", F.concat(F.lit("observed_time="), seen))
    origin = F.when(F.trim(F.coalesce(source, F.lit(""))) != "", F.concat(F.lit("time_source="), F.trim(source)))
    return F.concat_ws(", ", when, origin)


def fact_text(source: Column, relationship: Column, destination: Column) -> Column:
    """``src rel dst``; empty when any part is missing."""
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in (source, relationship, destination)]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.concat_ws(" ", *parts)).otherwise("")
