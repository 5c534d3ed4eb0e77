"""Text expressions: strip, names, clean-up, token labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.constants import (
    CHARS_PER_SECOND,
    LABEL_CASES,
    LABEL_MARKS,
    SPACED_DASH,
)

# Every character that Python's ``str.strip`` removes (all lie below U+3001).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Unicode-aware strip; the built-in trim without a set takes spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last ``.ext`` of the name, lower-cased; empty without one.

    A leading dot starts a hidden name and a trailing dot ends a name: neither is a suffix.
    """
    return F.lower(F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def done_key(path: Column) -> Column:
    """Resume key: file name without directory, case-insensitive."""
    return F.lower(basename(forward_slashes(path)))


def collapse_double_spaces(text: Column) -> Column:
    """One left-to-right pass: three spaces become two."""
    return F.replace(text, F.lit("  "), F.lit(" "))


def truncate_words(text: Column, max_chars: int | None) -> Column:
    """Cut to ``max_chars`` and drop the last, possibly cut, word; hard cut without a space."""
    if not max_chars:
        return text
    head = F.left(text, F.lit(max_chars))
    return F.when(
        F.length(text) > max_chars, F.regexp_replace(head, r" [^ ]*$", "")
    ).otherwise(text)


def clean_transcript(text: Column, max_chars: int | None = None) -> Column:
    return truncate_words(
        collapse_double_spaces(strip(F.coalesce(text, F.lit("")))), max_chars
    )


def speech_seconds(text: Column) -> Column:
    return F.greatest(F.lit(1.0), F.length(text) / F.lit(CHARS_PER_SECOND))


def enhanced_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_enhanced.wav"))


def upload_name(name: Column) -> Column:
    return F.concat(F.lit("upload_"), name)


def hex_id() -> Column:
    """Random 32-digit id. Write the rows out before using it twice: it is drawn per evaluation."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def is_language(hint: Column, detected: Column, language: str = "ru") -> Column:
    """The hint decides; the detected language counts only without a hint."""
    return F.when(hint.isNull(), F.coalesce(detected == language, F.lit(False))).otherwise(
        hint == language
    )


def label_table(spark: SparkSession) -> DataFrame:
    """label, case_mode, mark: three case modes times the marks (33 rows)."""
    rows = []
    for case in LABEL_CASES:
        for mark, text in LABEL_MARKS.items():
            spaced = mark == "TIRE" and case != "LOWER"
            rows.append((f"{case}_{mark}", case, SPACED_DASH if spaced else text))
    return spark.createDataFrame(rows, "label string, case_mode string, mark string")


def capitalise(word: Column) -> Column:
    """First letter in upper case, the rest lower; a letter whose upper form is two letters keeps
    only the first of them large."""
    head = F.upper(F.left(word, F.lit(1)))
    return F.concat(
        F.left(head, F.lit(1)),
        F.lower(F.substring(head, 2, 2)),
        F.lower(F.substring(word, 2, 2**30)),
    )


def apply_case(word: Column, case_mode: Column) -> Column:
    return (
        F.when(case_mode == "UPPER", capitalise(word))
        .when(case_mode == "UPPER_TOTAL", F.upper(word))
        .otherwise(word)
    )


def labelled_token(word: Column, label: Column) -> Column:
    """Token text for one (word, label); null for an unknown label.

    The label names are regular, so the case part and the mark come from the label itself and
    no join is needed.
    """
    case_mode = F.regexp_extract(label, r"^(UPPER_TOTAL|UPPER|LOWER)_", 1)
    mark = F.regexp_replace(label, r"^(UPPER_TOTAL|UPPER|LOWER)_", "")
    marks = F.create_map(*[F.lit(x) for pair in LABEL_MARKS.items() for x in pair])
    text = F.when((mark == "TIRE") & (case_mode != "LOWER"), F.lit(SPACED_DASH)).otherwise(
        F.try_element_at(marks, mark)
    )
    return F.when(case_mode != "", F.concat(apply_case(word, case_mode), text))


def render_tokens(tokens: Column) -> Column:
    """Text of an ``array<struct<word,label>>``: every token with a leading blank. Null as soon as
    one label is unknown, as the whole text then fails."""
    words = F.transform(
        tokens, lambda t: F.concat(F.lit(" "), labelled_token(strip(t["word"]), t["label"]))
    )
    return F.when(~F.exists(words, lambda w: w.isNull()), F.array_join(words, ""))
