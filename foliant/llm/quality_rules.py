"""Line-first quality rules, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Short lines that carry one of these are page furniture (fixed values).
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy", "read more", "sign up", "subscribe now", "terms of service", "terms of use",
)
BOILERPLATE_CHARS = 120
#: A line fails if more than this share of its characters are symbols.
SYMBOL_SHARE = 0.05
#: A line fails as a navigation bar with this many separators, if they come at most NAV_CHARS characters apart.
NAV_MARKS, NAV_CHARS = 3, 30
#: A line fails as shouting with this many capitals, if they are more than this share of its characters.
SHOUT_CAPITALS, SHOUT_SHARE = 10, 0.4
#: Marks of punctuation, and those that may end a sentence (fixed values, for a character class).
PUNCTUATION = r"!-/:-@\[-`{-~¡«·»¿‐-‧‹›、。〈-】！，．：；？"
SENTENCE_ENDS = r".!?:;…。！？．：；।؟"
#: What may follow a sentence's end on its line: closing quotes, brackets and spaces.
CLOSERS = r"\x22\x27”’»›)\]}*_\x20\x09-\x0D"
#: A line fails as punctuation with this many marks, if they are this share of its characters or more.
PUNCTUATION_MARKS, PUNCTUATION_SHARE = 4, 0.25
#: A line of at most so many characters that ends no sentence and holds no end of one fails as a fragment: a menu item, a button, a label.
FRAGMENT_CHARS = 60
#: A document that loses more than this share of its characters goes.
LOST_SHARE = 0.4


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base measures, lines that failed, kept, and the cleaned text.

    Each line is held against rules for punctuation (lines of marks alone or
    nearly so, short lines that end no sentence), navigation (bars), symbols,
    capitals and boilerplate. None but the last knows a language. Failing
    lines are removed, and a document goes if it loses more than LOST_SHARE of
    the characters of its lines. base_failed (fewer than 50 words, or more
    than half of them in repeated 3-word windows) rules out kept.

    All of it is a projection: no shuffle, whatever the sources' shares. A
    null or empty text has no words and fails; a line without a word is blank
    and fails no rule. Very long texts cost n log n in their words. Null ids,
    repeated rows and clashing columns pass through untouched, as rows are
    handled one by one and other columns aren't read. An empty table gives no
    rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "text", F.expr(f"array_remove(split(text, r'{WORD_SPLIT}'), '')").alias("words"), F.split("text", "\n").alias("lines"),
        # Two passes, the first of them cheap, leave each line's capitals and marks, a small part of the text, for the rules.
        F.split(F.regexp_replace(F.regexp_replace("text", "[a-z ]+", ""), rf"[^\p{{Lu}}#*$%&|<>»·•{PUNCTUATION}\n]+", ""), "\n").alias("marks"),
    )
    rows = rows.withColumn("judged", F.expr(f"zip_with(lines, marks, (l, m) -> named_struct('l', l, 'f', {line_fails('l', 'm')}))"))
    rows = rows.select(
        "doc_id", "lines", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(F.array_join("marks", ""), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(r"filter(lines, l -> l rlike r'[^\x20\x09-\x0D]')").alias("solid"),
        F.expr("CASE WHEN size(words) < 3 THEN array() ELSE slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, size(words) - 2) END").alias("windows"),
        F.expr("filter(judged, x -> x.f).l").alias("failed"), F.expr("filter(judged, x -> NOT x.f).l").alias("clean"),
    )
    rows = rows.withColumn("sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) END"))
    rows = rows.withColumn("twice", F.expr("filter(sorted, (x, j) -> x.h <=> get(sorted, j - 1).h OR x.h <=> get(sorted, j + 1).h)"))
    covered = F.expr("greatest(size(array_distinct(flatten(transform(twice, x -> array(x.i, x.i + 1, x.i + 2))))), 0)")
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("solid") - F.size(F.array_distinct("solid"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size("solid").cast("long").alias("n_lines"), F.size("failed").cast("long").alias("n_failed_lines"),
        F.length(F.array_join("failed", "")).cast("long").alias("lost_chars"), F.length(F.array_join("lines", "")).alias("line_chars"), F.array_join("clean", "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & (F.col("lost_chars") <= LOST_SHARE * F.col("line_chars"))).alias("kept"), "n_lines", "n_failed_lines", "lost_chars", "clean_text",
    )


def line_fails(line: str, marks: str) -> str:
    """SQL for whether a line fails a rule; ``marks`` are its capitals, symbols and punctuation in order."""
    symbols = f"length(regexp_replace({marks}, r'[^#*$%&|<>]+', ''))"
    bars = f"length(regexp_replace({marks}, r'[^|>»·•]+', ''))"
    capitals = rf"length(regexp_replace({marks}, r'[^\p{{Lu}}]+', ''))"
    punctuation = f"length(regexp_replace({marks}, r'[^{PUNCTUATION}]+', ''))"
    quoted = "'" + "|".join(BOILERPLATE) + "'"
    sentence = rf"r'[{SENTENCE_ENDS}](?:[{CLOSERS}]|\z)'"
    return (
        f"(CASE WHEN length({marks}) = 0 THEN false ELSE {symbols} > {SYMBOL_SHARE} * length({line}) OR {bars} >= greatest({NAV_MARKS}, length({line}) / {NAV_CHARS}D)"
        f" OR {capitals} >= greatest({SHOUT_CAPITALS}, {SHOUT_SHARE}D * length({line})) OR {punctuation} >= greatest({PUNCTUATION_MARKS}, {PUNCTUATION_SHARE}D * length({line})) END"
        rf" OR (length({line}) <= {FRAGMENT_CHARS} AND {line} rlike r'[^\x20\x09-\x0D]' AND NOT {line} rlike {sentence})"
        f" OR (length({line}) <= {BOILERPLATE_CHARS} AND lower({line}) rlike {quoted}))"
    )
