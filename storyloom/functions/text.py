"""Text expressions. Lengths are UTF-8 bytes; whitespace is Unicode White_Space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts and limits that results must carry exactly.
SUMMARY_UNAVAILABLE = "summary unavailable"
SUMMARY_FILTERED_OUT = "Summary content was filtered out - please check model configuration"
REASONING_TAGS = ("think", "thinking", "reason", "analysis")
MAX_ARTICLE_BYTES = 10_000
MAX_SUMMARY_WORDS = 200
WORD_SLACK = 20
STANDALONE_MAX_WORDS = 100
ELLIPSIS = "..."
SUMMARY_PROMPT = (
    "Please provide a concise summary of the following article in exactly %d words or less. "
    "The summary should be:\n"
    "- Written in clear, simple language that non-technical users can understand\n"
    "- Focused on the main points and key takeaways\n"
    "- Objective and factual\n"
    "- Complete sentences with proper grammar\n"
    "\n"
    "Article text:\n"
    "%s\n"
    "\n"
    "Summary:"
)
STANDALONE_PROMPT = (
    "Please provide a concise summary of the following article in exactly %d words or less. "
    "The summary should be:\n"
    "- Written in clear, simple language suitable for Discord posting\n"
    "- Focused on the main points and key takeaways\n"
    "- Objective and factual\n"
    "- Complete sentences with proper grammar\n"
    "- Easy to read and understand\n"
    "\n"
    "Article text:\n"
    "%s\n"
    "\n"
    "Summary:"
)

# ASCII blanks, as a `\s` without Unicode mode matches them.
_ASCII_WS = r"[\t\n\f\r ]"


def trim_ws(c: Column) -> Column:
    return F.regexp_extract(c, r"(?Us)^\s*(.*\S)?", 1)


def is_blank(c: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(trim_ws(c), F.lit("")) == ""


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def limit_words(c: Column, max_words: int = MAX_SUMMARY_WORDS, slack: int = WORD_SLACK) -> Column:
    """Cut to ``max_words`` once a text runs more than ``slack`` words over."""
    w = words(c)
    cut = F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.lit(ELLIPSIS))
    return F.when(F.size(w) > max_words + slack, cut).otherwise(c)


def safe_truncate(c: Column, n: int) -> Column:
    """At most ``n`` bytes, never ending inside a character."""
    if n <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    raw = F.encode(F.substring(c, 1, n + 1), "UTF-8")  # n bytes never reach past n characters

    def inside_char(back: int) -> Column:
        return F.hex(F.substring(raw, n + 1 - back, 1)).between("80", "BF")

    deepest = min(3, n)  # a character has at most three continuation bytes
    cut = F.lit(n - deepest)
    for back in range(deepest - 1, -1, -1):
        cut = F.when(~inside_char(back), F.lit(n - back)).otherwise(cut)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def clip_bytes(c: Column, n: int) -> Column:
    """``safe_truncate`` that marks the cut with dots."""
    return F.when(F.octet_length(c) > n, F.concat(safe_truncate(c, n), F.lit(ELLIPSIS))).otherwise(c)


def truncate_words(c: Column, n: int) -> Column:
    """At most ``n`` bytes including dots, cut at the last space when that lies past the middle."""
    head = safe_truncate(c, n - 3)
    tail = F.substring_index(head, " ", -1)
    last_space = F.octet_length(head) - F.octet_length(tail) - 1
    at_space = F.substring(head, F.lit(1), F.length(head) - F.length(tail) - 1)
    body = F.when((F.instr(head, " ") > 0) & (last_space > n // 2), at_space).otherwise(head)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(body, F.lit(ELLIPSIS)))


def sanitize_utf8(raw: Column) -> Column:
    """Drop byte sequences that are not UTF-8. A genuine U+FFFD in the input is dropped as well."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))


def content_hash(title: Column, url: Column, content: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, url, content)]
    return F.sha2(F.concat(*parts), 256)


def clean_summary(c: Column) -> Column:
    """Remove reasoning blocks, then stray tags, then squeeze blanks."""
    tagged = c
    for tag in REASONING_TAGS:
        close = rf"</{tag}{_ASCII_WS}*>"
        tagged = F.regexp_replace(tagged, rf"(?isu)<{tag}{_ASCII_WS}*>.*?{close}", "")
        tagged = F.regexp_replace(tagged, rf"(?iu)</?{tag}{_ASCII_WS}*>", "")
    # Nothing is removed from a text without any of the names, so no tag can come about in it either.
    c = F.when(c.rlike(rf"(?iu)</?(?:{'|'.join(REASONING_TAGS)})"), tagged).otherwise(c)
    c = trim_ws(F.regexp_replace(c, rf"{_ASCII_WS}+", " "))
    return F.regexp_replace(c, r"\A\z", SUMMARY_FILTERED_OUT)


def summary_prompt(
    text: Column,
    max_words: int = MAX_SUMMARY_WORDS,
    max_bytes: int = MAX_ARTICLE_BYTES,
    template: str = SUMMARY_PROMPT,
) -> Column:
    before, after = template.replace("%d", str(max_words)).split("%s")
    return F.concat(F.lit(before), clip_bytes(text, max_bytes), F.lit(after))


def summary_or_fallback(summary: Column) -> Column:
    return F.coalesce(summary, F.lit(SUMMARY_UNAVAILABLE))
