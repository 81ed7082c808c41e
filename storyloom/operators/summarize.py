"""Summaries and vectors for pending articles, through pluggable models."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from storyloom.functions.text import (
    MAX_SUMMARY_WORDS,
    SUMMARY_UNAVAILABLE,
    WORD_SLACK,
    clean_summary,
    is_blank,
    limit_words,
    summary_prompt,
    trim_ws,
)
from storyloom.operators.ledger import call_once
from storyloom.session import bound_batches

MAX_RETRIES = 3

# Attempt outcomes, as stored in the summary log.
SUCCESS, RETRY_FAILED, FAILED = "success", "retry_failed", "failed"
EMPTY_TEXT = "empty article text"
EMPTY_ANSWER = "received empty summary"
IN_DOUBT = "the attempt was cut off"

Summarizer = Callable[[str, str], str]  # (prompt, article text) -> raw answer
Embedder = Callable[[str], "np.ndarray"]

_ATTEMPT_SCHEMA = (
    "id long, article_url string, status string, raw string, error_message string, "
    "duration_ms int, retry_attempt int"
)


def lead_sentences(prompt: str, text: str, sentences: int = 3) -> str:
    """Default summarizer: the first sentences of the article."""
    return " ".join(re.split(r"(?<=[.!?])\s+", text.strip())[:sentences])


def word_hash_vector(text: str, dims: int = 64) -> np.ndarray:
    """Default embedder: signed word counts in hash slots."""
    vector = np.zeros(dims, dtype=np.float32)
    for word in text.lower().split():
        h = int.from_bytes(md5(word.encode("utf-8", "replace")).digest()[:4], "big")
        vector[h % dims] += 1.0 if h >> 31 else -1.0
    return vector


def pending_summary(articles: DataFrame) -> DataFrame:
    return articles.filter(~is_blank(F.col("full_content")) & F.col("summary").isNull())


def _attempts(summarizer: Summarizer, max_retries: int):
    def ask(row) -> list[tuple]:
        if row.blank:
            return [(row.id, row.url, FAILED, None, EMPTY_TEXT, 0, 0)]
        rows, begun, error = [], time.monotonic(), ""
        for attempt in range(1, max_retries + 1):
            start = time.monotonic()
            try:
                raw = summarizer(row.prompt, row.full_content).strip()
                if not raw:
                    raise ValueError(EMPTY_ANSWER)
                ms = int((time.monotonic() - start) * 1000)
                return [*rows, (row.id, row.url, SUCCESS, raw, "", ms, attempt)]
            except Exception as exc:  # any model failure counts as one failed attempt
                error = str(exc)
                ms = int((time.monotonic() - start) * 1000)
                rows.append((row.id, row.url, RETRY_FAILED, None, error, ms, attempt))
        total = int((time.monotonic() - begun) * 1000)
        return [*rows, (row.id, row.url, FAILED, None, error, total, max_retries)]

    columns = [c.split()[0] for c in _ATTEMPT_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([out for row in pdf.itertuples(index=False) for out in ask(row)], columns=columns)

    return run


def summary_attempts(
    articles: DataFrame,
    summarizer: Summarizer = lead_sentences,
    model: str = "lead-sentences",
    max_words: int = MAX_SUMMARY_WORDS,
    max_retries: int = MAX_RETRIES,
    slack: int = WORD_SLACK,
    tasks: int | None = None,
) -> DataFrame:
    """One log row per attempt, plus a final ``failed`` row when every attempt failed.

    ``articles``: id, url, full_content. Answers are cleaned and cut to ``max_words``. ``tasks``
    sets how many model calls run side by side. The model is called again each time the result is
    evaluated, so store it before using it twice.
    """
    bound_batches(articles.sparkSession)
    articles = articles if tasks is None else articles.repartition(tasks)
    done = _asked(articles, max_words).mapInPandas(_attempts(summarizer, max_retries), _ATTEMPT_SCHEMA)
    return _log_rows(done, model, max_words, slack)


def _asked(articles: DataFrame, max_words: int) -> DataFrame:
    return articles.select(
        "id",
        "url",
        F.coalesce("full_content", F.lit("")).alias("full_content"),
        is_blank(F.col("full_content")).alias("blank"),
        F.coalesce(summary_prompt(F.col("full_content"), max_words), F.lit("")).alias("prompt"),
    )


def _log_rows(done: DataFrame, model: str, max_words: int, slack: int) -> DataFrame:
    cleaned = limit_words(clean_summary(trim_ws(F.col("raw"))), max_words, slack)
    return done.select(
        "id",
        "article_url",
        F.lit(model).alias("model"),
        "status",
        F.when(F.col("status") == SUCCESS, cleaned)
        .when(F.col("status") == FAILED, SUMMARY_UNAVAILABLE)
        .otherwise("")
        .alias("summary"),
        "error_message",
        "duration_ms",
        "retry_attempt",
    )


def summary_attempts_once(
    articles: DataFrame,
    ledger: str,
    summarizer: Summarizer = lead_sentences,
    model: str = "lead-sentences",
    max_words: int = MAX_SUMMARY_WORDS,
    max_retries: int = MAX_RETRIES,
    slack: int = WORD_SLACK,
    **options,
) -> DataFrame:
    """``summary_attempts`` with a ledger: the model is asked once for each attempt, however often this is evaluated.

    An attempt whose task went down during it counts as failed for good ("in doubt"); ``in_doubt="again"`` asks once
    more. ``options`` are those of ``call_once``.
    """

    def attempt(article: Row, _: int) -> dict:
        if article.blank:
            return {"raw": None, "error": EMPTY_TEXT, "ms": 0}
        start = time.monotonic()
        try:
            raw, error = summarizer(article.prompt, article.full_content).strip(), None
            if not raw:
                raw, error = None, EMPTY_ANSWER
        except Exception as exc:  # any model failure counts as one failed attempt
            raw, error = None, str(exc)
        return {"raw": raw, "error": error, "ms": int((time.monotonic() - start) * 1000)}

    def done(outcome: dict) -> bool:
        return outcome["raw"] is not None or outcome["error"] == EMPTY_TEXT

    asked = _asked(articles, max_words)
    made = call_once(asked, ledger, ["id"], attempt, done, "raw string, error string, ms int", max_retries, **options)
    blank = F.col("error") == EMPTY_TEXT
    error = F.when(F.col("in_doubt"), IN_DOUBT).otherwise(F.coalesce("error", F.lit("")))
    success = F.col("raw").isNotNull()
    status = F.when(success, SUCCESS).when(blank, FAILED).otherwise(RETRY_FAILED)
    tried = made.select(
        "id",
        F.col("url").alias("article_url"),
        status.alias("status"),
        "raw",
        error.alias("error_message"),
        F.coalesce("ms", F.lit(0)).alias("duration_ms"),
        F.when(blank, 0).otherwise(F.col("attempt")).alias("retry_attempt"),
    )
    # At most ``max_retries`` rows an article; a final row for those without success.
    last = tried.groupBy("id", "article_url").agg(
        F.max(F.struct("retry_attempt", "status", "error_message")).alias("l"), F.sum("duration_ms").cast("int").alias("duration_ms")
    )
    failed = last.filter(F.col("l.status") == RETRY_FAILED).select(
        "id", "article_url", F.lit(FAILED).alias("status"), F.lit(None).cast("string").alias("raw"), "l.error_message", "duration_ms", "l.retry_attempt"
    )
    return _log_rows(tried.unionByName(failed), model, max_words, slack)


def final_summaries(attempts: DataFrame) -> DataFrame:
    """(id, url, summary): the text to store per article."""
    return attempts.filter(F.col("status").isin(SUCCESS, FAILED)).select(
        "id", F.col("article_url").alias("url"), "summary"
    )


def embed_rows(rows: DataFrame, embedder: Embedder = word_hash_vector) -> DataFrame:
    """(id, summary_embedding) from (id, summary). Rows whose embedding fails are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, vectors = [], []
            for r in pdf.itertuples(index=False):
                try:
                    vectors.append(np.asarray(embedder(r.summary), dtype=np.float32))
                    ids.append(r.id)
                except Exception:  # retried in the next cycle
                    continue
            if ids:  # a batch may consist of failures alone
                yield pd.DataFrame({"id": ids, "summary_embedding": vectors})

    bound_batches(rows.sparkSession)
    return rows.select("id", "summary").mapInPandas(run, "id long, summary_embedding array<float>")
