import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.functions import urls as ux

THREAT = "threat alert… details end"


def test_safe_truncate_every_length(spark):
    texts = (THREAT, "café — 日本語 🎉 end", "", "plain")
    longest = max(len(s.encode()) for s in texts)
    df = spark.createDataFrame([(s,) for s in texts], "x string")
    cuts = df.select("x", *[tx.safe_truncate(F.col("x"), n).alias(f"c{n + 1}") for n in range(-1, longest + 3)])
    for row in cuts.collect():
        raw = row.x.encode()
        for n in range(-1, longest + 3):
            assert row[f"c{n + 1}"] == raw[: max(n, 0)].decode(errors="ignore"), (row.x, n)


def test_sanitize_drops_stray_bytes_only(apply):
    broken = b"Cybersecurity report" + b"\xe2" + b"..."
    valid = ["", "ascii", "café — déjà vu …", "日本語"]
    got = apply([bytearray(broken), *[bytearray(v.encode()) for v in valid]], "binary", tx.sanitize_utf8)
    assert got == ["Cybersecurity report...", *valid]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("<think>plan</think>Answer.", "Answer."),
        ("<THINK >plan\nmore\n</think  >  Answer\n\nhere ", "Answer here"),
        ("<think>a<think>b</think>c</think>d", "cd"),
        ("start <thinking>never closed", "start never closed"),
        ("<analysis>x</analysis><reason>y</reason>", tx.SUMMARY_FILTERED_OUT),
        ("a <reason>1</reason> b <analysis>2</analysis> c", "a b c"),
        ("<thinker>kept</thinker>", "<thinker>kept</thinker>"),
        ("   ", tx.SUMMARY_FILTERED_OUT),
    ],
)
def test_clean_summary(apply, raw, clean):
    assert apply([raw], "string", tx.clean_summary) == [clean]


def test_truncate_words_cuts_at_late_spaces_only(apply):
    def cut(s, n):
        return apply([s], "string", lambda c: tx.truncate_words(c, n))[0]

    assert cut("short", 10) == "short"
    assert cut("exactly ten", 11) == "exactly ten"
    assert cut("alpha beta gamma delta", 16) == "alpha beta..."
    assert cut("ab cdefghijklmnopqrstuvw", 16) == "ab cdefghijkl..."
    assert cut("abcdefghijklmnopqrstuvwxyz", 10) == "abcdefg..."
    assert cut("ééééééééééé", 10) == "ééé..."


def test_limit_words(apply):
    text = " ".join(f"w{i}" for i in range(130))
    keep = apply([text], "string", lambda c: tx.limit_words(c, 110, 20))[0]
    assert keep == text
    cut = apply([text], "string", lambda c: tx.limit_words(c, 100, 0))[0]
    assert cut == " ".join(f"w{i}" for i in range(100)) + "..."


def test_blank_and_trim_are_unicode_aware(apply):
    blanks = ["", " ", "\t\n", "\u00a0\u2003", None, "x", "\u3000x\u3000"]
    assert apply(blanks, "string", tx.is_blank) == [True, True, True, True, True, False, False]
    assert apply(["\u3000x y\u2009"], "string", tx.trim_ws) == ["x y"]


def test_prompt_embeds_text_without_splitting_a_character(apply):
    (prompt,) = apply(["é" * 10], "string", lambda c: tx.summary_prompt(c, 50, 5))
    assert "in exactly 50 words or less" in prompt
    assert prompt.endswith("Article text:\néé...\n\nSummary:")
    (standalone,) = apply(["body"], "string", lambda c: tx.summary_prompt(c, 100, template=tx.STANDALONE_PROMPT))
    assert "suitable for Discord posting" in standalone and "\nbody\n" in standalone


def test_mask_webhook_url(apply):
    hook = "https://chat.example.com/api/webhooks/1/secret"
    got = apply([hook, "https://short.example.com/a"], "string", ux.mask_webhook_url)
    assert got == ["https://chat.example.com/api/webhooks/1/***TOKEN_HIDDEN***", "https://short.example.com/a"]


def test_feed_title_keeps_port_and_user(apply):
    urls = ["https://u:p@example.com:8080/rss?x=1", "example.org/feed", "http://only.host", "a://b://c/d"]
    assert apply(urls, "string", ux.feed_title) == ["u:p@example.com:8080", "example.org", "only.host", "b:"]


@pytest.mark.parametrize(
    ("excluded", "feed", "hit"),
    [
        ([], "https://a.example/feed", False),
        (["a.example"], "https://a.example/feed", True),
        (["A.EXAMPLE"], "https://a.Example/feed", True),
        (["b.example"], "https://a.example/feed", False),
        (["b.example", "a.example"], "https://a.example/feed", True),
        (["a.example"], "", False),
        (["", "  "], "https://a.example/feed", False),
        (["  a.example "], "https://a.example/feed", True),
        (["a.example"], None, False),
    ],
)
def test_feed_excluded(apply, excluded, feed, hit):
    assert apply([feed], "string", lambda c: ux.feed_excluded(c, excluded)) == [hit]


def test_status_codes(apply):
    codes = [200, 403, 404, 429, 500, 503, 519, 520, 527, 528]
    got = apply(codes, "int", ux.is_challenge_status)
    assert [c for c, g in zip(codes, got, strict=True) if g] == [403, 429, 503, 520, 527]
    assert apply([None, 302, 404, 500, 599], "int", ux.delivery_error_class) == [
        "network_error", "unknown", "client_error", "server_error", "server_error",
    ]
