"""Expressions against plain Python over generated texts."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storyloom.functions import text as tx
from storyloom.functions import urls as ux
from storyloom.operators.summarize import word_hash_vector

SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
plain = st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
tag = st.sampled_from(["think", "THINKING", "Reason", "analysis", "other"])
markup = st.builds(lambda a, t, b: f"{a}{t}{b}", st.sampled_from(["<", "</"]), tag, st.sampled_from([">", " >", "\n>", ""]))
spaces = st.text(st.sampled_from(SPACE), max_size=3)
texts = st.lists(st.one_of(plain, markup, spaces, st.just(" word ")), max_size=12).map("".join)
batches = st.lists(texts, min_size=60, max_size=60)
few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def clean(s):
    ws = "[\t\n\f\r ]"
    for name in ("think", "thinking", "reason", "analysis"):
        s = re.sub(f"<{name}{ws}*>.*?</{name}{ws}*>", "", s, flags=re.I | re.S)
        s = re.sub(f"</?{name}{ws}*>", "", s, flags=re.I)
    s = re.sub(f"{ws}+", " ", s).strip(SPACE)
    return s or tx.SUMMARY_FILTERED_OUT


def cut(s, n):
    return s.encode()[: max(n, 0)].decode(errors="ignore")


def cut_words(s, n):
    if len(s.encode()) <= n:
        return s
    head = cut(s, n - 3)
    at = head.encode().rfind(b" ")
    return (head.encode()[:at].decode() if at > n // 2 else head) + "..."


@few
@given(batches)
def test_clean_summary(apply, values):
    assert apply(values, "string", tx.clean_summary) == [clean(v) for v in values]


@few
@given(batches, st.integers(3, 60))
def test_truncation(apply, values, n):
    assert apply(values, "string", lambda c: tx.safe_truncate(c, n)) == [cut(v, n) for v in values]
    assert apply(values, "string", lambda c: tx.truncate_words(c, n)) == [cut_words(v, n) for v in values]


@few
@given(batches)
def test_trim_and_words(apply, values):
    split = [[w for w in re.split(f"[{SPACE}]+", v) if w] for v in values]
    assert apply(values, "string", tx.trim_ws) == [v.strip(SPACE) for v in values]
    assert apply(values, "string", tx.words) == split
    limited = [" ".join(w[:3]) + "..." if len(w) > 5 else v for v, w in zip(values, split, strict=True)]
    assert apply(values, "string", lambda c: tx.limit_words(c, 3, 2)) == limited


@few
@given(st.lists(st.lists(plain, min_size=1, max_size=9).map("/".join), min_size=40, max_size=40))
def test_mask(apply, values):
    want = ["/".join([*v.split("/")[:-1], ux.HIDDEN_TOKEN]) if v.count("/") >= 6 else v for v in values]
    assert apply(values, "string", ux.mask_webhook_url) == want


def test_word_vectors_depend_on_words_only():
    a, b = word_hash_vector("Alpha  beta\nalpha"), word_hash_vector("beta alpha ALPHA")
    assert (a == b).all() and abs(a).sum() in (1.0, 3.0)
