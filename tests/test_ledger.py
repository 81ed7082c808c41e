"""Calls to the outside with tasks that go down midway, counted."""

import os
from collections import Counter
from datetime import datetime, timezone

import pytest

from storyloom.operators import ledger, notify, summarize

PAYLOADS = "id long, article_url string, webhook_url string, payload string, size_ok boolean"


def sent(path):
    """Every call ever made, by a line each."""
    return Counter(open(path).read().splitlines()) if os.path.exists(path) else Counter()


def messages(spark, n=30):
    rows = [(i, f"u{i}", w, f"p{i}", i != 7) for i in range(n) for w in ("w/a", "w/b")]
    return spark.createDataFrame(rows, PAYLOADS).repartition(5)


def sender(calls, fail_at=None, failed=None):
    """Answers by webhook; at message ``fail_at`` the worker goes down once, before or after it has sent."""

    def send(webhook, payload):
        with open(calls, "a") as f:
            f.write(f"{webhook} {payload}\n")
        if payload == fail_at and not os.path.exists(failed):
            open(failed, "w").close()
            raise RuntimeError("lost executor")
        return 204 if webhook == "w/a" or payload == "p3" else None if payload == "p4" else 500

    return send


def test_a_second_evaluation_sends_nothing(spark, tmp_path):
    calls, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    plain = notify.deliver(messages(spark), sender(str(tmp_path / "plain")))
    want = sorted(map(str, (tuple(r) for r in plain.collect())))
    made = notify.deliver_once(messages(spark), sender(calls), path, slots=4, together=7)
    for _ in range(2):
        assert sorted(map(str, (tuple(r) for r in made.drop("in_doubt").collect()))) == want
        assert made.filter("in_doubt").count() == 0
        assert sent(calls) == sent(str(tmp_path / "plain"))
    # New messages are sent, old ones are not.
    notify.deliver_once(messages(spark, 31), sender(calls), path, slots=4).collect()
    assert sent(calls) - sent(str(tmp_path / "plain")) == Counter({"w/a p30": 1, "w/b p30": 3})


@pytest.mark.parametrize("together", [1, 5, 100])
def test_a_task_that_goes_down_sends_nothing_twice(spark, tmp_path, together):
    calls, path, failed = (str(tmp_path / x) for x in ("calls", "ledger", "failed"))
    send = sender(calls, "p11", failed)

    def made():
        return notify.deliver_once(messages(spark), send, path, slots=2, together=together)

    with pytest.raises(Exception, match="lost executor"):
        made().collect()
    rows = made().collect()
    by_call = sent(calls)
    most = {f"{w} p{i}": 1 if w == "w/a" or i == 3 else 3 for i in range(30) if i != 7 for w in ("w/a", "w/b")}
    assert all(n <= most[c] for c, n in by_call.items())
    doubtful = {(r.webhook_url, r.id) for r in rows if r.in_doubt}
    assert 1 <= len(doubtful) <= 2 * together and all(not r.ok for r in rows if r.in_doubt)
    # Whatever is not in doubt was sent as often as without a fault.
    assert {c: by_call[c] for c in most if (c.split()[0], int(c.split()[1][1:])) not in doubtful} == {
        c: n for c, n in most.items() if (c.split()[0], int(c.split()[1][1:])) not in doubtful
    }
    assert len({(r.webhook_url, r.id) for r in rows}) == 60
    before = sent(calls)
    again = notify.deliver_once(messages(spark), send, path, slots=2, together=together, in_doubt="again").collect()
    assert not any(r.in_doubt for r in again) and sum((sent(calls) - before).values()) >= len(doubtful)


def test_an_overtaken_task_stops_at_its_first_entry(tmp_path):
    first, second = ledger.SlotLog(str(tmp_path), 3), ledger.SlotLog(str(tmp_path), 3)
    first.begin([("k", 1)])
    with pytest.raises(FileExistsError):
        second.begin([("k", 1)])
    first.end({("k", 1): {"x": 1}})
    assert ledger.SlotLog(str(tmp_path), 3).outcomes == {("k", 1): {"x": 1}}
    assert not [n for n in os.listdir(tmp_path / "slot=000003") if n.endswith(".part")]


def test_a_model_is_asked_once_an_attempt(spark, tmp_path):
    calls, path, failed = (str(tmp_path / x) for x in ("calls", "ledger", "failed"))
    texts = {0: "one. two. three. four.", 1: "", 2: "bad text", 3: "dull text", 4: "fine text.", 5: None}
    articles = spark.createDataFrame([(i, f"u{i}", t) for i, t in texts.items()], "id long, url string, full_content string")

    def model(prompt, text):
        with open(calls, "a") as f:
            f.write(text + "\n")
        if text == "fine text." and not os.path.exists(failed):
            open(failed, "w").close()
            raise SystemExit("lost executor")
        if text == "bad text":
            raise ValueError("no")
        return "  " if text == "dull text" else summarize.lead_sentences(prompt, text)


    def made():
        return summarize.summary_attempts_once(articles, path, model, slots=1, together=1)

    with pytest.raises(Exception):
        made().collect()
    made().collect()
    rows = made().collect()
    assert sent(calls) == {"one. two. three. four.": 1, "bad text": 3, "dull text": 3, "fine text.": 1}
    got = sorted((r.id, r.retry_attempt, r.status, r.summary, r.error_message) for r in rows)
    plain = summarize.summary_attempts(articles.filter("id <> 4"), model)
    want = sorted((r.id, r.retry_attempt, r.status, r.summary, r.error_message) for r in plain.collect())
    assert [g for g in got if g[0] != 4] == want
    assert [(g[1], g[2]) for g in got if g[0] == 4] == [(1, "failed"), (1, "retry_failed")]


def test_no_requests_and_repeated_ones(spark, tmp_path):
    calls = str(tmp_path / "calls")
    none = spark.createDataFrame([], PAYLOADS)
    assert notify.deliver_once(none, sender(calls), str(tmp_path / "a"), slots=2).collect() == []
    twice = messages(spark, 2).unionByName(messages(spark, 2))
    notify.deliver_once(twice, sender(calls), str(tmp_path / "b"), slots=2).collect()
    assert sent(calls) == {"w/a p0": 1, "w/a p1": 1, "w/b p0": 3, "w/b p1": 3}
    with pytest.raises(ValueError):
        ledger.call_once(none, "x", ["id"], None, None, "a int", in_doubt="maybe")
