import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomwire import ai, clients, schedule
from loomwire.plans.pipeline import Pipeline, Stage, StageError
from loomwire.sources.store import Conflict, ParquetStore, merge_sql
from tests.test_items import frame


@pytest.fixture
def server():
    """A local service: replies by path, kept requests, and failures to give first."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.seen.append((self.path, dict(self.headers), body))
            code = self.server.codes.pop(0) if self.server.codes else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(self.server.replies.get(self.path, {})).encode())

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    s.seen, s.codes, s.replies = [], [], {}
    s.url = f"http://127.0.0.1:{s.server_port}"
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


REPLIES = {
    "/chat/completions": {"choices": [{"message": {"content": "yes"}}]},
    "/responses": {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "yes"}]}]},
    "/messages": {"content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "yes"}]},
}


def test_ai_clients(server, monkeypatch):
    monkeypatch.setattr(clients, "PAUSE", 0.0)
    server.replies.update(REPLIES)
    options = {"ai_api_key": "k", "ai_base_url": server.url, "ai_model": "m", "ai_max_retries": 2}
    for provider, path in (("openai-compatible", "/chat/completions"), ("openai", "/responses"), ("anthropic", "/messages")):
        client = clients.ai_client({**options, "ai_provider_type": provider}).with_task("the task", ai.DEDUPE_SHAPE)
        server.codes[:] = [503, 429]
        assert client.ask(["prompt"]) == ["yes"]
        seen = server.seen[-3:]
        assert {p for p, *_ in seen} == {path} and "the task" in json.dumps(seen[0][2]) and "ids" in json.dumps(seen[0][2]) and "k" in str(seen[0][1])
    server.codes[:] = [400]
    with pytest.raises(RuntimeError, match="400"):
        client.ask(["x"])
    server.replies.clear()
    with pytest.raises(RuntimeError, match="no text"):
        client.ask(["x"])


def test_tasks(spark, server):
    server.replies["/chat/completions"] = {"choices": [{"message": {"content": "{ids: ['a']}"}}]}
    client = clients.HttpAIClient("k", server.url, "m")
    assert [r.hash_id for r in ai.dedupe_by_event(frame(spark, dict(hash_id="a"), dict(hash_id="b")), frame(spark), client).collect()] == ["b"]
    assert "covered" in server.seen[0][2]["messages"][0]["content"] and server.seen[0][2]["response_format"]["json_schema"]["schema"] == ai.DEDUPE_SHAPE
    assert "French" in ai.SUMMARY_TASK.format(language="French") and '{"items"' in ai.SUMMARY_TASK.format(language="x")


def test_requests_are_bounded(spark):
    seen = []

    class Asked:
        def ask(self, prompts):
            for p in prompts:
                x = json.loads(p)
                assert len(x["fetched"]) <= 30 and len(x["covered"]) <= 30
            return [json.dumps(ai.same_titles(json.loads(p))) for p in prompts]

    new = frame(spark, *[dict(hash_id=f"n{i}", title=f"t{i}") for i in range(60)])
    old = frame(spark, *[dict(hash_id=f"o{i}", title=f"t{i}") for i in range(0, 60, 2)])
    assert {r.hash_id for r in ai.dedupe_by_event(new, old, Asked(), most=10).collect()} == {f"n{i}" for i in range(1, 60, 2)} and seen == []


def test_messages(server):
    clients.BotSink("t", server.url).send("c", ["one", "two"])
    clients.BotSink("t", server.url, None).send("c", ["three"])
    assert [(p, b.get("parse_mode"), b["text"]) for p, _, b in server.seen] == [("/bott/sendMessage", "MarkdownV2", "one"), ("/bott/sendMessage", "MarkdownV2", "two"), ("/bott/sendMessage", None, "three")]
    server.seen.clear()
    server.codes[:] = [400]
    clients.ErrorChannels(clients.BotSink("t", server.url, None, retries=0), ["bad", "", "good"])(StageError(4, ValueError("broken")))
    assert [b["chat_id"] for *_, b in server.seen] == ["bad", "good"] and "code 4" in server.seen[1][2]["text"] and "ValueError" in server.seen[1][2]["text"]


def test_cron():
    at = lambda text, *t, zone=None: schedule.Cron(text, zone).after(datetime(*t, tzinfo=timezone.utc)).astimezone(timezone.utc)
    assert at("0 8 * * mon-fri", 2025, 6, 6, 12) == datetime(2025, 6, 9, 8, tzinfo=timezone.utc)
    assert at("*/15 * * * *", 2025, 1, 1, 0, 59) == datetime(2025, 1, 1, 1, tzinfo=timezone.utc)
    assert at("30 0 8 29 2 *", 2025, 1, 1) == datetime(2028, 2, 29, 8, 0, 30, tzinfo=timezone.utc)
    assert at("0 8 * * *", 2025, 7, 1, zone="Europe/Madrid") == datetime(2025, 7, 1, 6, tzinfo=timezone.utc)
    assert at("0 0 13 * 5", 2025, 6, 1) == datetime(2025, 6, 6, tzinfo=timezone.utc)
    for bad in ("* * *", "61 * * * *", "5-1 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            schedule.Cron(bad)
    ran = []

    def job():
        ran.append(1)
        raise RuntimeError("x")

    assert schedule.run_scheduled(job, schedule.Cron("* * * * * *"), most=1) == 1 and ran == [1]


def test_store_survives_crashes_and_writers(spark, rows, tmp_path, monkeypatch):
    store = ParquetStore(spark, f"file://{tmp_path}/s", parts=4)
    store.upsert(frame(spark, dict(hash_id="a"), dict(hash_id="b", category="f1")))
    with monkeypatch.context() as m:  # a crash before the pointer is in place
        m.setattr(ParquetStore, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.upsert(frame(spark, dict(hash_id="c")))
    assert rows(store.read(), "hash_id") == [("a",), ("b",)] and store.version() == 1
    # another writer comes first, once
    other, point = ParquetStore(spark, store.root, parts=4), ParquetStore._point

    def slow(self, version, folders):
        monkeypatch.setattr(ParquetStore, "_point", point)
        other.upsert(frame(spark, dict(hash_id="d")))
        point(self, version, folders)

    monkeypatch.setattr(ParquetStore, "_point", slow)
    store.upsert(frame(spark, dict(hash_id="c"), dict(hash_id="b", category="ai", title="moved")))
    assert rows(store.read(), "hash_id") == [("a",), ("b",), ("c",), ("d",)] and rows(store.read(["f1"]), "hash_id") == [] and store.version() == 3
    with pytest.raises(Conflict):
        store._point(3, {})


def test_merge_statement():
    assert merge_sql("t", "s", ["hash_id", "a", "b"]) == "MERGE INTO t t USING s s ON t.hash_id = s.hash_id WHEN MATCHED THEN UPDATE SET a = s.a, b = s.b WHEN NOT MATCHED THEN INSERT (hash_id, a, b) VALUES (s.hash_id, s.a, s.b)"


def by_path(given, services, options):
    return {"b": given["a"] + 1}


def test_stage_by_path_and_timeout(caplog):
    import time

    assert Pipeline([Stage("x", "tests.test_services:by_path", {"a": None}, ("b",))], debug=True).run({"a": 1}, ["b"]) == {"b": 2}
    ran = []

    def slow(given, services, options):
        time.sleep(0.4)
        return {"b": 1}

    def late(given, services, options):
        ran.append(1)
        return {"c": 1}

    p = Pipeline([Stage("slow", slow, {"a": None}, ("b",)), Stage("late", late, {"b": None}, ("c",))]).set_timeout(0.1)
    with pytest.raises(TimeoutError):
        p.run({"a": 1}, ["c"])
    assert ran == []
