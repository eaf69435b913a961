import pytest

from loomwire import ai
from loomwire.plans.news import run_news
from loomwire.plans.pipeline import Pipeline, Stage, StageError
from loomwire.sinks import DeliveryLog, MemorySink
from loomwire.sources.store import ParquetStore
from tests.test_items import AS_OF, frame


def add(name, give=None, fail=None, code=0, inputs=("a",)):
    def apply(given, services, options):
        if fail:
            raise fail
        return {"b": sum(given.values())} if give is None else give

    return Stage(name, apply, dict.fromkeys(inputs), ("b",), code)


def test_names_and_waves():
    p = Pipeline([add("one"), add("two").map_input("a", "b").map_output("b", "c")])
    assert p.run({"a": 2}, ["c"]) == {"c": 2} and p.lint(["a"], ["c"]) == []
    assert p.lint() == ["c is made but not used", "a is used but not made"]
    with pytest.raises(ValueError, match="same name"):
        Pipeline([add("x"), add("x")])
    for inputs, outputs in (({"z": 1}, ["c"]), ({"a": 1}, ["z"])):
        with pytest.raises(KeyError, match="unknown"):
            p.run(inputs, outputs)
    with pytest.raises(KeyError):
        add("x").map_input("q", "r")


def test_error_branch():
    told = []
    p = Pipeline([add("one", fail=StageError(7, "x")), add("two").map_input("a", "b").map_output("b", "c")], told.append)
    assert p.run({"a": 1}, ["c"]) == {"c": None} and [e.code for e in told] == [7]
    told.clear()
    assert Pipeline([add("one", fail=RuntimeError("x"), code=3)], told.append).run({"a": 1}, ["b"]) == {"b": None} and told[0].code == 3
    with pytest.raises(RuntimeError):
        Pipeline([add("one", fail=RuntimeError("x"))]).run({"a": 1}, ["b"])
    with pytest.raises(KeyError, match="declare"):
        Pipeline([add("one", give={"q": 1})]).run({"a": 1}, ["b"])


def echo(payload):
    return {"items": [{"hash_id": x["hash_id"], "title": x["title"] + "!", "bullets": ["a bullet of ten", "another bullet"]} for x in payload]}


class Client:
    """Drops nothing, summarises everything."""

    def ask(self, prompts):
        import json

        return [json.dumps(echo(json.loads(p)) if p.startswith("[") else {"ids": []}) for p in prompts]


def test_news(spark, rows, tmp_path):
    store, sink = ParquetStore(spark, f"file://{tmp_path}/s"), MemorySink(("broken",))
    store.upsert(frame(spark, dict(hash_id="old", raw=None)))
    pages = spark.createDataFrame([("https://a.example/2", "<p>" + "word " * 12 + "</p>")], "url string, html string")
    new = frame(spark, dict(hash_id="old"), dict(hash_id="new", url="https://a.example/2", bullets=None, raw=None), dict(hash_id="late", category="f1", source_date=AS_OF.replace(year=2020)))
    log = DeliveryLog(sink, 0)
    ok = run_news(new, ["ai", "f1"], ["c", "broken"], {"store": store, "pages": pages, "ai": Client(), "sink": log}, {"as_of": AS_OF})
    assert ok and [c for c, _ in log.log] == ["c", "broken"] and len(sink.sent) == 1 and "A title\\!" in sink.sent[0][2] and "🤖🏎️" in sink.sent[0][2]
    assert rows(store.read(), "hash_id", "title", "raw") == [("new", "A title!", ("word " * 12).strip()), ("old", "A title", None)]


def test_news_error(spark, tmp_path):
    told = []
    services = {"store": ParquetStore(spark, f"file://{tmp_path}/s"), "pages": spark.createDataFrame([], "url string, html string"), "ai": ai.FakeAIClient(dict), "sink": MemorySink()}
    assert not run_news(frame(spark, {}), ["ai"], ["c"], services, {"as_of": AS_OF}, told.append) and told[0].code == 5
