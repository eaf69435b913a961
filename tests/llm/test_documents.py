import pytest

from loomwire.llm import mixing, quality, tokens

DOC = "doc_id bigint, text string, source string, n_tokens string, slot string"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)


@pytest.mark.skipif(not __import__("os").path.exists(tokens.rank_file()), reason="no vocabulary files here")
def test_mix(spark):
    rows = [(i, f"word number {i} " * 20, "big") for i in range(200)] + [(1000 + i, f"word number {i} " * 20, "small") for i in range(20)] + [(5000, "x", "other"), (5001, None, "big"), (5002, "", "big"), (None, "x", "big"), (5003, "x", None)]
    goal = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs(spark, *rows), goal, block=256)
    got = mixed.collect()
    by = {r.source: r for r in mixing.shares(mixed, goal).collect()}
    # shares of the present sources, whole documents apart
    assert abs(by["big"].actual_share - 0.7 / 0.9) < 0.02 and by["absent"].n_tokens == 0 and by["small"].most_repeats <= 3
    assert {r.source for r in got} == {"big", "small"} and max(sum(1 for r in got if r.doc_id == d) for d in {r.doc_id for r in got}) <= 3
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    # every stretch of the schedule is near the targets
    first = [r for r in sorted(got, key=lambda r: r.slot) if r.slot < 20]
    assert 0.5 < sum(r.n_tokens for r in first if r.source == "big") / sum(r.n_tokens for r in first) < 0.95
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs(spark, *rows), goal, block=256).collect()), key=repr)
    # with a total beyond what a source has, the others fill up
    more = {r.source: r for r in mixing.shares(mixing.mix(docs(spark, *rows), goal, total=12_000, block=256), goal).collect()}
    assert abs(sum(r.n_tokens for r in more.values()) - 12_000) < 400
    assert mixing.mix(docs(spark), goal).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(tokens.rank_file()), reason="no vocabulary files here")
def test_long_document_at_the_end(spark):
    rows = [(i, f"word number {i} " * 10, "a") for i in range(100)] + [(1000 + i, f"word number {i} " * 10, "b") for i in range(60)] + [(5000 + i, "long text " * 3000, "b") for i in range(2)]
    goal = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        mixed = mixing.mix(docs(spark, *rows), goal, block=256, seed=seed)
        got = {r.source: r.n_tokens for r in mixing.shares(mixed, goal).collect()}
        quota = {r.source: r.quota for r in mixed.select("source", "quota").distinct().collect()}
        # a document of 6,000 tokens is no longer taken for a quota of some 1,000, unless it comes first
        first = mixed.where("source = 'b'").orderBy("slot", "part").first()
        assert first.n_tokens > 1000 or abs(got["b"] - quota["b"]) < 1000


PROSE = "The mayor said on Monday that the club had signed a lease for the {}. Nobody who was asked about it could say how much it would cost, and the board of the {} did not reply to a letter from the town. "


def corpus():
    words = "stadium harbour library museum station market garden bridge tower theatre".split()
    out = [(i, PROSE.format(words[i % 10], words[(i * 3 + 1) % 10]) * (1 + i % 3), 1) for i in range(60)]
    zh = [(100 + i, "市长周一表示，俱乐部已经签下新的租约，" + w + "的费用没有公布。居民们说，他们从来没有被问到这个问题。", 1) for i, w in enumerate(["港口", "体育场", "图书馆", "车站", "桥梁"] * 3)]
    lists = [(200 + i, "\n".join(f"- Anna {chr(65 + (i + j) % 26)}ellon" for j in range(12)), 0) for i in range(8)]
    tables = [(300 + i, "\n".join(f"Kelder {chr(65 + j)};{i * j};{j}%;1{j}.{i}" for j in range(9)), 0) for i in range(8)]
    import random

    r = random.Random(1)
    strings = [(400 + i, " ".join("".join(r.choices("abcdefghij0123456789", k=r.randint(3, 20))) for _ in range(40)), 0) for i in range(8)]
    symbols = [(500 + i, "".join(r.choices("#$%^&*+=<>|~ 1a\n", k=300)), 0) for i in range(8)]
    again = [(600 + i, "buy now " * (30 + i), 0) for i in range(8)]
    return out, zh + out + lists + tables + strings + symbols + again


def test_profiles(spark, rows):
    _, all_ = corpus()
    extra = [(900, "Q: Why was the club late?\nA: It was the weather, and the train that we were on had stopped.\n\nKelder Works 4, Ruskby 1\n" + PROSE.format("dock", "pier"), 1), (901, None, 1), (902, "", 1), (903, " ​\n", 1)]
    df = docs(spark, *[(i, t, "s") for i, t, _ in all_ + extra])
    want = sorted(((i,) for i, _, ok in all_ if not ok), key=repr)
    assert rows(quality.not_prose(df), "doc_id") == want
    q = {r.doc_id: r for r in quality.text_quality(df).collect()}
    assert 901 not in q and 903 not in q and q[0].best_lang == "en" and q[100].best_lang == "zh" and q[0].line_end_share == 1
    assert quality.text_quality(docs(spark)).count() == 0


def test_char_classes():
    n = quality.char_counts("aé我 1,%�\x85。")
    assert n.tolist() == [3, 1, 1, 2, 1, 2]
