import re
from collections import Counter

import pytest

from loomwire.llm import furniture, lines, residue, truncation

SCHEMA = "item_id int, raw string, source_name string, line_no int, source string"


def frame(spark, *texts, source="S"):
    return spark.createDataFrame([(i, t, source if not isinstance(source, list) else source[i], 0, "clash") for i, t in enumerate(texts)], SCHEMA)


def brute(rows):
    plain = lambda x: re.sub(r"\d+", "0", re.sub(r"\s+", " ", x.upper().lower()).strip())
    n, c = Counter(), Counter()
    for _, t, s, *_ in rows:
        if t and t.strip():
            n[s] += 1
            c.update({(s, plain(x)) for x in t.split("\n") if x.strip()})
    often = {k for k, v in c.items() if v >= 3 and v >= 0.05 * n[k[0]]}
    return sorted((i, k) for i, t, s, *_ in rows if t for k, x in enumerate(t.split("\n"), 1) if x.strip() and (s, plain(x)) in often)


def test_recurrent_lines(spark, rows):
    texts = [f"Only here {chr(97 + i)}\n\nShare this, {i} shares\nFUSSBALL heute" if i % 2 else f"Other {chr(97 + i)}\n share  THIS, {i}9 shares\t\nFußball heute\nFußball heute" for i in range(8)] + [None, "", " \n\t"]
    df = frame(spark, *texts, source=["A", "A", "A", "A", "B", "B", "B", None, None, None, None])
    got = rows(lines.recurrent_lines(df), "item_id", "line_no")
    assert got == brute([tuple(r) for r in df.collect()]) and {i for i, _ in got} == set(range(7))
    assert lines.recurrent_lines(frame(spark)).count() == 0


def test_share_of_rows(spark):
    texts = [f"text {chr(97 + i % 26)}{chr(97 + i // 26)}" + ("\nrare line" if i < 4 else "") for i in range(100)]
    assert lines.recurrent_lines(frame(spark, *texts)).count() == 0
    assert lines.recurrent_lines(frame(spark, *texts[:80])).count() == 4


ARTICLE = "The mayor said on Monday that the club had signed a new lease. Nobody else was asked about it."


def test_residue(spark, rows):
    cases = {
        0: "{{ story.city }}", 1: f"{ARTICLE}\n\n[LEDE TK]", 2: "None null", 3: "By NaN in null", 4: "Lorem ipsum dolor sit amet consectetur.", 5: "Placeholder copy, do not publish.",
        6: "Please enable JavaScript to view this page.", 7: "404 Not Found", 8: "抱歉，您访问的页面不存在 错误代码 503", 9: "Access denied\nRequest ID 1234",
    }
    fine = [ARTICLE, "The old page answered with a 404 for an hour, said the mayor.", f"{ARTICLE}\nEnable JavaScript to see the 9 comments on Sport.", "The draft still had lorem ipsum in its margin, according to two people who saw it.", None, "", " "]
    df = frame(spark, *cases.values(), *fine)
    assert [i for i, in rows(residue.residue(df), "item_id")] == list(cases)
    assert rows(residue.without_residue(df), "item_id") == sorted(((i,) for i in range(len(cases), len(cases) + len(fine))), key=repr)
    assert residue.residue(frame(spark)).count() == 0


def test_boilerplate_is_no_evidence(spark, rows):
    note = "Please enable JavaScript to use this site."
    df = frame(spark, *[f"{note}\nShort story number {w}." for w in ("one", "two", "three", "four")], note)
    assert rows(residue.residue(df), "item_id") == [(4,)]


def test_furniture(spark, rows):
    text = "\n".join([
        "Home / Sport / Kelder", "By Anna Bell, Sport correspondent", ARTICLE, "What happens next", ARTICLE, "Kelder Works 4, Ruskby Kites 1", "- Anna Bell", "", "Tags: Kelder, Ruskby", "Most read",
        "Ruskby Kites appoint Anna Bell as coach after 9 quiet weeks", "Storm over Kelder: Anna Bell counts 40 closed roads", "© 2025 The Paper. All rights reserved.",
    ])
    df = frame(spark, text, None, "", " ", "404 Not Found")
    assert rows(furniture.furniture_lines(df), "item_id", "line_no") == sorted([(0, n) for n in (1, 2, 9, 10, 11, 12, 13)], key=repr)
    body = {r.item_id: r.body for r in furniture.main_body(df).collect()}
    assert body[0].startswith("The mayor") and body[0].endswith("- Anna Bell") and body[1] is None and body[2] == ""
    assert furniture.furniture_lines(frame(spark)).count() == 0


def test_markup_counts_as_tags():
    n, b = furniture.body_mask(f'<a href="#">Home</a><a href="#">Sport</a>\n{ARTICLE}\n<p>')
    assert list(zip(n, b))[:2] == [(1, False), (2, True)]


def test_digits_count():
    at = lambda line, outlet="": furniture.line_ratios(f"{ARTICLE}\n{line}", outlet)[1][1]
    assert at("(c) 2024 Ruskby") == at("Ruskby Verlag 2025 - Kelder") == furniture.LOW
    assert at("12:30 Anna Bell leaves the room") == furniture.HIGH
    assert at("All of it from Kanal 42 Heute", "Kanal 42 Heute") == furniture.LOW < at("All of it from Kanal 43 Heute", "Kanal 42 Heute")


def test_truncated(spark, rows):
    whole = [f"{ARTICLE} The {w} was late again for the second time this month." for w in ("train", "tram", "bus", "boat", "plane", "mail", "milk", "band")]
    cut = [f"{ARTICLE} The {w} was late again for the seco" for w in ("cook", "cat")] + [f"{ARTICLE} The clown was late again for…", f"{ARTICLE} The cow was late <"]
    other = [f"{ARTICLE}\nKelder Works 4, Ruskby Kites 1", f"{ARTICLE}\nShare this story: 9 shares so far", None, "", " ", "Please enable JavaScript"]
    df = frame(spark, *whole, *cut, *other)
    assert [i for i, in rows(truncation.truncated(df), "item_id")] == [10, 11, 8, 9]
    rate = truncation.truncation_rates(df).first()
    assert (rate.n_rows, rate.n_cut) == (15, 4) and abs(rate.share - 4 / 15) < 1e-12
    assert truncation.truncated(frame(spark)).count() == 0


def test_near_and_removal(spark, rows):
    names = ("Anna Bellon", "Rosa Vantik", "Lilo Dekker", "Karan Holt")
    df = frame(spark, *[f"Story {w} of its own.\nWritten by {n} for Kelder on {i + 1} May\n\nAbout this paper" for i, (w, n) in enumerate(zip(("one", "two", "red", "odd"), names))], None, "")
    assert rows(lines.recurrent_lines(df), "item_id", "line_no") == sorted([(i, 4) for i in range(4)], key=repr)
    assert rows(lines.recurrent_lines(df, near=True), "item_id", "line_no") == sorted([(i, n) for i in range(4) for n in (2, 4)], key=repr)
    clean = lines.without_recurrent_lines(df, near=True)
    assert clean.columns == df.columns
    assert {r.item_id: r.raw for r in clean.collect()} == {0: "Story one of its own.\n", 1: "Story two of its own.\n", 2: "Story red of its own.\n", 3: "Story odd of its own.\n", 4: None, 5: ""}


def test_near_lines(spark, rows):
    """Recall of near lines against all pairs: a line counts if, with those at least as similar as SIMILAR to it
    by their masked words, it is in enough rows."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    bases = [" ".join(r.sample(vocabulary, r.randint(8, 20))) for _ in range(30)]
    texts = []
    for i in range(120):
        mine = []
        for b in r.sample(bases, 4):
            words = b.split()
            if r.random() < 0.5:
                words[r.randrange(len(words))] = r.choice(vocabulary)  # one word is another
            mine.append(" ".join(words))
        texts.append("\n".join([" ".join(r.sample(vocabulary, 12)), *mine]))
    df = frame(spark, *texts)
    words = {x: frozenset(x.split()) for t in texts for x in t.split("\n")}
    alike = {a: [b for b in words if len(words[a] & words[b]) >= lines.SIMILAR * len(words[a] | words[b])] for a in words}
    of = {x: {i for i, t in enumerate(texts) if x in t.split("\n")} for x in words}
    want = {(i, n) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"), 1) if len(set().union(*(of[y] for y in alike[x]))) >= 0.05 * len(texts)}
    got = set(rows(lines.recurrent_lines(df, near=True), "item_id", "line_no"))
    assert len(want) > 400 and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)
    assert set(rows(lines.recurrent_lines(df), "item_id", "line_no")) <= got


def test_masked_lines_are_near(spark, rows):
    texts = [f"Own words of text {chr(97 + i)}\nReported by {n} {m}, published on {i + 3} {d} 20{10 + i}" for i, (n, m, d) in enumerate([("Anna", "Bellon", "may"), ("Rosa", "Vantik", "march"), ("Yaran", "Didafune", "april"), ("Lisel", "Hosehune", "june")])]
    assert rows(lines.recurrent_lines(frame(spark, *texts), near=True), "item_id", "line_no") == [(i, 2) for i in range(4)]
    assert lines.recurrent_lines(frame(spark, *texts)).count() == 0


def test_residue_of_any_case_and_length(spark, rows):
    story = "\n\n".join(ARTICLE for _ in range(20))
    stand_in = ["text here", "your text here", "replace this text", "blindtext", "aquí va el texto", "placeholder text", "lorem ipsum dolor sit amet", "hier steht ihr blindtext", "texte à remplacer", "sample copy", "texto de relleno"]
    cases = [f"{story}\n{x}\n{ARTICLE}" for w in stand_in for x in (w, w.upper(), w.title(), w.swapcase())]
    cases += ["Access denied\n" + "Please try again or contact the site owner with the number of this request.\n" * 12, "Traceback (most recent call last):\n" + 'File "view.py", line 7, in show\n' * 30]
    cases += [f"{ARTICLE}\n404 Not Found\nnginx", "Pulvis sanum quereb morit rhonca nostru velas ornatu."]
    own = "\n".join(f"In town {chr(97 + i)} the mayor said that it was so." for i in range(20))  # the story recurs here
    fine = [story, f"{own}\nSorry, said the mayor, but the page was not found.", f"{story}\n410 comments - join the discussion on Sport"]
    assert sorted(i for i, in rows(residue.residue(frame(spark, *cases, *fine)), "item_id")) == list(range(len(cases)))


def test_needed_strings_are_implied():
    from loomwire.llm import literals

    for pattern in (residue.SLOT, residue.UNSET, residue.STAND_IN.removeprefix("(?i)"), residue.SCRIPT_WORDS):
        for part in literals.alternatives(pattern):
            assert literals.required(part)
    f = literals.Finder([r"\b(?:read|see) (?:more|also)\b", r"co+kies?\b", r"[xX]y{2,}z"])
    assert f.candidates("SEE ALSO the Cookies") == {0, 1} and f.candidates("xyyyyz") == {2} and not f.any("read on")
    assert literals.required("a(?:bc|bd)?e") == {"abce", "abde", "ae"} and literals.required("a.*bcd") == {"bcd"}


def test_lines_of_any_length():
    notice = "We and our 12 partners use cookies and similar technologies to measure our audience. You can accept all or change your choice; see our cookie policy for details. "
    for n in (1, 2, 5):
        text = "\n".join([ARTICLE, ARTICLE, notice * n, ARTICLE])
        assert furniture.body_mask(text)[1] == [True, True, False, True]
    assert furniture.body_mask("\n".join([ARTICLE * 3, ARTICLE * 4 + " She said that cookies were sold at the door. " + ARTICLE * 4, ARTICLE]))[1] == [True] * 3
    assert furniture.has_cue("Got a tip for us, readers") and furniture.has_cue("Got a tip? Write to the city desk")


def test_cues_need_their_strings():
    from loomwire.llm import literals

    for cue in furniture.CUES:
        for part in literals.alternatives(cue):
            assert literals.required(part)


def test_half_words_among_many_texts(spark, rows):
    """Half a word that is met again, at ends and inside, is one however many the texts are."""
    whole = [f"{ARTICLE} The board met in the {w} hall of town {i}." for i in range(60) for w in ("old", "new")]
    cases = [f"{ARTICLE} Town {chr(97 + i)} was quiet. The board met in the ne" for i in range(4)]
    met = [f"{ARTICLE} The board met in the ne… and that was it for town {i}." for i in range(3)] + [f"{ARTICLE} The board met in the ne or so they said in town {i}." for i in range(3)]
    titles = [f"{ARTICLE}\n\nThe hall of town {i}, who goes there now" for i in range(8)]
    df = frame(spark, *cases, *whole, *met, *titles)
    assert [i for i, in rows(truncation.truncated(df), "item_id")] == [0, 1, 2, 3]


def test_recurrent_lines_come_from_compared_clusters(spark, rows, monkeypatch):
    """Lines of one bucket that are unlike its leader are compared with it and still found, and without clusters there are no rows."""
    monkeypatch.setattr(lines, "with_bands", lambda df: df.drop("words").select("*", *[lines.F.lit(1).cast("long").alias(f"d{j}") for j in range(lines.BANDS)]))
    texts = [f"Own words {chr(97 + i)}\nShare this story now\nAll rights are reserved here\nShare this story, {i}" for i in range(4)] + ["Share this story now"] * 2
    df = frame(spark, *texts)
    want = brute([tuple(r) for r in df.collect()])
    assert len(want) == 14 and rows(lines.recurrent_lines(df), "item_id", "line_no") == want
    clusters = lines.near_clusters
    monkeypatch.setattr(lines, "near_clusters", lambda *a, **k: clusters(*a, **k).where("false"))
    assert lines.recurrent_lines(df).count() == 0


@pytest.mark.xfail(reason="the first case is missed: among so few texts its last trigram, inside two and at two ends, does not count as hardly ever terminal; open")
def test_cut_texts_without_bounds(spark, rows):
    body = [f"{ARTICLE} The board met in town {chr(97 + i)}." for i in range(12)]
    cases = [ARTICLE + " The board met in the" + " " * 90, ARTICLE + " The board met in the <a href=\"https://a.example/" + "x" * 300, ARTICLE + " The board met in the to"]
    fine = [ARTICLE + "<!-- end -->", f"{ARTICLE}\nBy Anna Bellon", f"{ARTICLE}\nKelder Works 4, Ruskby 1", f"{ARTICLE}\n- Anna Bellon", f"{ARTICLE}\nRead more: The board met in the"]
    assert sorted(i for i, in rows(truncation.truncated(frame(spark, *cases, *fine, *body)), "item_id")) == [0, 1, 2]
