import pytest

from loomwire.llm import linkage, titles

ITEM = "hash_id string, url string, title string, source_name string, rep string"


def history(spark, *rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], f"item_id bigint, {ITEM}")


def batches(spark, *rows):
    return spark.createDataFrame([(i, n, *r, "clash") for i, (n, *r) in enumerate(rows)], f"batch_item_id bigint, batch_no int, {ITEM}")


T = "Storm over Kelderby: Anna Bellon counts 40 closed roads"


@pytest.mark.parametrize(
    ("title", "same"),
    [
        (T, True), (T.upper() + "!", True), ("BREAKING: Storm&nbsp;over Kelderby: Anna Bellon counts 40 clossed roads", True), ("Storm over Kelderby: Anna Bellon now counts 40 roads | The Paper", True),
        ("Storm over Kelderby: Anna Bellon counts 41 closed roads", False), ("Storm over Kelderby: Rosa Vantik counts 40 closed roads", False), ("Storm over Ruskford: Anna Bellon counts 40 closed roads", False),
        ("Storm in Kelderby, Anna Bellon sees 40 roads shut", False), ("", False), (None, False),
    ],
)
def test_titles(spark, title, same):
    known = history(spark, ("h0", "https://a.example/0", T, "The Paper"), ("h1", "https://a.example/1", "Rosa Vantik leads in Ruskford and Anna Bellon follows", "The Paper"))
    got = linkage.link_batches(known, batches(spark, (1, "x", None, title, "The Paper"))).first()
    assert got.is_case is same and (got.rep == -1 if same else got.rep == 0)


def test_chinese():
    a = titles.tagged("柳湾岛新增837个岗位，岗然佐批评了港口扩建方案")
    for other, same in (("【快讯】柳湾岛新增837个岗位，岗然佐已批评港口扩建方案", True), ("柳湾岛新增838个岗位，岗然佐批评了港口扩建方案", False), ("柳湾岛新增837个岗位，维川诚批评了港口扩建方案", False)):
        b = titles.tagged(other)
        assert (titles.compare(a, b) is not None) is same
        if same:
            assert set(titles.index_keys(a)) & set(titles.probe_keys(b))


def test_keys_survive_two_changes():
    a = titles.tagged("one two three four five six 7")
    for b in ("one two three four 7", "zero one twoo three four five six 7", "one five six four three two 7", "one two three x y six 7"):
        assert set(titles.index_keys(a)) & set(titles.probe_keys(titles.tagged(b)))


def test_chain_of_cases(spark, rows):
    known = history(spark, ("h0", "https://a.example/0", "A", "S"))
    new = batches(
        spark,
        (1, "h0", "https://a.example/9", "B one two three", "S"),  # case by identity
        (1, "h1", "https://www.a.example/9/?utm_x=1", "C", "S"),  # its address was never accepted
        (1, "h2", "https://a.example/9", "D", "S"),  # case by the address of 1
        (2, "h2", None, "E", "S"),  # 2 was not accepted
        (2, "h2", None, "F", "S"),  # case by 3
        (2, None, None, None, None),
        (3, None, "", "", ""),
    )
    assert rows(linkage.link_batches(known, new).where("is_case"), "batch_item_id") == [(0,), (2,), (4,)]


def test_no_rows(spark):
    none = batches(spark)
    assert linkage.link_batches(history(spark, ("h", "u", "t", "s")), none).count() == 0
    assert linkage.link_batches(history(spark), batches(spark, (1, "h", "https://a.example", T, "S"), (1, "h", "https://a.example", T, "S"))).where("is_case").count() == 1


def test_clusters(spark):
    linker = linkage.HistoryLinker(spark)
    linker.bootstrap(history(spark, ("h0", "https://a.example/0", "A", "S"), ("h1", "https://a.example/1", "B", "S"), ("h2", "https://a.example/2", "C", "S")))
    for one in ((1, "h0", "https://a.example/1", "X", "S"), (1, "h1", "https://a.example/2", "Y", "S")):
        linker.link(batches(spark, one))
    assert {(r.id, r.root_id) for r in linker.clusters().where("not of_batch").collect()} == {(0, 0), (1, 0), (2, 0)}
    linker.close()


def test_links_of_all_kinds_unite(spark, rows):
    known = history(spark, ("h0", "https://a.example/0", "A", "S"), ("h1", "https://a.example/1", T, "S"), ("h2", "https://a.example/2", "C", "S"), ("h2", "https://a.example/3", "D", "S"), ("h4", "https://a.example/4", "E", "S"))
    new = batches(
        spark,
        (1, "h1", None, "V", "S"),  # known by identity alone
        (1, "h0", None, T.lower(), "S"),  # by identity and title: 0 and 1 are one
        (2, None, "https://a.example/3", "W", "S"),  # 3 has the identity of 2
        (2, "h7", None, "An item of its own that 3 people saw", "S"),
        (3, "h7", "https://a.example/2", "X", "S"),  # an accepted item and 2 are one
        (3, "h1", "https://a.example/3", "Y", "S"),  # and so are the clusters of 1 and 2
        (3, "h9", None, "Z", "S"),
    )
    linked = linkage.link_batches(known, new)
    assert rows(linked, "batch_item_id", "is_case", "n_links", "root") == [(0, True, 1, -1), (1, True, 2, -1), (2, True, 1, -1), (3, False, 0, -1), (4, True, 2, -1), (5, True, 2, -1), (6, False, 0, 6)]


def test_roots_are_kept(spark, tmp_path):
    root = f"file://{tmp_path}/linkage"
    first = linkage.HistoryLinker(spark, root)
    first.bootstrap(history(spark, *[(f"h{i}", f"https://a.example/{i}", "ABCD"[i], "S") for i in range(4)]))
    assert first.clusters().count() == 0
    for one in ((1, "h1", "https://a.example/2", "X", "S"), (1, "h3", None, "Y", "S")):
        first.link(batches(spark, one))
    first.close()
    again = linkage.HistoryLinker(spark, root)
    got = again.link(batches(spark, (2, "h0", "https://a.example/2", "Z", "S")).withColumn("batch_item_id", linkage.F.lit(9)))
    assert [(r.n_links, r.root) for r in got.collect()] == [(2, -1)]
    assert {(r.id, r.root_id) for r in again.clusters().collect()} == {(0, 0), (1, 0), (2, 0)}
    assert spark.read.parquet(f"{root}/decisions/*").count() == 3
    again.close()


def test_weights_order():
    w, p = linkage.agreement_weights([((1, 1, 2), 50), ((1, 0, 0), 5), ((0, 0, 1), 30), ((0, 0, 0), 1000)])
    assert all(x[1] > x[0] for x in w) and w[2][2] > w[2][0] and 0 < p < 1
    assert linkage.agreement_weights([])[0][0][1] > 0


def test_reopened(spark, tmp_path):
    root = f"file://{tmp_path}/linkage"
    first = linkage.HistoryLinker(spark, root)
    first.bootstrap(history(spark, ("h0", "https://a.example/0", T, "S")))
    first.link(batches(spark, (1, "h1", "https://a.example/1", "Another story with 9 names", "S"))).count()
    first.close()
    again = linkage.HistoryLinker(spark, root)
    got = again.link(batches(spark, (2, "x", None, T.lower(), "S"), (2, "h1", None, "Y", "S"), (2, "z", None, "Z", "S")).where("batch_no = 2").selectExpr("batch_item_id + 10 AS batch_item_id", "hash_id", "url", "title", "source_name"))
    assert {r.batch_item_id: r.is_case for r in got.collect()} == {10: True, 11: True, 12: False}
    plan = spark.table(again.table)._jdf.queryExecution().toString()
    assert f"{again.buckets} buckets" in plan or "Bucketed" in plan
    again.close()
