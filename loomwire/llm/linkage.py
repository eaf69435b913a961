"""Duplicates of new batches against all history, by incremental record linkage (problem 2).

What has been accepted is kept as four tables in a folder: blocking keys of identity, address
and title, bucketed by key, so that a batch is joined with them without moving them; statistics
of title words; the decisions on each batch; and the root of every representative whose cluster
was merged with another. A batch computes its own keys, probes the key table, compares the titles
it meets, adds the keys of what it accepts, and unites the clusters that one of its items links to:
only the rows of clusters whose root changes are written again. The history's rows are read once, when the folder is filled for the first time.
Equal titles share one entry, so a title that a third of all rows bear is one row of the table,
and no group of rows is ever paired with itself.

Agreement on the fields is weighted by Fellegi and Sunter's model, whose parameters are learned
by expectation-maximisation from the counts of agreement patterns (at most twelve); the weights
choose the representative among several matches. Whether two items match at all is then decided
by the exact definition: same identity, same address, or nearly the same title.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwire.functions.urls import canonical_url
from loomwire.llm import titles
from loomwire.scratch import materialize, new_folder

#: Share of capitals from which a word never seen in lower case is a name; German nouns need so many titles.
GERMAN_NOUN = 5
#: Pairs that the prior of the weights counts for; probability of each level of agreement of two items at random.
PRIOR, CHANCE = 10, 1e-6
#: Buckets of the key table at least.
BUCKETS = 16

_WORDS = "word string, lower bigint, cap bigint, german bigint"
_SIGNATURE = "uid bigint, hash_id string, url string, tags string, ikeys array<bigint>, pkeys array<bigint>"


def _signatures(df: DataFrame, uid: Column, probe: bool) -> DataFrame:
    """uid, hash_id, url (canonical), tags (normal form of the title), ikeys, pkeys, one row per row."""
    src = df.select(uid.cast("bigint").alias("uid"), "hash_id", F.nullif(canonical_url(F.col("url")), F.lit("")).alias("url"), F.col("title"), F.col("source_name").cast("string").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [titles.tagged(t, (s,) if s else ()) if t else "" for t, s in zip(b.column("title").to_pylist(), b.column("s").to_pylist())]
            ikeys = [titles.index_keys(t) for t in tags]
            pkeys = [titles.probe_keys(t) if probe else [] for t in tags]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("hash_id"), b.column("url"), pa.array(tags, pa.string()), pa.array(ikeys, kind), pa.array(pkeys, kind)], ["uid", "hash_id", "url", "tags", "ikeys", "pkeys"])

    return src.mapInArrow(run, _SIGNATURE)


def _exact_keys(kind: str, column: str) -> Column:
    value = F.concat(F.lit(kind), F.col(column))
    return F.struct(F.xxhash64(value).alias("k"), F.xxhash64(F.lit(3), value).alias("v"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("tags"))


def _title_keys(column: str) -> Column:
    return F.transform(F.col(column), lambda k: F.struct(k.alias("k"), F.lit(0).cast("bigint").alias("v"), F.lit("t").alias("kind"), F.col("tags").alias("tags")))


def _keys(sig: DataFrame, titles_by: str) -> DataFrame:
    """uid, k, v, kind, tags: all keys of the rows; ``titles_by`` names the column of title keys."""
    exact = F.filter(F.array(F.when(F.col("hash_id") != "", _exact_keys("h", "hash_id")), F.when(F.col("url").isNotNull(), _exact_keys("u", "url"))), lambda x: x.isNotNull())
    return sig.select("uid", F.inline(F.concat(exact, _title_keys(titles_by))))


def _entries(sig: DataFrame) -> DataFrame:
    """Entries of the key table: the least uid stands for all rows with the same key and title."""
    return _keys(sig, "ikeys").groupBy("k", "v", "kind", "tags").agg(F.min("uid").alias("rep"))


def _equal_rows(sig: DataFrame) -> DataFrame:
    """a and b: different representatives of the keys of one row, by identity, address and the words of
    the title, so that their clusters are one. The least uid with a key is its representative."""
    words = sig.select("uid", "hash_id", "url", F.when(F.size("ikeys") > 0, F.regexp_replace("tags", "(^| ).", "$1")).alias("words"))
    found = F.array(F.when(F.col("hash_id") != "", _exact_keys("h", "hash_id")), F.when(F.col("url").isNotNull(), _exact_keys("u", "url")), F.when(F.col("words").isNotNull(), _exact_keys("t", "words")))
    keys = words.select("uid", F.filter(found, lambda x: x.isNotNull()).alias("keys")).select("uid", F.size("keys").alias("n"), F.inline("keys")).select("uid", "n", "k", "v")
    shared = keys.groupBy(F.col("k").alias("k2"), F.col("v").alias("v2")).agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    by_row = keys.join(shared, (F.col("k") == F.col("k2")) & (F.col("v") == F.col("v2"))).groupBy("uid").agg(F.collect_set("rep").alias("reps"), F.count(F.lit(1)).alias("met"), F.min("n").alias("n"))
    # a key that no other row has is the row's own
    reps = F.when(F.col("met") < F.col("n"), F.array_union("reps", F.array("uid"))).otherwise(F.col("reps"))
    return by_row.select(F.array_min(reps).alias("a"), F.explode(reps).alias("b")).where("a <> b").distinct()


def _components(pairs: DataFrame) -> DataFrame:
    """uid and root, the least uid of its component, of all ends of the pairs (a, b), by pointer jumping."""
    links = materialize(pairs.select(F.col("a").alias("uid"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("uid"), F.col("a").alias("to"))).distinct(), "graph")
    root = materialize(links.groupBy("uid").agg(F.least(F.min("to"), F.col("uid")).alias("root")), "roots")
    while True:
        far = root.select(F.col("uid").alias("x"), F.col("root").alias("r2"))
        best = links.join(far, F.col("to") == F.col("x")).groupBy(F.col("uid").alias("n")).agg(F.min("r2").alias("m"))
        step = root.join(best, F.col("uid") == F.col("n")).select("uid", F.col("root").alias("was"), F.least("root", "m").alias("to"))
        jump = materialize(step.join(far, F.col("to") == F.col("x")).select("uid", "was", F.least("to", "r2").alias("root")), "roots")
        root = jump.select("uid", "root")
        if jump.where("root <> was").isEmpty():
            return root


def _named(uid: Column) -> Column:
    """-1 - item_id of a history row, or the key of an item."""
    return F.when(uid % 2 == 0, -1 - F.floor(uid / 2)).otherwise(F.floor(uid / 2))


def _word_counts(sig: DataFrame) -> DataFrame:
    """word, lower, cap and german: in how many different titles a word stands in lower case, with a
    capital, and with a capital in a German one."""
    distinct = sig.where("tags <> ''").select("tags").distinct()
    words = F.array_distinct(F.split("tags", " "))
    plain = F.transform(words, lambda w: F.substring(w, 2, 1000))
    german = F.arrays_overlap(plain, F.array(*map(F.lit, sorted(titles._GERMAN))))
    each = distinct.select(german.alias("g"), F.explode(words).alias("w")).where(F.col("w").rlike("^[oc].*[^0-9]"))
    cap = F.substring("w", 1, 1) == "c"
    return each.groupBy(F.substring("w", 2, 1000).alias("word")).agg(
        F.count_if(~cap).alias("lower"), F.count_if(cap & ~F.col("g")).alias("cap"), F.count_if(cap & F.col("g")).alias("german")
    )


def _compared(pairs: DataFrame) -> DataFrame:
    """uid, rep, inner, kind, changes, doubtful of the pairs that share a key; changes is -1 where titles
    differ too much. Names are not yet looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("kind").to_pylist()
            found = [titles.compare(x, y) if k == "t" else (0, []) for k, x, y in zip(kinds, b.column("known").to_pylist(), b.column("new").to_pylist())]
            good = [f or (-1, []) for f in found]
            arrays = [b.column(c) for c in ("uid", "rep", "inner", "kind")] + [pa.array([f[0] for f in good], pa.int32()), pa.array([f[1] for f in good], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "rep", "inner", "kind", "changes", "doubtful"])

    return pairs.select("uid", "rep", "inner", "kind", "known", "new").mapInArrow(run, "uid bigint, rep bigint, inner boolean, kind string, changes int, doubtful array<string>")


def agreement_weights(patterns: list[tuple[tuple[int, int, int], int]], rounds: int = 50) -> tuple[list[dict[int, float]], float]:
    """Log2 weights of the levels of (identity, address, title) by expectation-maximisation, and the
    share of matches. ``patterns`` are distinct patterns with their counts.

    Learned are the probabilities among matches and the share of matches. Those among others are fixed at
    CHANCE: pairs come from blocking, among which chance agreement is far too frequent to learn it from."""
    levels = [(0, 1), (0, 1), (0, 1, 2)]
    start = [{0: 0.6, 1: 0.4}, {0: 0.6, 1: 0.4}, {0: 0.2, 1: 0.4, 2: 0.4}]
    m = [dict(x) for x in start]
    u = [{x: CHANCE if x else 1 - (len(ls) - 1) * CHANCE for x in ls} for ls in levels]
    p, n = 0.5, sum(c for _, c in patterns) or 1
    for _ in range(rounds if patterns else 0):
        post = []
        for g, _ in patterns:
            a = p * math.prod(m[i][x] for i, x in enumerate(g))
            b = (1 - p) * math.prod(u[i][x] for i, x in enumerate(g))
            post.append(a / (a + b))
        match = sum(w * c for w, (_, c) in zip(post, patterns))
        p = min(0.99, max(0.01, match / n))
        for i, ls in enumerate(levels):
            for x in ls:
                m[i][x] = (sum(w * c for w, (g, c) in zip(post, patterns) if g[i] == x) + PRIOR * start[i][x]) / (match + PRIOR)
    return [{x: math.log2(m[i][x] / u[i][x]) for x in ls} for i, ls in enumerate(levels)], p


class HistoryLinker:
    """Linkage of batches against a growing history.

    ``root`` is a folder that all executors share; one that holds a history is opened, and is not to be
    filled again; a new one in the session's shared folder if not given. Rows need hash_id, url, title and source_name; null or empty ones are no evidence. Other
    columns are ignored.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.root = root or new_folder(spark, "linkage")
        self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"loomwire_keys_{uuid.uuid4().hex[:10]}"
        if root and _exists(spark, f"{root}/buckets"):
            # a history of an earlier session: its table is named again, nothing is read
            self.buckets = spark.read.parquet(f"{root}/buckets").first()[0]
            columns = "k BIGINT, v BIGINT, kind STRING, tags STRING, rep BIGINT"
            spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {self.buckets} BUCKETS LOCATION '{root}/keys'")
        self.weights: list[dict[int, float]] | None = None
        self.share = 0.5
        if root and _exists(spark, f"{root}/buckets") and not _exists(spark, f"{root}/roots"):
            self._write_roots(spark.range(0).select(F.col("id").alias("uid"), F.col("id").alias("root")))

    def _append(self, sig: DataFrame) -> None:
        entries = _entries(sig).repartition(self.buckets, "k")
        writer = entries.write.format("parquet").bucketBy(self.buckets, "k").sortBy("k").mode("append").option("path", f"{self.root}/keys")
        writer.saveAsTable(self.table)

    def bootstrap(self, history: DataFrame, key: str = "item_id") -> None:
        """Fills the tables from the rows accepted so far, whose ``key`` is their identity; even numbers
        stand for them inside, odd ones for the items of batches. The word statistics stay as of here."""
        sig = materialize(_signatures(history, F.col(key) * 2, False).drop("pkeys"), "history")
        self._append(sig)
        _word_counts(sig).write.parquet(f"{self.root}/words")
        pairs = materialize(_equal_rows(sig), "pairs")
        self._write_roots(pairs.select(F.col("a").alias("uid"), F.col("b").alias("root")) if pairs.isEmpty() else _components(pairs))
        self.spark.range(1).select(F.lit(self.buckets).alias("n")).write.parquet(f"{self.root}/buckets")

    def _write_roots(self, changed: DataFrame) -> None:
        changed.write.mode("append").parquet(f"{self.root}/roots")

    def _stored_roots(self) -> DataFrame:
        """uid and root as they were written; roots only fall, so the least one of a uid holds."""
        return self.spark.read.schema("uid bigint, root bigint").parquet(f"{self.root}/roots")

    def _unite(self, pairs: DataFrame) -> None:
        """Merges the clusters of a and b. Looked up are the roots of the ends of ``pairs``, written are
        these and the members of clusters whose root changes."""
        if pairs.isEmpty():
            return
        stored = self._stored_roots()
        ends = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
        now = materialize(ends.join(stored, F.col("e") == F.col("uid"), "left").groupBy("e").agg(F.coalesce(F.min("root"), F.col("e")).alias("r")), "ends")
        a, b = now.select(F.col("e").alias("ea"), F.col("r").alias("ra")), now.select(F.col("e").alias("eb"), F.col("r").alias("rb"))
        apart = pairs.join(a, F.col("a") == F.col("ea")).join(b, F.col("b") == F.col("eb")).where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        moved = _components(apart)
        # a root that stands is stored with no other root, so whoever has it in any row is a member
        sunk = moved.where("uid <> root").select(F.col("uid").alias("old"), F.col("root").alias("new"))
        members = stored.join(sunk, F.col("root") == F.col("old")).select("uid", F.col("new").alias("root"))
        # written aside first, since the stored table is read for it
        self._write_roots(materialize(moved.unionByName(members).distinct(), "changed"))

    def with_roots(self, linked: DataFrame) -> DataFrame:
        """``linked``, as of :meth:`link_signatures`, with root: the name of the cluster of rep, which is the
        member with the least number inside, as merged so far."""
        roots = self._stored_roots().groupBy("uid").agg(F.min("root").alias("to")).select(_named(F.col("uid")).alias("of"), _named(F.col("to")).alias("to"))
        return linked.join(roots, F.col("rep") == F.col("of"), "left").withColumn("root", F.coalesce("to", "rep")).drop("of", "to")

    def signatures(self, batch: DataFrame, key: str = "batch_item_id", *keep: str) -> DataFrame:
        """Signatures of the items of one or more batches, written once; repeated keys are read once."""
        rows = batch.dropDuplicates([key]).where(F.col(key).isNotNull())
        sig = _signatures(rows, F.col(key) * 2 + 1, True)
        if keep:
            sig = sig.join(rows.select((F.col(key) * 2 + 1).cast("bigint").alias("ku"), *keep), F.col("uid") == F.col("ku")).drop("ku")
        return materialize(sig, "batch")

    def link(self, batch: DataFrame, key: str = "batch_item_id") -> DataFrame:
        """Probes the history with a batch and accepts what is new. Returns ``key``, rep (its
        representative: -1 - item_id of a history row, or the ``key`` of an item), score, is_case, n_links
        (the representatives that it agrees with) and root (of its cluster, named as rep is) for each
        item of the batch, which is ordered by ``key``."""
        return self.with_roots(self.link_signatures(self.signatures(batch, key), key))

    def link_signatures(self, sig: DataFrame, key: str = "batch_item_id") -> DataFrame:
        """As :meth:`link`, from :meth:`signatures`, without the root, which :meth:`with_roots` adds."""
        links = self._links(sig)
        cases, good = self._cases(sig, links)
        accepted = sig.join(cases.where("is_case").select(F.col("uid").alias("cu")), F.col("uid") == F.col("cu"), "left_anti")
        self._append(accepted)
        _word_counts(accepted).write.mode("append").parquet(f"{self.root}/words")
        several = cases.where("is_case and n_links > 1").select(F.col("uid").alias("c"), F.col("rep").alias("a"))
        self._unite(materialize(good.join(several, F.col("uid") == F.col("c")).where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs"))
        return cases.select(F.floor(F.col("uid") / 2).alias(key), _named(F.coalesce("rep", "uid")).alias("rep"), "score", "is_case", "n_links")

    def _links(self, sig: DataFrame) -> DataFrame:
        """uid, rep, inner, kind, score of all agreements, exact and near. rep is a representative of the
        history, or, if inner, the first item of the batch with the key or title that was met."""
        probes = _keys(sig, "pkeys").withColumnRenamed("tags", "new").repartition(self.buckets, "k")
        known = self.spark.table(self.table).select(F.col("k").alias("ik"), F.col("v").alias("iv"), "rep", F.col("tags").alias("known"))
        own = _keys(sig, "ikeys").groupBy("k", "v", "kind", "tags").agg(F.min("uid").alias("rep"))
        own = own.select(F.col("k").alias("ik"), F.col("v").alias("iv"), "rep", F.col("tags").alias("known"))
        # k alone is the key of the join, as the table is bucketed by it; v, which tells the kinds apart too, is checked beside it
        on = (F.col("k") == F.col("ik")) & (F.col("v").bitwiseXOR(F.col("iv")) == 0)
        columns = ["uid", "rep", "kind", "known", "new"]
        met = probes.join(known, on).select(*columns, F.lit(False).alias("inner"))
        met = met.unionByName(probes.join(own, on & (F.col("rep") < F.col("uid"))).select(*columns, F.lit(True).alias("inner"))).distinct()
        # changed words in doubt are looked up; one that is a name ends the agreement
        compared = materialize(_compared(met), "compared")
        asked = compared.where("changes >= 0").withColumn("d", F.explode_outer("doubtful")).drop("doubtful")
        words = self.spark.read.schema(_WORDS).parquet(f"{self.root}/words").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("lower", "cap", "german")])
        found = asked.join(words, F.element_at(F.split("d", ":"), -1) == F.col("word"), "left").na.fill(0, ["lower", "cap", "german"])
        noun = (F.substring("d", 2, 1) == "g") & (F.col("cap") == 0) & (F.col("german") >= GERMAN_NOUN)
        # a capital inside a sentence is a name's; at its start, or where case says nothing, the word must be known as one
        is_name = (F.col("lower") == 0) & ~noun & F.when(F.col("d").startswith("c"), True).otherwise((F.col("cap") + F.col("german")) > 0)
        sound = found.groupBy("uid", "rep", "inner", "kind", "changes").agg(F.coalesce(F.bool_or(is_name), F.lit(False)).alias("named")).where("not named").drop("named")
        self._learn(compared)
        return materialize(self._scored(sound), "links")

    def _learn(self, compared: DataFrame) -> None:
        """Weights from all pairs that share a key, those whose titles differ among them, of the first items that have any."""
        if self.weights is None:
            patterns = [((r.h, r.u, r.t), r["count"]) for r in self._levels(compared).groupBy("h", "u", "t").count().collect()]  # twelve at most
            if patterns:
                self.weights, self.share = agreement_weights(patterns)

    @staticmethod
    def _levels(links: DataFrame) -> DataFrame:
        """uid, rep, inner, kinds, and the level of agreement by identity (h), address (u) and title (t)."""
        level = {"h": F.when(F.col("kind") == "h", 1), "u": F.when(F.col("kind") == "u", 1), "t": F.when(F.col("kind") == "t", F.when(F.col("changes") == 0, 2).when(F.col("changes") > 0, 1).otherwise(0))}
        return links.groupBy("uid", "rep", "inner").agg(F.collect_set("kind").alias("kinds"), *[F.coalesce(F.max(x), F.lit(0)).alias(c) for c, x in level.items()])

    def _scored(self, links: DataFrame) -> DataFrame:
        """The links that the weights of their agreement make likelier than not, with the log2 of the odds."""
        weights, share = (self.weights, self.share) if self.weights else agreement_weights([])
        fields = self._levels(links)
        score = math.log2(share / (1 - share)) + sum((F.element_at(F.array(*[F.lit(w[x]) for x in sorted(w)]), F.col(c) + 1) for c, w in zip("hut", weights)), F.lit(0.0))
        return fields.select("uid", "rep", "inner", F.explode("kinds").alias("kind"), score.alias("score")).where("score > 0")

    def _cases(self, sig: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """uid, rep, score, is_case, n_links, and all links to something accepted. An item with a link into the history is a case. Links within the batch
        lead to groups of items with the same key or title, named by their first item; an item is a case
        if a group that it links to has an earlier item that is none. Decided in rounds: an item is
        accepted when its groups have no earlier item left, and a case when the earliest left in one
        is accepted. A round moves one row per item and group, never pairs of a group's items."""
        case = links.where("not inner").select("uid").distinct()
        inner = links.where("inner").select("uid", "kind", "rep")
        left, rounds = None, []
        if not inner.isEmpty():
            # all items by group, for the groups that were met
            keys = _keys(sig, "ikeys").select("uid", "k", "v", "kind", "tags")
            first = keys.groupBy("k", "v", "kind", "tags").agg(F.min("uid").alias("rep"), F.count_distinct("uid").alias("n")).withColumnsRenamed({"k": "k2", "v": "v2", "kind": "kind2", "tags": "tags2"})
            on = (F.col("k") == F.col("k2")) & (F.col("v") == F.col("v2")) & (F.col("kind") == F.col("kind2")) & F.col("tags").eqNullSafe(F.col("tags2"))
            groups = keys.join(first.join(inner.select("kind", "rep").distinct().withColumnsRenamed({"kind": "gk", "rep": "gr"}), (F.col("kind2") == F.col("gk")) & (F.col("rep") == F.col("gr")), "left_semi"), on)
            groups = groups.select("kind", "rep", F.col("uid").alias("member")).distinct()
            groups = groups.join(case.select(F.col("uid").alias("x")), F.col("member") == F.col("x"), "left_anti")
            open_ = inner.join(case.select(F.col("uid").alias("x")), F.col("uid") == F.col("x"), "left_anti")
            both = materialize(groups.select("kind", "rep", F.col("member").alias("uid"), F.lit(True).alias("member")).unionByName(open_.withColumn("member", F.lit(False))), "open")
            while True:
                left, open_ = both.where("member").select("kind", "rep", F.col("uid").alias("m")), both.where("not member").select("uid", "kind", "rep")
                waiting = open_.select(F.col("uid").alias("w")).distinct()
                earliest = left.groupBy("kind", "rep").agg(F.min("m").alias("first")).join(waiting, F.col("first") == F.col("w"), "left").select("kind", "rep", "first", F.col("w").isNull().alias("accepted"))
                state = open_.join(earliest, ["kind", "rep"], "left").groupBy("uid").agg(F.bool_or((F.col("first") < F.col("uid")) & F.col("accepted")).alias("dup"), F.bool_or(F.col("first") < F.col("uid")).alias("behind"))
                state = materialize(state.select("uid", F.coalesce("dup", F.lit(False)).alias("dup"), (~F.coalesce("behind", F.lit(False))).alias("free")), "state")
                new = state.where("dup").select("uid")
                rounds.append(new)
                done = state.where("dup or free").select(F.col("uid").alias("x"))
                gone = new.select(F.col("uid").alias("y"))
                if state.where("not dup and not free").isEmpty():
                    left = left.join(gone, F.col("m") == F.col("y"), "left_anti")
                    break
                kept = both.where("member").join(gone, F.col("uid") == F.col("y"), "left_anti").unionByName(both.where("not member").join(done, F.col("uid") == F.col("x"), "left_anti"))
                both = materialize(kept, "open")
        for new in rounds:
            case = case.unionByName(new)
        case = case.distinct().select(F.col("uid").alias("c"))
        # the representative is the best link to something accepted, the earliest of equals
        good = links.where("not inner").select("uid", "rep", "score")
        if left is not None:
            first = left.groupBy(F.col("kind").alias("fk"), F.col("rep").alias("g")).agg(F.min("m").alias("first"))
            within = links.where("inner").join(first, (F.col("kind") == F.col("fk")) & (F.col("rep") == F.col("g"))).where("first < uid").select("uid", F.col("first").alias("rep"), "score")
            good = good.unionByName(within)
        best = good.groupBy(F.col("uid").alias("b")).agg(F.max_by(F.struct("rep", "score"), F.struct("score", -F.col("rep"))).alias("best"), F.count_distinct("rep").alias("n"))
        out = sig.select("uid").join(case, F.col("uid") == F.col("c"), "left").join(best, F.col("uid") == F.col("b"), "left")
        is_case = F.col("c").isNotNull()
        decided = out.select("uid", F.when(is_case, F.col("best.rep")).alias("rep"), F.when(is_case, F.col("best.score")).alias("score"), is_case.alias("is_case"), F.when(is_case, F.col("n")).otherwise(0).alias("n_links"))
        path = f"{self.root}/decisions/{uuid.uuid4().hex}"
        decided.write.parquet(path)
        return self.spark.read.schema(decided.schema).parquet(path), good

    def clusters(self) -> DataFrame:
        """id and root_id of every representative that has been merged, and whether each is of a batch."""
        roots = self._stored_roots().groupBy("uid").agg(F.min("root").alias("root"))
        return roots.select(F.floor(F.col("uid") / 2).alias("id"), (F.col("uid") % 2 == 1).alias("of_batch"), F.floor(F.col("root") / 2).alias("root_id"), (F.col("root") % 2 == 1).alias("root_of_batch"))

    def close(self) -> None:
        """Forgets the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def link_batches(history: DataFrame, batches: DataFrame, batch_no: str = "batch_no", key: str = "batch_item_id") -> DataFrame:
    """All batches in the order of ``batch_no`` against ``history`` and what was accepted before; columns
    as of :meth:`HistoryLinker.link` and ``batch_no``, with the roots after the last batch.

    The history is probed once for all of them: their items are numbered in the order of batch and
    ``key``, and are decided as one. What is collected is the least and the greatest key of each batch."""
    rows = batches.where(F.col(batch_no).isNotNull() & F.col(key).isNotNull()).dropDuplicates([key])
    spans = rows.groupBy(batch_no).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(batch_no).collect()
    number, at, named = F.col(key), 0, F.col(key)
    for i, r in enumerate(spans):
        # the items of a batch get the numbers from ``at`` on
        shift = at - r["lo"]
        number = F.when(F.col(batch_no) == r[batch_no], F.col(key) + shift) if i == 0 else number.when(F.col(batch_no) == r[batch_no], F.col(key) + shift)
        at += r["hi"] - r["lo"] + 1
    if at >= 1 << 62:
        raise ValueError("the keys of the batches are too far apart; link them one by one")
    linker = HistoryLinker(history.sparkSession)
    linker.bootstrap(history)
    sig = linker.signatures(rows.withColumn("__number", number) if spans else rows.withColumn("__number", F.col(key)), "__number", batch_no, key)
    linked = linker.with_roots(linker.link_signatures(sig, "__number"))
    linker.close()
    names = sig.select(F.floor(F.col("uid") / 2).alias("n"), F.col(key).alias("named"), F.col(batch_no).alias("of"))
    for column in ("__number", "rep", "root"):  # numbers of items; negative ones are rows of the history
        by = names.withColumnsRenamed({"n": f"n_{column}", "named": f"k_{column}", "of": f"b_{column}"})
        linked = linked.join(by, F.col(column) == F.col(f"n_{column}"), "left")
    known = [F.coalesce(F.col(f"k_{c}"), F.col(c)).alias(c) for c in ("rep", "root")]
    return linked.select(F.col("k___number").alias(key), known[0], "score", "is_case", "n_links", known[1], F.col("b___number").alias(batch_no))
