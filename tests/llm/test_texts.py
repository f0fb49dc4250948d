"""Operators on texts, against plain Python versions of them, on texts with all that is awkward."""

import random

import brute
import pytest

from streamtable.llm._components import components
from streamtable.llm.decontaminate import contamination, decontaminate
from streamtable.llm.jaccard_join import jaccard_components
from streamtable.llm.line_dedup import dedup_lines
from streamtable.llm.substring_dedup import dedup_passages
from streamtable.llm.suffix_dedup import dedup_bytes

SCHEMA = "doc_id bigint, text string, N_Lines string, key int, id int, row int, spans int"


def made_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéß漢XYZ") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, shared, base = prose(70), "a Common line of the corpus", prose(160)
    rows = [(0, base), (1, None), (2, ""), (3, " \t\r\n\x0b "), (4, "one"), (5, "One"), (6, "one two"), (7, "x" * 5000), (8, "ab " * 700), (9, "\n\n\n")]
    for k in range(10, 40):
        text = f"{prose(r.randint(1, 90))}\n {shared.upper() if k % 2 else shared}\t\n{prose(r.randint(0, 40))}"
        if k % 3 == 0:
            text += " " + passage + "  " + prose(5)
        if k % 4 == 0:
            ws = base.split(" ")
            ws[r.randrange(len(ws))] = word()
            text = " ".join(ws)
        rows.append((k, text))
    rows += [(40, base), (41, base), (41, base), (42, prose(12_000) + " " + passage), (None, base), (None, passage), (43, shared), (44, shared + "\n" + shared), (45, "short\nshort")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = made_texts()
    return rows, spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


def none_last(rows):
    return sorted(rows, key=lambda x: tuple((v is None, str(v)) for v in x))


def test_line_dedup(docs):
    rows, df = docs
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "key", "id", "row", "spans", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()]
    assert none_last(got) == none_last(brute.lines(rows))


def files_of(spark, work):
    """How many files work() writes to the shared folder, and its result."""
    from pathlib import Path

    from streamtable.llm import _store

    folder = Path(_store.shared_folder(spark).removeprefix("file://"))
    count = lambda: sum(1 for p in folder.rglob("part-*"))
    before = count()
    out = work()
    return count() - before, out


def test_line_dedup_starts_no_programs_for_files(spark, docs):
    """Each file of the local file system starts a program, which counts as a second executor for a moment. Nothing is written, and what is held goes."""
    from streamtable.llm import _store

    rows, df = docs
    _store.release()
    files, got = files_of(spark, lambda: [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df).collect()])
    assert files == 0
    assert none_last(got) == none_last(brute.lines(rows))
    _store.release()
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_join_writes_no_file_for_each_task(spark, docs):
    """As many files for many tasks as for few."""
    rows, df = docs
    few, one = files_of(spark, lambda: sorted(map(str, jaccard_components(df.repartition(2, "text")).collect())))
    many, other = files_of(spark, lambda: sorted(map(str, jaccard_components(df.repartition(9, "text")).collect())))
    assert (few, one) == (many, other)


def test_join_plans_hold_no_plans_of_what_is_held(spark, docs):
    """The driver keeps and compiles a plan for every query on a held result; its own rows are a leaf of it."""
    rows, df = docs
    plan = jaccard_components(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan


def test_plans_go_with_the_cache(spark, docs):
    """What clearCache() lets go isn't kept in the driver by the list of what is held."""
    from streamtable.llm import _store

    _store.release()
    kept = [_store.held(spark.range(k, k + 3)) for k in range(3)]
    assert len(_store._held) == len(kept)
    spark.catalog.clearCache()
    again = _store.held(spark.range(9, 11))
    assert len(_store._held) == 1 and again.count() == 2
    _store.release()


def test_substring_dedup_writes_no_files(spark, docs, monkeypatch):
    """Nor where hot hashes are divided, step by step."""
    monkeypatch.setattr("streamtable.llm.substring_dedup.HOT", 2000)
    rows, df = docs
    files, got = files_of(spark, lambda: none_last((r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_passages(df).collect()))
    assert files == 0
    assert got == none_last(brute.passages(rows, 50))


def test_filters_met_by_range(docs, monkeypatch):
    """Filters too large for a broadcast, in many ranges, each asked in several tasks."""
    monkeypatch.setattr("streamtable.llm._repeats.RANGE", 5000)
    monkeypatch.setattr("streamtable.llm._repeats.LITTLE", 5000)
    monkeypatch.setattr("streamtable.llm._repeats.ASKED", 3)
    rows, df = docs
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in dedup_bytes(df, max_filter_bits=1).collect()]
    assert none_last(got) == none_last(brute.bytes_(rows))
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_passages(df, max_filter_bits=1).collect()]
    assert none_last(got) == none_last(brute.passages(rows))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, max_filter_bits=1).collect()]
    assert none_last(got) == none_last(brute.components(rows))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, max_filter_bits=1).collect()]
    assert none_last(got) == none_last(brute.lines(rows))


@pytest.mark.parametrize("hot", [1 << 22, 3000, 1])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr("streamtable.llm.suffix_dedup.HOT", hot)
    rows, df = docs
    out = dedup_bytes(df)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.text)) for r in out.collect()]
    assert none_last(got) == none_last(brute.bytes_(rows))
    for r in out.collect():
        assert sum(s.hi - s.lo for s in r.spans) == r.n_removed


@pytest.mark.parametrize("hot", [1 << 22, 1200, 1])
def test_substring_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr("streamtable.llm.substring_dedup.HOT", hot)
    rows, df = docs
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_passages(df).collect()]
    assert none_last(got) == none_last(brute.passages(rows))


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join(docs, monkeypatch, block):
    monkeypatch.setattr("streamtable.llm.jaccard_join.BLOCK", block)
    rows, df = docs
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()]
    assert none_last(got) == none_last(brute.components(rows))


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_join_counts_links(docs, monkeypatch, block):
    """Every link is counted, also those that join nothing new."""
    monkeypatch.setattr("streamtable.llm.jaccard_join.BLOCK", block)
    rows, df = docs
    sets = {i: brute.shingle_set(t) for i, t in rows if i is not None}
    n = {i: sum(j != i and 100 * len(s & t) >= 90 * len(s | t) for j, t in sets.items() if s and t) for i, s in sets.items()}
    assert max(n.values()) > 2
    got = [(r.doc_id, r.n_links) for r in jaccard_components(df).collect()]
    assert none_last(got) == none_last([(i, n.get(i)) for i, _ in rows])


def test_pipeline_keeps_one_of_near_copies(spark):
    """The stage against brute force on five words and 0.8; three words and 0.9 would leave these copies."""
    import corpus_pipeline

    r = random.Random(6)
    rows = []
    for k in range(0, 40, 2):
        ws = [f"w{r.randrange(10**6)}" for _ in range(200)]
        copy = [*ws, *(f"w{r.randrange(10**6)}" for _ in range(24 + k // 2))]  # past 0.9 and, at the end, close to 0.8
        rows += [(k, " ".join(ws)), (k + 1, " ".join(copy))]
    rows += [(100, " ".join(f"v{j}" for j in range(100))), (101, " ".join(f"v{j}" for j in range(130))), (102, None), (103, "one"), (None, rows[0][1])]
    sets = [(i, brute.shingle_set(t, 5)) for i, t in rows]
    gone = {i for i, s in sets for j, t in sets if i is not None and j is not None and j < i and s and t and 100 * len(s & t) >= 80 * len(s | t)}
    assert len(gone) == 20 and 101 not in gone
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(x.doc_id,) for x in corpus_pipeline.keep_one_of_a_group(spark, df, "").collect()]
    assert none_last(got) == none_last([(i,) for i, _ in rows if i not in gone])
    assert all(i is None or i == c for i, _, c in brute.components(rows))


def test_jaccard_join_of_texts_that_share_passages(spark, monkeypatch):
    """A chain of long texts, each with a passage of the one before, is no cluster whose blocks meet all others: little is shuffled."""
    monkeypatch.setattr("streamtable.llm.jaccard_join.BLOCK", 4)
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(10**7)}" for _ in range(n))
    passages = [prose(120) for _ in range(161)]
    rows = [(k, f"{passages[k]} {prose(160)} {passages[k + 1]}") for k in range(160)]
    rows += [(200 + k, f"{t} {prose(20)}") for k, t in rows[::10]] + [(400 + k, t) for k, t in rows[::20]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    sent = lambda: sum(x.totalShuffleWrite() for x in (lambda xs: [xs.apply(i) for i in range(xs.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    before = sent()
    got = [(x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in jaccard_components(df, words=5, percent=80).collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sent() - before < 6 * sum(len(t) for _, t in rows)
    sets = {i: brute.shingle_set(t, 5) for i, t in rows}
    links = {i: [j for j, t in sets.items() if 100 * len(s & t) >= 80 * len(s | t)] for i, s in sets.items()}  # of one text and its copies
    assert max(map(len, links.values())) == 3
    assert sorted(got) == sorted((i, len(s), min(links[i]), len(links[i]) - 1) for i, s in sets.items())


def test_jaccard_join_of_ids_with_several_texts(spark):
    """Rows of one id are one node, also where their texts have nothing in common."""
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randrange(10**7)}" for _ in range(n))
    x, y, z, alone = (prose(80) for _ in range(4))
    rows = [(5, x), (5, y), (3, y), (7, x + " " + prose(2)), (9, y + " " + prose(2)), (7, z), (11, z), (12, alone), (13, prose(50)), (13, alone)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert none_last(got) == none_last(brute.components(rows))


def test_local_links_of_many_similar_sets():
    import numpy as np

    from streamtable.llm.jaccard_join import local_links

    r = random.Random(1)
    base = r.sample(range(10**6), 60)
    sets = [np.array(sorted(set(base) ^ {r.choice(base) for _ in range(r.randint(0, 4))} | {r.randrange(10**6) for _ in range(r.randint(0, 3))}), np.uint64) for _ in range(80)]
    for some in (sets, sets[:12], sets[:2], sets[:1]):
        parent = list(range(len(some)))
        root = lambda i: i if parent[i] == i else root(parent[i])  # noqa: E731, B023
        own = list(range(len(some)))
        top = lambda i: i if own[i] == i else top(own[i])  # noqa: E731, B023
        for i, j in local_links(some, 90):
            assert 100 * len(set(some[i]) & set(some[j])) >= 90 * len(set(some[i]) | set(some[j]))
            parent[root(i)] = root(j)
        for i in range(len(some)):
            for j in range(i):
                if 100 * len(set(some[i]) & set(some[j])) >= 90 * len(set(some[i]) | set(some[j])):
                    own[top(i)] = top(j)
        assert all((root(i) == root(j)) == (top(i) == top(j)) for i in range(len(some)) for j in range(i))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 299: 299, 300: 299}


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    """A small graph takes no rounds, which write files; both ways agree."""
    r = random.Random(11)
    edges = spark.createDataFrame([(r.randrange(400) - 200, r.randrange(400) - 200) for _ in range(260)], "a bigint, b bigint")
    files, whole = files_of(spark, lambda: sorted(components(edges).collect()))
    assert files == 0
    monkeypatch.setattr("streamtable.llm._components.WHOLE", -1)
    files, rounds = files_of(spark, lambda: sorted(components(edges).collect()))
    assert files > 0 and whole == rounds and len({x.root for x in whole}) > 5
    assert components(edges.where("a = b")).collect() == []


def test_decontamination(spark, docs):
    rows, df = docs
    r = random.Random(9)
    long = next(t for i, t in rows if i == 42).split(" ")
    items = [(1, " ".join(long[5000:5030])), (2, "".join(c.upper() if c.upper().lower() == c else c for c in " ".join(long[100:114]))), (3, " ".join([*long[300:320], "other", *long[321:340]])), (4, None), (5, ""), (6, "one two"), (7, " ".join(r.sample(long, 30))), (8, " ".join(long[50:62])), (8, " ".join(long[50:62])), (None, "one")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in contamination(df, frame).collect())
    want = brute.contaminated(rows, items)
    assert got == want and {1, 2, 6, 8} <= {x[1] for x in want}
    left = [x.doc_id for x in decontaminate(df, frame).collect()]
    assert none_last([(x,) for x in left]) == none_last([(i,) for i, _ in rows if i not in {x[0] for x in want}])


def test_decontamination_recall_by_length(spark):
    """Items of one to ten shingles, 200 of each, cut out of long documents."""
    r = random.Random(12)
    docs = [(k, " ".join(f"w{r.randrange(10**7)}" for _ in range(3000))) for k in range(40)]
    items = []
    for n in range(1, 11):
        for _ in range(200):
            ws = docs[r.randrange(40)][1].split(" ")
            at = r.randrange(3000 - n - 4)
            items.append((len(items), " ".join(ws[at : at + n + 4])))
    found = {x.item_id for x in contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for n in range(10):
        assert sum(k in found for k in range(200 * n, 200 * n + 200)) >= (196 if n == 0 else 200)


def test_decontamination_with_a_hot_shingle(spark):
    """A phrase that all items and all documents have makes no pairs by itself, and hides none."""
    r = random.Random(13)
    prose = lambda n: " ".join(f"w{r.randrange(10**7)}" for _ in range(n))
    phrase = "what is the answer to the question that follows"
    items = [(k, f"{phrase} {prose(30)}") for k in range(300)] + [(1000, phrase)]
    docs = [(k, f"{prose(40)} {phrase} {prose(40)}") for k in range(300)] + [(1000 + k, f"{prose(20)} {items[k][1]}") for k in range(5)]
    got = sorted((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == brute.contaminated(docs, items) and len(got) == 310


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for out in (dedup_lines(none), dedup_bytes(none), dedup_passages(none), jaccard_components(none), contamination(none, spark.createDataFrame([], "item_id bigint, text string"))):
        assert out.collect() == []


def test_sql_states_the_same(spark):
    """The queries that have SQL, on the smallest table."""
    import duckdb

    from streamtable.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, folder)
        want = con.sql(sql)
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
