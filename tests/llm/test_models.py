"""Tokenizer, neighbours, classifiers, language model and page extraction."""

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamtable.llm import _store, bpe, html_extract, lm_score, toxicity
from streamtable.llm.neighbours import nearest


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


ODD = [None, "", " \n\t ", "I'll DON'T we've o'clock 's", "Straße ÉCOLE İstanbul ΑΣ ΣΑΣ", "漢字かな 🙂🙂 ½ ²3", "<|endoftext|>a<|startoftext|> <|nothing|>", "a" * 3000, "x\x00y\x1cz\x85w​q", "é Å", "$$$ *** 123 4.5", "aaaa " * 50, "aaaa " * 50]


def test_bpe_equals_the_library(spark, library):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(ODD)], "doc_id bigint, text string, ids string, extra int")
    out = bpe.encode_decode(df, bpe.default_vocabulary())
    assert out.columns == ["doc_id", "text", "extra", "ids", "decoded"]
    for r in out.collect():
        want = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    for r in bpe.digests(out, with_ids=True).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(df.limit(0), bpe.default_vocabulary()).collect() == []


def test_bpe_on_documents(spark, library):
    from streamtable.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op6_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded)


def test_pipeline_encodes_in_one_worker(spark):
    """Encoding and digests one after the other take two Python workers for each task at once; the rows are the same."""
    import corpus_pipeline

    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(None, "no id")], "doc_id bigint, text string")
    got = corpus_pipeline.encode(spark, df, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = bpe.digests(bpe.encode_decode(df, bpe.default_vocabulary(), keep=("doc_id",)), with_ids=True)
    assert got.schema == want.schema and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert corpus_pipeline.encode(spark, df.limit(0), "").collect() == []


def test_workers_keep_nothing_for_other_tasks():
    """A vocabulary and its words last for the tasks that use them, not for as long as the Python worker."""
    encode, other = _store.tidy(lambda batches: [_store.kept("spec", object)], keeps=True), _store.tidy(iter)
    assert next(encode([])) is (one := next(encode([])))
    assert list(other([1, 2])) == [1, 2] and next(encode([])) is not one
    _store.forget()


def test_workers_give_memory_back():
    """What a task has freed below something that stays is no longer the process's after it."""
    code = """
import re
from streamtable.llm._store import tidy
mb = lambda: sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
stay = []
def run(batches):
    blocks = [b"x" * 100_000 for _ in range(2000)]
    stay.append(blocks.pop())
    yield mb()
before = mb()
most, = run([])
plain = mb()
most, = tidy(run)([])
print(before, plain, most, mb())
"""
    before, plain, most, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout.split())
    assert most > before + 150 and plain > before + 150 and after < before + 30


def test_bpe_of_every_code_point(library):
    """Each code point of the basic plane, and every third one beyond, beside a letter, a digit and a sign, a few of them in a text."""
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        own = bpe.Bpe(f.read())
    letters = [chr(c) for c in [*range(0x10000), *range(0x10000, 0x110000, 3)] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}B{c}1!{c}" for c in letters[k : k + 16]) for k in range(0, len(letters), 16)]
    assert all(own.encode(t).tolist() == e.ids for k in range(0, len(texts), 5000) for t, e in zip(texts[k : k + 5000], library.encode_batch(texts[k : k + 5000], add_special_tokens=False)))


def test_bpe_refuses_other_settings():
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        j = json.load(f)
    j["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        bpe.Bpe(json.dumps(j))


@pytest.mark.parametrize("options", [{}, {"shard_rows": 700, "visits": 50}])
@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_neighbours_recall(spark, sf, options):
    """At two sizes, in one cell and in many."""
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = total = 0
    got = {}
    for r in nearest(table, **options).collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0)
    for q, found in got.items():
        c = u @ u[ids == q][0]
        c[ids == q] = -2
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert max(abs(r.score - c[ids == r.vec_id][0]) for r in found) < 1e-12
        hit += len({r.vec_id for r in found} & set(ids[np.argsort(-c)[:5]].tolist()))
        total += 5
    assert hit / total >= 0.9


def test_neighbours_of_a_hot_vector(spark):
    """A third of the rows are one vector, others are multiples of another; ties go to the smaller id, exactly."""
    r = np.random.default_rng(8)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else [2.0 ** (k % 7), 2.0 ** (k % 7), 0.0, 0.0] if k % 3 == 1 else r.normal(size=4).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for x in nearest(df, shard_rows=300, visits=20).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    assert len(got) == 60
    for q, found in got.items():
        if q % 3 < 2:
            assert [i for _, i in sorted(found)] == [i for i in range(q % 3, 3000, 3) if i != q][:5]


def test_neighbours_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (50, [1.0, 0.0]), (8, [3.0, 0.0]), (8, [3.0, 0.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1e200, 1e200])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in nearest(df).collect())
    half = round(2**-0.5, 12)
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 50, 1.0), (0, 4, 2, half), (0, 5, 11, -half), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 8, 1.0), (50, 4, 2, half), (50, 5, 11, -half)]
    assert nearest(df.limit(0)).collect() == []


def test_toxicity_held_out(spark):
    """Fitted on four fifths of the documents by content, copies together; judged on the others."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text").collect()
    fold = toxicity.folds([toxicity.features(r.text) for r in rows])
    fifth = spark.createDataFrame([(r.doc_id,) for r, f in zip(rows, fold.tolist()) if f == 0], "doc_id bigint")
    chain = toxicity.fit_chain(docs, labels.join(fifth, "doc_id", "left_anti"), {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")})
    out = toxicity.score(docs.join(fifth, "doc_id", "left_semi"), chain, keep=("doc_id",)).join(labels, "doc_id").collect()
    n = {k: sum((r.toxic, r.is_toxic) == k for r in out) for k in ((1, True), (1, False), (0, True), (0, False))}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.8 and n[0, True] / (n[0, True] + n[0, False]) < 0.01
    told, true = sum(r.p_toxic for r in out) / len(out), sum(r.toxic for r in out) / len(out)
    assert abs(told - true) < 0.05  # probabilities in the corpus, not in the half-and-half sample


def test_copies_share_a_fold():
    """Random labels, each row five times and one word changed in some: what is out of fold tells nothing."""
    r = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(150):
        row = np.unique(r.integers(0, 4000, 60)).astype(np.int32)
        label = int(r.random() < 0.5)
        for k in range(5):
            rows.append(np.unique(np.append(row[k > 2 :], 5000 + k)).astype(np.int32))
            y.append(label)
    fold = toxicity.folds(rows)
    assert all(len(set(fold[k : k + 5].tolist())) == 1 for k in range(0, len(rows), 5)) and max(np.bincount(fold)) < 200
    y = np.array(y, float)
    right = 0
    for f in range(toxicity.FOLDS):
        w = toxicity.fit_without(f, rows, fold, np.zeros((len(rows), 0)), y, 1 << toxicity.BITS)
        o = np.flatnonzero(fold == f)
        p = toxicity.Rows([rows[i] for i in o]).dot(w[: 1 << toxicity.BITS]) + w[-1]
        right += ((p > 0) == (y[o] > 0)).sum()
    assert 0.3 < right / len(rows) < 0.7


def test_the_sample_is_bounded(spark):
    rows, held = toxicity.within([(k, b"1234" * 10, 1) for k in range(9, -1, -1)], 35)
    assert [x[0] for x in rows] == [0, 1, 2] and held == 30
    docs = spark.createDataFrame([(k % 4, f"word{k} text") for k in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] * 50, "doc_id bigint, toxic int")
    assert len(toxicity.fit_chain(docs, labels, {"toxic": F.col("toxic")}, total=3).weights) == 1


def test_chain_feeds_earlier_probabilities():
    r = random.Random(2)
    rows, first, second = [], [], []
    for _ in range(400):
        a, b = r.random() < 0.5, r.random() < 0.2
        rows.append(np.array(sorted({10} & {10 if a else -1} | {20} & {20 if b else -1} | {30 + r.randrange(50)}), np.int32))
        first.append(a)
        second.append(a and not b)
    chain = toxicity.train(rows, {"first": np.array(first), "second": np.array(second)}, least=5)
    p = chain.probabilities(rows)
    assert ((p[:, 0] >= chain.thresholds[0]) == np.array(first)).mean() > 0.97
    assert ((p[:, 1] >= chain.thresholds[1]) == np.array(second)).mean() > 0.95
    assert chain.weights[1][-2] != 0  # the weight of the first category's probability


def test_toxicity_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "bad words", "a"), (2, "good words", "b"), (3, None, None), (3, "", "c"), (None, "bad", "d")], "doc_id bigint, text string, p_toxic string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    out = toxicity.score(docs, toxicity.fit_chain(docs, labels, {"toxic": F.col("toxic")}))
    assert out.columns == ["doc_id", "text", "p_toxic", "is_toxic"] and out.count() == 5
    assert toxicity.score(docs.limit(0), toxicity.train([], {"toxic": np.zeros(0)})).collect() == []


def test_lm_prefers_the_order_it_was_trained_on(spark):
    r = random.Random(3)
    cycle = ["red", "green", "blue", "white", "black", "grey"]
    texts = []
    for k in range(300):
        at = r.randrange(6)
        texts.append(" ".join(cycle[(at + j) % 6] for j in range(120)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = lm_score.fit(docs)
    shuffled = " ".join(r.sample(texts[0].split(), 120))
    probe = spark.createDataFrame([(0, texts[0], 7), (1, shuffled, 7), (2, None, 7), (3, " \n", 7), (4, "red", 7), (4, "red", 7)], "doc_id bigint, text string, n_tokens int")
    out = {r.doc_id: r for r in lm_score.score(probe, model=model).collect()}
    assert out[0].log_likelihood > out[1].log_likelihood + 20
    assert (out[2].n_tokens, out[2].log_likelihood, out[2].mean_log_likelihood) == (0, 0.0, None) == (out[3].n_tokens, out[3].log_likelihood, out[3].mean_log_likelihood)
    assert out[4].n_tokens == 1 and out[0].n_tokens == 120
    assert lm_score.score(probe.limit(0)).collect() == []


def test_lm_trains_on_every_word_pair(spark):
    """A corpus of one repeated word pair: a draw by word pair might leave it out."""
    docs = spark.createDataFrame([(k, "left right " * 60) for k in range(200)], "doc_id bigint, text string")
    assert lm_score.score(docs).first().mean_log_likelihood > np.log(0.8)


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """The same rows in 1 and 7 partitions, trained in several blocks."""
    monkeypatch.setattr(lm_score, "BLOCK", 20_000)
    monkeypatch.setattr(lm_score, "WARM", 5_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, seven = ({r.doc_id: r.log_likelihood for r in lm_score.score(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == seven


def test_lm_beats_frequencies_on_held_out_documents(spark):
    """Nine in ten documents by content for training; on the others, at least half a nat a word better than how often words are."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    model = lm_score.fit(docs.where("not held"))
    out = lm_score.score(docs.where("held"), model=model).agg(F.sum("log_likelihood"), F.sum("n_tokens")).first()
    plain = n = 0
    texts = lm_score.pa.array([r.text for r in docs.where("held").collect()])
    mass = np.bincount(model.classes, weights=np.exp(model.within), minlength=lm_score.CLASSES)
    assert mass.max() < 1.001  # shares of a class add up to one at most
    number, total, distinct = count_words(docs.where("not held").collect())
    for _, data, offs in lm_score._words.pieces(texts):
        h, _ = lm_score.read(data, offs)
        n += len(h)
        plain += sum(np.log((number.get(x, 0) + 0.5) / (total + 0.5 * distinct)) for x in h.tolist())
    assert n == out[1] and out[0] / n > plain / n + 0.5


def count_words(rows):
    from collections import Counter

    number = Counter()
    for _, data, offs in lm_score._words.pieces(lm_score.pa.array([r.text for r in rows])):
        number.update(lm_score.read(data, offs)[0].tolist())
    return number, sum(number.values()), len(number)


def test_lm_scores_against_a_loop(spark):
    """The score of whole documents, word by word from the model's numbers."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(1, 60))) for _ in range(50)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    m = lm_score.fit(docs)
    p = [q.astype(float) for q in m.params]
    for row in lm_score.score(docs, model=m).collect():
        ws = texts[row.doc_id].split(" ")
        ids = [int(m.words.ids(lm_score.read(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0]) for w in ws]
        total = 0.0
        for i, own in enumerate(ids):
            near = [m.classes[ids[j]] if 0 <= j < len(ids) else lm_score.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
            mean = [np.mean([m.vectors[j] for j in side], axis=0) if side else np.zeros(lm_score.DIMS) for side in (ids[max(0, i - 16) : i], ids[i + 1 : i + 17])]
            h = np.tanh(np.concatenate([*(p[0][c] for c in near), *mean]) @ p[1] + p[2])
            z = h @ p[3] + p[4]
            total += z[m.classes[own]] - np.log(np.exp(z).sum()) + m.within[own]
        assert row.log_likelihood == pytest.approx(total, rel=1e-4)


def test_extraction_of_held_out_layouts():
    model, r = html_extract.train(), random.Random(77)
    right = 0
    for _ in range(120):
        page = html_extract.generated_page(r)
        want = "\n\n".join(x.text for x in html_extract.parse(page) if x.text and x.label)
        right += html_extract.main_text([page], model)[0] == want
    assert right >= 102


def test_extraction_from_pages(spark):
    import re

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    out = html_extract.extract(df).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.n_chars == len(r.text)
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1|article)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_extraction_of_awkward_pages(spark):
    pages = [(1, None), (2, ""), (3, "no tags &amp; one\n block &lt;b&gt;"), (4, "<p>a<p>b <i>c</i>"), (5, "<!-- never closed <p>x"), (6, "<article><p>" + "word " * 20000 + "</p></article>"), (6, "<<<>>> < a='"), (7, '<script>var x = "</p>";</script><article><p>text here is long enough to matter, surely.</p></article>')]
    df = spark.createDataFrame([(i, h, "u", "clash") for i, h in pages], "page_id bigint, html string, url string, text string")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect() if r.page_id != 6}
    assert got[1].text == got[2].text == got[5].text == ""
    assert "var x" not in got[7].text and "text here" in got[7].text
    assert out.where("page_id = 6").agg(F.max("n_chars")).first()[0] == 99_999
    assert html_extract.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["<a ", "<option>", "<p>", "<b>", "</x>", '<a ">" ', "<!", "<a href='x\">", "<b></i>", "<p><div><b><hr>", "<", "&amp", "<table><tr><td>", "<li><!--", "<head>"])
def test_long_malformed_pages_take_linear_time(unit):
    import time

    page = unit * (400_000 // len(unit))
    html_extract.parse(page[:1000])
    began = time.perf_counter()
    known = html_extract.Features(html_extract.parse(page))
    known.rows(0, min(known.n, 1000))
    assert time.perf_counter() - began < 15


def test_a_page_of_five_megabytes():
    import time

    model = html_extract.train(60)
    began = time.perf_counter()
    texts = html_extract.main_text(["<a " * 1_700_000, "<article>" + "<p>some words of the text, and more of them.</p>" * 100_000 + "</article>"], model)
    assert time.perf_counter() - began < 60 and texts[0] == "" and len(texts[1]) > 3_000_000


def test_text_in_any_element_is_judged():
    model = html_extract.train()
    text = "The words that stand here are long enough to matter, as are those that follow them. " * 3
    page = f"<body><article><p>{text}</p><p>Let <math><mi>x</mi></math> be <object>given</object>. {text}</p><noscript><p>{text}</p></noscript></article></body>"
    plain = " ".join(text.split())
    assert html_extract.main_text([page], model) == ["\n\n".join([plain, f"Let x be given. {plain}", plain])]


def test_decoding_is_consistent_and_best():
    import itertools

    r = np.random.default_rng(0)
    for _ in range(40):
        n = 7
        up = np.array([-1, *(int(r.integers(0, i)) for i in range(1, n))])
        p = r.uniform(0.05, 0.95, n)
        got = html_extract.decode(p, up)
        score = lambda y: sum(np.log(a if b else 1 - a) for a, b in zip(p, y))  # noqa: E731, B023
        fine = [y for y in itertools.product([False, True], repeat=n) if all(y[up[i]] or not y[i] for i in range(1, n))]
        assert score(got) == pytest.approx(max(map(score, fine)))
        assert all(got[up[i]] or not got[i] for i in range(1, n))


def test_pipeline(spark):
    """Each stage against its own input."""
    import brute
    import corpus_pipeline
    from streamtable.llm._store import stored

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, before, folder))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if k < 4:
            assert after.columns == docs.columns
            got = sorted((r.doc_id, r.text) for r in after.collect())
        if k == 0:
            assert set(got) <= set(rows) and len(got) > 0.7 * len(rows)
        elif k == 1:
            assert got == sorted((i, t) for i, _, _, t in brute.lines(rows))
        elif k == 2:
            assert [i for i, _ in got] == sorted(i for i, _, c in brute.components(rows) if i == c)
        elif k == 3:
            gone = {x[0] for x in brute.contaminated(rows, items)}
            assert [i for i, _ in got] == sorted(i for i, _ in rows if i not in gone)
        else:
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, _ in rows)
        before = after
    assert "corpus_pipeline" in sys.modules


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, a very long text; then empty tables."""
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, prose(30), None, "b", 5), (3, prose(40_000), "en", "a", 9), (4, prose(50), None, None, None), (4, rows_text := prose(60), "en", "a", 1), (4, rows_text, "en", "a", 1)]
    rows += [(k, prose(r.randrange(1, 120)), "en", "a", 1) for k in range(10, 60)]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = [(k, int(k % 3 == 0), int(k % 5 == 0)) for k in range(10, 40)] + [(None, 1, 1), (11, None, 1), (12, 1, None), (99, 1, 1), (13, 0, 1)]
    items = [(1, " ".join(rows[5][1].split(" ")[500:520])), (None, "x"), (2, None), (3, "")]
    for name, some in (("full", slice(None)), ("empty", slice(0, 0))):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows[some], ddl).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels[some], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame(items[some], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if name == "empty":
            assert got == []
            continue
        ids = [x.doc_id for x in got]
        assert {None, 1, 2, 4} <= set(ids) and 3 not in ids  # null and empty texts stay, the document that holds an item goes
        assert ids.count(2) == 2 and len(ids) > 40


def test_scores_are_computed_in_place():
    """No second array of all classes, whose fresh memory took most of the time; and the scores of the plain formula."""
    import tracemalloc

    r = np.random.default_rng(2)
    near, wide, y = r.integers(0, lm_score.CLASSES + 1, (4096, 2 * lm_score.SIDE)), r.normal(size=(4096, 2 * lm_score.DIMS)).astype(np.float32), r.integers(0, lm_score.CLASSES, 4096)
    p = lm_score.start()
    tracemalloc.start()
    got = lm_score.log_probability(p, near, wide, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.9 * 4096 * lm_score.CLASSES * 4
    z = np.tanh(np.concatenate([p[0][near].reshape(4096, -1), wide], axis=1).astype(float) @ p[1] + p[2]) @ p[3] + p[4]
    assert np.allclose(got, z[np.arange(4096), y] - np.log(np.exp(z).sum(axis=1)), atol=1e-4)
