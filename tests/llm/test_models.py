"""Classifiers by held-out accuracy, personal data and pages against plain versions, queries against DuckDB."""

from zlib import crc32

import duckdb
import numpy as np
import pytest
from brute import components, kept_lines, leaks, personal, sha
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import bpe, html, jaccard, lines, pii, quality, queries, substrings, toxicity
from tessera.llm.oracle import SQL
from tools.oracle_check import digest

SF_MODEL = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, SF_SMALL)
    rows, res = [tuple(r) for r in df.collect()], duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, rows) == digest(cols, res.fetchall())


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(SQL) <= set(entry.oracle_sql())


# --- operators 2 and 4


def held_out(spark, query, label, positive):
    labels = spark.read.parquet(f"{SF_MODEL}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = queries.queries()[query](spark, SF_MODEL).where("held_out").join(labels, "doc_id").toPandas()
    hit = rows[rows.y == positive].predicted == positive
    return (rows.predicted == rows.y).mean(), hit.mean(), len(rows)


def test_toxicity_on_held_out_rows(spark):
    accuracy, recall, n = held_out(spark, "op2_toxicity", "toxic", 1)
    assert n > 500 and accuracy > 0.97 and recall > 0.9


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """2,700 rows a class, in several shards: none is left out of the counts, the folds or the thresholds."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2000)
    n = 5400
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.when(F.col("id") % 2 == 0, "vile").otherwise("kind"), F.lit(" w"), F.col("id") % 300).alias("text"))
    labels = spark.range(n).selectExpr("id doc_id", "int(id % 2 = 0 or id % 9 = 0) toxic")
    data = [toxicity.Shard(*r) for r in toxicity.shards(docs, labels, F.lit(True)).collect()]
    assert len(data) == 3 and sum(len(x.texts) for x in data) == n
    assert all(set(x.fold) == set(range(toxicity.FOLDS)) for x in data)
    kept = []
    monkeypatch.setattr(toxicity, "thresholds", lambda logits, y, spoken, was=toxicity.thresholds: kept.append(len(logits)) or was(logits, y, spoken))
    model = toxicity.train(docs, labels, F.lit(True))
    toxic = sum(i % 2 == 0 or i % 9 == 0 for i in range(n))
    assert toxic > 2500 and model.value[2] == toxic / n and kept == [n]
    wrong = toxicity.score(docs, model).where("(score >= 0.5) <> (doc_id % 2 = 0)").count()
    assert wrong == 0


def test_toxicity_in_shards_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 800)
    accuracy, recall, n = held_out(spark, "op2_toxicity", "toxic", 1)
    assert n > 500 and accuracy > 0.96 and recall > 0.88


def test_toxicity_takes_one_row_of_a_repeated_document(spark):
    docs = spark.createDataFrame([(i % 40, f"text {'bad' if i % 40 < 20 else 'good'} {i % 40}") for i in range(120)] + [(None, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] * 2 + [(77, 1), (None, 0), (5, None)], "doc_id long, toxic int")
    (row,) = toxicity.shards(docs, labels, F.lit(True)).collect()
    shard = toxicity.Shard(*row)
    assert len(shard.texts) == 40 and shard.labels.tolist() == [1] * 20 + [0] * 20 and len(shard.texts[4]) == 3


def test_quality_on_held_out_rows(spark):
    accuracy, recall, n = held_out(spark, "op4_quality", "quality", 0)
    assert n > 500 and accuracy > 0.98 and recall > 0.95


def quality_balance(spark, epochs, grams_only=False):
    """Mean of the two classes' hit rates on held-out rows of the labelled documents."""
    docs, labels = (spark.read.parquet(f"{SF_MODEL}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").orderBy("doc_id").toPandas()
    held = rows.doc_id.map(lambda i: crc32(str(i).encode()) % 4 == 2)
    learn = rows[~held].groupby("y").head(quality.MAX_ROWS)
    model = quality.fit([quality.features(t.encode()) for t in learn.text], learn.y.to_numpy(), epochs)
    added = quality.Added(model)
    good = np.array([added.logit(t.encode().split()) >= model.cut for t in rows[held].text])
    y = rows[held].y.to_numpy()
    return (good[y == 1].mean() + (~good[y == 0]).mean()) / 2


def test_quality_comes_from_training_the_vectors_and_needs_no_pairs(spark, monkeypatch):
    assert quality_balance(spark, quality.EPOCHS) > 0.95
    assert quality_balance(spark, 0) < 0.9
    monkeypatch.setattr(quality, "pairs", lambda words: np.zeros(0, np.int64))
    assert quality_balance(spark, quality.EPOCHS) > 0.93


def test_quality_sums_do_not_depend_on_the_cache(monkeypatch):
    model = quality.Model(np.random.default_rng(1))
    texts = [b"", b"one", b"a b a b " * 30, b"x" * 3000 + b" end", "ä ö ü".encode()]

    def logits():
        added = quality.Added(model)
        return [added.logit(t.split()) for t in texts + texts]

    plain = [model.logit(quality.features(t)[1] @ model.table[quality.features(t)[0]].astype(float), quality.features(t)[1].sum()) for t in texts]
    assert np.allclose(logits(), plain * 2)
    monkeypatch.setattr(quality, "STRETCH", 7)
    monkeypatch.setattr(quality, "CACHED_WORDS", 3)
    assert np.allclose(logits(), plain * 2)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd_docs, no_docs, module, label):
    labels = spark.createDataFrame([(i % 17, i % 2) for i in range(34)] + [(None, 1), (3, None), (999, 1)], f"doc_id long, {label} int")
    everything = F.lit(True)
    fitted = module.train(odd_docs.drop("score"), labels, everything)
    rows = module.score(odd_docs, fitted).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    again = {r.doc_id: r.score for r in module.score(odd_docs, fitted).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    assert module.score(no_docs, fitted).count() == 0
    unlabelled = module.train(odd_docs, labels.limit(0), everything)
    assert {r.score for r in module.score(odd_docs, unlabelled).collect()} == {0.0}
    assert {r.score for r in module.score(odd_docs, module.train(odd_docs, labels.where(f"{label} = 1"), everything)).collect()} == {1.0}


def test_language_is_told_from_the_text():
    for lang, words in toxicity.FUNCTION_WORDS.items():
        assert toxicity.LANGUAGES[toxicity.language(toxicity.codes(words.encode()))] == lang


# --- operator 5


def spans(docs):
    return {(r.doc_id, i): [tuple(s) for s in r.spans] for i, r in enumerate(pii.find(docs).collect())}


def test_seed_spans_against_plain_patterns(spark, odd_texts):
    hard = [
        "a@b.c_d@e.f x@y @z a@b a.b@c.d.e-f.g..h@i.j@k.l 1@2.3.4.5",
        "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 00255.0.0.01 1.2.3 .1.2.3.4. 12.34.56.78x",
        "4111-1111 1111-1111 4111 1111 1111 1112 4111  1111 0000000000000000000 00000000000000000000 5-",
        "+1 (214) 555-7381 +1 +12 +123456789012345 +1234567890123456 ++49 30 1234567- +.1",
        "é你 a@b.de 🎉 10.0.0.1 ü +49 30 12345678 4111111111111111",
        "x@" * 3000 + "x.y",
        "9" * 4000 + " 1.1.1.1",
    ]
    texts = [*odd_texts, *hard]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.find(docs).collect()}
    assert got == {i: personal(t) for i, t in enumerate(texts)}


def test_confident_patterns_discover_what_seeds_miss(spark):
    seeds = [(i, f"my notes say please call +49 30 555-{1000 + i} before noon and not the {i} of it") for i in range(20)]
    missed = [(100, "well please call 030-5554711 before noon or so"), (101, "there were 030-5554712 of them"), (102, "please call 12 before noon")]
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.find(spark.createDataFrame(seeds + missed, "doc_id long, text string")).collect()}
    assert got[100] == [("phone", 17, 28, False)]
    assert got[101] == got[102] == []
    assert all(got[i] and got[i][0][0] == "phone" and got[i][0][3] for i, _ in seeds)


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if not s.base] for r in pii.find(docs).collect()}


def test_discovery_with_many_unseen_spaced_and_second_round_identifiers(spark):
    texts = [f"note {i}: please call +49 30 555-{1000 + i} before noon" for i in range(12)]
    texts += [f"please call 030-555{4000 + i} before noon" for i in range(8)]  # 60 % seeds
    texts += [f"you may dial 030-555{4000 + i} at night" for i in range(8)]  # no seed stands here
    texts += ["you may dial 030-7770001 at night", "please call 030 555 4711 before noon.", "please call (030) 555 4712 before noon", "please call 030 5554713 before noon"]
    texts += ["please call 20 before noon", "there were 030-7770002 of them", "in 2020 12 people came", "up to 7 80"]
    got = found(spark, texts)
    assert [got[i] for i in range(12, 20)] == [got[i] for i in range(20, 28)] == [[f"030-555{4000 + i}"] for i in range(8)]
    assert [got[i] for i in range(28, 36)] == [["030-7770001"], ["030 555 4711"], ["030) 555 4712"], ["030 5554713"], [], [], [], []]
    assert not any(got[i] for i in range(12))


def test_misfits_and_other_kinds_speak_against_a_pattern(spark):
    seeds = [f"see +49 30 555-{1000 + i} there" for i in range(8)]
    misfits = [f"see {10 + i} there" for i in range(8)]
    others = [f"see a{i}@b.de there" for i in range(8)]
    assert found(spark, [*seeds, "see 030-5554711 there"])[8] == ["030-5554711"]
    for against in (misfits, others):
        assert found(spark, [*seeds, *against, "see 030-5554711 there"])[16] == []


def test_personal_data_of_odd_rows(spark, odd_docs, no_docs):
    assert len(spans(odd_docs)) == odd_docs.count()
    assert pii.find(no_docs).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark, odd_docs):
    for df in (pii.find(odd_docs), lines.apply_bitmaps(odd_docs, lines.keep_bitmaps(odd_docs))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


# --- operator 7

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='<p>no</p>';</script></head><body><header><a href=/>Home</a></header>"
    "<nav><ul><li><a href=/a>Menu entry</a></li></ul></nav><div class='ad'>Buy now, only today and only here in this shop</div><article><h1>Title &amp; more</h1>"
    "<p>First&nbsp;paragraph,\n with <b>bold</b> and <a href=/x title='a > b'>a link</a> in it.<p>Ja.<!-- no --><form><input><p>Your name</p></form><ul><li>Point</li></ul></article>"
    "<section class='comments'><p>A reader writes a long comment about the text above, with many words.</p></section><aside><p>More to read on this subject in our archive</p></aside><footer>&copy; me</footer>"
)


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\nFirst paragraph, with bold and a link in it.\nJa.\nPoint"
    assert html.main_text(PAGE[: PAGE.index("in it.")]) == "Title & more\nFirst paragraph, with bold and a link"
    assert [html.main_text(x) for x in (None, "", "<", "<p", "<!-- open", "<script>x")] == ["", "", "<", "", "", ""] or html.main_text("<") in ("", "<")


ARTICLE = "<article><h1>Tides</h1><p>The water comes and goes twice a day, as it always did.</p>%s<p>Nobody had to be told so.</p></article>"
TIDES = "Tides\nThe water comes and goes twice a day, as it always did.\nNobody had to be told so."


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><script>var a = '<body><p>no';</script><body>" + ARTICLE % "",
    "<html><head><meta charset=utf-8><title>T</title>" + ARTICLE % "",
    "<html><head><title>Never ended</head><body>" + ARTICLE % "",
    "<html><head><title>T</title></head><body><svg class='logo' viewBox='0 0 1 1'/>" + ARTICLE % "<object data='a.svg' />",
    "<body><svg><path d=''/>" + ARTICLE % "<svg><foreignObject><p>no</p></foreignObject></svg>",
    "<body><button>Menu" + ARTICLE % "<iframe src='a'/>" + "<button>More</button>",
    "<body><select><option>One<option>Two" + ARTICLE % "<object data=a>",
    "<body class='has-sidebar'>" + ARTICLE % "",
    "<html class='no-popup'><body class='home comments-open'><main id='search-results'>" + ARTICLE % "" + "</main>",
    "<body>" + (ARTICLE % "").replace("<article", "<article class='post ad-free'"),
])
def test_ordinary_pages_keep_their_article(page):
    assert html.main_text(page) == TIDES


def test_comments_in_articles_of_their_own_are_no_main_text():
    page = "<body>" + ARTICLE % "" + "<div id=comments><article class=comment><p>I saw it there only last week and it was low.</p></article></div>"
    assert html.main_text(page) == TIDES


def test_many_open_tags_take_linear_time():
    import time

    for tag in ("<object>", "<button>", "<select>", "<svg>", "<iframe>", "<head>", "<title>", "<script>"):
        began = time.process_time()
        html.main_text("<body>" + (tag + "x ") * 30_000)
        assert time.process_time() - began < 5


def test_tree_learns_its_table():
    x, y = html.examples()
    assert (html.classify(html.tree(), x) == y).all() and 0.3 < y.mean() < 0.7


def test_pages_with_odd_rows(spark):
    long = "<article>" + "<p>word &lt; word</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", None), (None, "u", long, "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert [len(r.text) for r in got if r.page_id is None] == [20_000 * 12 - 1]
    assert sorted(r.text for r in got if r.page_id in (2, 3)) == ["", ""] and len(got) == 5
    assert html.extract(pages.limit(0)).count() == 0


# --- pipeline


def test_pipeline_against_plain_stages(spark):
    """The classifier's decisions are taken as they are; all other stages are done again by brute force."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    clean = stages["toxicity"](spark, docs, SF_SMALL)
    assert clean.columns == docs.columns
    scored = {r.doc_id: r.predicted for r in queries.op2_toxicity(spark, SF_SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not scored[r.doc_id]]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows)
    rows = [(i, x[2]) for i, x in kept_lines(rows).items()]
    least = components(rows)
    rows = [(i, t) for i, t in rows if least[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {x[0] for x in leaks(rows, items)}
    want = {i: sha(t) for i, t in rows if i not in bad}
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert {r.doc_id: r.decoded_sha256 for r in got.collect()} == want
    assert got.where("not decodes").count() == 0


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF_SMALL)
            assert out.columns == docs.columns
            docs = out
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
        assert last.count() == docs.count()
        assert last.where("not decodes").count() == 0


def test_operators_write_nothing_to_the_driver_folder(spark, odd_docs):
    ranks = queries.vocabulary(spark)
    assert bpe.encode(odd_docs, ranks, queries.PATTERN).count() == substrings.dedup(odd_docs).count() == jaccard.join(odd_docs).count()
