"""Filter audit, license scan and periodic runs against brute force."""

import random

import numpy as np
import pytest
from brute import audit as plain_audit
from brute import collapsed, license_matches, planted, runs, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import audit, licenses, periods, queries

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

# --- operator 11


def judged(seed=3, n=150):
    """Documents that fail the filters in all sorts of ways, copies among them, two of them with one id."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.choice([0, 3, 99, 100, 101, 180])))
        t = t.upper() if rng.random() < 0.2 else t
        t = t + rng.choice(["", " #", "|", " 50%"]) if rng.random() < 0.4 else t
        t = rng.choice(rows)[1] if rows and rng.random() < 0.3 else t
        rows.append((i, t, rng.choice(["en", "de", None, ""])))
    rng.shuffle(rows)
    rows += [(None, rows[0][1], "en"), (None, rows[0][1], "xx"), rows[5], (7, None, "en"), (8, "", "en")]
    labels = [(rng.randrange(n + 20), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    return rows, labels


def test_audit_is_that_of_filtering_each_order(spark):
    rows, labels = judged()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in found.collect()} == plain_audit(rows, labels)
    assert found.count() == len({p or "" for _, _, p in rows}) * 600


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_positional_popcounts(words):
    found = audit.positional_popcount(np.array(words, np.uint32))
    assert found.tolist() == [sum(w >> i & 1 for w in words) for i in range(32)]


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    found = audit.audit(odd_docs.withColumn("part", odd_docs.lang).withColumn("fails", odd_docs.score), labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in found} == plain_audit(rows, [(0, 1, 0), (5, 1, 1)])
    assert audit.audit(no_docs, labels).count() == 0


def test_audit_with_text_ids_and_no_labels(spark):
    docs = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en"), ("c", "y", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    last = audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").first()
    assert (last.kept, last.removed, last.good_lost) == (2, 1, 0)


def test_one_survival_word_for_each_set_of_failures():
    assert [int(w).bit_count() for w in audit.SURVIVAL] == [1 << (5 - f.bit_count()) for f in range(32)]


# --- operator 12


def licensed(seed=11, n=80):
    rng = random.Random(seed)
    filler = ["the", "license", "under", "to", "a", "of", "version", "2", "public", "Zürich", "mit", "cc", "nc", "by", "software", "4.0", "general"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.choice([0, 1, 5, 40, 90]))]
        if rng.random() < 0.7:
            own = rng.choice(licenses.TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(filler)
            own[0] = own[0].title()
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        out.append((i, rng.choice([" ", "\n", ", ", " - "]).join(words)))
    return out


def test_license_scan_finds_what_judging_each_window_finds(spark):
    rows = licensed()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = licenses.scan(docs).collect()
    expected = {i: license_matches(t, licenses.TEMPLATES) for i, t in rows}
    for r in out:
        assert {(m.template, m.first_word, m.end_word, m.containment) for m in r.matches} == expected[r.doc_id]
        assert all(m.label == licenses.TEMPLATES[m.template].label for m in r.matches)
    assert len({m[0] for x in expected.values() for m in x}) > 15


def test_license_scan_does_not_depend_on_the_order_of_words():
    texts = [t.encode() for _, t in licensed(5)]
    names = licenses.vocabulary(licenses.TEMPLATES)
    by_name = licenses.Index(licenses.TEMPLATES, dict.fromkeys(names, 0))
    backwards = licenses.Index(licenses.TEMPLATES, {w: -i for i, w in enumerate(names)})
    found = [x.matches(licenses.Hits(texts, x.numbers)) for x in (by_name, backwards)]
    assert found[0] == found[1] and any(found[0])


def test_filters_leave_few_blocks_of_common_words(spark):
    """Blocks that hold a template's frequent words alone aren't candidates."""
    rows = [(i, "the license of the public software version 2 under a general work is") for i in range(200)] + [(500, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = licenses.Index(licenses.TEMPLATES, licenses.frequencies(docs))
    hits = licenses.Hits([t.encode() for _, t in rows], index.numbers)
    number = next(i for i, t in enumerate(licenses.TEMPLATES) if t.text == "released under the mit license")
    assert {int(x[0]) for x in index.candidates(number, hits)} == {200}


def test_license_scan_of_odd_rows(spark, odd_docs, no_docs):
    extra = odd_docs.withColumn("matches", odd_docs.key).withColumn("word", odd_docs.key)
    out = licenses.scan(extra)
    assert out.columns == [*odd_docs.columns, "word", "n_words", "matches"]
    for r in out.collect():
        assert {(m.template, m.first_word, m.end_word, m.containment) for m in r.matches} == license_matches(r.text, licenses.TEMPLATES)
    assert licenses.scan(no_docs).count() == 0
    assert licenses.scan(odd_docs, templates=()).where("size(matches) > 0").count() == 0


# --- operator 13


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=5), st.integers(1, 9), st.integers(0, 40))
def test_runs_of_any_words(documents, period, more):
    documents = documents + [d[:period] * (more // period + 1) + d for d in documents]
    assert periods.runs_of(documents) == [runs(d) for d in documents]
    for d in documents:
        found = runs(d)
        assert periods.collapse(d, found).decode() == collapsed([x.decode() for x in d], found)


def test_runs_of_long_periods():
    rng = random.Random(2)
    for q in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 64, 65, 100):
        root = [b"%d" % rng.randrange(9) for _ in range(q)]
        for times in (3.9, 4, 4.3, 11):
            words = [b"x", b"y"] + (root * 12)[: int(q * times)] + [b"z"] * 7 + root
            assert periods.runs_of([words, root, words]) == [runs(words), runs(root), runs(words)]


def test_find_and_digests(spark, odd_docs, no_docs):
    extra = odd_docs.withColumn("runs", odd_docs.key).withColumn("period", odd_docs.key)
    out = periods.find(extra)
    assert out.columns == [*odd_docs.columns, "period", "n_words", "runs", "collapsed"]
    for r in out.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert [tuple(x) for x in r.runs] == runs(words) and r.collapsed == collapsed(words, runs(words)) and r.n_words == len(words)
    assert periods.find(no_docs).count() == 0


@pytest.fixture(scope="module")
def repeating(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(rng.choice([0, 1, 2, 7, 30, 90])))) for i in range(300)]
    rows += [(1000 + i, rng.choice(["", None, "ha " * 40, "x y z " * 9 + "x y", "a a a a a a b b b b b b"])) for i in range(40)] + [(None, "u u u u u u u")]
    path = str(tmp_path_factory.mktemp("repeating"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows, path


def test_query_of_runs_equals_brute_force(spark, repeating):
    rows, path = repeating
    out = {r.doc_id: r for r in queries.QUERIES["op13_periods"](spark, path).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        words = planted(i, t) if i is not None else t.split()
        found, r = runs(words), out[i]
        top = sorted(found, key=lambda x: (-x[1] / x[2], x[0], x[2]))[0] if found else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *top)
        assert r.exponent_milli == (1000 * r.length // r.period if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r.collapsed_sha256 == sha(collapsed(words, found))


SF = "/root/testdata/sf0.001"


def test_stages_beside_clashing_columns(spark):
    """Columns with the names that stages or operators use inside come out as they went in."""
    import corpus_pipeline as cp

    docs = queries.table(spark, SF, "documents").limit(40)
    names = ["_id", "n_lines", "n_dropped", "kept", "kept_text", "_score", "_lang", "_matches", "matches", "score", "component_id", "n_shingles", "key"]
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.col("doc_id") * 100 + i)
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id * 100 + i for r in rows for i, c in enumerate(names))


def test_periods_read_a_few_texts_at_a_time(spark, monkeypatch, folder):
    from tessera import session

    held = {}

    def spy(df, name, batch=None, options=None):
        held[name] = batch
        return session.materialize(df, name, batch, options)

    monkeypatch.setattr(queries, "materialize", spy, raising=False)
    spark.createDataFrame([(1, "a b " * 9), (2, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id for r in queries.QUERIES["op13_periods"](spark, folder).collect()} == {1, 2}
    assert held == {"periods": periods.READ}
