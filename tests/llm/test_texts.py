"""Tokens, exact dedup, lines, substrings, decontamination and near duplicates against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import components, kept_lines, kept_words, leaks, lower, sha, shingles
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, contamination, exact, jaccard, lines, queries, substrings
from tessera.llm.graph import components as spark_components
from tessera.llm.packed import pack, pack_plain, unpack, unpack_plain

DATA = open(public_tokenizers.path(queries.RANK_FILE), "rb").read()
VOCABULARY = bpe.Vocabulary(DATA)
LIBRARY = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def pool(n=60, seed=1):
    """Documents of few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.55:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif texts and kind < 0.7:
            a, b = rng.choice(texts).split(), [rng.choice(words) for _ in range(rng.randint(0, 30))]
            texts.append(" ".join(b + a[:20]))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 5, 6, 20, 60, 120]))))
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


# --- operator 1


def test_encoding_is_that_of_the_library(spark, odd_docs, odd_texts):
    ranks = bpe.vocabulary_bytes(spark, public_tokenizers.path(queries.RANK_FILE))
    out = bpe.decode(bpe.encode(odd_docs, ranks, queries.PATTERN), ranks)
    assert out.columns == [*odd_docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == LIBRARY.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert sorted(bpe.encode(odd_docs, ranks, queries.PATTERN, decoded="decoded").collect(), key=repr) == sorted(rows, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab eEtTh'sl.,\n\t\x1c\x85  é你1 "), max_size=60), max_size=6))
def test_encoder_on_any_text(texts):
    found = bpe.Encoder(VOCABULARY, queries.PATTERN).encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == [LIBRARY.encode_ordinary(x) for x in texts]


def test_encoder_splits_new_words_in_one_pass():
    encoder, calls = bpe.Encoder(VOCABULARY, queries.PATTERN), []
    find, encoder.find = encoder.find, lambda text: calls.append(text) or find(text)
    texts = ["", None, " ".join(f"wörd{i}'s, x{i}" for i in range(500)), "a\tb c\td " * 3, "a  b", "it's 's \xa0 'll", "end "]
    found = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]
    assert found == [LIBRARY.encode_ordinary(x or "") for x in texts]
    assert len(calls) < 20


def test_both_merges_agree():
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aeinrsth \xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(2000)] + [b"a" * 64, b"e" * 63]
    joint = bpe.merge_many([x for x in pieces if x not in VOCABULARY.ranks], VOCABULARY)
    single = [bpe.merge(x, VOCABULARY.ranks) for x in pieces if x not in VOCABULARY.ranks]
    assert [np.frombuffer(x, np.int32).tolist() for x in joint] == single


def test_a_very_long_pre_token_takes_near_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert b"".join(VOCABULARY.tokens[i] for i in bpe.merge(b"abcdefgh" * (n // 8), VOCABULARY.ranks)) == b"abcdefgh" * (n // 8)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_digests_of_ids(spark, no_docs):
    ranks = bpe.vocabulary_bytes(spark, public_tokenizers.path(queries.RANK_FILE))
    tokens = bpe.encode(frame(spark, [(1, "two words"), (2, None)]), ranks, queries.PATTERN)
    got = bpe.decode(tokens, ranks).select("doc_id", *bpe.digests()).collect()
    for r, text in zip(sorted(got), ("two words", "")):
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert bpe.encode(no_docs, ranks, queries.PATTERN).count() == 0


# --- operator 6


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 3000])
def test_perfect_hash_is_minimal(n):
    keys = np.frombuffer(np.random.default_rng(n).bytes(32 * n), np.uint8).reshape(-1, 32)
    moves, slots = exact.perfect_hash(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert (exact.locate(moves, n, keys) == slots).all()


def test_exact_dedup_with_and_without_history(spark, odd_texts):
    texts = [*odd_texts, *[t for _, t in pool(80)]] * 2
    rows = list(enumerate(texts))
    best, size = {}, {}
    for i, t in rows:
        best[lower(t)], size[lower(t)] = max(best.get(lower(t), i), i), size.get(lower(t), 0) + 1
    want = sorted((i, best[lower(t)], size[lower(t)], best[lower(t)] == i, sha(lower(t))) for i, t in rows)
    from pyspark.sql import functions as F

    for cut in (0, 37, 100, len(rows)):
        out = exact.dedup(frame(spark, rows[cut:]), frame(spark, rows[:cut]) if cut else None)
        got = pairs(out.withColumn("h", F.lower(F.hex("digest"))), "doc_id", "keep_id", "group_size", "kept", "h")
        assert sorted(got) == want


def test_lookup_compares_all_bytes(spark):
    known = [(bytes([i]) * 32, i, 1) for i in range(50)]
    other = [(bytes([i]) * 31 + b"\xff", 100 + i, 2) for i in range(50)] + [(bytes([7]) * 32, 700, 3)]
    schema = "digest binary, winner long, copies long"
    index, shards = exact.build(spark.createDataFrame(known, schema), 3)
    got = exact.lookup(spark.createDataFrame(other, schema), index, shards).collect()
    assert len(got) == 51
    assert [(r.winner, r.copies) for r in got if r.member] == [(700, 4)]


def test_exact_dedup_of_odd_rows(spark, odd_docs, no_docs):
    got = exact.dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.keep_id is not None and not (r.doc_id is None and r.kept) for r in got)
    assert exact.dedup(no_docs, no_docs).count() == 0 and exact.dedup(odd_docs, no_docs).count() == len(got)


# --- operator 8


def test_lines_against_brute_force(spark, odd_texts):
    rng = random.Random(2)
    stock = ["Shared line number one", "  shared LINE number one\t", "ÉCOLE des lignes", "école des lignes", "Éligne partagée ici", "éLIGNE partagée ici", "Éligne PARTAGÉe ici", "short", "ten chars!", "TEN chars! ", "ãÃ lead bytes Ã©"]
    made = ["\n".join(rng.choice(stock + [f"own line {i} {rng.random()}"]) for _ in range(rng.randint(0, 90))) for i in range(40)]
    rows = list(enumerate([*odd_texts, *made]))
    docs = frame(spark, rows)
    got = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    want = kept_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()} == want


def test_bitmaps_have_only_documents_that_lose_lines(spark):
    docs = frame(spark, [(1, "a line of text"), (2, "x\n" * 70 + "A line of text\ny"), (3, "nothing in common")])
    got = lines.keep_bitmaps(docs).collect()
    assert [(r.doc_id, r.n_dropped, len(r.keep_bitmap)) for r in got] == [(2, 1, 3)]
    full = (1 << 32) - 1
    assert got[0].keep_bitmap == [full, full, full - (1 << 6)]


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    out = lines.apply_bitmaps(odd_docs, lines.keep_bitmaps(odd_docs))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert [r.n_dropped for r in rows if r.doc_id is None] == [1]  # another document has the line
    assert lines.apply_bitmaps(no_docs, lines.keep_bitmaps(no_docs)).count() == 0


def test_lines_in_many_ranges_against_brute_force(spark):
    """One line in two thirds of all places and few distinct ones, over ranges that one hash fills."""
    rng = random.Random(8)
    rows = [(i, "\n".join("the same line again" if rng.random() < 0.66 else f"line number {rng.randrange(40)}" for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows += [(500, "\n".join(f"line number {i}" for i in range(40))), (501, "x\n" * 5000 + "the same line again")]
    docs = frame(spark, rows[::-1])
    conf = "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "23")
    try:
        bitmaps = lines.keep_bitmaps(docs, compressed=True)
        got = lines.apply_bitmaps(docs, bitmaps).collect()
        assert max(len(r.keep_bitmap) for r in bitmaps.collect() if r.doc_id == 501) == 1  # words that keep all take no room
    finally:
        spark.conf.set(conf, before)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == kept_lines(rows)


def test_ranges_of_lines_are_read_in_order(spark, monkeypatch):
    """The plan sorts each range and finds first occurrences by windows; nothing is grouped by hash."""
    plans = []
    keep = lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    lines.lost_lines(frame(spark, [(1, "a line of text"), (2, "a line of text")])).collect()
    assert plans[1].count("Window") >= 2 and "Aggregate" not in plans[1] and "RepartitionByExpression" in plans[1]


def test_lines_beside_clashing_columns(spark):
    docs = frame(spark, [(1, "a line of text"), (2, "a line of text\nown")])
    for c in ("_id", "_key", "_own", "_dropped", "_bitmap", "part", "keeper", "h1"):
        docs = docs.withColumn(c, F.col("doc_id"))
    out = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, compressed=True))
    assert [(r._id, r._bitmap, r.kept_text) for r in out.orderBy("doc_id").collect()] == [(1, 1, "a line of text"), (2, 2, "own")]


# --- operator 9


def test_substrings_against_brute_force(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 1500)  # several batches
    rows = list(enumerate([*odd_texts, *[t for _, t in pool(90, 4)]]))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(frame(spark, rows)).collect()}
    assert got == kept_words(rows)


def test_repeats_are_maximal(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "a b c " + passage), (2, passage + " x y"), (3, "q " + passage[: passage.index("p12") + 3])]
    got = {r.doc_id: [tuple(s) for s in r.repeats] for r in substrings.dedup(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [(0, 40)], 3: [(1, 14)]}


def test_substrings_of_odd_rows(spark, odd_docs, no_docs):
    got = substrings.dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert [(r.n_removed, r.kept) for r in got if r.doc_id is None] == [(60, "")]  # null ids come last
    assert [r.n_removed for r in got if r.doc_id == 5] == [0, 0]  # a repeated row is no other document
    assert substrings.dedup(no_docs).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packed_numbers(numbers):
    values = np.array(sorted(numbers), np.uint64)
    assert (unpack(pack(values), np.uint64) == values).all()
    assert (unpack_plain(pack_plain(values), np.uint64) == values).all()


# --- operator 10


def test_contamination_against_brute_force(spark, odd_texts, monkeypatch):
    rng = random.Random(9)
    docs = pool(60, 7)
    items = [(i, " ".join(rng.choice(docs)[1].split()[: rng.choice([1, 4, 5, 9, 30])])) for i in range(30)]
    items += [(100, None), (101, ""), (102, items[0][1]), (103, odd_texts[5]), (103, odd_texts[5])]
    rows = docs + [(1000 + i, t) for i, t in enumerate(odd_texts)]
    want = sorted(leaks(rows, items), key=repr)
    for block in (1 << 20, 400):
        monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
        found = contamination.annotate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        got = {(r.doc_id, m.item_id, m.n_shingles, m.n_common) for r in found.collect() for m in r.matches}
        assert sorted(got, key=repr) == want
    assert want


def test_short_items_in_long_documents_are_found(spark):
    item = " ".join(f"q{i}" for i in range(9))
    filler = " ".join(f"f{i}" for i in range(20_000))
    docs = frame(spark, [(1, filler + " " + item.upper() + " " + filler), (2, filler), (3, "q0 q1 q2 q3")])
    got = contamination.search(docs, spark.createDataFrame([(5, item), (6, "q0 q1 q2 q3")], "item_id long, text string"))
    assert pairs(got, "doc_id", "item_id", "containment") == [(1, 5, 1.0), (3, 6, 1.0)]


def test_contamination_of_odd_rows(spark, odd_docs, no_docs):
    items = odd_docs.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")
    out = contamination.annotate(odd_docs, items)
    assert out.count() == odd_docs.count() and out.columns == [*odd_docs.columns, "matches"]
    assert contamination.search(no_docs, items).count() == 0
    assert contamination.search(odd_docs, items.limit(0)).count() == 0


# --- operator 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_against_brute_force(spark, odd_texts, seed):
    rows = list(enumerate([*[t for _, t in pool(100, seed)], *odd_texts]))
    want = components(rows)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == {i: (want[i], len(shingles(t))) for i, t in rows}


def test_the_forest_alone_finds_all_links(spark, monkeypatch):
    """Without the first pass; with trees of several levels."""
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "FANOUT", 2)
    monkeypatch.setattr(jaccard, "star_pairs", lambda classes: spark.createDataFrame([], "a long, b long"))
    rows = pool(120, 11)
    want = components(rows)
    assert {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()} == want


def test_trees_of_many_classes_are_dealt_into_blocks(spark, monkeypatch):
    """Documents that share a template, just below the threshold, with some linked pairs among them and sizes a quarter apart."""
    monkeypatch.setattr(jaccard, "MEMBERS", 12)
    monkeypatch.setattr(jaccard, "SENT", 3)
    monkeypatch.setattr(jaccard, "star_pairs", lambda classes: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(4)
    rows = []
    for size in (40, 50, 62, 78):
        for _ in range(25):
            words = [f"t{i}" for i in range(size)] + [f"u{rng.randrange(10**6)}" for _ in range(size // 5)]
            rows.append(" ".join(words))
            if rng.random() < 0.4:
                rows.append(" ".join(words[:-1] + ["last"]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()} == components(rows)
    classes = spark.createDataFrame([(i, 40 + i % 30, i, [7, 8], b"") for i in range(200)], "rep long, n long, label long, prefix array<long>, counts binary")
    dealt = jaccard.forest(classes, 4).groupBy("task", "side").count().collect()
    assert max(r["count"] for r in dealt) < 40 and len({r.task for r in dealt}) > 50


def test_tree_search_for_other_points_is_complete():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 12, (30, jaccard.GROUPS))
    points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape), 0) for _ in range(6)])
    sizes, labels = points.sum(1), rng.integers(0, 120, len(points))
    tree = jaccard.Tree(points[100:], sizes[100:], labels[100:])
    got = {(i, j) for a, b in tree.search(points[:100], sizes[:100], labels[:100]) for i, j in zip(a.tolist(), b.tolist())}
    both = [(i, j) for i in range(100) for j in range(len(points) - 100)]
    assert got == {(i, j) for i, j in both if labels[i] != labels[100 + j] and 9 * np.minimum(points[i], points[100 + j]).sum() >= 4 * (sizes[i] + sizes[100 + j])}


def test_tree_search_is_complete():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 12, (40, jaccard.GROUPS))
    points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape), 0) for _ in range(5)])
    sizes, labels = points.sum(1), rng.integers(0, 150, len(points))
    got = {tuple(sorted((i, j))) for a, b in jaccard.Tree(points, sizes, labels).pairs() for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(points)) for j in range(i) if labels[i] != labels[j] and 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])}
    assert got == {tuple(sorted(x)) for x in want}


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = jaccard.join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.join(no_docs).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1000, 1002), (5, 5)]
    got = {r.node: r.component for r in spark_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys((1000, 1001, 1002), 1000)}


def test_jaccard_reads_a_few_texts_at_a_time(spark, monkeypatch):
    from tessera import session

    held = {}

    def spy(df, name, batch=None, options=None):
        held[name] = batch
        return session.materialize(df, name, batch, options)

    monkeypatch.setattr(jaccard, "materialize", spy)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text + " end"), (3, "else")]
    assert {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}
    assert {k: held.get(k) for k in ("jaccard-sketches", "jaccard-stars", "jaccard-pairs", "jaccard-links")} == dict.fromkeys(("jaccard-sketches", "jaccard-stars", "jaccard-pairs", "jaccard-links"), jaccard.READ)


def test_tasks_of_the_pipeline_return_freed_memory(spark, monkeypatch):
    """Python workers stay for later tasks, so each step gives back what it freed."""
    import pyarrow as pa

    from tessera.llm import bpe, contamination, queries, toxicity

    back, tasks = [], []
    for module in (bpe, contamination, toxicity):
        monkeypatch.setattr(module, "give_back", lambda name=module.__name__: back.append(name), raising=False)
    docs = frame(spark, [(1, "one two three four five six")])
    held = type("Held", (), {"value": contamination.Sketches([])})()
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: tasks.append(f) or self)
    bpe.encode(docs, queries.vocabulary(spark), queries.PATTERN)
    bpe.decode(docs.withColumn("ids", F.array(F.lit(1))), queries.vocabulary(spark))
    toxicity.score(docs, spark.sparkContext.broadcast((None, {}, 0.0)))
    contamination._annotate(docs.withColumn("matches", F.array().cast(contamination.MATCH)), held, "text", "matches", pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_common", pa.int64())])))
    for task in tasks:
        rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"], "ids": [[1]], "matches": [[]]})
        assert len(list(task(iter([rows])))) == 1
    assert sorted(back) == ["tessera.llm.bpe"] * 2 + ["tessera.llm.contamination", "tessera.llm.toxicity"]


def test_shared_shingles_are_dealt_some_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from tessera import session

    monkeypatch.setattr(jaccard, "DEALT", 8)
    tasks, held = [], {}
    classes = spark.createDataFrame([(1, [1])], "label long, prefix array<long>")
    with monkeypatch.context() as m:
        m.setattr(type(classes), "mapInArrow", lambda self, f, schema: tasks.append(f) or self.selectExpr("1 part"))
        jaccard.shared_shingles(classes, 4)
    batches = [pa.RecordBatch.from_pydict({"label": [i, i + 1], "prefix": pa.array([[3 * i + 1, 7], [-5, 7 - i]] if i < 9 else [[], []], pa.list_(pa.int64()))}) for i in range(10)]
    sent = list(tasks[0](iter(batches)))
    assert [sum(len(unpack(x, np.uint64)) <= 8 for x in b.column("hashes").to_pylist()) == b.num_rows for b in sent] == [True] * 5  # four shingles a batch, 36 in all
    assert not list(tasks[0](iter(batches[9:])))
    monkeypatch.setattr(jaccard, "materialize", lambda df, name, batch=None, options=None: held.update({name: batch}) or session.materialize(df, name, batch, options))
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text + " end"), (3, "else"), (4, None)]
    assert {r.doc_id: r.component_id for r in jaccard.join(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert held["jaccard-shared"] == jaccard.READ


def test_exact_dedup_reads_few_texts_at_a_time(spark, monkeypatch):
    from tessera import session

    held = {}
    monkeypatch.setattr(exact, "materialize", lambda df, name, batch=None, options=None: held.update({name: batch}) or session.materialize(df, name, batch, options))
    got = exact.dedup(frame(spark, [(3, "Same"), (4, "new"), (5, None)]), frame(spark, [(1, "same"), (2, "old")]))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True)]
    assert held["exact-new"] <= 1024 and held["exact-old"] <= 1024
    assert "exact-index" not in held  # it is read once


def test_encoder_forgets_long_words():
    encoder = bpe.Encoder(VOCABULARY, queries.PATTERN)
    texts = ["a " + "x" * 100 + " b " + "y-" * 100, "a " + "x" * 100]
    for _ in range(2):
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)] == [LIBRARY.encode_ordinary(x) for x in texts]
        assert max(map(len, [*encoder.words, *encoder.pieces])) <= bpe.LONGEST
