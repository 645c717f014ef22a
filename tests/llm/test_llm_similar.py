"""The pipeline's near-duplicate rule, five-word shingles with a Jaccard similarity of 0.8, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from leakgauge.llm import similar
from leakgauge.llm.store import table
from test_llm_copies import components_of


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_of(rows):
    """The smallest identifier that each row's component has, by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    different = sorted(set(sets), key=sorted)
    near = [(a, b) for a in range(len(different)) for b in range(a)
            if (n := len(different[a] & different[b])) >= 0.8 * (len(different[a]) + len(different[b]) - n)]
    root = components_of(range(len(different)), near)
    part = [root[different.index(s)] for s in sets]
    named = {}
    for (i, _), p in zip(rows, part):
        if i is not None:
            named[p] = min(i, named.get(p, i))
    return [named.get(p) for p in part]


def passage(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(words))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Copies with one to seven changed words in 150; the last are too different from the others."""
    rng, rows = random.Random(8), []
    for _ in range(25):
        base = passage(rng, 150)
        rows += [base] + [edited(rng, base, e) for e in range(1, 8)]
    return list(enumerate(rows))


def test_edited_copies_go(spark, families):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in families], "doc_id long, text string, lang string, source string")
    want = {i for (i, _), least in zip(families, least_of(families)) if i == least}
    assert 25 < len(want) < len(families)
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, None).collect()} == want


@pytest.mark.parametrize("stars", [0, 2])
def test_groups_against_brute_force(spark, awkward, awkward_rows, nothing, sf_dir, monkeypatch, stars):
    monkeypatch.setattr(similar, "STARS", stars)
    given = table(spark, sf_dir, "documents")
    for docs, rows in ((awkward, [r[:2] for r in awkward_rows]), (given, [(r.doc_id, r.text) for r in given.collect()])):
        want = sorted(((i, least) for (i, _), least in zip(rows, least_of(rows))), key=str)
        assert sorted(map(tuple, similar.similar_groups(docs).collect()), key=str) == want
    assert similar.similar_groups(nothing).count() == 0


def test_one_row_of_a_group_stays_whatever_its_identifier(spark):
    """Null and repeated identifiers, clashing columns, a very long pair."""
    rng = random.Random(2)
    base, other, long = passage(rng, 80), passage(rng, 60), passage(rng, 60_000)
    rows = [(None, base), (None, base), (3, base + " end"), (3, base), (3, other), (None, passage(rng, 40)), (9, long), (8, long + " more words")]
    rows += [(None, "null twice"), (None, "null twice"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, gone_id int, mark int, row int, given int, component int")
    got = corpus_pipeline.distinct_documents(spark, docs, None)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == 6 and (8, rows[7][1]) in kept and (3, other) in kept and (5, None) in kept and rows[5] in kept
    assert [i for i, t in kept if t in (base, base + " end")] == [3] and (None, "null twice") in kept


@pytest.mark.parametrize("threshold,moved", [("16k", False), ("-1", True)])
def test_texts_of_rows_that_stay_are_not_moved(spark, threshold, moved):
    """The numbers of the rows that stay are a table far over the optimiser's threshold; as bits they are under it."""
    texts = [f"a{i // 2} b{i // 2} c{i // 2} d{i // 2} e{i // 2} f" for i in range(12_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = similar.first_of_groups(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        ids = sorted(r.doc_id for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == list(range(0, 12_000, 2))
    assert ("Exchange hashpartitioning" in plan) == moved


def test_row_numbers_as_bits(spark):
    numbers = [0, 1, 62, 63, 64, 127, 1 << 33, (1 << 33) + 63, (5 << 33) + 70]
    words = dict(map(tuple, similar.row_bits(spark.createDataFrame([(n,) for n in numbers], "n long"), "n").collect()))
    assert sorted(64 * w + i for w, bits in words.items() for i in range(64) if bits >> i & 1) == numbers


def test_hot_group_of_near_copies_verifies_few_pairs(spark, monkeypatch):
    """Copies of one text with changed words: links grow with the group, and tiles change nothing."""
    rng = random.Random(4)
    base = passage(rng, 100)
    rows = [(i, edited(rng, base, rng.randint(1, 6))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted, verify = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, sets: counted.append(pairs.count()) or verify(pairs, sets))
    monkeypatch.setattr(similar, "TILE", 64)
    got = dict(similar.similar_groups(docs).collect())
    assert got == dict(zip(range(400), least_of(rows)))
    assert sum(counted) < 400 * 40


@pytest.mark.parametrize("words", [12, 30, 200])
def test_fingerprints_keep_similar_pairs(words):
    rng = random.Random(words)
    apart = lambda a, b: int(np.bitwise_count(similar.fingerprint(a) ^ similar.fingerprint(b)).sum())
    near, far = [], []
    for _ in range(60):
        base = passage(rng, words)
        a = similar.shingle_set(base)
        b = similar.shingle_set(base + " " + passage(rng, max(1, words // 6)))
        near.append(apart(a, b) <= (similar.WITHIN_SMALL if min(len(a), len(b)) < similar.SMALL else similar.WITHIN) or len(a) < 0.8 * len(b))
        far.append(apart(a, similar.shingle_set(passage(rng, words))) > 700)
    assert all(near) and all(far)
