"""The filter audit against counting every order row by row."""

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

from compare import connect, differences
from leakgauge.llm import audit
from leakgauge.llm.store import table


def failing(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        out += "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        yield out + "E" * (i is not None and least[t] < i)


def plain(rows, good, toxic):
    out = {}
    fails = list(failing(rows))
    for part in {s or "" for *_, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        fair = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fair[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in r[1] for r in mine) - len(removed), sum(r[1] == f for r in mine),
                    sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(fair[order[step - 1]])
    return out


def found(df):
    assert df.columns == [f.split()[0] for f in audit.STEPS.split(", ")]
    rows = df.collect()
    out = {tuple(r)[:3]: list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_awkward_rows(spark, awkward, awkward_rows, nothing):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(5, 0, None), (5, 1, None), (None, 1, 1), (7, None, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    rows = [(r[0], r[1], r[3]) for r in awkward_rows]
    assert found(audit.filter_audit(awkward, marked)) == plain(rows, good, toxic)
    assert audit.filter_audit(nothing, marked).count() == 0
    unlabelled = audit.filter_audit(awkward, marked.limit(0)).collect()
    assert len(unlabelled) == 600 * len({s or "" for *_, s in rows}) and not any(r.good_lost or r.toxic_lost for r in unlabelled)


def test_hot_text_and_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(i, "Hot $ TEXT", f"s{i % 3}") for i in range(5000)] + [(9000 + i, long, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert found(audit.filter_audit(docs, labels)) == plain(rows, {1}, {1})


def test_equals_the_sql(spark, sf_dir):
    make = lambda s, d: audit.filter_audit(table(s, d, "documents"), table(s, d, "labels"))
    assert differences(spark, connect(sf_dir), make, audit.SQL, sf_dir) == ""


def test_least_squares_gives_shapley_values():
    rng = random.Random(3)
    for size in (2, 3, 5):
        game = [0] + [rng.randint(-50, 50) for _ in range((1 << size) - 1)]
        want = []
        for i in range(size):
            others = [c for c in range(1 << size) if not c >> i & 1]
            want.append(sum(Fraction(factorial(c.bit_count()) * factorial(size - 1 - c.bit_count()), factorial(size)) * (game[c | 1 << i] - game[c]) for c in others))
        assert audit.shapley(game, size) == want
