"""Exact groups, near groups and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from leakgauge.llm import components, recipes, simhash


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(awkward, awkward_rows, nothing):
    groups = {}
    for i, t, *_ in awkward_rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for i, t, *_ in awkward_rows:
        members = groups[squeezed(t)]
        _, missing, keep = min(members)
        keep = None if missing else keep
        want[i, keep, len(members), i == keep, hashlib.sha256(squeezed(t).encode()).hexdigest()] += 1
    got = recipes.exact_groups(awkward).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert recipes.exact_groups(nothing).count() == 0


def test_chunks_give_the_text_back_and_follow_content():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh \n") for _ in range(80_000))
    whole = list(recipes.chunks(text))
    assert b"".join(whole).decode() == squeezed(text)
    assert all(len(c) <= recipes.LONGEST for c in whole)
    moved = list(recipes.chunks("inserted" + text))
    assert len(set(whole) & set(moved)) > 0.8 * len(whole)


def test_unverified_keys_fall_back_to_the_whole_text(spark, awkward, awkward_rows, monkeypatch):
    want = Counter((r.doc_id, r.keep_id, r.group_size) for r in recipes.exact_groups(awkward).collect())
    real = recipes.chunk_recipes
    from pyspark.sql import functions as F
    clash = lambda *a, **k: real(*a, **k).withColumn("keys", F.transform("keys", lambda _: F.lit(7).cast("long")))
    monkeypatch.setattr(recipes, "chunk_recipes", clash)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in recipes.exact_groups(awkward).collect()) == want


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_of(nodes, linked):
    up = {n: n for n in nodes}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_groups(awkward, awkward_rows, nothing, monkeypatch):
    marks = [plain_fingerprint(t) for _, t, *_ in awkward_rows]
    pairs = [(a, b) for a in set(marks) for b in set(marks) if a < b and (a ^ b).bit_count() <= 2]
    root = components_of(set(marks), pairs)
    least = {}
    for (i, *_), m in zip(awkward_rows, marks):
        if i is not None:
            least[root[m]] = min(i, least.get(root[m], i))
    want = Counter((i, f"{m:016x}", least.get(root[m])) for (i, *_), m in zip(awkward_rows, marks))
    got = simhash.near_groups(awkward).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_groups(nothing).count() == 0


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_of_dense_fingerprints(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0]
    marks = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            marks.add(x)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    df = spark.createDataFrame([(signed(m),) for m in marks], "mark long")
    found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    every = [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 2]
    assert components_of(marks, found) == components_of(marks, every)


def test_pivots_only_discard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    b = np.concatenate([a[:50] ^ np.uint64(1), a[50:100] ^ np.uint64(5 << 40), rng.integers(0, 1 << 64, 300, dtype=np.uint64)])
    found = {(int(x), int(y)) for i, j in simhash.close_pairs(a, b) for x, y in zip(i, j)}
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 2}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, i) for i in range(600, 700)] + [(3, 500)]
    got = {r.node: r.component for r in components.component_of(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    nodes = {x for e in chain + star for x in e}
    want = components_of(nodes, chain + star)
    assert {n: got.get(n, n) for n in nodes} == want
