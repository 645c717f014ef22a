"""The pipeline stage by stage against plain versions over the smallest given tables."""

from collections import Counter

import corpus_pipeline
from leakgauge.llm import quality
from leakgauge.llm.store import table
from test_llm_mixing_shards import jump, plain_mix
from test_llm_similar import least_of
from test_llm_text import holds, plain


def near_kept(docs):
    least = least_of([(d, r["text"]) for d, r in docs.items()])
    return {d: r for (d, r), name in zip(docs.items(), least) if name == d}


def uncontaminated(docs, items):
    items = [plain(t) for t in items]
    return {d: r for d, r in docs.items() if not any(holds(i, plain(r["text"])) for i in items)}


def mixed(docs):
    rows = [(d, r["text"], r["source"]) for d, r in docs.items()]
    sizes = [len((text or "").encode().split()) for _, text, _ in rows]
    out = Counter({d: 1 for (d, _, _), n in zip(rows, sizes) if n == 0})
    for (i, _), words in plain_mix(rows).items():
        out[rows[i][0]] += words * 2 >= sizes[i] and words > 0
    return +out


def test_stages_against_plain_versions(spark, sf_dir):
    docs = {r.doc_id: r.asDict() for r in table(spark, sf_dir, "documents").collect()}
    model = quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    docs = {d: r for d, r in docs.items() if model.score(r["text"] or "") >= 0.3}
    docs = near_kept(docs)
    docs = uncontaminated(docs, [r.text for r in table(spark, sf_dir, "benchmark").collect()])
    times = mixed(docs)
    want = Counter({(d, docs[d]["text"], jump(d, 8), jump(d, 9)): n for d, n in times.items()})
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "grown_shard"]
    assert Counter((r.doc_id, r.text, r.shard, r.grown_shard) for r in got.collect()) == want


def test_stages_take_awkward_rows_and_keep_their_columns(spark, awkward, nothing, sf_dir):
    for start in (awkward, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == start.columns, name
        rows = corpus_pipeline.sharded_documents(spark, docs, sf_dir).collect()
        assert {r.shard for r in rows} <= set(range(8))
        assert (start is awkward) or not rows


def test_stage_names_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_columns_named_like_helpers_pass(spark, sf_dir):
    """Names that the stages use themselves, and rows without an identifier."""
    rows = [(i if i % 4 else None, f"word{i} " * (i + 1), f"s{i % 2}", 1, 2, 3, 4, 5, 6) for i in range(12)]
    names = "doc_id long, text string, source string, gone_id int, mix_id int, mix_size int, mix_times int, given int, mix_turn int"
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}
