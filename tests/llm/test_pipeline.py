"""The pipeline's stages on a small table: each keeps a subset, with the columns of documents, by its operator."""

import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from daylark.llm import common, exact_dedup, mixing, quality, simhash
from tests.llm.test_operators import brute_components, brute_print, brute_verdict, lower


def test_stages_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).cache()
    before = docs
    for (name, stage), decide in zip(corpus_pipeline.STAGES[:-1], (
        lambda d: quality.judge(d, ["doc_id"]).where("kept"),
        lambda d: exact_dedup.exact_duplicates(d).where("kept"),
        lambda d: simhash.near_duplicates(d).where("doc_id = component_id"),
        lambda d: mixing.mixture(d).where("sampled").select("row.doc_id"),
    )):
        after = stage(spark, before, "").cache()
        assert after.columns == docs.columns
        assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in decide(before).collect()), name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, "")
    assert last.count() == before.count()


def test_stages_against_brute_force(spark):
    """Random documents with copies, near copies, junk, nulls and repeated rows; each stage on what the one before kept."""
    rng = random.Random(21)
    vocabulary = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    texts = [None, "", "too short", "# " * 40, "same " * 60]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        near = list(base)
        near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts += rng.choices([" ".join(base), " ".join(base).upper().capitalize(), " ".join(base), " ".join(near)], k=rng.randrange(1, 5))
    ids = [*range(len(texts))]
    ids[3], ids[9] = None, None
    rows = [(i, t, rng.choice(["de", "en", None]), rng.choice(["a", "b", None]), 7) for i, t in zip(ids, texts)]
    rows += [rows[12], rows[12], (500, None, None, None, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, kind).repartition(3).cache()

    good = stages["quality rules"](spark, docs, "").cache()
    assert Counter(map(tuple, good.collect())) == Counter(r for r in rows if brute_verdict(r[1])[-1])
    unique = stages["exact dedup"](spark, good, "").cache()
    largest = {}
    for r in good.collect():
        largest.setdefault(lower(r.text), []).append(r.doc_id)
    assert Counter((lower(r.text), r.doc_id) for r in unique.collect()) == Counter((t, max((i for i in own if i is not None), default=None)) for t, own in largest.items())
    left = stages["near dedup"](spark, unique, "").cache()
    kept = unique.collect()
    groups = {}
    for r, root in zip(kept, brute_components([brute_print(r.text) for r in kept])):
        groups.setdefault(root, []).append(r.doc_id)
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(min((i for i in own if i is not None), default=-1) for own in groups.values())
    assert len(kept) > len(groups) > 10
    mixed = stages["mixing"](spark, left, "").cache()
    assert not set(map(tuple, mixed.collect())) - set(map(tuple, left.collect())) and mixed.columns == docs.columns
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by_id = {r.doc_id: r.text for r in mixed.collect()}
    out = stages["sentencepiece"](spark, mixed, "").collect()
    assert len(out) == mixed.count()
    for r in out:
        ids = model.encode(by_id[r.doc_id])
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, __gone int, mark string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and docs.columns[-2:] == ["__gone", "mark"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_run_leaves_only_the_table_that_its_result_reads(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    other = common.stored(docs.select("doc_id"), "of-another-query")
    before = common.made()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = common._MADE[before:]
    assert len(left) == 1 and "mixing" in left[0] and other.count() == 60
    shared = common.shared_dir(spark).removeprefix("file://")
    kinds = {"-".join(n.split("-")[:-1]) for n in os.listdir(shared)}
    assert not kinds & {"quality-rules", "exact-dedup", "near-dedup"}
    assert out.count() > 0
    common.release(spark, before)
    assert common.made() == before
