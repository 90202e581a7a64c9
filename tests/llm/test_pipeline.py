"""The pipeline's stages against brute force, and on odd rows."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import brute_components, brute_fingerprint, brute_targets, odd_docs
from test_secrets import brute_mask

import corpus_pipeline
from quiverlake.llm import mixing, queries, quality, secrets

STAGES = dict(corpus_pipeline.STAGES)


def held(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def odd(spark, sf):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns that clash with what the stages add."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).union(odd_docs(spark))
    docs = docs.union(docs.filter("doc_id < 12"))
    for name in ("score", "mix", "statistics", "fingerprint", "class", "spans", "size", "copies", "target"):
        docs = docs.withColumn(name, F.lit(f"my {name}"))
    return held(spark, docs)


def test_stages_on_odd_rows(spark, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Counter(map(str, odd.collect()))
    good = STAGES["quality"](spark, odd, sf)
    scored = {r.text: r.s for r in quality.score_texts(odd, quality._learnt(quality.with_statistics(odd.select("doc_id", "text")), labels), "text", "s").collect()}
    assert good.columns == odd.columns
    assert Counter(map(str, good.collect())) == Counter({k: n for k, n in rows.items() if any(k == str(r) and scored[r.text] >= 0.7 for r in odd.collect())})

    one = STAGES["near_duplicates"](spark, odd, sf)
    assert one.columns == odd.columns
    own = odd.collect()
    classes = brute_components([brute_fingerprint(r.text) for r in own], list(range(len(own))))
    got = one.collect()
    assert len(got) == len(set(classes))
    want = {}
    for r, c in zip(own, classes, strict=True):
        if r.doc_id is not None:
            want[c] = min(want.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want.values())
    assert all(str(r) in rows for r in got)

    masked = STAGES["secrets"](spark, odd, sf)
    model = secrets.learn(secrets.samples(odd))
    brute = Counter(str(tuple(None if r[c] is None else brute_mask(r.text, model) if c == "text" else r[c] for c in odd.columns)) for r in own)
    assert masked.columns == odd.columns and Counter(str(tuple(r)) for r in masked.collect()) == brute

    mixed = STAGES["mix"](spark, odd, sf)
    sizes = Counter()
    for r in own:
        sizes[r.source] += len(r.text.encode().split()) if r.text else 0
    targets, chance = brute_targets(sizes), {r.doc_id: r.c for r in odd.select("doc_id", mixing.chance().alias("c")).collect()}
    times = Counter()
    for r in own:
        rate = targets[r.source] / sizes[r.source] if sizes[r.source] else 0.0
        times[str(r)] += int(rate) + (chance[r.doc_id] < rate - int(rate))
    assert mixed.columns == odd.columns and Counter(map(str, mixed.collect())) == +times

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    pieces = STAGES["pieces"](spark, odd, sf).collect()
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in pieces) == Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in own)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_an_empty_table(spark, sf, odd, name):
    out = STAGES[name](spark, odd.limit(0), sf)
    assert out.count() == 0 and (name == "pieces" or out.columns == odd.columns)


def test_masks_and_copies_inside_the_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = held(spark, STAGES["near_duplicates"](spark, held(spark, STAGES["quality"](spark, docs, sf)), sf))
    model = secrets.learn(secrets.samples(kept))
    masked = held(spark, STAGES["secrets"](spark, kept, sf))
    was = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == {k: brute_mask(t, model) for k, t in was.items()}
    assert sum(secrets.MASK in r.text for r in masked.collect()) > 0
    mixed = STAGES["mix"](spark, masked, sf)
    copies = {r.doc_id: r.copies for r in mixing.plan(masked).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(copies)
