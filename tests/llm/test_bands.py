"""The learnt limits of op10."""

import base64
import random
import zlib

import duckdb

from quiverlake.llm import queries, rules

SF = "/root/testdata/sf0.1"


def labelled():
    rows = duckdb.connect().sql(f"SELECT doc_id, text, quality FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()
    for i, text, quality in rows:
        n = rules.counts(text or "")
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0]:
            yield quality, zlib.crc32(str(i).encode()) % 4 == 2, text.encode()


def learnt(raw):
    return rules.band_verdict(raw, rules.LEARNT_WHOLE, rules.LEARNT_CHUNK, rules.LEARNT_BAD_CHUNKS)[3]


def test_limits_are_what_the_good_documents_give():
    docs = list(labelled())
    assert rules.learn([x for quality, held_out, x in docs if quality == 1 and not held_out]) == (rules.LEARNT_WHOLE, rules.LEARNT_CHUNK)
    assert all(learnt(x) for quality, held_out, x in docs if quality == 1 and held_out)


def test_the_bands_decide(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = queries.op10_compression_bands(spark, SF).join(labels, "doc_id").filter("quality = 0 and not base_failed")
    assert bad.filter("not kept").count() > bad.count() / 3


def test_noise_of_any_length_and_in_the_tail():
    rng = random.Random(10)
    noise = lambda n: base64.b64encode(rng.randbytes(n))[:n]
    assert not any(learnt(noise(n)) for n in (250, 500, 1000, 2000, 3500, 6000, 20000))
    prose = max((x for quality, _, x in labelled() if quality == 1 and 8_500 < len(x) < 12_000), key=len)
    cut = prose[:8_192]
    assert learnt(cut) and not learnt(cut + noise(4_000))
    assert rules.band_verdict(cut + noise(4_000))[1:3] == (3, 1)  # its tail is looked at
