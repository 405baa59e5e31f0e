import hashlib

import corpus_pipeline


def test_the_last_stage_decodes(spark):
    df = spark.createDataFrame([(1, "a  word ▁ and more"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in corpus_pipeline.tokens(spark, df, "").collect()}
    assert all(r.round_trip for r in got.values())
    assert got[1].decoded_sha256 == hashlib.sha256("a  word ▁ and more".encode()).hexdigest()
