import random
import re

import numpy as np

import corpus_pipeline
from pagewright.llm import mixing, pieces

EN = "the of and to in a is that it for on with as are was be this by from they have were their".split()
DE = "der die das und ist nicht ein eine zu den von mit auf für dem sich als auch werden wurde bei".split()


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    rows = []
    for k in range(60):
        words = rng.choices(EN if k % 2 else DE, k=50) + [f"n{rng.randrange(10**6)}{c}" for c in "abcdefgh" for _ in range(5)]
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en" if k % 2 else "de", f"s{k % 3}"))
    rows += [(100, rows[3][1].replace(" ", "  "), "en", "s0"), (101, rows[4][1].replace(" ", "\n"), "de", "s1")]
    copy = rows[7][1].split()
    copy[40] = "else"
    rows += [(102, " ".join(copy), "en", "s2"), (103, None, "en", "s0"), (104, "12 34 --", "en", "s1"), (105, "", "de", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")

    left = {i: t for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    ids, label = sorted(left), {i: i for i in left}
    sets = {i: shingles(t) for i, t in left.items()}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
    left = {i: left[i] for i in left if label[i] == i}
    assert 102 not in left and 100 not in left and len(left) == 60

    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"t{k}")
        assert docs.columns == df.columns
    assert {r.doc_id for r in docs.collect()} == set(left) and docs.count() == len(left)

    want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(docs).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    count = {}
    with open(pieces.MODEL, "rb") as f:
        codec = pieces.Pieces(f.read())
    for r in got:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert codec.decode(np.array(r.ids, np.int32).tobytes()) == r.text == left[r.doc_id]
    assert count == {i: n for i, n in want.items() if n}


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
