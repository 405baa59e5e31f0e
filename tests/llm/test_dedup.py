import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pagewright.llm import content_sort, graph, simhash

DOCS = "doc_id long, text string, group_size int, prefix string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_groups_against_brute_force(spark, parts):
    rng = random.Random(3)
    texts = ["", " ", None, "a  b", "a\tb", "a b", "x" * 50 + "1", "x" * 50 + "2", "é   b", "w " * 5000]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(7, "a b"), (7, "a b"), (None, "only null ids"), (None, "a b")]
    got = content_sort.exact_groups(docs(spark, rows).repartition(parts)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    for norm, ids in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(map(repr, (r.doc_id for r in own))) == sorted(map(repr, ids))
        assert {(r.keep_id, r.group_size) for r in own} == {(least, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [least]


def test_one_text_over_many_ranges(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"other {i}") for i in range(50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort.exact_groups(docs(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same = [r for r in got if r.doc_id < 3000]
    assert {(r.keep_id, r.group_size) for r in same} == {(0, 3000)}
    assert sum(r.kept for r in got) == 51


def test_exact_groups_of_an_empty_table(spark):
    assert content_sort.exact_groups(docs(spark, [])).count() == 0


def test_drop_copies_keeps_columns_and_one_row(spark):
    got = content_sort.drop_copies(docs(spark, [(1, "a b"), (1, "a b"), (2, "a  b"), (3, "c")]))
    assert got.columns == ["doc_id", "text", "group_size", "prefix"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b"), (3, "c")]


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    for t in (None, "", " \n", "One", "One two", "One two THREE", "É É é x y z É É é", "a b c d " * 9000):
        assert simhash.fingerprint(t, 3) & (2**64 - 1) == plain_fingerprint(t, 3)


def linked(fps, radius):
    n = len(fps)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("radius,group", [(2, 1024), (2, 90), (3, 90)])
def test_links_against_brute_force(spark, radius, group):
    rng = random.Random(5)
    near = [rng.getrandbits(64) for _ in range(6)]
    fps = {0} | {rng.choice(near) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for _ in range(250)}
    fps |= {near[0] ^ m << 20 for m in range(64)}
    fps = sorted(simhash._signed(x) for x in fps)
    want = linked([x & (2**64 - 1) for x in fps], radius)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.near_links(df, radius, group)).collect()}
    of = {}
    for x, w in zip(fps, want):
        of.setdefault(w, set()).add(roots.get(x, x))
    assert all(len(v) == 1 for v in of.values()) and len({*map(tuple, of.values())}) == len(of)


def test_gray_rank_orders_neighbours_by_one_bit():
    words = np.arange(256, dtype=np.uint64)
    order = np.argsort(simhash.gray_rank(words))
    assert all(bin(int(a ^ b)).count("1") == 1 for a, b in zip(words[order], words[order][1:]))


def test_near_components(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base.upper()), (6, base + " tail"), (8, None), (2, " "), (1, "lone words stand here"), (1, "lone words stand here")]
    got = simhash.near_components(docs(spark, rows))
    fps = [plain_fingerprint(t, 3) for _, t in rows]
    label = linked(fps, 2)
    want = sorted((i, min(rows[k][0] for k in range(len(rows)) if label[k] == label[n])) for n, (i, _) in enumerate(rows))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == want
    assert simhash.near_components(docs(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 400)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{k: 100 for k in range(200, 400)}}
