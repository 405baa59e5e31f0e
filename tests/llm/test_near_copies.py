import random

from pagewright.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def classes(spark, rows):
    return {r.doc_id: r.class_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def edited(words, places, mark):
    out = list(words)
    for p in places:
        out[p] = f"{mark}{p}"
    return " ".join(out)


def words_of(rng, n, most=10**6):
    return [f"t{rng.randrange(most)}" for _ in range(n)]


def test_recall_of_classes(spark):
    """Classes of three, and short texts. In the first kind a and b are similar, c is not quite similar to
    either, whatever the fingerprints say; in the second one pair is not similar, so both links are needed."""
    rng, rows, n = random.Random(5), [], 250
    for k in range(n):
        base, places = words_of(rng, 200), rng.sample(range(10, 190, 6), 6)
        trio = [" ".join(base), edited(base, places[:4], "b"), edited(base, places[:5], "c")]
        assert jaccard(*trio[:2]) >= 0.8 > max(jaccard(trio[0], trio[2]), jaccard(trio[1], trio[2]))
        chain = [edited(base, places[:3], "b"), " ".join(base), edited(base, places[3:6], "c")]
        assert min(jaccard(chain[0], chain[1]), jaccard(chain[1], chain[2])) >= 0.8 > jaccard(chain[0], chain[2])
        other = {w: f"o{w}" for w in base}
        chain = [" ".join(other.get(w, w) for w in t.split()) for t in chain]
        rows += [(6 * k + m, t) for m, t in enumerate([*trio, *chain])]
    for k in range(150):
        short = words_of(rng, 8)
        rows += [(10_000 + 2 * k, " ".join(short)), (10_001 + 2 * k, " ".join([*short, "more"]))]
    got = classes(spark, rows)
    assert all(c <= i and c // 3 == i // 3 for i, c in got.items() if i < 10_000) and not any(i % 6 == 2 for i in got if i < 10_000)
    assert sum(6 * k + 1 in got for k in range(n)) >= 0.96 * n
    assert sum(all(got.get(6 * k + m) == 6 * k + 3 for m in (3, 4, 5)) for k in range(n)) >= 0.97 * n
    assert {i: c for i, c in got.items() if i >= 10_000} == {i: i - i % 2 for i in range(10_000, 10_300)}


def test_families_far_larger_than_a_block(spark, monkeypatch):
    """Copies that random bits hardly split, a chain in which each text is similar to the next only, and
    copies of one text that are no copies of each other."""
    monkeypatch.setattr(simhash, "GROUP", 24)
    rng = random.Random(8)
    base = words_of(rng, 400)
    rows = [(k, edited(base, [rng.randrange(10, 390)], f"c{k}x")) for k in range(300)]
    rows += [(1000 + k, " ".join(rng.choices(base, k=300))) for k in range(60)]
    words = words_of(rng, 300)
    for k in range(120):
        words = edited(words, rng.sample(range(10, 290, 6), 2), f"e{k}x").split()
        rows.append((2000 + k, " ".join(words)))
    base = words_of(rng, 200)
    star = [(3000, " ".join(base))] + [(3000 + k, edited(base, rng.sample(range(10, 190, 6), 4), f"s{k}x")) for k in range(1, 400)]
    assert jaccard(star[0][1], star[1][1]) >= 0.8 > jaccard(star[1][1], star[2][1])
    got = classes(spark, rows + star)
    assert {i: c for i, c in got.items() if i < 3000} == {**{k: 0 for k in range(300)}, **{2000 + k: 2000 for k in range(120)}}
    assert sum(got.get(3000 + k) == 3000 for k in range(400)) >= 396


def test_five_thousand_close_copies_are_one_class(spark):
    rng = random.Random(11)
    base = words_of(rng, 120)
    rows = [(k, edited(base, [rng.randrange(5, 115)], f"c{k}x")) for k in range(5000)]
    rows += [(10_000 + k, " ".join(words_of(rng, 120))) for k in range(50)]
    assert classes(spark, rows) == {k: 0 for k in range(5000)}


def test_pairs_at_the_similarity_asked_for():
    share = simhash.SPREAD * simhash.differing(0.8)
    radius = int(256 * share + simhash.DEVIATIONS * (256 * share * (1 - share)) ** 0.5)
    for size in (6, 12, 16):
        tables = simhash.tables_needed(share, size, radius)
        assert simhash.missed(share, size, tables, radius) <= simhash.MISSED < simhash.missed(share, size, tables - 1, radius)
        rng = random.Random(size)
        places = [sum(1 << p for p in rng.sample(range(256), size)) for _ in range(tables)]
        lost = 0
        for _ in range(2000):
            differ = sum((rng.random() < share) << p for p in range(256))
            lost += differ.bit_count() > radius or all(differ & x for x in places)
        assert lost <= 2000 * 2 * simhash.MISSED


def test_against_brute_force(spark):
    """Families around the similarity asked for, ties, repeated rows and ids, empty and null texts."""
    rng, rows = random.Random(14), [(900, ""), (901, None), (902, " "), (None, "x y z"), (903, "a b"), (904, "A  b"), (905, "a b c")]
    for f in range(25):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([8, 20, 60, 150]))]
        for m in range(6):
            rows.append((10 * f + m, edited(base, rng.sample(range(len(base)), rng.randrange(0, max(2, len(base) // 25))), f"m{m}x")))
    rows += [rows[20], rows[20], (rows[30][0], "another text of a row that repeats an id and is similar to nothing")]
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, set()).add((t or "").lower())
    label = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and any(jaccard(x, y) >= 0.8 for x in texts[a] for y in texts[b]):
                label = {i: min(label[a], label[b]) if v in (label[a], label[b]) else v for i, v in label.items()}
    sizes = {v: sum(w == v for w in label.values()) for v in label.values()}
    got = classes(spark, rows)
    assert got == {i: v for i, v in label.items() if sizes[v] > 1}
    assert classes(spark, rows[:0]) == {}


def test_hashes_of_shingles():
    same = simhash.shingle_hashes("One two  THREE four\tfive six one two three four five", 5)
    assert len(same) == len(shingles("one two three four five six one two three four five"))
    assert list(same) == sorted(same) and len(simhash.shingle_hashes("", 5)) == len(simhash.shingle_hashes("a b", 5)) == 1
    assert simhash.shingle_hashes("a b", 5)[0] != simhash.shingle_hashes("b a", 5)[0] != simhash.shingle_hashes(None, 5)[0]


def test_texts_without_candidates_are_not_moved(spark):
    """What the table of bits lets through holds all that a join with the ids would keep, and hardly more."""
    rows = [(k, "x" * 50) for k in range(-500, 3000)] + [(None, "null id"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in [*range(0, 200), 7, -1, 10**12]], "x long")
    got = simhash.may_hold(docs, docs["doc_id"], ids)
    assert got.columns == ["doc_id", "text", "_may"] and got.count() == len(rows)
    let = [r.doc_id for r in got.where("_may").collect()]
    assert set(let) >= {-1, *range(200)} and let.count(7) == 2 and len(let) <= 202 + 5
    assert simhash.may_hold(docs, docs["doc_id"], ids.limit(0)).where("_may").count() == 0


def test_only_classes_give_up_rows(spark):
    """Dropping near copies shuffles the rows that may go, and keeps null ids and further columns."""
    rng = random.Random(3)
    base = words_of(rng, 60)
    rows = [(5, edited(base, [30], "a"), "a"), (9, " ".join(base), "b"), (None, " ".join(base), "c"), (9, "something else", "d")] + [(100 + k, " ".join(words_of(rng, 60)), "e") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.drop_near_copies(df)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id or 0, r.more) for r in out.collect()) == sorted((i or 0, m) for i, _, m in rows if i != 9)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
