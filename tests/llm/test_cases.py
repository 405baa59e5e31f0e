"""Cases that every operator must stand: empty tables, long texts, ties, repeated rows, clashing columns; and
brute-force versions of what SQL cannot express."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import zstandard as zstd

from pagewright.llm import chat, language, lm_score, mixing, pieces, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string"


# --- chat


def test_a_long_conversation_with_a_long_text(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", ("</turn> é " * (100_000 if k == 3 else 1))) for k in range(400)]
    got = chat.format_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    said = "".join(t for _, _, r, t in rows if r == "assistant")
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(400, len(said), hashlib.sha256(said.encode()).hexdigest())]


# --- LM scoring


def brute_scores(docs, held, model):
    """(score, lattice score) by id, natural logarithms to base 10, straight from the formulas."""
    words = {i: (t or "").encode().lower().split() + [lm_score.END] for i, t in docs.items()}
    train = Counter(w for i, ws in words.items() if i not in held for w in ws)
    names, score = lm_score.vocabulary(model)
    end = math.log(0.25)
    score = score + math.log(0.75)
    for _ in range(lm_score.ROUNDS):
        uses = 0.01 + lm_score.Lattice(names, score, end).expected([w for w in train if w != lm_score.END])
        share = np.log(uses / uses.sum())
        score, end = share[:-1], float(share[-1])
    lattice, n, v = lm_score.Lattice(names, score, end), sum(train.values()), len(train)
    once = [sum(c == k for c in train.values()) for k in (1, 2)]
    d = once[0] / (once[0] + 2 * once[1]) if all(once) else 0.5
    p_end, a, out = (train[lm_score.END] + 1) / (n + 2), lm_score.ALPHA, {}
    for i, ws in words.items():
        q = {w: float(lattice.log_probability([w])[0]) for w in set(ws) - {lm_score.END}}
        mass = d * max(0, v - 1) + 1
        p = {w: (max(train[w] - d, 0) + mass * math.exp(q[w])) / (n + 2) for w in q} | {lm_score.END: p_end}
        log = math.lgamma(a) - math.lgamma(a + len(ws))
        for w, k in Counter(ws).items():  # G(x + k) / G(x) is x * G(k) for an x too small for a double
            log += math.lgamma(a * p[w] + k) - math.lgamma(a * p[w]) if p[w] else math.log(a * mass / (n + 2)) + q[w] + math.lgamma(k)
        plain = math.log(p_end) + sum(q[w] + math.log1p(-p_end) for w in ws if w != lm_score.END)
        out[i] = log / math.log(10), plain / math.log(10)
    return out


def test_scores_and_lattice_scores_against_brute_force(spark):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choices([f"word{k}" for k in range(60)] + ["the", "of", "ß", "x"], k=rng.randrange(0, 40))) for i in range(60)} | {90: None, 91: "unseen zzz", 92: "w" * 3000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    with open(lm_score.MODEL, "rb") as f:
        model = f.read()
    for held in ({1, 5, 9, 91, 92}, set(docs)):
        want = brute_scores(docs, held, model)
        got = {r.doc_id: r for r in lm_score.score(df, df["doc_id"].isin(*held)).collect()}
        assert got.keys() == want.keys()
        for i, (score, lattice) in want.items():
            assert math.isclose(got[i].lattice_score, lattice, rel_tol=1e-9) and math.isclose(got[i].score, score, rel_tol=1e-6, abs_tol=1e-6)
    assert lm_score.score(df.limit(0), df["doc_id"] == 1).count() == 0


# --- toxicity


def test_toxicity_cases(spark):
    rng = random.Random(9)
    en, de = [f"the{k}of" for k in range(200)], [f"der{k}und" for k in range(200)]
    rows = []
    for i in range(320):
        words = rng.choices(en if i % 2 else de, k=30) + (["badword"] * 2 if i % 3 == 0 else [])
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s"))
    rows += [(900, None, None, None), (900, None, None, None), (901, "", "en", "s"), (902, "badword " * 30_000, "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(320)] + [(0, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, docs["doc_id"] % 4 != 2)
    assert set(model.languages) == {"en", "de"} and toxicity.OTHER in model.shift
    got = toxicity.predict(docs, model, ["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (900, 901)}) == 1 and by[902].predicted == 1
    again = {r.doc_id: r.score for r in toxicity.predict(docs.repartition(1).orderBy("text"), model, ["doc_id"]).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-6) for r in got)
    held = [(by[i].predicted, int(i % 3 == 0)) for i in range(320) if i % 4 == 2]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)  # sixty labelled documents with the word
    assert toxicity.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    # the forward pass, plainly
    guess = language.Classifier(model.languages).classify
    for text in (rows[0][1], rows[1][1], "", "a", None):
        words = toxicity.tokens(text)
        x = [sum(model.rows[k] for k in toxicity.features(w)) for w in words]
        blank = [np.zeros(toxicity.WIDTH)] * max(toxicity.WIDTHS)
        pools = [max([max(0.0, float(b[m] + sum((x + blank)[at + j] @ f[j, :, m] for j in range(f.shape[0])))) for at in range(len(x) + 1)]) for f, b in zip(model.filters, model.bias) for m in range(toxicity.FILTERS)]
        z = float(np.dot(pools, model.out) + model.out_bias[0]) + model.shift.get(guess(text)[0], model.shift[toxicity.OTHER])
        assert math.isclose(model.scorer()([text])[0], 1 / (1 + math.exp(-z)), rel_tol=1e-3, abs_tol=1e-5)


# --- top-k search


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 30, rng.normal(size=6).tolist(), "x") for k in range(90)] + [(3, [1.0] * 6, "x")] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    v = [(i, np.floor(1024 * np.array(e)).astype(int)) for i, e, _ in rows]
    want = Counter()
    for n, (q, x) in enumerate(v):
        if q % 3 == 0:
            best = sorted(((-int(x @ y), i) for m, (i, y) in enumerate(v) if m != n))[:5]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    for group in (7, None):
        assert Counter(map(tuple, topk.search(df, "vec_id % 3 = 0", k=5, group=group).collect())) == want


# --- language


def test_sizes_by_plain_compression():
    rng = random.Random(4)
    words = {n: ["".join(rng.choices(letters, k=6)) for _ in range(900)] for n, letters in (("aa", "aeioubdg"), ("bb", "klmnprst"), ("cc", "aeklmnio"))}
    raw = {n: [" ".join(w[:300]).join("  ").encode(), " ".join(w[300:]).join("  ").encode()] for n, w in words.items()}
    own = language.Classifier(raw)
    for k in range(60):
        text = " ".join(rng.choices(words[rng.choice("aa bb cc".split())] + words["aa"][:9], k=rng.choice([1, 3, 40, 4000])))
        data = f" {text} ".encode()
        sums, parts = Counter(), [data[lo : lo + language.BLOCK] for lo in range(0, len(data), language.BLOCK)]
        for n in range(2):
            for name, d in raw.items():
                c = zstd.ZstdCompressor(level=language.LEVEL, dict_data=zstd.ZstdCompressionDict(d[n], dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                first = b"".join(d[n][k * len(d[n]) // 13 : k * len(d[n]) // 13 + 16] for k in range(1, 13))
                sums[name] += sum(len(c.compress(first + p)) - len(c.compress(first)) for p in parts)
            least, next_ = sorted(sums.values())[:2]
            narrow = (next_ - least) / max(1, next_) < language.NARROW
            if not narrow:
                break
        got = own.classify(text)
        assert got[0] == min(sums, key=lambda x: (sums[x], x)) and got[2] == narrow


def test_language_cases(spark):
    rng = random.Random(5)
    en, de = "the of and to in a is that it for on with as are was".split(), "der die das und ist nicht ein eine zu den von mit auf".split()
    rows = [(i, " ".join(rng.choices(en if i % 2 else de, k=60)), "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(70, "½ ² 12 --", "en", None), (71, "und " * 40_000, None, None), (72, rows[1][1], "de", None), (72, rows[1][1], "de", None), (None, "the of and to in", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{DOCS}, rejected string")
    learned = language.learn(df, df["doc_id"] < 60)
    got = language.predict(df, learned, ["doc_id", "rejected"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[70].lang_pred == "und" and by[71].lang_pred == "de" and by[72].lang_pred == by[1].lang_pred == "en"
    assert language.predict(df.limit(0), learned, ["doc_id"]).count() == 0


# --- pieces


def test_pieces_of_an_empty_table_and_a_long_word(spark):
    df = spark.createDataFrame([(1, "x" * 20_000, "a"), (2, "", "b"), (2, "", "b"), (3, None, "c")], "doc_id long, text string, ids string")
    got = pieces.encode(df, ["doc_id", "ids"]).collect()
    assert all(r.round_trip for r in got) and len(got) == 4 and [len(r.ids) for r in got if r.doc_id > 1] == [0, 0, 0]
    assert pieces.encode(df.limit(0), ["doc_id"]).count() == 0


# --- mixing


def mix_rows(rng):
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["s0", "s0", "s0", "s1", "s2", None])) for i in range(600)]
    return rows + [(None, "same text of a row without an id", "s1")] * 200 + [(7, "a b", "s0")] * 50 + [(8, None, "s0")] * 3


def test_every_prefix_of_the_mix_is_near_its_targets(spark):
    rows = mix_rows(random.Random(2))
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, source string, size string, uses int")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows)
    target = {r.source: r.target for r in got}
    total = sum(target.values())
    at = sorted((t, r.source) for r in got for t in (r.uses or []))
    words = Counter()
    slots = sum(target.values()) / 16
    for k in (0.1, 0.25, 0.5, 0.75, 1.0):
        words = Counter()
        for r in got:
            words[r.source] += sum(r["size"] for t in (r.uses or []) if t < k * slots)
        for s, t in target.items():
            assert abs(words[s] / max(1, sum(words.values())) - t / total) <= 0.05 / k**0.5
    assert at[0][0] == 0
    seen = {}
    for r in got:
        assert (r.first_slot is None) == (r.taken == 0) and 0 <= r.taken <= 3 * r["size"]
        seen.setdefault(r.source, 0)
        seen[r.source] += r.taken
    assert all(abs(seen[s] - t) <= 0.5 for s, t in target.items())
    out = mixing.mixed(df.drop("uses"), block=16)
    assert out.columns == ["doc_id", "text", "source", "size"]
    counts, want = Counter(out.toPandas()["text"].str.split().str.len().groupby(out.toPandas()["source"].fillna("none")).sum().to_dict()), {s or "none": t for s, t in target.items()}
    assert all(abs(counts[s] - t) <= 100 for s, t in want.items())


def test_the_schedule_is_the_golden_ratio_sequence(spark):
    got = sorted(map(tuple, mixing.schedule(spark.range(1), [(0, 6, 60), (1, 3, 30), (2, 1, 10)], 10).collect()))
    rank, want, given = Counter(), [], []
    for t in range(10):
        u = t * mixing.GOLDEN % mixing.PERIOD / mixing.PERIOD
        s = 0 if u < 0.6 else 1 if u < 0.9 else 2
        given.append(s)
        if rank[s] < (6, 3, 1)[s]:
            want.append((t, s, rank[s]))
        rank[s] += 1
    for s, need in enumerate((6, 3, 1)):
        want += [(10 + k, s, rank[s] + k) for k in range(max(0, need - rank[s]))]
    assert got == sorted(want)
    assert re.fullmatch("[012]+", "".join(map(str, given)))
