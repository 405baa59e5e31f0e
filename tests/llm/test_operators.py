import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pagewright.llm import chat, html_text, language, lm_score, mixing, pieces, simhash, topk, toxicity
from pagewright.llm.queries import _HOSTILE


# --- chat


def test_template_language():
    t = chat.Template("{% set a = 'x' %}{% for m in ms %}{% if m.r == 'u' and not m.z %}{{ a + m['t']|upper }}{% elif m.r in 'abc' %}({% generation %}{{ m.t }}{% endgeneration %}){% else %}-{% endif %}{% endfor %}{# note #}")
    text, spans = t.render(ms=[{"r": "u", "t": "hi"}, {"r": "b", "t": "é!"}, {"r": "q", "t": ""}])
    assert text == "xHI(é!)-" and [text[a:b] for a, b in spans] == ["é!"]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{% if true %}e{% endif %}"))
    assert tree == (chat.Out(chat.Const("abcde")),)


@pytest.mark.parametrize("source", ["{{ x.__class__.y }}", "{{ f() }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a|nope }}", "{% import os %}"])
def test_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source).render(x="text", a=1)


def test_chat_reads_back_what_went_in():
    rng = random.Random(1)
    alphabet = ["\\", "<turn>", "</turn>", "### ", "#", "<", "/", " ", "a", "é😀", "\n", "turn>"]
    t = chat.Template(chat.TEMPLATE)
    for _ in range(300):
        ms = [{"role": rng.choice(["user", "assistant", "sys### ", "", "\\"]), "text": "".join(rng.choices(alphabet, k=rng.randrange(9)))} for _ in range(rng.randrange(5))]
        read = chat.Reader()
        for p in t.pieces(messages=ms):
            read.feed(p)
        want = hashlib.sha256("".join(f"{m['role']}\n{m['text']}\n" for m in ms).encode()).hexdigest()
        said = "".join(m["text"] for m in ms if m["role"] == "assistant")
        assert (read.turns, read.digest.hexdigest(), read.loss_chars, read.loss.hexdigest()) == (len(ms), want, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_over_a_table(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", _HOSTILE), (None, 0, "assistant", "x"), (1, 1, "assistant", None), (2, 0, None, "t")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r.conv_id: r for r in chat.format_digests(df).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[None].loss_chars == 1 and got[1].loss_chars == 0
    texts = {r.conv_id: r.formatted for r in chat.format_texts(df).collect()}
    assert {k: len(v) for k, v in texts.items()} == {k: v.formatted_chars for k, v in got.items()}
    assert chat.format_digests(df.limit(0)).count() == 0


# --- mixing


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50)])
    assert [g[0] for g in got] == ["a", "b", None]
    assert got[0][2] == 30.0 and abs(sum(g[2] for g in got) - 160) < 1e-9
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [("a", 0, 0.0)]


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["s0", "s0", "s1", "s2", None, ""])) for i in range(300)] + [(5, "a b", "s0"), (5, "a b", "s0"), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("x", "x")
    got = mixing.mix(df, block=16).collect()
    again = mixing.mix(df.repartition(5), block=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    out = Counter(r.doc_id for r in mixing.mixed(df, block=16).collect())
    assert sum(out.values()) > 0 and mixing.mix(df.limit(0)).count() == 0


# --- language


def test_language(spark):
    en = "the of and to in a is that it for on with as are was be this by from they have were their "
    de = "der die das und ist nicht ein eine zu den von mit auf für dem sich als auch werden wurde bei "
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices((en if i % 2 else de).split(), k=60)), "en" if i % 2 else "de", 1.0) for i in range(80)]
    rows += [(900, None, "en", 1.0), (901, "123 --", None, 1.0), (902, "", "de", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    learned = language.learn(df, df["doc_id"] < 40)
    got = {r.doc_id: r for r in language.predict(df, learned, ["doc_id", "lang", "score"]).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and not got[i].rejected for i in range(40, 80))
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert language.learn(df.limit(0), df["doc_id"] < 40) == {}
    assert {r.lang_pred for r in language.predict(df, {}, ["doc_id"]).collect()} == {"und"}


# --- pieces


@pytest.fixture(scope="module")
def codec():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


SAMPLES = ["", " ", "Hello world", "  two  spaces ", "x\n\ny\tz", "日本語 é 😀", "a" * 300, "the The THE", "1234,5 €", "bá ​"]


def test_ids_are_the_librarys(codec):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text, ids in zip(SAMPLES, codec.encode(SAMPLES)):
        assert np.frombuffer(ids, np.int32).tolist() == own.encode(text)


def test_round_trip(codec):
    rng = random.Random(6)
    texts = SAMPLES + ["▁", "a ▁ b▁"] + ["".join(rng.choices("ab ▁\né漢😀the", k=40)) for _ in range(200)]
    assert [codec.decode(x) for x in codec.encode(texts)] == texts


def test_viterbi_against_brute_force():
    from sentencepiece import sentencepiece_model_pb2

    with open(pieces.MODEL, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    own = pieces.Pieces(proto.SerializeToString())
    score = {p.piece: p.score for p in proto.pieces if p.type == 1}

    def best(w):
        out = [(0.0, [])]
        for j in range(1, len(w) + 1):
            out.append(max(((out[i][0] + score[w[i:j]], out[i][1] + [w[i:j]]) for i in range(j) if w[i:j] in score), key=lambda x: (x[0], len(x[1][-1]))))
        return out[-1]

    words = [" the", " reading", " thenation", " abc", " zebra"]
    for w, ids in own._segments(words).items():
        got = [proto.pieces[i].piece for i in np.frombuffer(ids, np.int32)]
        assert sum(score[p] for p in got) == best(w.replace(" ", "▁"))[0] and "".join(got) == w.replace(" ", "▁")


def test_pieces_over_a_table(spark):
    df = spark.createDataFrame([(1, "a b", [1]), (2, None, [2]), (1, "a b", None)], "doc_id long, text string, ids array<int>")
    got = pieces.encode(df, ["doc_id", "ids"]).collect()
    assert len(got) == 3 and all(r.round_trip for r in got) and [len(r.ids) for r in got if r.doc_id == 2] == [0]


# --- language model


def brute_q(word, share, end):
    w = b" " + word
    a = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        a[j] = sum(a[i] * share[w[i:j]] for i in range(j) if w[i:j] in share)
    return a[-1] * end


def test_lattice_sums_all_segmentations():
    names = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab"]
    share = np.array([0.1, 0.2, 0.1, 0.1, 0.2, 0.05, 0.05])
    own = lm_score.Lattice(names, np.log(share), math.log(0.2))
    words = [b"a", b"ab", b"abba", b"bab", b"aaaa", b""]
    want = [brute_q(w, dict(zip(names, share)), 0.2) for w in words]
    assert np.allclose(np.exp(own.log_probability(words)), want)
    up = 1e-6
    for k in range(len(names)):  # expected uses are the derivative of the log probability
        more = np.log(share) + up * (np.arange(len(names)) == k)
        slope = (lm_score.Lattice(names, more, math.log(0.2)).log_probability(words) - own.log_probability(words)).sum() / up
        assert abs(slope - own.expected(words)[k]) < 1e-4


def test_scores_against_brute_force(spark):
    texts = [(1, "the cat the Dog"), (2, "the zzq éß"), (3, None), (4, " "), (5, "a " * 40 + "rare"), (6, "the cat"), (6, "the cat"), (None, "dog")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string")
    got = lm_score.score(df, df["doc_id"].isin(2, 5)).collect()
    train, docs = Counter(), [(i, [w.encode() for w in re.findall(r"\S+", (t or "").lower())] + [lm_score.END]) for i, t in texts]
    for i, w in docs:
        if i not in (2, 5):
            train.update(w)
    n, v = sum(train.values()), len(train)
    base = sorted((repr(i), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 9)) for i, ws in docs)
    assert sorted((repr(r.doc_id), round(r.base_score, 9)) for r in got) == base
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known) for r in got) == sorted((repr(i), len(ws), sum(train[w] > 0 for w in ws)) for i, ws in docs)
    by = {r.doc_id: r for r in got}
    assert by[5].score / by[5].n_tokens > by[2].score / by[2].n_tokens


def test_log_gamma(spark):
    xs = [1.0, 1.5, 2.0, 7.3, 1e4, 1e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(lm_score.log_gamma(df["x"])).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], atol=1e-7)


# --- html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a>Home</a><li>News</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title {0}</h1><p><b>First {0} &amp; more<br>same block<p>Second\n  {0}&nbsp;end</p><aside>side</aside><form><label>x</label></form></article>
<div id="comments"><p>Nice {0}</p></div><footer>&copy; all</footer></body>"""


def test_declared_article():
    got = html_text.texts([PAGE.format(k) for k in ("one", "two")] + [None, "", "just text"])
    assert got[0] == "Title one\nFirst one & more same block\nSecond one end" and got[2:4] == ["", ""] and got[4] == "just text"


def test_suffix_array_finds_undeclared_boilerplate():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    body = [" ".join(rng.choices(words, k=40)) for _ in range(8)]
    menu, foot = "Home News Sport Weather Travel Food Music Film Books", "All rights reserved by the owner of this fine site since long ago"
    pages = [f"<div><span>{menu}</span></div><section><p>{b}</p></section><center>{foot}</center>" for b in body]
    assert html_text.texts(pages) == body


def test_html_over_a_table(spark):
    rows = [(k, f"http://a.example/{k % 3}", PAGE.format(k)) for k in range(5)] + [(9, None, None), (9, None, None)]
    got = html_text.extract(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert len(got) == 7 and all(len(r.text) == r.n_chars for r in got)
    assert {r.page_id: r.text for r in got}[3].startswith("Title 3\n")


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (["badword", "nastyish"] if i % 3 == 0 else [])), i % 3 == 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(999, None, 1.0), (998, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, docs["doc_id"] % 4 != 2)
    got = {r.doc_id: r for r in toxicity.predict(docs, model, ["doc_id"]).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 4 == 2]
    assert sum((r.predicted == 1) == y for r, y in held) >= 0.95 * len(held)
    assert got[999].score == got[998].score and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.fit(docs, labels.limit(0), docs["doc_id"] >= 0).constant == 0.0


def test_long_texts_are_scored_whole(monkeypatch):
    m = toxicity.Model()
    words = [f"w{k}" for k in range(500)]
    whole = m.pools([words, []])
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    assert np.allclose(m.pools([words, []]), whole, atol=1e-6)


# --- search


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 12))
    x[50:90] = x[50]
    rows = [(i, x[i].tolist()) for i in range(300)] + [(1000, None), (1001, [float("nan")] * 12), (None, x[0].tolist()), (1002, [None] * 12), (1003, [0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    v = {i: np.pad(np.floor(1024 * np.array(e)).astype(np.int64), (0, 12 - len(e))) for i, e in rows if i is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)}
    want = {(q, k + 1, *t) for q in v if q % 20 == 0 for k, t in enumerate(sorted(((i, int(v[q] @ y)) for i, y in v.items() if i != q), key=lambda t: (-t[1], t[0]))[:10])}
    got = topk.search(df, "vec_id % 20 = 0", group=64).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.search(df.limit(0), "vec_id % 20 = 0").count() == 0


# --- near copies


def test_similar_classes(spark):
    rng = random.Random(12)
    words = [f"t{k}" for k in range(2000)]
    rows, want = [], {}
    for c in range(30):
        base = rng.choices(words, k=200)
        rows.append((c * 10, " ".join(base)))
        for n in (1, 2):
            copy = list(base)
            copy[rng.randrange(5, 195)] = "changed"
            rows.append((c * 10 + n, " ".join(copy)))
            want[c * 10 + n] = c * 10
        want[c * 10] = c * 10
    rows += [(5000 + k, " ".join(rng.choices(words, k=200))) for k in range(60)] + [(7000, ""), (7001, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash.similar_classes(df).collect()}
    assert {k: v for k, v in got.items() if k < 7000} == want
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert len([k for k in kept if k is not None and k < 5000]) == 30 and None in kept


def test_similarity_is_checked_exactly(spark):
    base = [f"t{k}" for k in range(100)]
    far = base[:60] + [f"u{k}" for k in range(40)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far))], "doc_id long, text string")
    assert simhash.similar_classes(df).count() == 0


def test_fingerprints_follow_similarity():
    words = [f"w{k}" for k in range(600)]
    other = words[:100] + ["x"] + words[101:]
    a, b = (simhash.wide_fingerprint(simhash.shingle_hashes(" ".join(w), 5)).view(np.uint64) for w in (words, other))
    assert 0 < np.bitwise_count(a ^ b).sum() < 40
    assert xxhash.VERSION
