import random

from pagewright.llm import language


def test_how_often_words_occur_counts():
    """Forty thousand running words of one language, and a passage of many different ones of another."""
    rng = random.Random(4)
    words = {n: ["".join(rng.choices(letters, k=6)) for _ in range(1500)] for n, letters in (("aa", "aeioubdg"), ("bb", "klmnprst"))}
    own = language.Classifier({n: [" ".join(w).join("  ").encode()] for n, w in words.items()})
    common = words["aa"][:60]
    text = " ".join([*rng.choices(common, k=40000), *words["bb"][:1200]])
    assert own.classify(text)[0] == "aa"
    assert own.classify(" ".join(words["bb"][:200]))[0] == "bb"
