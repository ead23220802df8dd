"""Language and toxicity: held-out accuracy, and what may not matter."""

import math
import random
from collections import Counter

import pytest

import zstandard

from xylem.llm import language, toxicity

SYLLABLES = {"aa": "ka lo mi ten sar", "bb": "ön üt schi eg arn", "cc": "ção él qui ue ros"}
SLURS = ["grumblex", "snortwaddle", "fribber", "zonkhead", "plimp"]


def text_of(rng, lang, n=None):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n or rng.randrange(5, 60)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, text_of(rng, lang := rng.choice("aa aa bb cc".split())), lang, "s") for i in range(600)], "doc_id long, text string, lang string, source string")


def test_language_of_unseen_texts(spark, corpus, odd_docs, no_docs):
    model = language.fit(corpus.where("doc_id % 3 <> 0"))
    assert model["langs"] == ["aa", "bb", "cc"]
    held = corpus.where("doc_id % 3 = 0")
    truth = {r.doc_id: r.lang for r in held.collect()}
    got = language.identify(held, model).collect()
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.98 * len(truth)
    assert all(0 <= r.score <= 1 for r in got)
    hidden = held.selectExpr("doc_id", "text", "'zz' as lang", "'t' as source")
    assert sorted(language.identify(hidden, model).collect()) == sorted(got)
    odd = {r.doc_id: r for r in language.identify(odd_docs, model).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (1, 2, 3, 11, 12)) and odd[8].lang_pred != "und"
    assert language.identify(no_docs, model).collect() == []
    nothing = language.fit(no_docs)
    assert {r.lang_pred for r in language.identify(corpus, nothing).collect()} == {"und"}


def naive_model(rows):
    """{lang: [counts of words, of 1-grams ... 4-grams]} by loops."""
    model = {}
    for lang, text in rows:
        counts = model.setdefault(lang, [Counter() for _ in range(5)])
        for w in language.words(text):
            counts[0][w] += 1
            for n in range(1, 5):
                for i in range(len(w) + 3 - n):
                    counts[n][f"<{w}>"[i : i + n]] += 1
    return model


def naive_scores(model, text):
    """{lang: sum of logs}: a known word by its frequency, another by the longest known n-grams from its left."""
    sizes = [len({x for c in model.values() for x in c[n]}) for n in range(5)]
    log = lambda lang, n, item: math.log((model[lang][n][item] + 0.5) / (sum(model[lang][n].values()) + 0.5 * (sizes[n] + 1)))
    out = dict.fromkeys(sorted(model), 0.0)
    for w in language.words(text):
        if any(w in c[0] for c in model.values()):
            for lang in out:
                out[lang] += log(lang, 0, w)
            continue
        rest = f"<{w}>"
        while rest:
            n = next((n for n in (4, 3, 2, 1) if len(rest) >= n and any(rest[:n] in c[n] for c in model.values())), 0)
            for lang in out:
                out[lang] += language.BACKOFF * log(lang, n, rest[:n]) if n else 0.0
            rest = rest[n or 1 :]
    return out


def test_language_against_brute_force(spark, corpus):
    taught = [(r.lang, r.text) for r in corpus.where("doc_id % 3 <> 0").collect()]
    model, naive = language.fit(corpus.where("doc_id % 3 <> 0")), naive_model(taught)
    for n in range(5):
        assert model["items"][n][0] == sorted({x for c in naive.values() for x in c[n]})
    rng = random.Random(9)
    texts = [text_of(rng, rng.choice(list(SYLLABLES)), 30) for _ in range(60)] + ["qqq zzz", "kalo", "ön ção x", "  ", None, "!!", "Kalo KALO kalo-kalo"]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        want = naive_scores(naive, text)
        if not language.words(text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        best = max(want.values())
        assert want[got[i].lang_pred] == pytest.approx(best, abs=1e-3)
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - best) for x in want.values()), abs=1e-3)


def test_language_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, "kalo w" + "".join(chr(97 + int(c)) for c in str(i)), "aa") for i in range(3000)] + [(None, "kalo mi ten", "bb")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, per_language=300)
    assert 200 < sum(x.startswith("w") for x in model["items"][0][0]) < 400 and model["langs"] == ["aa", "bb"]


def test_letters():
    assert language.words("x² ½") == ["x²", "½"] and language.words("² ½ 12") == language.words(None) == language.words(" -- ") == []
    assert language.words("Ünï code-MIX") == ["ünï", "code", "mix"]


def test_full_table_of_words_changes_nothing(spark, corpus, monkeypatch):
    model = language.fit(corpus)
    few = [r.text for r in corpus.limit(50).collect()]
    rows = language.Rows(model)
    whole = [rows.sums([w + "x" for w in language.words(t)]) for t in few]
    monkeypatch.setattr(language, "CACHE", 3)
    rows = language.Rows(model)
    again = [rows.sums([w + "x" for w in language.words(t)]) for t in few]
    assert all(abs(a - b).max() < 1e-2 for a, b in zip(whole, again, strict=True))


def test_toxicity_of_unseen_texts(spark, odd_docs, no_docs):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        words = text_of(rng, rng.choice(["aa", "cc"]), rng.randrange(20, 80)).split()
        for _ in range(toxic * rng.randrange(2, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(SLURS))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(out[i].predicted, y) for i, y in marks if i % 3 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert toxicity.fit(docs.repartition(5), labels.where("doc_id % 3 <> 0")) == model
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == 13 and len({r.score for r in odd if r.doc_id in (1, 2, 3, 12)}) == 1
    assert toxicity.score(no_docs, model).collect() == []
    empty = toxicity.fit(no_docs, labels)
    assert len(toxicity.score(docs, empty).collect()) == 900


def test_window_gains_against_plain_compression():
    """Each gain is one length less another, of windows that hold every byte; counts are what a loop counts."""
    rng = random.Random(2)
    texts = [(text_of(rng, "aa", 40) + (" " + " ".join(rng.choices(SLURS, k=5)) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    model = toxicity.trained(texts)
    assert len(model["pairs"]) == len(toxicity.PAIRS) and any(s.encode() in model["pairs"][0][0] for s in SLURS) and not any(s.encode() in model["base"] for s in SLURS)

    def length(dictionary, window):
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    gains = toxicity.Gains(model["base"], model["pairs"])
    for text in [None, "", " ", "a", text_of(rng, "cc", 500), *(t for t, _ in texts[:4])]:
        cut, body = toxicity.windows(text), toxicity.normal(text)
        assert cut[0] == body[: toxicity.WINDOW] and all(body[toxicity.STEP * i :].startswith(w) and len(w) <= toxicity.WINDOW for i, w in enumerate(cut))
        assert toxicity.STEP * (len(cut) - 1) + len(cut[-1]) == len(body)
        each = [[length(model["base"] + ordinary, w) - length(model["base"] + toxic, w) for w in cut] for toxic, ordinary in model["pairs"]]
        assert gains.of(cut).tolist() == each
        summed = [sum(g) // len(each) for g in zip(*each)]
        least = [min(g) for g in zip(*each)]
        want = [1.0]
        for row in (summed, least):
            up = [sum(g >= k for g in row) for k in range(1, toxicity.MOST_GAIN + 1)]
            down = [sum(g <= -k for g in row) for k in range(toxicity.LEAST_GAIN, 0, -1)]
            mean = sum(row) / len(row)
            want += [math.log1p(n) for n in up] + [5 * math.sqrt(n / len(row)) for n in up] + [math.log1p(n) for n in down] + [5 * math.sqrt(n / len(row)) for n in down]
            want += [mean, math.sqrt(sum((g - mean) ** 2 for g in row) / len(row))]
        assert toxicity.features(text, gains) == pytest.approx([*want, math.log1p(len(cut)) / 5])


def test_one_label_alone_teaches_nothing():
    assert toxicity.learn([]) == toxicity.learn([(1, "a b c", 1), (2, "", 1)]) == {"base": b"", "pairs": [], "weights": []}
    assert len(toxicity.learn([(1, "a b c", 1), (2, "", 0), (3, "x", 0)])["weights"]) == len(toxicity.features("", toxicity.Gains(b"", [(b"", b"")])))


def test_toxicity_sample_is_bounded_in_bytes(spark):
    rows = [(i, text_of(random.Random(i), "aa", 50)) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    learn, toxicity.learn = toxicity.learn, seen.append
    try:
        toxicity.fit(docs, labels, per_class_bytes=2000)
        toxicity.fit(docs, labels)
    finally:
        toxicity.learn = learn
    assert all(0 < sum(len(t) for _, t, y in seen[0] if y == label) <= 2000 for label in (0, 1)) and len(seen[1]) == 200
