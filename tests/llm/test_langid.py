from collections import Counter

import regex

from ticktide.llm import langid


def ngrams(word):
    padded = f"_{word}_"
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]


SENTENCES = {
    "en": "the cat sat on the mat and the dog was in the house with all of the other animals that they had there",
    "de": "der hund und die katze sind in dem haus und das kind ist mit einem ball auf der strasse nicht allein",
    "fr": "le chat est dans la maison avec les enfants et une fille qui ne veut pas que nous soyons en retard",
}


def brute_profile(texts):
    counts = Counter()
    for t in texts:
        for w in regex.findall(r"\p{L}+", t.lower()):
            counts.update(ngrams(w))
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE])}


def brute(text, profiles):
    own = brute_profile([text])
    return {k: sum(abs(r - p[g]) if g in p else langid.PROFILE for g, r in own.items()) for k, p in profiles.items()}


def test_learning_and_distances_match_brute_force(spark):
    rows = [(i, s * (i % 3 + 1), k) for i, (k, s) in enumerate(SENTENCES.items())] + [(9, None, "en"), (10, "the lonely text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    profiles = langid.learn(docs)
    assert profiles == {k: brute_profile([t for _, t, lang in rows if lang == k and t]) for k in SENTENCES}
    ranker = langid.Ranker(profiles)
    for t in [*SENTENCES.values(), "hund dog chien", "ÉÈ été", "x" * 3000, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 17)}" for i in range(5000))]:
        away = brute(t, profiles)
        lang, score = ranker.judge(t)
        assert lang == min(sorted(away), key=lambda k: away[k])
        first, second = sorted(away.values())[:2]
        assert abs(score - (1 - first / second)) < 1e-12


def test_undetermined_and_odd_rows(spark, odd_docs, no_docs):
    profiles = langid.learn(spark.createDataFrame([(1, s, k) for k, s in SENTENCES.items()], "doc_id long, text string, lang string"))
    rows = langid.predict(odd_docs, profiles).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.predict(no_docs, profiles).count() == 0
    assert langid.learn(no_docs) == {} and langid.Ranker({}).judge("abc") == ("und", 0.0)
    assert all(langid.Ranker(profiles).judge(t) == ("und", 0.0) for t in ("123 .,! _", "² ½ ① Ⅷ", None, "", " "))


def test_long_texts_are_counted_whole(spark, monkeypatch):
    texts = [" ".join(SENTENCES.values()) * 9, "hund" * 400 + " chien " * 50 + "x" * 900 + "_y" * 200, "  a", "b  ", "c", "日x², ½é"]
    whole = [dict(zip(map(langid.gram, c.tolist()), n.tolist())) for c, n in map(langid.gram_counts, texts)]
    assert whole == [dict(Counter(g for w in regex.findall(r"\p{L}+", t) for g in ngrams(w))) for t in texts]
    monkeypatch.setattr(langid, "PART", 37)
    assert [dict(zip(map(langid.gram, c.tolist()), n.tolist())) for c, n in map(langid.gram_counts, texts)] == whole


def test_clashing_names_pass(spark):
    docs = spark.createDataFrame([(1, SENTENCES["en"], "en", 7, 8)], "doc_id long, text string, lang string, `a.b` int, Score int")
    out = langid.predict(docs, langid.learn(docs))
    assert out.columns == ["doc_id", "lang", "a.b", "lang_pred", "score"] and out.first()[2] == 7


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held_out", langid.held_out())
    profiles = langid.learn(docs.filter("NOT held_out"))
    rows = langid.predict(docs.filter("held_out AND lang IS NOT NULL AND length(text) > 40"), profiles).collect()
    assert len(rows) > 20
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
