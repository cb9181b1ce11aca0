import re
from collections import Counter

from pyspark.sql import functions as F

from ticktide.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = W.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", "   ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 30, ("one two three four five six seven eight nine " * 3).strip(), "#a *b $c %d &e |f <g >h\n" * 4,
    "l1\nl1\n\n \nl2\nl1", "é日 𝒳 ß x\x1c y", "p q r s t u v w x p q r s t u v w y", " ".join(f"w{i}" for i in range(500)), "\n".join(f"line {i % 3}" for i in range(40)),
]


def test_measures_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.measured(df).collect():
        want = measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    verdicts = set()
    for rules in (quality.RULES, quality.RULES[::-1]):
        text = F.coalesce("text", F.lit(""))
        rows = df.select("doc_id", quality.rejected(lambda m: quality.MEASURES[m](text, quality.words_of(text)), rules).alias("r")).orderBy("doc_id").collect()
        verdicts.add(tuple(r.r for r in rows))
    assert len(verdicts) == 1
    assert sorted(r.name for r in quality.ordered(df)) == sorted(r.name for r in quality.RULES)


def test_filter_and_odd_rows(spark, odd_docs, no_docs):
    assert quality.measured(no_docs).count() == quality.quality_filter(no_docs).count() == 0
    long = " ".join(f"word{i} tail{i % 31}" for i in range(60_000))
    odd_docs = odd_docs.unionByName(spark.createDataFrame([(60, long, "en", "a", len(long))], odd_docs.schema))
    kept = quality.quality_filter(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {(r.doc_id, r.text) for r in quality.measured(odd_docs).filter("kept").collect()}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want and any(i == 60 for i, _ in want)


def test_main_path_is_native(spark, odd_docs):
    plan = quality.quality_filter(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
