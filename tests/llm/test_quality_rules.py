"""Base counts against a plain count, distances against the definition."""

import random
import re
from collections import Counter

import numpy as np

from vigilo.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_base_counts_of_the_table(real_docs, odd_docs):
    for docs in (real_docs, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        refs = Q.references(docs)
        got = Q.judge(docs, refs).collect()
        key = lambda n, c: (str(n), *sorted(c.items()))
        want = sorted(key(r.doc_id, plain_counts(r.text or "")) for r in rows)
        assert want == sorted(key(r.doc_id, {k: r[k] for k in plain_counts("")}) for r in got)
        for r in got:
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)


def test_references_count_all_documents(real_docs):
    rows = real_docs.collect()
    refs = Q.references(real_docs)
    for lang, ref in refs.items():
        words = Counter(w for r in rows if r.lang == lang for w in r.text.lower().encode().split())
        total = sum(words.values())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:100]
        assert sorted(ref["words"].values()) == sorted(n / total for _, n in top)
        assert sum(ref["classes"]) == sum(len(r.text.encode()) for r in rows if r.lang == lang)


def test_distance_is_jensen_shannon():
    p, q = np.array([1.0, 0, 3]), np.array([[1.0, 0, 3], [0, 5, 0], [2, 2, 4]])
    got = Q.js_distance(p, q)
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12
    a, b = p / 4, q[2] / 8
    m = (a + b) / 2
    kl = lambda x: sum(x[i] * np.log2(x[i] / m[i]) for i in range(3) if x[i])
    assert abs(got[2] - np.sqrt((kl(a) + kl(b)) / 2)) < 1e-12


def test_clean_documents_stay_and_junk_goes(real_docs, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.quality_rules(real_docs).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.all()
    assert got[got.quality == 0].kept.mean() < 0.9


def test_short_texts_are_not_tested(make_docs):
    settings = Q.Settings(min_chars=10 ** 6, min_common_words=10 ** 6)
    docs = make_docs([" ".join(f"w{i}" for i in range(60)), "### " * 10])
    got = {r.doc_id: r for r in Q.quality_rules(docs, settings).collect()}
    assert got[0].kept and got[0].class_distance is None and got[0].word_distance is None
    assert not got[1].kept


def test_kept_rows_have_all_columns(odd_docs, no_docs):
    got = Q.kept(odd_docs)
    assert got.columns == odd_docs.columns
    verdict = {r.doc_id for r in Q.quality_rules(odd_docs).where("kept").collect()}
    assert {r.doc_id for r in got.collect()} == verdict
    assert Q.kept(no_docs).count() == 0 and Q.quality_rules(no_docs).count() == 0


def test_no_language_leaves_the_base_rule(odd_docs):
    from pyspark.sql import functions as F
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert Q.references(docs) == {}
    assert all(r.kept == (not r.base_failed) for r in Q.quality_rules(docs).collect())


def varied(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(words, k=120)) for _ in range(n)]


def test_small_and_unknown_languages_are_not_held_against_others(spark):
    english = [f"{a}{b}" for a in "the of and to in for was he on".split() for b in ("", "r", "ing", "se", "ly")]
    russian = [f"{a}{b}" for a in "и в не на я быть он что это".split() for b in ("", "а", "ом", "ые", "ть")]
    greek = [f"{a}{b}" for a in "και το να είναι με για που".split() for b in ("", "ς", "ων", "ου", "ες")]
    finnish = [f"{a}{b}" for a in "ja on ei se että kuin mutta".split() for b in ("", "ssa", "lla", "iin", "ksi")]
    texts = ([(t, "en") for t in varied(english, 3000, 0)] + [(t, "ru") for t in varied(russian, 12, 3)]
             + [(varied(greek, 1, 5)[0], None), (varied(finnish, 1, 5)[0], "fi")])
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(texts)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    refs = Q.references(docs)
    assert sorted(refs) == ["en", "ru"]  # ru has less than 0.5 % of the words
    got = {r.doc_id: r for r in Q.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(3000, len(texts)))
    assert got[len(texts) - 2].class_distance is None and got[len(texts) - 1].word_distance is None


def test_a_verdict_follows_the_text_alone(spark):
    english = [f"{a}{b}" for a in "the of and to in for was he on".split() for b in ("", "r", "ing", "se", "ly")]
    clean, signs = varied(english, 1, 7)[0], " ".join(f"#{i}$%&|<>{i * i}" for i in range(90))
    salad = " ".join(random.Random(1).choices(english[:3], weights=(8, 1, 1), k=400))
    langs = ["en", "EN", "zz", "", None]
    odd = [(t, lang) for t in (clean, signs, salad) for lang in langs]
    texts = odd + [(t, "en") for t in varied(english, 500, 0)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in Q.judge(docs, Q.references(docs.where(f"doc_id >= {len(odd)}"))).collect()}
    for k, kept in enumerate((True, False, None)):
        verdicts = {tuple(got[i])[1:] for i in range(k * len(langs), (k + 1) * len(langs))}
        assert len(verdicts) == 1 and (kept is None or verdicts.pop()[-1] == kept)
    assert got[len(langs)].class_distance > Q.Settings().max_class_distance


def test_whole_result_by_plain_rules(odd_docs, real_docs):
    """``kept`` from distances that are taken over plain histograms."""
    s = Q.Settings()
    for docs in (real_docs, odd_docs):
        refs = Q.references(docs)
        number = Q.byte_classes()
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        for r in Q.judge(docs, refs).collect():
            if r.base_failed:
                assert not r.kept
                continue
            assert r.kept == ((r.class_distance is None or r.class_distance <= s.max_class_distance)
                              and (r.word_distance is None or r.word_distance <= s.max_word_distance))
            if r.word_distance is None or len(texts[r.doc_id]) > 1:
                continue
            text = texts[r.doc_id][0]
            words, chars = Counter(WORD.findall(text.lower())), Counter(int(number[b]) for b in text.encode())
            by = []
            for ref in refs.values():
                bins = [words[w.decode()] for w in ref["words"]]
                p, q = np.array([*bins, sum(words.values()) - sum(bins)]), np.array([[*ref["words"].values(), ref["rest"]]])
                c = np.array([chars[i] for i in range(len(Q.CLASSES))])
                by.append((Q.js_distance(c, np.array([ref["classes"]]))[0], Q.js_distance(p, q)[0]))
            want = min(by, key=sum)
            assert abs(want[0] - r.class_distance) < 1e-9 and abs(want[1] - r.word_distance) < 1e-9
