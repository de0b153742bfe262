"""Toxicity in scripts other than Latin: the tables of wide words against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.llm import toxicity as X

ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "".join(map(chr, range(0x430, 0x450))),
    "han": "".join(map(chr, range(0x4E00, 0x4E00 + 1500))),
    "hangul": "".join(map(chr, range(0xAC00, 0xAC00 + 900))),
}


def plain_ratios(toxic, ordinary, words):
    """Kneser–Ney by its definition on dictionaries of tuples of characters."""
    n = X.WIDE_ORDER

    def grams(word):
        s = (None,) * (n - 1) + tuple(word) + ("end",)
        return [s[i:i + n] for i in range(len(word) + 1)]

    classes = [Counter(g for w in ws for g in grams(w)) for ws in (toxic, ordinary)]
    lower, longer = {}, set(classes[0]) | set(classes[1])
    for k in range(n - 1, 0, -1):
        lower[k] = Counter(g[1:] for g in longer)
        longer = set(lower[k])

    def off(counts):
        return X.discount_of(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))

    def step(counts, g, below):
        d, inside = off(counts), [c for h, c in counts.items() if h[:-1] == g[:-1]]
        if not inside:
            return below
        return max(counts[g] - d, 0) / sum(inside) + d * len(inside) / sum(inside) * below

    def log_p(counts, g):
        p = 1 / X.WIDE_SYMBOLS
        for k in range(1, n):
            p = step(lower[k], g[n - k:], p)
        return math.log(step(counts, g, p))

    return {w: sum(log_p(classes[0], g) - log_p(classes[1], g) for g in grams(w)) / (len(w) + 1) for w in words}


def test_wide_ratios_by_definition(spark, make_docs):
    rng = random.Random(5)
    letters = "жзийклмн"
    some = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(60)]
    toxic, ordinary = rng.choices(some, k=40), rng.choices(some, k=80)
    docs = make_docs([" ".join(toxic), " ".join(ordinary)]).withColumn("toxic", (F.col("doc_id") == 0).cast("int"))
    model = X.wide_model(X.gram_counts(docs))
    words = sorted({*some, "ж", "ззз", "жжжжжжжж", "日本", "мнлюбой"})
    got = {r.word: r.ratio for r in X.wide_ratios(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    want = plain_ratios(toxic, ordinary, words)
    assert got.keys() == want.keys()
    for w in words:
        assert abs(got[w] - want[w]) < 1e-9, w


def test_what_is_wide():
    narrow, wide = ["über", "straße", "øre", "łódź", "a1", "٣", "ﬁn", "ｗｉｄｅ"], ["любовь", "й", "한글", "日本", "αβγ", "naïvж"]
    assert not any(map(X.is_wide, narrow)) and all(map(X.is_wide, wide))
    grams, lengths = X.wide_grams(["한글", "하글", "ио", "йо"])
    parts = [grams[a:a + n].tolist() for a, n in zip([0, 3, 6, 9], lengths)]
    assert lengths.tolist() == [3] * 4
    assert not set(parts[0]) & set(parts[1]) and not set(parts[2]) & set(parts[3])   # й is not и
    assert (X.word_grams(["über"])[0] == X.word_grams(["uber"])[0]).all()
    assert max(X.word_grams(["zzzzz", "99999"])[0]) < X.SYMBOLS ** X.ORDER


def recall_by_script(spark, scripts, n=1500):
    """Documents of 40 ordinary words; each toxic one has one of 12 insults. Held-out recall and precision."""
    rng = random.Random(9)
    rows = []
    for script in scripts:
        letters = ALPHABETS[script]
        short = len(letters) > 100
        make = lambda: "".join(rng.choices(letters, k=rng.randint(2, 3) if short else rng.randint(4, 9)))
        ordinary, insults = [make() for _ in range(4000)], [make() for _ in range(12)]
        for _ in range(n):
            words, toxic = rng.choices(ordinary, k=40), int(rng.random() < 0.4)
            if toxic:
                words[rng.randrange(40)] = rng.choice(insults)
            rows.append((len(rows), " ".join(words), toxic, script))
    all_rows = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, script string").repartition(4)
    kept = X.Settings(calibration_share=5)
    model = X.fit(all_rows, all_rows.where("doc_id % 4 <> 0").select("doc_id", "toxic"), kept)
    got = X.score(all_rows, model).join(all_rows.where("doc_id % 4 = 0"), "doc_id").toPandas()
    out = {}
    for script, g in got.groupby("script"):
        hits = ((g.predicted == 1) & (g.toxic == 1)).sum()
        out[script] = (hits / g.toxic.sum(), hits / max(1, (g.predicted == 1).sum()))
    return out


@pytest.mark.parametrize("script", ["cyrillic", "han", "hangul"])
def test_recall_does_not_follow_the_script(spark, script):
    latin, other = recall_by_script(spark, ["latin"])["latin"], recall_by_script(spark, [script])[script]
    assert other[0] >= latin[0] - 0.05 and other[1] >= latin[1] - 0.05, (latin, other)


@pytest.mark.parametrize("script", ["cyrillic", "han"])
def test_another_script_does_not_spoil_latin(spark, script):
    """Narrow and wide words have features of their own."""
    got = recall_by_script(spark, ["latin", script])
    print(got)
    assert all(recall >= 0.85 and precision >= 0.75 for recall, precision in got.values()), got


def test_one_row_for_each_document(spark, make_docs):
    texts = ["любовь и мир", "любовь и мир", "plain words", "", None, "日本 plain 日本 日本 日本"]
    docs = make_docs(texts).unionByName(make_docs(texts[:2]))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, toxic int")
    rows = X.score(docs, X.fit(docs, labels, X.Settings(calibration_share=2))).collect()
    assert len(rows) == 8 and len({r.score for r in rows if r.doc_id in (0, 1)}) == 1


def test_features_are_over_all_words(spark, make_docs):
    """Strongest, mean of the strongest three, and mean, with repeats, of narrow and of wide words."""
    docs = make_docs(["добрый день bad day", "злой день good day", "злой злой bad день"])
    rows = docs.withColumn("toxic", (F.col("doc_id") > 0).cast("int"))
    counts = X.gram_counts(rows).collect()
    narrow = sorted((r.gram, r.toxic, r.ordinary) for r in counts if not r.wide)
    table = tuple(np.array(c) for c in zip(*narrow))
    shared = spark.sparkContext.broadcast(table)
    wide = X.wide_model(X.gram_counts(rows))
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    distinct = sorted({w for ws in texts.values() for w in ws})
    ratio = dict(zip([w for w in distinct if not X.is_wide(w)],
                     X.Model(*table).ratios([w for w in distinct if not X.is_wide(w)]).tolist()))
    words = spark.createDataFrame([(w,) for w in distinct if X.is_wide(w)], "word string")
    ratio |= {r.word: r.ratio for r in X.wide_ratios(words, wide).collect()}
    for r in X.feature_rows(docs, shared, wide).collect():
        for is_wide, names in ((False, X.FEATURES[:3]), (True, X.FEATURES[3:])):
            mine = sorted((ratio[w] for w in texts[r.doc_id] if X.is_wide(w) == is_wide), reverse=True)
            want = (mine[0], sum(mine[:3]) / len(mine[:3]), sum(mine) / len(mine)) if mine else (0, 0, 0)
            assert all(abs(r[f] - v) < 1e-12 for f, v in zip(names, want))
