import hashlib
import random
import re

import pytest

from tessella.llm.substring_dedup import cut_repeats, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Windows by their words: the first start of each, then the words that later ones cover."""
    docs = sorted({(d if d is not None else -(1 << 63), t) for d, t in rows}, key=lambda x: x[0])
    first, out = {}, {}
    words = {x: WORD.findall(x[1] or "") for x in docs}
    for x in docs:
        for s in range(len(words[x]) - window + 1):
            first.setdefault(tuple(words[x][s : s + window]), (x, s))
    for x in docs:
        gone = set()
        for s in range(len(words[x]) - window + 1):
            if first[tuple(words[x][s : s + window])] != (x, s):
                gone |= set(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words[x]) if k not in gone)
        out[x] = (len(words[x]), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def check(spark, rows, window=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(docs, window).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    ids = [d for d, _ in rows]
    for r in got:
        if ids.count(r.doc_id) == 1:
            text = dict(rows)[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[(r.doc_id if r.doc_id is not None else -(1 << 63), text)], r
            assert sum(b - a for a, b in r.spans) == r.n_removed


def words(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


def test_planted_repeats(spark):
    passage = words(1000, 1055)
    rows = [
        (1, words(0, 30) + " " + passage + " " + words(30, 50)),
        (2, words(60, 80) + "\n" + passage + "\t" + words(80, 90)),
        (3, passage),
        (4, words(1000, 1019)),
        (5, words(2000, 2030) + " " + words(2000, 2030) + " " + words(2005, 2030)),
        (6, None),
        (7, ""),
        (8, "é " * 200),
        (9, "x \x0b y  z"),
        (None, words(1030, 1060)),
        (12, " ".join(f"w{k}" for k in range(1054, 999, -1))),
    ]
    check(spark, rows)
    check(spark, rows, 5)


def test_random_texts_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for k in range(120)]
    for window in (2, 3, 7, 8):
        check(spark, rows, window)


def test_copies_and_repeated_rows(spark):
    text = words(0, 100)
    rows = [(k, text) for k in range(50)] + [(7, text), (900, words(40, 70)), (900, words(50, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(docs).collect()
    assert len(got) == len(rows)
    assert {r.n_removed for r in got if r.doc_id == 0} == {0}
    assert {r.n_removed for r in got if 0 < r.doc_id < 900} == {100}
    assert sorted(r.n_removed for r in got if r.doc_id == 900) == [30, 40]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(docs).count() == 0
    docs = spark.createDataFrame([(1, words(0, 40), "a", 5), (2, "head\n" + words(0, 40) + "\ntail  end", "b", 6)], "doc_id long, text string, th string, hits int")
    got = sorted(cut_repeats(docs).collect())
    assert got[0].text == words(0, 40) and got[1].text == "head\ntail  end" and [r.th for r in got] == ["a", "b"]


def test_window_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup(spark.createDataFrame([], "doc_id long, text string"), 1)


def test_a_very_long_text_and_an_empty_table(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    words[50_000:50_060] = words[100:160]
    rows = [(1, " ".join(words) + " " + "z" * (2 << 20)), (2, " ".join(words[40_000:40_030])), (3, None)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bucket int, hits string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    assert got == {1: (60_001, 60), 2: (30, 30), 3: (0, 0)}
    assert substring_dedup(docs.limit(0)).count() == 0 and cut_repeats(docs.limit(0)).count() == 0
    assert cut_repeats(docs).columns == docs.columns
