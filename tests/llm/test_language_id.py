import random
import zlib

from pyspark.sql import functions as F

from tessella.llm.language_id import ORDER, KneserNey, distinct_grams, identify_language, symbols


def brute_grams(text):
    kept, last = [], False
    for c in text.lower():
        if c.isalpha():
            kept.append(min(ord(c), 0xFFFF))
        elif last:
            kept.append(0)
        last = c.isalpha()
    if last:
        kept.append(0)
    padded = [0] * (ORDER - 1) + kept
    return [tuple(padded[k : k + ORDER]) for k in range(len(kept))]


def test_grams_of_a_batch_are_those_of_each_text():
    rng = random.Random(1)
    texts = ["", None, "a", "ab", "Abc, déf!", "1 2", "x1", "日本"] + ["".join(rng.choice("ab Cé.🙂") for _ in range(rng.randrange(12))) for _ in range(200)]
    values, ptr = symbols(texts)
    keys, which = distinct_grams(values, ptr)
    got = [tuple((int(k) >> 16 * b) & 0xFFFF for b in reversed(range(ORDER))) for k in keys[which]]
    want = [brute_grams(x or "") for x in texts]
    assert [got[a:z] for a, z in zip(ptr[:-1], ptr[1:], strict=True)] == want


def test_probabilities_add_up_to_one():
    values, ptr = symbols(["the cat sat on the mat and then the hat", "a that", "tact"])
    keys, which = distinct_grams(values, ptr)
    import numpy as np

    model = KneserNey(keys, np.bincount(which))
    alphabet = [0, *map(ord, "abcdefghijklmnopqrstuvwxyz")]
    seen = set(values.tolist())
    for context in [(0, 0, 0), (0, ord("t"), ord("h")), (ord("z"), ord("z"), ord("q"))]:
        p = [float(np.exp(model.log_probabilities(np.array([sum(c << 16 * (ORDER - 1 - k) for k, c in enumerate((*context, d)))], np.uint64)))[0]) for d in alphabet]
        known = sum(x for x, d in zip(p, alphabet, strict=True) if d in seen)
        unknown = [x for x, d in zip(p, alphabet, strict=True) if d not in seen]
        assert abs(known + unknown[0] - 1) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = {r.doc_id: r for r in identify_language(docs, learn).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == 1000
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rejection_nulls_and_empty_tables(spark):
    rows = [(k, "the cat and the other cat sat with that", "en", 1) for k in range(40)] + [(k, "le chat et la souris que vous avez vue", "fr", 1) for k in range(40, 80)]
    rows += [(90, None, "en", 1), (91, "", None, 1), (92, "123 ...", None, 1), (93, "ЖЩЪЫЭЮЯ ЖЩЪЫЭЮЯ", None, 1), (94, "that cat", None, 1), (94, "that cat", None, 1), (None, "la souris", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = identify_language(docs, F.lit(True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score, by[k].accepted) == ("und", 0.0, False) for k in (90, 91, 92))
    assert by[94].lang_pred == "en" and by[None].lang_pred == "fr" and not by[93].accepted
    assert identify_language(docs.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify_language(docs, F.lit(False)).collect()} == {"und"}


def test_every_language_is_learned_whatever_their_number(spark):
    names = [chr(0x4E00 + 3 * k) * 3 for k in range(420)]
    rows = [(k, f"l{k}", " ".join([x] * 5)) for k, x in enumerate(names)]
    got = identify_language(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: lang for k, lang, _ in rows}


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney of order 4 with dictionaries; returns the probability of a run of four symbols."""
    from collections import Counter, defaultdict

    levels = {4: Counter(g for t in texts for g in runs(t))}
    for n in (3, 2, 1):
        before = defaultdict(set)
        for g in levels[n + 1]:
            before[g[1:]].add(g[0])
        levels[n] = Counter({g: len(s) for g, s in before.items()})
    discount, total, kinds = {}, defaultdict(int), defaultdict(int)
    for n, counts in levels.items():
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        for g, c in counts.items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(levels[1]) + 1)
        if not total[n, g[:-1]]:
            return p(g[1:])
        return (max(levels[n][g] - discount[n], 0) + discount[n] * kinds[n, g[:-1]] * p(g[1:])) / total[n, g[:-1]]

    return p


def runs(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    symbols = [c for k, c in enumerate(letters) if c != " " or (k and letters[k - 1] != " ")]
    return [tuple(([" "] * 3 + symbols)[k : k + 4]) for k in range(len(symbols))]


def test_cross_entropies_equal_a_plain_model():
    import math
    import random

    import numpy as np

    from tessella.llm.language_id import KneserNey, LanguageModel, distinct_grams, symbols

    rng = random.Random(5)
    train = ["".join(rng.choice("aab c dé.") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    asked = [*train[:5], "abcd", "É a é", "zzz qq", "a"]
    values, ptr = symbols(train)
    keys, which = distinct_grams(values, ptr)
    got = LanguageModel({"x": KneserNey(keys, np.bincount(which, minlength=len(keys)))}).entropies(asked)[:, 0]
    p = plain_kneser_ney(train)
    for text, e in zip(asked, got, strict=True):
        assert e == np.float64(e) and abs(e + sum(math.log(p(g)) for g in runs(text)) / len(runs(text))) < 1e-9, text


def test_ties_go_to_the_first_name_and_long_texts_are_read_whole(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["b", "a"] * 20)]
    rows += [(100, "same", None), (101, "same words " * 200_000 + "1" * 1_000_000, None)]
    docs = spark.createDataFrame([(*r, "y", 2.0) for r in rows], "doc_id long, text string, lang string, entropy string, score double")
    got = {r.doc_id: r for r in identify_language(docs, F.lit(True)).collect()}
    assert got[100].lang_pred == "a" and abs(got[100].score - 0.5) < 0.01 and got[101].lang_pred in ("a", "b")
    import numpy as np

    from tessella.llm.language_id import KneserNey, LanguageModel

    same = KneserNey(np.array([1, 2], np.uint64), np.array([3, 1]))
    model = LanguageModel({"b": same, "a": same})
    e = model.entropies(["abc"])
    assert model.names == ["a", "b"] and e[0, 0] == e[0, 1] and e[0].argmin() == 0


def test_letters_beyond_sixteen_bits_are_told_apart(spark):
    rows = [(k, "".join(chr(0x10330 + j) for j in range(8)) + " " + chr(0x10331) * 3, "got") for k in range(30)] + [(k, "".join(chr(0x10400 + j) for j in range(8)) + " " + chr(0x10402) * 3, "dsr") for k in range(30, 60)]
    docs = spark.createDataFrame([*rows, (100, chr(0x10331) * 6, None), (101, chr(0x10402) * 6, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify_language(docs, F.lit(True)).collect()}
    assert (got[100], got[101]) == ("got", "dsr")
