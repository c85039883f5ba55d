import random
import re

import pytest

from tessella.llm import ngram_join as J
from tessella.llm import packing as P
from tessella.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, width=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        if grams(t):
            sets.setdefault(grams(t), []).append(d)
    nodes = list(sets)
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(nodes)
    for a in range(len(nodes)):
        for b in range(a):
            i = len(nodes[a] & nodes[b])
            if i and i >= threshold * (len(nodes[a]) + len(nodes[b]) - i) - 1e-12:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, s in enumerate(nodes):
        least[find(k)] = min(least.get(find(k), 1 << 62), *sets[s])
    index = {s: k for k, s in enumerate(nodes)}
    out = []
    for d, t in rows:
        k = index.get(grams(t))
        out.append((d, d, d, 1, 0) if k is None else (d, min(sets[nodes[k]]), least[find(k)], len(sets[nodes[k]]), links[k]))
    return sorted(out)


def corpus(seed, groups=12, size=8, common=""):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows) * 3, common + " ".join(copy)))
    return rows + [(1, ""), (2, None), (4, "short"), (5, "short")]


def check(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.set_id, r.class_id, r.n_copies, r.n_links) for r in J.ngram_join(docs, **more).collect())
    assert got == brute(rows, more.get("threshold", 0.8))


def test_brute_force(spark):
    check(spark, corpus(1))


def test_large_buckets_are_split_and_chunked(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 5)
    monkeypatch.setattr(J, "CHUNK", 4)
    check(spark, corpus(2, groups=6, size=14, common="a very common line of words on top of all texts\n"))


def test_documents_of_the_test_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_one_row_of_each_class_stays(spark):
    rows = [(5, "a b c d e f", "u"), (3, "a b c d e f", "v"), (3, "a b c d e f", "v"), (9, None, "w"), (8, "", "x"), (None, "p q", "y"), (7, "p q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid string")
    got = sorted((str(r.doc_id), r.sid) for r in J.drop_near_copies(docs).collect())
    assert got == [("3", "v"), ("8", "x"), ("9", "w"), ("None", "y")]
    assert J.drop_near_copies(docs.limit(0)).count() == 0


def test_runs():
    assert J.runs_for(1 - 1e-6, 0.8) == 3 and J.runs_for(0.9, 0.8) == 1


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(k, 0) for k in range(1, 30)] + [(50, 51), (51, 50), (7, 7)]])
def test_components(spark, edges):
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_sets_that_can_be_linked_share_a_size_class():
    for threshold in (0.5, 0.8, 0.95):
        for small in range(1, 400):
            large = int(small / threshold + 1e-9)
            assert set(J.size_classes(small, threshold)) & set(J.size_classes(large, threshold))


def test_chunks_of_large_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_TOKENS", 60)
    check(spark, corpus(3, groups=5, size=9))


def test_the_registered_recall_takes_three_runs():
    from tessella.llm import ngram_join as J

    assert J.RECALL >= 1 - 1e-6 and J.runs_for(J.RECALL, J.THRESHOLD) == 3
    missed = (1 - (1 - (1 - J.THRESHOLD) ** J.FAN) ** J.LEVELS) ** J.runs_for(J.RECALL, J.THRESHOLD)
    assert missed <= 1e-6


def test_shuffles_are_let_go_as_soon_as_they_are_done_with(spark, monkeypatch):
    """After the tokens, the comparisons and the classes are written, not only when the driver next needs memory."""
    steps = []
    for name in ("durable", "release"):
        monkeypatch.setattr(P, name, lambda x, f=getattr(P, name), name=name: (steps.append(name), f(x))[1])
    out = J.ngram_join(spark.createDataFrame([(k, " ".join(f"w{(k // 2 + j) % 50}" for j in range(40))) for k in range(60)], "doc_id long, text string"))
    assert steps.count("release") == 3 and steps[-2:] == ["durable", "release"]
    assert out.count() == 60
