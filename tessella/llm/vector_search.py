"""Nearest neighbours by cosine with additive quantisation.

A unit vector is approximated by a sum of one codeword from each of BOOKS full-dimensional
codebooks. The codebooks start as residual k-means and are then improved by least squares (book by
book, in sweeps) with the codes held fixed. Encoding is a beam search: after each book the BEAM best partial sums go
on. A row of the index is its id, its codes (a byte a book), the norm of the sum and a hash of the vector.

A query makes one table of inner products with all codewords; an index row's approximate cosine
is the sum of its looked-up products over its norm. The queries (a stated subset) meet the whole
index in blocks: every pair of a query block and an index group is one unit, which makes the tables of
its queries itself and returns the RERANK best of each query (ties to the smaller id), packed for each
part of SCAN_QUERIES queries. These are merged part by part, MERGE units at a time, in as many rounds as
it takes, so no task holds more than that. Rows that tie with the last of the RERANK best (near copies
with the same codes) are no better and no worse than it: they go on as rows of their own and meet the
final limit of their query by a join. All these candidates are reranked by the exact cosine of the
original vectors in double precision.

The codebooks are fitted on a bounded sample of about SAMPLE rows, chosen by a hash of the id;
every row is indexed. What is sent to the executors is the codebooks, of fixed size. The index is encoded
without a shuffle; what is shuffled is the vectors once (equal ids), the codes once for each query
block, the queries once for each index group, and RERANK candidates a query with their vectors. Blocks
and groups are as large as leaves PARTS of each, between the bounds QUERY_BLOCK and INDEX_GROUP.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without an id. Vectors of different lengths have no cosine: each length is searched on its own.
Rows with the same id are one; of different vectors the least counts. Of equal vectors that tie with
the last candidate, no more than `k` + 1 go on from a unit, those of the smallest ids. A query is no
candidate of its own. With fewer candidates than `k` all are returned. Empty tables give an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packing as P
from . import textscan as S

BOOKS = 24
WORDS = 256
BEAM = 4
SAMPLE = 8192
ROUNDS = 1
RERANK = 200
PARTS = 12
INDEX_GROUP = (8192, 1 << 18)
QUERY_BLOCK = (256, 2048)
SCAN_ROWS, SCAN_QUERIES = 8192, 32
MERGE = 32


def _assign(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1)[None, :] - 2 * x @ words.T, axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    words = x[rng.permutation(len(x))[:k]]
    words = np.vstack([words, np.zeros((k - len(words), x.shape[1]))]) if len(words) < k else words.copy()
    for _ in range(steps):
        at = _assign(x, words)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        words[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
    return words


class AdditiveQuantiser:
    """books: [BOOKS, WORDS, dimension]."""

    def __init__(self, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        rest, found = x.copy(), []
        for _ in range(books):
            found.append(_k_means(rest, words, rng))
            rest -= found[-1][_assign(rest, found[-1])]
        self.books = np.stack(found)
        for _ in range(rounds):
            self._refit(x, self.encode(x))

    def _refit(self, x: np.ndarray, codes: np.ndarray, sweeps: int = 12, ridge: float = 0.1) -> None:
        """Least squares for all codewords, one book after the other with the rest held, sweep by sweep; so the
        normal equations of all books at once, which take the square of the codewords, are never held. The
        ridge holds codewords that few rows use near where they were."""
        at = codes.astype(np.intp)
        rest = x - self.decode(codes)
        dealt = []
        for m in range(len(self.books)):
            order = np.argsort(at[:, m], kind="stable")
            n = np.bincount(at[:, m], minlength=self.books.shape[1])
            full = np.flatnonzero(n)
            dealt.append((order, n, full, (np.cumsum(n) - n)[full]))
        for _ in range(sweeps):
            for words, own, (order, n, full, begin) in zip(self.books, at.T, dealt, strict=True):
                rest += words[own]
                words[full] = (np.add.reduceat(rest[order], begin, axis=0) + ridge * words[full]) / (n[full, None] + ridge)
                rest -= words[own]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        books = self.books.astype(np.float32)
        m, k, _ = books.shape
        out = np.empty((len(x), m), np.uint8)
        norms = (books**2).sum(axis=2)
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512].astype(np.float32)
            n = len(part)
            rest, codes, cost = part[:, None, :], np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), np.float32)
            for book in range(m):
                # |r - c|^2 = |r|^2 - 2 rc + |c|^2; cost holds |r|^2 up to a constant of the row
                grown = cost[:, :, None] - 2 * rest @ books[book].T + norms[book]
                width = grown.shape[1]
                flat = grown.reshape(n, width * k)
                keep = min(beam if book < m - 1 else 1, width * k)
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, word = best // k, best % k
                cost = np.take_along_axis(flat, best, axis=1)
                rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - books[book][word]
                codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            out[lo : lo + n] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def approximate(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Approximate cosines of all queries and rows. tables: [queries, books, words]."""
    out = np.empty((len(tables), len(codes)), np.float32)
    for lo in range(0, len(codes), SCAN_ROWS):
        part = codes[lo : lo + SCAN_ROWS].T.astype(np.intp)
        s = tables[:, 0].take(part[0], axis=1)
        for m in range(1, len(part)):
            s += tables[:, m].take(part[m], axis=1)
        out[:, lo : lo + SCAN_ROWS] = s / norms[lo : lo + SCAN_ROWS]
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the `keep` best of these rows lie, and the other rows that tie with the last of them. ids must
    ascend, so that the first of a tie are those of the smallest ids; -inf stands for no row."""
    there = int((scores > -np.inf).sum())
    if there <= keep:
        return np.flatnonzero(scores > -np.inf), np.zeros(0, np.int64)
    limit = np.partition(scores, len(scores) - keep)[len(scores) - keep]
    above, level = np.flatnonzero(scores > limit), np.flatnonzero(scores == limit)
    return np.concatenate([above, level[: keep - len(above)]]), level[keep - len(above) :]


def few_of_each(values: np.ndarray, most: int) -> np.ndarray:
    """The places of the first `most` of each value."""
    order = np.argsort(values, kind="stable")
    begin = P.run_starts(values[order])
    number = np.arange(len(values)) - np.repeat(begin, np.diff(begin, append=len(values)))
    return np.sort(order[number < most])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (the vector) of the rows that take part."""
    limit = F.lit(float("inf"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).groupBy("id").agg(F.min("v").alias("v"))


_INDEX = "grp int, ids binary, codes binary, norms binary, prints binary"
_FOUND = "part int, grp int, ids binary, sizes binary, found binary, scores binary, query_id long, vec_id long, score float"
_TIED = "query_id long, vec_id long, score float"


def _encode(sent, groups: int):
    """Packed index rows of a few thousand vectors each, dealt to the groups."""
    schema = P.arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in P.column_batches(batches):
            ids = batch.column("id").to_numpy().astype("<i8")
            codes = sent.value.encode(_unit(_matrix(batch.column("v"))))
            norms = np.maximum(np.sqrt((sent.value.decode(codes) ** 2).sum(axis=1)), 1e-9).astype("<f4")
            prints = batch.column("print").to_numpy().astype("<i8")
            for lo in range(0, len(ids), INDEX_GROUP[0]):
                part = slice(lo, lo + INDEX_GROUP[0])
                grp = int(S.mix(ids[part][:1].view(np.uint64))[0] % np.uint64(groups))
                yield P.frames(schema, {"grp": [grp], "ids": [ids[part].tobytes()], "codes": [codes[part].tobytes()], "norms": [norms[part].tobytes()], "prints": [prints[part].tobytes()]})

    return run


def _found_rows(out: dict[str, list], part: int, grp: int, own: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """One packed row: for each query (`own`) its best ids and scores."""
    none = dict.fromkeys(out)
    packed = {"ids": own.astype("<i8"), "sizes": np.array([len(i) for i, _ in best], "<i4"), "found": np.concatenate([i for i, _ in best]).astype("<i8"), "scores": np.concatenate([s for _, s in best]).astype("<f4")}
    for name, value in (none | {"part": part, "grp": grp} | {k: x.tobytes() for k, x in packed.items()}).items():
        out[name].append(value)


def _tied_rows(out: dict[str, list], query: int, ids: np.ndarray, scores: np.ndarray) -> None:
    for name in out:
        out[name] += {"query_id": [query] * len(ids), "vec_id": ids.tolist(), "score": scores.tolist()}.get(name) or [None] * len(ids)


def _search(sent, keep: int, k: int):
    """The best rows of an index group for each query of a block."""
    schema = P.arrow_schema(_FOUND)

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in schema.names}
        if index.num_rows and queries.num_rows:
            ids, norms, prints = (np.concatenate([np.frombuffer(x, t) for x in index.column(c).to_pylist()]) for c, t in (("ids", "<i8"), ("norms", "<f4"), ("prints", "<i8")))
            codes = np.concatenate([np.frombuffer(x, np.uint8) for x in index.column("codes").to_pylist()]).reshape(len(ids), -1)
            order = np.argsort(ids)
            ids, norms, prints, codes = ids[order], norms[order], prints[order], codes[order]
            queries = queries.sort_by([("part", "ascending"), ("id", "ascending")])
            own, parts, x = queries.column("id").to_numpy(), queries.column("part").to_numpy(), _unit(_matrix(queries.column("v")))
            cuts = [*P.run_starts(parts).tolist(), len(parts)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                best = []
                for lo in range(a, z, SCAN_QUERIES):
                    some = slice(lo, min(lo + SCAN_QUERIES, z))
                    tables = np.einsum("mkd,qd->qmk", sent.value.books, x[some], optimize=True).astype(np.float32)
                    for query, scores in zip(own[some].tolist(), approximate(tables, codes, norms), strict=True):
                        scores[ids == query] = -np.inf
                        at, tied = best_of(ids, scores, keep)
                        best.append((ids[at], scores[at]))
                        tied = tied[few_of_each(prints[tied], k + 1)]
                        _tied_rows(out, query, ids[tied], scores[tied])
                _found_rows(out, int(parts[a]), index.column("grp")[0].as_py(), own[a:z], best)
        return pa.Table.from_batches([P.frames(schema, out)])

    return run


def _merge(keep: int):
    """The best of several units for the queries of one part."""
    schema = P.arrow_schema(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = np.frombuffer(rows[0]["ids"], "<i8")
        cuts = [np.concatenate(([0], np.cumsum(np.frombuffer(r["sizes"], "<i4")))) for r in rows]
        ids, scores = ([np.frombuffer(r[c], t) for r in rows] for c, t in (("found", "<i8"), ("scores", "<f4")))
        out: dict[str, list] = {name: [] for name in schema.names}
        best = []
        for q, query in enumerate(own.tolist()):
            i, s = (np.concatenate([x[c[q] : c[q + 1]] for x, c in zip(of, cuts, strict=True)]) for of in (ids, scores))
            order = np.argsort(i)
            i, s = i[order], s[order]
            at, tied = best_of(i, s, keep)
            best.append((i[at], s[at]))
            _tied_rows(out, query, i[tied], s[tied])
        _found_rows(out, rows[0]["part"], rows[0]["grp"], own, best)
        return pa.Table.from_batches([P.frames(schema, out)])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that a merged part stands for."""
    for batch in P.column_batches(batches):
        for r in batch.to_pylist():
            own, sizes = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i4")
            columns = [np.repeat(own, sizes), np.frombuffer(r["found"], "<i8"), np.frombuffer(r["scores"], "<f4")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=P.arrow_schema(_TIED))


def _shortlists(rows: DataFrame, queries: DataFrame, k: int, rerank: int, sample: int, books: int) -> DataFrame:
    """query_id and vec_id of the candidates, from rows (id, v) and queries of them, all of one length."""
    spark = rows.sparkSession
    total, asked = rows.count(), queries.count()
    pick = F.pmod(F.xxhash64(F.lit(17), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where(pick < min(1.0, sample / total)).orderBy("id").select("v").toArrow()
    taken = taken if taken.num_rows else rows.orderBy("id").limit(1).select("v").toArrow()
    sent = spark.sparkContext.broadcast(AdditiveQuantiser(_unit(_matrix(taken.column("v"))), books))
    size = lambda n, bounds: min(max(-(-n // PARTS), bounds[0]), bounds[1])
    groups, blocks, parts = -(-total // size(total, INDEX_GROUP)), -(-asked // size(asked, QUERY_BLOCK)), -(-asked // SCAN_QUERIES)
    index = P.durable(rows.withColumn("print", F.xxhash64("v")).mapInArrow(_encode(sent, groups), _INDEX))
    part = F.pmod(F.xxhash64(F.lit(19), F.col("id")), F.lit(parts)).cast("int")
    dealt = queries.withColumn("part", part).withColumn("block", F.col("part") % blocks)
    # every pair of a query block and an index group is one unit
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = dealt.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = P.durable(left.groupBy("block", "grp").cogroup(right.groupBy("block", "grp")).applyInArrow(_search(sent, rerank, k), _FOUND))
    tied = found.where("query_id IS NOT NULL")
    best = found.where("query_id IS NULL")
    while groups > 1:
        groups = -(-groups // MERGE)
        merged = P.durable(best.withColumn("grp", F.col("grp") % groups).groupBy("part", "grp").applyInArrow(_merge(rerank), _FOUND))
        tied, best = tied.unionByName(merged.where("query_id IS NOT NULL")), merged.where("query_id IS NULL")
    near = best.mapInArrow(_candidates, _TIED)
    limits = near.groupBy("query_id").agg(F.min("score").alias("limit"))
    more = tied.select("query_id", "vec_id", "score").join(limits, "query_id").where("score = limit")
    return near.select("query_id", "vec_id").unionByName(more.select("query_id", "vec_id"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, rerank: int = RERANK, sample: int = SAMPLE, books: int = BOOKS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (exact cosine) of the k nearest of each query.

    is_query: a condition on the key column, by its name."""
    spark = vectors.sparkSession
    rows = P.durable(usable(vectors, key, vector))
    queries = rows.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    near = spark.createDataFrame([], "query_id long, vec_id long")
    for r in sorted(queries.select(F.size("v").alias("n")).distinct().collect()):
        same = F.size("v") == r.n
        near = near.unionByName(_shortlists(rows.where(same), queries.where(same), k, rerank, sample, books))
    return exact_best(near, rows, k)


def exact_best(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best of the pairs of each query by the exact cosine, ties to the smaller id."""
    add = lambda v, f: F.aggregate(v, F.lit(0.0), f)
    # scaled by a power of two, which changes no cosine, so that no square overflows or vanishes
    scale = F.pow(F.lit(2.0), -F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))))
    doubles = lambda v, s: F.transform(v, lambda x: x.cast("double") * s)
    measured = rows.select("id", "v", scale.alias("scale"))
    measured = measured.withColumn("norm", F.sqrt(add(doubles("v", F.col("scale")), lambda a, x: a + x * x)))
    a = measured.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("scale").alias("qs"), F.col("norm").alias("qn"))
    b = measured.select(F.col("id").alias("vec_id"), "v", "scale", "norm")
    products = F.zip_with("qv", "v", lambda x, y: (x.cast("double") * F.col("qs")) * (y.cast("double") * F.col("scale")))
    met = pairs.join(a, "query_id").join(b, "vec_id")
    scored = met.select("query_id", "vec_id", (add(products, lambda s, x: s + x) / (F.col("qn") * F.col("norm"))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
