"""Tokens, the inverted index and tier-1 retrieval, as plans over many queries at once.

An index is built and written once, as blocks of documents: the tokens of a block, and for each the places of its
documents in two bytes each. A posting is never a row, neither in a shuffle nor on disk. Retrieval reads each block of
queries with every block of documents, without a shuffle of either; one task holds a block of queries and their best
documents so far, adds up the masses of a query over a block of documents in an array, and returns the best only. A
token of up to a quarter of all documents costs its entries in each block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import config as C
from tessella.checkpoints import durable, release
from tessella.functions.geometry import cells, size_bucket
from tessella.functions.text import norm_label

#: Documents and queries of a block, at most; a block of documents has under 2**16, their places being two bytes.
DOC_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 8192, 6144, 64
#: Where all scores are asked, in place of the best: queries of a block, and rows a task returns, about, if pairs of blocks allow.
ALL_QUERIES, ALL_ROWS = 512, 2**24
#: Rows of bytes, at most; queries of a block that ask a token with a row, at least; steps of a row. Tokens without a row
#: are added for TOGETHER queries at once.
ROWS, LEAST_ASKED, STEPS, TOGETHER = 8192, 4, 24, 32
#: A number for each token of each block goes to every executor up to so many, else the blocks are shuffled to theirs.
SENT = 16_000_000
#: Tokens that go to every executor with their idf, at most.
SENT_TOKENS = 500_000


def _token(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def grid_tokens(buttons: DataFrame, key: str = "doc") -> DataFrame:
    """key and token: position, colour, size and label tokens of each button, once for each document."""
    colour, size, label = F.coalesce("color", F.lit("grey")), size_bucket(F.coalesce("w", F.lit(0.0))), norm_label(F.col("label"))
    rows = buttons.select(key, colour.alias("c"), size.alias("s"), label.alias("l"), F.explode(cells(F.col("x"), C.GRID_X)).alias("cx"), cells(F.col("y"), C.GRID_Y).alias("cys"))
    rows = rows.select(key, "c", "s", "l", "cx", F.explode("cys").alias("cy"))
    x, y, c, s, l = (F.col(k) for k in ("cx", "cy", "c", "s", "l"))
    made = F.array(
        _token("G", x, y, c, s),
        _token("Gc", x, y, c),
        _token("Gs", x, y, s),
        F.when(l.isNotNull(), _token("L", x, y, l)),
        F.when(l.isNotNull(), _token("LT", l)),
    )
    return rows.select(key, F.explode(made).alias("token")).where("token IS NOT NULL").distinct()


def triplet_tokens(buttons: DataFrame, key: str = "rid") -> DataFrame:
    """key and token: for each button the pairs of its nearest neighbours, by distance ratio, angle and
    colours; documents with 3 to TRIPLET_MAX_BUTTONS buttons only. All joins stay inside a document."""
    n = F.count("*").over(Window.partitionBy(key))
    b = buttons.select(key, "pos", "x", "y", "color", n.alias("n")).where((F.col("n") >= 3) & (F.col("n") <= C.TRIPLET_MAX_BUTTONS)).drop("n")
    other = b.select(key, *[F.col(c).alias(f"{c}_o") for c in ("pos", "x", "y", "color")])
    dx, dy = F.col("x_o") - F.col("x"), F.col("y_o") - F.col("y")
    near = b.join(other, key).where("pos <> pos_o").withColumns({"dx": dx, "dy": dy, "d": F.sqrt(dx * dx + dy * dy)})
    rank = F.row_number().over(Window.partitionBy(key, "pos").orderBy("d", "pos_o"))
    near = near.withColumn("r", rank).where((F.col("r") <= C.TRIPLET_K) & (F.col("d") >= 1e-9))
    around = F.sort_array(F.collect_list(F.struct("r", "dx", "dy", "d", F.col("color_o").alias("c"))))
    fans = near.groupBy(key, "pos", "color").agg(around.alias("a"))
    pairs = F.flatten(F.transform("a", lambda p: F.transform(F.filter("a", lambda q: q["r"] > p["r"]), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    t = fans.select(key, "color", F.explode(pairs).alias("t")).select(key, "color", "t.p", "t.q")
    cosine = (F.col("p.dx") * F.col("q.dx") + F.col("p.dy") * F.col("q.dy")) / (F.col("p.d") * F.col("q.d"))
    angle = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    ratio = F.floor(10 * F.least("p.d", "q.d") / F.greatest("p.d", "q.d") + 0.5)
    token = _token("T", ratio, F.floor(angle / C.TRIPLET_ANGLE + 0.5), F.col("color"), F.least("p.c", "q.c"), F.greatest("p.c", "q.c"))
    return t.select(key, token.alias("token")).distinct()


def token_stats(tokens: DataFrame, n_docs: int | Column) -> DataFrame:
    """token, df and idf = max(ln(n_docs / df), 1e-6)."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return tokens.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.greatest(F.log(n / F.col("df")), F.lit(1e-6)))


def usable_tokens(stats: DataFrame, n_docs: int) -> DataFrame:
    """Tokens that queries use: informative, and in a large index not too common."""
    out = stats.where(F.col("idf") >= C.MIN_IDF)
    return out.where(F.col("df") <= int(C.MAX_DF_FRACTION * n_docs)) if n_docs >= C.DF_MIN_DOCS else out


_BLOCK = "block long, docs array<long>, tokens array<string>, sizes array<int>, places binary"
_NULL = -(2**63)


def _distinct(token: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by token and then doc."""
    key = np.sort(token * n + doc)
    key = key[np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1])]
    return key // n, key % n


def _block_of(rows: pa.Table) -> pa.RecordBatch:
    """One block from the buttons of its documents: the tokens of grid_tokens(), each with the places of its documents."""
    rows = rows.combine_chunks()
    number = lambda name, none: pc.fill_null(rows.column(name), none).to_numpy().astype(np.int64)
    ids, doc = np.unique(number("doc", _NULL), return_inverse=True)
    coded, texts = {}, {}
    for name in ("c", "l"):
        column = rows.column(name).combine_chunks().dictionary_encode()
        coded[name], texts[name] = column.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary.to_pylist()
    x, y = ((number(f"{v}0", -1), number(f"{v}1", -2)) for v in "xy")  # -1: null, -2: no second cell
    held = [(np.flatnonzero((a > -2) & (b > -2)), a, b) for a in x for b in y]
    at = np.concatenate([k for k, _, _ in held])
    cx, cy = np.concatenate([a[k] for k, a, _ in held]) + 1, np.concatenate([b[k] for k, _, b in held]) + 1
    high, colours, labels = int(cy.max()) + 1, len(texts["c"]), len(texts["l"])
    cell, c, s, l, doc = cx * high + cy, coded["c"][at], number("s", 0)[at], coded["l"][at], doc[at]
    said = l >= 0
    kinds = (
        ("G", (cell * colours + c) * 3 + s, doc, ("cell", "c", "s")),
        ("Gc", cell * colours + c, doc, ("cell", "c")),
        ("Gs", cell * 3 + s, doc, ("cell", "s")),
        ("L", (cell * labels + l)[said], doc[said], ("cell", "l")),
        ("LT", l[said], doc[said], ("l",)),
    )
    tokens, owners, of = [], [], []
    for kind, code, d, parts in kinds:
        code, d = _distinct(code, d, len(ids))
        values, sizes = np.unique(code, return_counts=True)
        of.append(np.repeat(np.arange(len(values)) + len(tokens), sizes))
        owners.append(d)
        columns = []
        for part in reversed(parts):
            if part == "cell":
                columns += [[str(k - 1) if k else None for k in ks.tolist()] for ks in (values % high, values // high)]
            else:
                base = {"c": colours, "s": 3, "l": labels}[part]
                values, k = values // base, (values % base).tolist()
                columns.append([str(v) for v in k] if part == "s" else [texts[part][v] for v in k])
        tokens += ["|".join([kind, *[v for v in row if v is not None]]) for row in zip(*reversed(columns), strict=True)]
    of, owners = np.concatenate(of), np.concatenate(owners)
    known = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
    if len(known) < len(tokens):  # different parts, one text
        of, owners = _distinct(np.array([known[t] for t in tokens])[of], owners, len(ids))
    docs = pa.array([ids], pa.list_(pa.int64())) if ids[0] != _NULL else pa.array([[None, *ids[1:].tolist()]], pa.list_(pa.int64()))
    sizes = np.bincount(of, minlength=len(known)).astype(np.int32)
    columns = [pa.array([int(ids[-1])]), docs, pa.array([list(known)], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())), pa.array([owners.astype("<u2").tobytes()])]
    return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "tokens", "sizes", "places"])


def _make_blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of up to `most` documents (one record at least) from buttons in the order of their records, full ones but
    for the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last, two = [], 0, None, False  # two: whether the record at hand has a turned document
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = pc.fill_null(batch.column("doc"), _NULL).to_numpy()
            record = doc // 2
            new = np.flatnonzero(np.append(last is None or record[0] != last, record[1:] != record[:-1]))
            turned = np.logical_or.reduceat(doc % 2 == 1, new) if len(new) else new
            if not two and (doc[: new[0] if len(new) else None] % 2 == 1).any():  # of the record that began in the batch before
                n, two = n + 1, True
            last, start = record[-1], 0
            for k, two in zip(new.tolist(), turned.tolist(), strict=True):
                if n and n + 2 > most:  # a record has two documents at most
                    held.append(batch.slice(start, k - start))
                    yield _block_of(pa.Table.from_batches(held))
                    held, n, start = [], 0, k
                n += 1 + two
            held.append(batch.slice(start))
        if held:
            yield _block_of(pa.Table.from_batches(held))

    return run


def _add_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The norm of each document of a block: the idf of all its tokens, also those that queries skip."""
    for batch in batches:
        for row in range(batch.num_rows):
            docs, sizes, idfs = (batch.column(k)[row].values for k in ("docs", "sizes", "idfs"))
            places = np.frombuffer(batch.column("places")[row].as_buffer(), "<u2")
            norms = np.bincount(places, np.repeat(idfs.to_numpy(), sizes.to_numpy()), len(docs))
            yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), batch.column("docs").slice(row, 1), pa.array([np.maximum(norms, 1e-6)])], names=["block", "docs", "norms"])


_MASSES = "qid {kind}, doc long, mass double"
_SCORED = _MASSES + ", score double"


def _first(values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind; negative ones always are."""
    out = values < 0
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _by_document(tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The tokens, of 32 bits at most, in the order of their documents; alters its first argument."""
    tokens |= places.astype(np.int64) << 32
    tokens.sort()
    return tokens.astype(np.int32)


class _Queries:
    """A block of queries, and of each the best documents so far.

    A grid token of cell, colour and size comes with that of its cell and colour and that of its cell and size. Where
    enough queries ask such a token, one row of bytes holds what the three add to each document of a block, in steps and
    rounded up. The sum of a query's rows, with the idf of its other tokens, is at least the mass of a document, so that
    exact masses are needed only of those whose sum reaches the least of the best."""

    def __init__(self, rows: pa.StructArray, most: int | None, triples: np.ndarray, scored: bool = True) -> None:
        self.most, self.qid, self.scored = most, rows.field("qid"), scored
        self.root = np.sqrt(rows.field("q_mass").to_numpy())
        held = rows.field("tokens")
        self.vocabulary, wanted = np.unique(held.flatten().to_numpy(), return_inverse=True)
        self.ends = np.cumsum(pc.list_value_length(held).to_numpy())[:-1]
        idf = rows.field("idfs").flatten().to_numpy()
        self.wanted, self.idf = np.split(wanted, self.ends), np.split(idf, self.ends)
        none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.best = [none] * len(rows)  # doc, mass, score
        self.least = np.full(len(rows), -1.0)
        if most is not None:
            self.weight = np.zeros(len(self.vocabulary) + 1)
            self.weight[wanted] = idf
            self._choose_rows(wanted, triples)

    def _choose_rows(self, wanted: np.ndarray, triples: np.ndarray) -> None:
        """parts: the tokens of each row, -1: none; chosen and others: the rows and other tokens of each query."""
        at = np.minimum(np.searchsorted(self.vocabulary, triples), len(self.vocabulary) - 1)
        at = np.where(self.vocabulary[at] == triples, at, -1)
        asked = np.bincount(wanted, minlength=len(self.vocabulary))
        self.parts = at[(at[:, 0] >= 0) & (asked[at[:, 0]] >= LEAST_ASKED)]
        row_of = np.full(len(self.vocabulary), -1)
        row_of[self.parts[:, 0]] = np.arange(len(self.parts))
        tops = np.where(self.parts >= 0, self.weight[self.parts], 0.0).sum(1)
        # of some steps, that by which rounding up adds the least
        used, often = np.unique(self.parts[self.parts >= 0], return_counts=True)
        steps = (tops.max() if len(tops) else 1.0) / np.linspace(STEPS - 4, STEPS, 33)
        self.step = min(steps.tolist(), key=lambda s: (np.ceil(self.weight[used] / s) * s - self.weight[used]) @ (often * np.exp(-self.weight[used])))
        has = np.zeros(len(self.vocabulary) + 1, bool)
        has[-1] = True  # a part that no query can ask
        self.chosen, self.others = [], []
        for tokens in self.wanted:
            has[tokens] = True
            rows = row_of[tokens]
            rows = rows[rows >= 0]
            rows = rows[has[self.parts[rows, 1]] & has[self.parts[rows, 2]]]
            rows = rows[_first(self.parts[rows, 1])]
            rows = rows[_first(self.parts[rows, 2])]
            has[self.parts[rows].ravel()] = False
            self.others.append(tokens[has[tokens]])
            has[tokens], has[-1] = False, True
            self.chosen.append(rows.tolist())

    def meet(self, docs: np.ndarray, norms: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, places: np.ndarray, known: np.ndarray, scratch: list[np.ndarray]) -> Iterator[tuple]:
        """Adds a block of documents; without `most`, yields its masses and, if asked, scores. known: whether a document has
        an id; scratch: room for rows, kept between calls."""
        order = np.argsort(hashes)
        at = order[np.minimum(np.searchsorted(hashes, self.vocabulary, sorter=order), len(hashes) - 1)]
        stops, there = np.cumsum(sizes), hashes[at] == self.vocabulary
        stop, start = np.where(there, stops[at], 0), np.where(there, stops[at] - sizes[at], 0)
        lengths = stop - start
        root, inverse = np.sqrt(norms), known / np.sqrt(norms)
        if self.most is not None:
            kind = np.full(len(hashes), len(self.vocabulary), np.int64)
            kind[at[there]] = np.flatnonzero(there)
            self._best_of(docs, root, inverse, places, start, lengths, _by_document(np.repeat(kind, sizes), places), np.cumsum(np.bincount(places, minlength=len(docs))), scratch)
            return
        postings = [places[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        for k, (wanted, idf) in enumerate(zip(self.wanted, self.idf, strict=True)):
            mass = np.bincount(np.concatenate([postings[t] for t in wanted.tolist()]), np.repeat(idf, lengths[wanted]), len(docs))
            found = np.flatnonzero(mass * inverse > 0)
            if len(found):
                some = mass[found]
                yield k, docs[found], some, *([self._score(some, root[found], k)] if self.scored else [])

    def _score(self, mass: np.ndarray, root: np.ndarray, k: int) -> np.ndarray:
        return np.round(np.minimum(mass / (root * self.root[k]), 1.0), 9)

    def _rows(self, places: np.ndarray, start: np.ndarray, lengths: np.ndarray, n: int, scratch: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
        """The rows over n documents, and how many of them a byte can add up."""
        if not scratch or scratch[0].size < len(self.parts) * n:
            scratch[:] = [np.empty(len(self.parts) * n, np.uint8)]
        rows = scratch[0][: len(self.parts) * n].reshape(len(self.parts), n)
        rows[:] = 0
        steps = np.ceil(self.weight / self.step).astype(np.uint8)
        low, high = start.tolist(), (start + lengths).tolist()
        for row, parts in zip(rows, self.parts.tolist(), strict=True):
            for t in parts:
                if t >= 0:
                    row[places[low[t] : high[t]]] += steps[t]  # a document is in a posting list once
        most = np.where(self.parts >= 0, steps[self.parts], 0).sum(1)
        return list(rows), 255 // max(1, int(most.max(initial=0)))

    def _of_others(self, first: int, places: np.ndarray, start: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
        """What tokens without a row add to each of n documents, in steps, for TOGETHER queries from the first on."""
        others = self.others[first : first + TOGETHER]
        tokens = np.concatenate(others)
        sizes = lengths[tokens]
        at = np.arange(sizes.sum()) + np.repeat(start[tokens] - (np.cumsum(sizes) - sizes), sizes)
        of = np.repeat(np.repeat(np.arange(len(others)) * n, [len(o) for o in others]), sizes)
        return np.bincount(places[at] + of, np.repeat(self.weight[tokens] / self.step, sizes), len(others) * n).astype(np.float64, copy=False).reshape(-1, n)

    def _best_of(self, docs: np.ndarray, root: np.ndarray, inverse: np.ndarray, places: np.ndarray, start: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, ends: np.ndarray, scratch: list[np.ndarray]) -> None:
        """places: of the tokens, start and lengths those of each token asked; tokens: of the documents, one document after
        the other up to its end."""
        n = len(docs)
        rows, together = self._rows(places, start, lengths, n, scratch)
        small, starts = np.empty(n, np.uint8), np.append(0, ends[:-1])
        weight = np.zeros(len(self.weight))
        low, high = starts.tolist(), ends.tolist()

        def exact(of: np.ndarray) -> np.ndarray:
            flat = [tokens[low[d] : high[d]] for d in of.tolist()]
            at = np.append(0, np.cumsum(ends[of] - starts[of])[:-1])
            return np.add.reduceat(weight[np.concatenate(flat)], at)  # every document has a token

        for k, (wanted, idf, chosen) in enumerate(zip(self.wanted, self.idf, self.chosen, strict=True)):
            if k % TOGETHER == 0:
                bounds = self._of_others(k, places, start, lengths, n)
            bound, total = bounds[k % TOGETHER], None
            for first in range(0, len(chosen), together):
                part = chosen[first : first + together]
                if len(part) == 1:
                    np.copyto(small, rows[part[0]])
                else:
                    np.add(rows[part[0]], rows[part[1]], small)
                    for row in part[2:]:
                        np.add(small, rows[row], small)
                if total is None:
                    total = small.astype(np.uint32 if len(chosen) > 250 else np.uint16)
                else:
                    np.add(total, small, total)
            if total is not None:
                np.add(bound, total, bound)
            np.multiply(bound, inverse, bound)  # at least score * root of q_mass / step
            scale = self.root[k] / self.step
            weight[wanted] = idf
            least = self.least[k]
            if least < 0 and n > self.most:  # the least exact score of as many documents will do
                some = np.argpartition(bound, n - self.most)[n - self.most :]
                least = self._score(exact(some), root[some], k).min() if bound[some].min() > 0 else 0.0
            found = np.flatnonzero(bound >= (min(least, 1.0) - 4e-9) * scale) if least > 0 else np.flatnonzero(bound > 0)
            if len(found):
                mass = exact(found)
                score = self._score(mass, root[found], k)
                good = (mass > 0) & (score >= least)
                self._add(k, docs[found[good]], mass[good], score[good])
            weight[wanted] = 0

    def _add(self, k: int, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        doc, mass, score = (np.concatenate(x) for x in zip(self.best[k], new, strict=True))
        if len(doc) > self.most + (self.most // 4 if self.least[k] >= 0 else 0):
            doc, mass, score = self._cut(doc, mass, score)
            self.least[k] = score[-1]
        self.best[k] = doc, mass, score

    def _cut(self, doc: np.ndarray, mass: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = np.lexsort((doc, -score))[: self.most]
        return doc[chosen], mass[chosen], score[chosen]

    def batch(self, found: list[tuple]) -> pa.RecordBatch:
        rows = np.repeat([k for k, *_ in found], [len(x[1]) for x in found])
        columns = [np.concatenate(x) for x in list(zip(*found, strict=True))[1:]]
        return pa.RecordBatch.from_arrays([self.qid.take(pa.array(rows)), *map(pa.array, columns)], names=["qid", "doc", "mass", "score"][: 1 + len(columns)])

    def rest(self) -> Iterator[pa.RecordBatch]:
        found = [(k, *self._cut(*x)) for k, x in enumerate(self.best) if len(x[0])]
        if found:
            yield self.batch(found)


def _score_blocks(most: int | None, triples: np.ndarray, scored: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The masses and, if asked, scores of blocks of queries over blocks of documents; with `most`, the best of each query of
    all blocks that one task meets, or more. A few blocks of queries are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Queries] = {}
        scratch: list[np.ndarray] = []
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column("qb")[row].as_py()
                if at not in held:
                    if len(held) == 4:
                        yield from held.pop(next(iter(held))).rest()
                    held[at] = _Queries(batch.column("queries")[row].values, most, triples, scored)
                docs, norms, hashes, sizes = (batch.column(k)[row].values for k in ("docs", "norms", "hashes", "sizes"))
                places = np.frombuffer(batch.column("places")[row].as_buffer(), "<u2")
                known, ids = docs.is_valid().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                some, n = [], 0
                for found in held[at].meet(ids, norms.to_numpy(), hashes.to_numpy(), sizes.to_numpy(), places, known, scratch):
                    some.append(found)
                    n += len(found[1])
                    if n > 1_000_000:
                        yield held[at].batch(some)
                        some, n = [], 0
                if some:
                    yield held[at].batch(some)
        for queries in held.values():
            yield from queries.rest()

    return run


def record_of(kind: str) -> dict[str, Column]:
    """rid, of type kind, and flipped from doc."""
    return {"rid": F.expr("doc div 2").cast(kind), "flipped": F.col("doc") % 2 == 1}


def top_records(scored: DataFrame, kind: str, top_n: int = C.TOP_N) -> DataFrame:
    """qid, rid (of type kind), flipped, score and rk: the best 2 * top_n documents, the best of each record, then top_n."""
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    cut = scored.select("qid", "doc", "score").withColumn("r", first).where(F.col("r") <= 2 * top_n).withColumns(record_of(kind))
    best = F.row_number().over(Window.partitionBy("qid", "rid").orderBy(F.desc("score"), "flipped"))
    cut = cut.withColumn("b", best).where("b = 1")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rid"))
    return cut.withColumn("rk", rank).where(F.col("rk") <= top_n).select("qid", "rid", "flipped", "score", "rk")


def index_documents(buttons: DataFrame, ambiguous: Column) -> DataFrame:
    """buttons with doc = 2 * rid for the upright document; records with an open orientation get a
    second, turned one, 2 * rid + 1."""
    ways = F.when(ambiguous, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = buttons.withColumn("flipped", F.explode(ways))
    turned = lambda v: F.when(F.col("flipped"), 1 - F.col(v)).otherwise(F.col(v))
    return both.withColumns({"x": turned("x"), "y": turned("y"), "doc": F.col("rid") * 2 + F.col("flipped").cast("int")})


class TokenIndex:
    """buttons has size, the size bucket, or w. Tables of an index, written when it is made: blocks (tokens and postings of some thousand documents), stats, and
    sums, the norms of the documents of each block. tokens, docs and norms are rows read from these."""

    def __init__(self, buttons: DataFrame, ambiguous: Column) -> None:
        self.kind = buttons.schema["rid"].dataType.simpleString()
        size = F.col("size") if "size" in buttons.columns else size_bucket(F.coalesce("w", F.lit(0.0)))
        parts = buttons.select("rid", "x", "y", F.coalesce("color", F.lit("grey")).alias("c"), size.alias("s"), norm_label(F.col("label")).alias("l"))
        spark = buttons.sparkSession
        tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # fewer, so that blocks are full
        placed = index_documents(parts.repartition("rid").sortWithinPartitions("rid").coalesce(tasks), ambiguous)
        placed = placed.select("doc", "c", "s", "l", cells(F.col("x"), C.GRID_X).alias("xs"), cells(F.col("y"), C.GRID_Y).alias("ys"))
        cell = [F.get(F.col(f"{v}s"), F.lit(k)).alias(f"{v}{k}") for v in "xy" for k in (0, 1)]
        self.blocks = durable(placed.select("doc", "c", "s", "l", *cell).mapInArrow(_make_blocks(min(DOC_BLOCK, 2**16 - 2)), _BLOCK))
        sizes = self.blocks.agg(F.sum(F.size("docs")).alias("docs"), F.sum(F.size("tokens")).alias("tokens")).first()
        self.n_docs, self.sent = sizes["docs"] or 0, (sizes["tokens"] or 0) <= SENT
        sized = self.blocks.select(F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("sizes").alias("n"))))
        counted = sized.groupBy("token").agg(F.sum("n").alias("df"))
        self.stats = durable(counted.withColumn("idf", F.greatest(F.log(F.lit(self.n_docs) / F.col("df")), F.lit(1e-6))))
        of = self.blocks.select("block", F.posexplode("tokens").alias("k", "token")).join(self.stats.select("token", "idf"), "token")
        idfs = of.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "idf"))).alias("a")).select("block", F.col("a.idf").alias("idfs"))
        self.sums = durable(self._by_block(idfs).select("block", "docs", "sizes", "places", "idfs").mapInArrow(_add_norms, "block long, docs array<long>, norms array<double>"))
        release(self.blocks.sparkSession)

    def _by_block(self, other: DataFrame) -> DataFrame:
        return self.blocks.join(F.broadcast(other) if self.sent else other, "block")

    def readable(self) -> bool:
        """Whether the files of its tables are still there."""
        try:
            return all(t.limit(1).count() >= 0 for t in (self.blocks, self.stats, self.sums))
        except Exception:  # Spark's error for lost files differs by the place that meets it
            return False

    @property
    def tokens(self) -> DataFrame:
        """doc and token."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    docs, tokens, sizes = (batch.column(k)[row].values for k in ("docs", "tokens", "sizes"))
                    of = np.repeat(np.arange(len(tokens)), sizes.to_numpy())
                    places = np.frombuffer(batch.column("places")[row].as_buffer(), "<u2")
                    for k in range(0, len(of), 100_000):
                        part = slice(k, k + 100_000)
                        yield pa.RecordBatch.from_arrays([docs.take(pa.array(places[part])), tokens.take(pa.array(of[part]))], names=["doc", "token"])

        return self.blocks.mapInArrow(run, "doc long, token string")

    @property
    def docs(self) -> DataFrame:
        """doc, rid and flipped; every button has a token, so no document is missing."""
        return self.sums.select(F.explode("docs").alias("doc")).withColumns(record_of(self.kind))

    @property
    def norms(self) -> DataFrame:
        return self.sums.select(F.inline(F.arrays_zip(F.col("docs").alias("doc"), F.col("norms").alias("norm"))))

    def usable(self) -> DataFrame:
        return usable_tokens(self.stats, self.n_docs)

    def _triples(self) -> np.ndarray:
        """Hashes of the most frequent tokens of a cell, colour and size, and of the two tokens that come with each."""
        grid = self.usable().where("token LIKE 'G|%'").orderBy(F.desc("df"), "token").limit(ROWS).select("token", F.split("token", r"\|").alias("p"))
        kinds = _token("Gc", *[F.get("p", F.lit(k)) for k in (1, 2, 3)]), _token("Gs", *[F.get("p", F.lit(k)) for k in (1, 2, 4)])
        found = grid.select(*[F.xxhash64(t) for t in ("token", *kinds)]).collect()
        return np.array(found, np.int64).reshape(-1, 3)

    def scores(self, query_tokens: DataFrame, most: int | None = None) -> DataFrame:
        """qid, doc, mass and score of every document that shares a usable token with a query; with `most`, at
        least the best `most` documents of each query (score descending, then doc).

        query_tokens: qid, token."""
        return self._met(query_tokens, most, True)

    def masses(self, query_tokens: DataFrame) -> DataFrame:
        """qid, doc and mass of scores()."""
        return self._met(query_tokens, None, False)

    def _met(self, query_tokens: DataFrame, most: int | None, scored: bool) -> DataFrame:
        spark = query_tokens.sparkSession
        usable = self.usable().select("token", "idf")
        if self.stats.count() <= SENT_TOKENS:  # else tokens of queries meet them in a shuffle
            usable = F.broadcast(usable)
        asked = query_tokens.join(usable, "token").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("token").alias("t"), "idf"))).alias("a"), F.sum("idf").alias("q_mass"))
        asked = durable(asked.select("qid", "q_mass", F.col("a.t").alias("tokens"), F.col("a.idf").alias("idfs")))
        n = asked.count()
        cores = spark.sparkContext.defaultParallelism
        full = -(-n // (ALL_QUERIES if most is None else QUERY_BLOCK))
        blocks = max(1, full if full < cores else -(-full // cores) * cores, min(-(-n // LEAST_QUERIES), 3 * cores))
        placed = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).repartitionById(blocks, "qb")
        queries = durable(placed.groupBy("qb").agg(F.collect_list(F.struct("qid", "q_mass", "tokens", "idfs")).alias("queries")))
        release(spark)
        docs = self._by_block(self.sums.select("block", "norms"))
        docs = docs.select("docs", "norms", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), "sizes", "places")
        # a pair of partitions for each pair of blocks, read where they are written; those of a block of queries follow each other
        tasks = blocks if most is not None else max(blocks, -(-n * self.n_docs // ALL_ROWS))
        pairs = queries.hint("shuffle_replicate_nl").crossJoin(docs).coalesce(tasks)
        schema = (_SCORED if scored else _MASSES).format(kind=asked.schema["qid"].dataType.simpleString())
        return pairs.mapInArrow(_score_blocks(most, self._triples() if most is not None else np.zeros((0, 3), np.int64), scored), schema)

    def retrieve(self, query_tokens: DataFrame, top_n: int = C.TOP_N) -> DataFrame:
        return top_records(self.scores(query_tokens, 2 * top_n), self.kind, top_n)
