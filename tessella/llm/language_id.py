"""Language identification by interpolated Kneser-Ney character models.

One model a language, of `ORDER` characters: letters, lower-cased, with every run of other
characters as one boundary. A model is a sorted array of 64-bit n-gram hashes for each order
(16 bits a character) with its discounted probabilities, and one of context hashes with their
interpolation weights. A text is scored by the length-normalised cross-entropy (nats a symbol)
under each model; the lowest wins, ties to the first name. The score is the softmax of the
negative cross-entropies, with the temperature that fits labelled texts kept apart from the
counts; `accepted` is false where the cross-entropy lies beyond the quantile REJECT of the
language's own texts of that calibration part, which marks texts in no learned language.

The classifier is fitted on a bounded sample of labelled rows: TRAIN_DOCS rows a language in
expectation (chosen by a hash of the key), every fifth of them for calibration; a language whose
rows would all fall to the calibration counts them instead. Every language and every n-gram of the
sample is kept, so what is collected and sent out grows with the languages, but not with the rows of
one. The prediction is one pass without a shuffle, over every whole text.

In a batch, only the distinct n-grams are looked up, and a text's sum is a sum of looked-up
values.

Edge cases: a null text and one without a letter get `und`, score 0, and are not accepted. With
no labelled rows every text gets `und`. Repeated rows are predicted alike. The key may be null. A very long
text is read whole; an empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing as P

ORDER = 4
TRAIN_DOCS = 4000
REJECT = 0.995
PIECE_CHARS = 1_500_000
DENSE = 1 << 25
TEMPERATURES = np.array([1, 2, 4, 8, 16, 32, 64, 128.0])


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as 16-bit numbers, 0 for a boundary after a letter; and where each text begins."""
    lowered = [x.lower() if x else "" for x in texts]
    sizes = np.array([len(x) + 1 for x in lowered], np.int64)
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    ptr = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(sizes)))]
    # letters beyond 16 bits share the 6,400 numbers of the private use area, where no letter is
    points = np.where(points > 0xFFFF, 0xE000 + points % 6400, points)
    return np.where(is_letter, points, 0)[keep].astype(np.int64), ptr


def grams(values: np.ndarray, ptr: np.ndarray, base: int) -> np.ndarray:
    """For each symbol the number of the n-gram that ends there; before a text stand boundaries (0)."""
    out = values.copy()
    begin = ptr[:-1][ptr[:-1] < ptr[1:]]
    for back in range(1, ORDER):
        before = np.zeros_like(values)
        before[back:] = values[:-back]
        for k in range(back):
            at = begin + k
            before[at[at < len(before)]] = 0
        # a text shorter than k symbols: the place belongs to the next text, which has its own zeros
        out += before * base**back
    return out


def distinct_grams(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes and, for each symbol, which of them ends there."""
    seen = np.zeros(1 << 16, bool)
    seen[values] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen)
    dense = np.cumsum(seen) - 1
    base = len(alphabet)
    codes = grams(dense[values], ptr, base)
    if base**ORDER <= DENSE:
        there = np.zeros(base**ORDER, bool)
        there[codes] = True
        found = np.flatnonzero(there)
        place = np.empty(base**ORDER, np.int32)
        place[found] = np.arange(len(found), dtype=np.int32)
        which = place[codes]
    else:
        found = P.sorted_distinct(codes)
        which = np.searchsorted(found, codes)
    keys, rest = np.zeros(len(found), np.uint64), found
    for back in range(ORDER):
        keys |= alphabet[rest % base].astype(np.uint64) << np.uint64(16 * back)
        rest = rest // base
    return keys, which


class KneserNey:
    """Interpolated Kneser-Ney over n-gram hashes of 16 bits a character."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.levels = []  # from the highest order: hashes, probabilities, context hashes, weights
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        for n in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            context = keys >> np.uint64(16)
            begin = P.run_starts(context)
            total = np.add.reduceat(counts, begin)
            sizes = np.diff(begin, append=len(keys))
            self.levels.append((keys, (counts - np.minimum(discount, counts)) / np.repeat(total, sizes), context[begin], np.minimum(discount, 1) * sizes / total))
            if n == 1:
                self.alphabet = len(keys) + 1
            # continuation counts of the next lower order: distinct first characters
            lower = np.sort(keys & np.uint64((1 << 16 * (n - 1)) - 1))
            begin = P.run_starts(lower)
            keys, counts = lower[begin], np.diff(begin, append=len(lower)).astype(np.float64)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1.0 / self.alphabet)
        for n in range(1, ORDER + 1):
            hashes, values, contexts, weights = self.levels[ORDER - n]
            key = keys & np.uint64((1 << 16 * n) - 1) if n < 4 else keys
            direct = _look(hashes, values, key, 0.0)
            p = direct + _look(contexts, weights, key >> np.uint64(16), 1.0) * p
        return np.log(p)


def _look(hashes: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, values[at], missing)


class LanguageModel:
    """The models of all languages, with temperature and rejection thresholds."""

    def __init__(self, models: dict[str, KneserNey]) -> None:
        self.names = sorted(models)
        self.models = [models[k] for k in self.names]
        self.temperature, self.limits = 16.0, np.full(len(self.names), np.inf)

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy of each text under each language; nan without a letter."""
        out, at, size = [], 0, 0
        for k, x in enumerate(texts):
            size += len(x or "")
            if size >= PIECE_CHARS or k == len(texts) - 1:
                out.append(self._entropies(texts[at : k + 1]))
                at, size = k + 1, 0
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))

    def _entropies(self, texts: list[str | None]) -> np.ndarray:
        values, ptr = symbols(texts)
        out = np.full((len(texts), len(self.names)), np.nan)
        full = np.flatnonzero(np.diff(ptr))
        if len(values) and self.names:
            keys, which = distinct_grams(values, ptr)
            for k, model in enumerate(self.models):
                out[full, k] = -np.add.reduceat(model.log_probabilities(keys)[which], ptr[full]) / np.diff(ptr)[full]
        return out

    def scores(self, entropies: np.ndarray) -> np.ndarray:
        z = -self.temperature * (entropies - entropies.min(axis=1, keepdims=True))
        return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray) -> None:
        if not len(truth):
            return
        row = np.arange(len(truth))
        fits = []
        for self.temperature in TEMPERATURES:
            fits.append(np.log(self.scores(entropies)[row, truth] + 1e-12).mean())
        self.temperature = float(TEMPERATURES[int(np.argmax(fits))])
        for k in range(len(self.names)):
            own = entropies[truth == k, k]
            self.limits[k] = np.quantile(own, REJECT) * 1.1 if len(own) else np.inf


def _train(labelled: DataFrame) -> LanguageModel:
    """labelled: lang, text, calibrate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in P.column_batches(batches):
            langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
            for lang in sorted(set(langs.tolist())):
                mine = [texts[k] for k in np.flatnonzero(langs == lang)]
                while mine:
                    size, cut = 0, 0
                    while cut < len(mine) and size < PIECE_CHARS:
                        size, cut = size + len(mine[cut] or ""), cut + 1
                    values, ptr = symbols(mine[:cut])
                    mine = mine[cut:]
                    if len(values):
                        keys, which = distinct_grams(values, ptr)
                        n = np.bincount(which, minlength=len(keys))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = labelled.where("NOT calibrate").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    model = LanguageModel({k: KneserNey(keys[langs == k], n[langs == k]) for k in set(langs)})
    if model.names:
        sent = labelled.sparkSession.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in P.column_batches(batches):
                e = sent.value.entropies(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(e.tolist(), pa.list_(pa.float64()))], names=["lang", "e"])

        rows = labelled.where("calibrate").select("lang", "text").mapInArrow(measure, "lang string, e array<double>").collect()
        rows = [r for r in sorted(rows) if r.lang in model.names and r.e[0] == r.e[0]]
        model.calibrate(np.array([r.e for r in rows]).reshape(-1, len(model.names)), np.array([model.names.index(r.lang) for r in rows], int))
    return model


def identify_language(docs: DataFrame, learn: Column, train_docs: int = TRAIN_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang_pred, score, entropy (of the winner) and accepted for every row; learns where `learn` holds."""
    labelled = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    fifth = F.pmod(F.xxhash64(F.lit(13), F.col(key)), F.lit(5)) == 0
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("rows"), F.count_if(~fifth).alias("counting")).collect()
    pick = F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(1.0)
    for r in sizes:
        if r.rows > train_docs:
            share = F.when(F.col(lang) == r.lang, train_docs / r.rows).otherwise(share)
    calibrate = fifth & ~F.col(lang).isin([r.lang for r in sizes if not r.counting])
    sample = labelled.where(pick < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"), calibrate.alias("calibrate"))
    model = _train(sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in P.column_batches(batches):
            texts = batch.column(1).to_pylist()
            names, score, entropy, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
            if own.names:
                e = own.entropies(texts)
                full = np.flatnonzero(~np.isnan(e[:, 0]))
                best = e[full].argmin(axis=1) if len(full) else full
                score[full], entropy[full] = own.scores(e[full])[np.arange(len(full)), best], e[full, best]
                accepted[full] = entropy[full] <= own.limits[best]
                for k, b in zip(full, best, strict=True):
                    names[k] = own.names[b]
            out = [batch.column(0), pa.array(names), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(out, names=[key, "lang_pred", "score", "entropy", "accepted"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double, entropy double, accepted boolean")
