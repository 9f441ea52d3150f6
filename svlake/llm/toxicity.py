"""Toxicity: a convolutional text classifier over hashed word embeddings, trained on all labelled rows in numpy and Spark.

A word's vector is the sum of hashed embeddings of the word and of its beginnings and ends, so that inflected and compound words
that training never saw are near those it did see. Filters of widths 1, 2 and 3 run over the words, rectified; the largest
response of each filter over the whole text goes into a logistic unit. Embeddings start from the log odds among training
documents, the rest is trained by Adam with word dropout: blocks of rows learn apart in each pass and their changes are averaged. A slope and offset, fitted on rows kept out of training, calibrate
the score; each language gets its own flagging threshold, which decides ``flagged`` and never enters a score.

Texts are scored whole, in overlapping pieces of bounded size.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, bounded_batches, materialise

WORD = re.compile(r"\w+")
BITS, DIM, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
AFFIXES = (3, 4, 5, 6)
PARTS, MASK = 1 + 2 * len(AFFIXES), (1 << BITS) - 1
SHARE = np.array([1.0] + [1 / (2 * len(AFFIXES))] * (2 * len(AFFIXES)), np.float32)  # of each part in a word's vector
PIECE = 1 << 15
#: Labelled rows of a block, and about the characters that are held of one; passes over the rows, of several blocks and of one.
BLOCK, MOST_BYTES, PASSES, EPOCHS = 4096, 32 << 20, 2, 6
#: Changes are summed in whole units of 1 / UNIT, logits counted in steps of 1 / STEPS.
UNIT, STEPS = 1 << 24, 256


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def parts_of_all(words: list[str]) -> np.ndarray:
    """Embedding rows of words, (n, PARTS): of each itself, and its beginnings and ends of 3 to 6 letters; the last row of the table stands for none."""
    h = xxhash.xxh3_64_intdigest
    out = np.full((len(words), PARTS), 1 << BITS, np.int32)
    out[:, 0] = [h("=" + w) & MASK for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    for i, n in enumerate(AFFIXES):
        longer = np.flatnonzero(size > n)
        some = [words[k] for k in longer.tolist()]
        out[longer, 1 + 2 * i] = [h("<" + w[:n]) & MASK for w in some]
        out[longer, 2 + 2 * i] = [h(">" + w[-n:]) & MASK for w in some]
    return out


def parts_of(word: str) -> list[int]:
    return parts_of_all([word])[0].tolist()


def by_size(rows: Iterable[tuple], most: int = 1 << 20) -> Iterable[list[tuple]]:
    """Rows (text or word numbers, ...) in groups of at most ``most`` characters or words, or of one row."""
    group, size = [], 0
    for row in rows:
        n = 0 if row[0] is None else len(row[0])
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield group


class Words(dict):
    """Numbers words and keeps a row for each, its embedding rows, for about ``most`` words at a time."""

    def __init__(self, most: int = 400_000, width: int = PARTS, dtype: type = np.int32):
        super().__init__()
        self.most, self.fresh = most, []
        self.rows = np.zeros((1 << 12, width), dtype)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def made(self, words: list[str]) -> np.ndarray:
        return parts_of_all(words)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of the words of each text, in order; ``rows`` then holds their rows. Forgets earlier words first if there are ``most``."""
        if len(self) >= self.most:
            self.clear()
        first, found = len(self), []
        for text in texts:
            words = words_of(text)
            found.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        if len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self), len(self.rows)), self.rows.shape[1]), self.rows.dtype)])
        for lo in range(0, len(self.fresh), 4096):
            new = self.made(self.fresh[lo : lo + 4096])
            self.rows[first + lo : first + lo + len(new)] = new
        self.fresh.clear()
        return found


class Vocabulary(Words):
    """Words with their vectors."""

    def __init__(self, table: np.ndarray, most: int = 400_000):
        super().__init__(most, DIM, np.float32)
        self.table = table

    def made(self, words: list[str]) -> np.ndarray:
        return np.einsum("npd,p->nd", self.table[parts_of_all(words)], SHARE)

    def __call__(self, text: str | None) -> np.ndarray:
        """The word vectors of a text, (n, DIM)."""
        found = self.numbers([text])[0]
        return self.rows[found]

    def logits(self, model: dict, texts: list[str | None]) -> list[float]:
        return [logit(model, self.rows[found]) for some in by_size((t,) for t in texts) for found in self.numbers([r[0] for r in some])]


def taps(filters: list[np.ndarray]) -> np.ndarray:
    """All filters as one matrix: their first places, then the second places of those that have one, and so on."""
    return np.concatenate([f[j] for j in range(max(WIDTHS)) for f in filters if len(f) > j], axis=1)


def responses(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Of all filters, the narrowest first, at each place of word vectors; where a filter reaches beyond the end, without the missing words."""
    made = x @ taps
    out, at = made[:, : len(WIDTHS) * FILTERS], len(WIDTHS) * FILTERS
    for j in range(1, max(WIDTHS)):
        n = FILTERS * sum(w > j for w in WIDTHS)
        out[: max(len(x) - j, 0), -n:] += made[j:, at : at + n]
        at += n
    return out


def places(n: int, width: int) -> int:
    """At how many places of a text of ``n`` words a filter stands."""
    return max(n - width + 1, 1)


class ConvText:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, ((1 << BITS) + 1, DIM)).astype(np.float32)
        self.table[-1] = 0
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # start as detectors of the log-odds coordinate
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
        self.offset = np.float32(-1.0)
        self.slope, self.shift = 1.0, 0.0

    def start(self, seen: np.ndarray, clean: int, toxic: int, least: int = 3) -> None:
        """Set the first coordinate to the smoothed log odds of words and affixes, by the documents (clean, toxic) that hold them; of those in fewer than ``least`` documents, to nothing."""
        odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
        self.table[:-1, 0] = np.where(seen.sum(axis=0) >= least, odds, 0)[:-1] / 4

    def params(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out]

    def fit(self, texts: list[str | None], y: np.ndarray, weights: tuple[float, float], rng: np.random.Generator, rate: float = 0.01, dropout: float = 0.2) -> None:
        """One pass over texts, in batches of 32 in random order, by Adam; ``weights`` of the classes 0 and 1."""
        params, offset_m, offset_v = self.params(), 0.0, 0.0
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order, words = rng.permutation(len(texts)), Words()
        gap, absent, each = max(WIDTHS) - 1, np.full((1, PARTS), 1 << BITS, np.int32), np.arange(len(WIDTHS) * FILTERS)
        for step, at in enumerate(range(0, len(order), 32), 1):
            grads, moved, d_offset = [np.zeros_like(p) for p in params], [], 0.0
            coded = words.numbers([texts[i] for i in order[at : at + 32]])
            batch = [(held, y[i]) for i, ids in zip(order[at : at + 32], coded, strict=True) if len(held := ids[rng.random(len(ids)) >= dropout])]
            none, place = len(words), np.empty(len(words) + 1, np.int64)
            for some in by_size(batch, 1 << 16):  # its texts behind each other, with gaps of no words
                ids = np.concatenate([part for held, _ in some for part in (held, np.full(gap, none, np.int32))])
                found = np.unique(ids)
                place[found] = np.arange(len(found))
                ids, parts = place[ids], np.concatenate([words.rows[found[:-1]], absent])
                x = np.einsum("npd,p->nd", self.table[parts], SHARE)[ids]
                made, lo, top = responses(x, taps(self.filters)), 0, []
                for held, _ in some:
                    top.append([lo + made[lo : lo + places(len(held), w), k * FILTERS : (k + 1) * FILTERS].argmax(axis=0) for k, w in enumerate(WIDTHS)])
                    lo += len(held) + gap
                top, truth = np.array(top).reshape(len(some), -1), np.array([label for _, label in some])
                pooled = made[top, each] + self.bias.ravel()
                active = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.offset, -30, 30)))
                d = ((p - truth) * np.array(weights)[truth] / 32).astype(np.float32)
                back = d[:, None] * self.out * (pooled > 0)
                d_offset += d.sum()
                grads[-1] += d @ active
                grads[-2] += back.sum(axis=0).reshape(self.bias.shape)
                for k, w in enumerate(WIDTHS):
                    of = slice(k * FILTERS, (k + 1) * FILTERS)
                    b, f = back[:, of].nonzero()
                    g = back[:, of][b, f][:, None]
                    for j in range(w):
                        rows = top[:, of][b, f] + j
                        np.add.at(grads[k][j].T, f, x[rows] * g)
                        moved.append((parts[ids[rows]], self.filters[k][j].T[f] * g))
            for p_, g, a, b in zip(params, grads, m, v, strict=True):
                a[:] = 0.9 * a + 0.1 * g
                b[:] = 0.999 * b + 0.001 * g * g
                p_ -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            offset_m, offset_v = 0.9 * offset_m + 0.1 * d_offset, 0.999 * offset_v + 0.001 * d_offset**2
            self.offset -= np.float32(rate * (offset_m / (1 - 0.9**step)) / (np.sqrt(offset_v / (1 - 0.999**step)) + 1e-8))
            if moved:
                rows, g = (np.concatenate(x) for x in zip(*moved, strict=True))
                rows, to = np.unique(rows, return_inverse=True)
                g = (g[:, None, :] * SHARE[:, None]).reshape(-1, DIM)
                self.table[rows] -= 0.05 * np.stack([np.bincount(to.ravel(), c, len(rows)) for c in g.T], axis=1)
            self.table[-1] = 0

    def flat(self) -> np.ndarray:
        """All weights as rows of DIM numbers: the table, then the others."""
        rest = np.concatenate([*[p.ravel() for p in self.params()], [self.offset]])
        return np.concatenate([self.table, np.resize(np.append(rest, np.zeros(-len(rest) % DIM)), (-(-len(rest) // DIM), DIM)).astype(np.float32)])

    def unflat(self, rows: np.ndarray) -> None:
        self.table, rest, at = rows[: len(self.table)].astype(np.float32), rows[len(self.table) :].ravel(), 0
        for p in self.params():
            p[:] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
        self.offset = np.float32(rest[at])

    def compile(self) -> dict:
        return {"table": self.table, "filters": self.filters, "taps": taps(self.filters), "bias": self.bias, "out": self.out, "offset": float(self.offset), "slope": self.slope, "shift": self.shift}


def logit(model: dict, x: np.ndarray) -> float:
    """The score before calibration of a text's word vectors."""
    best, longest = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), max(WIDTHS)
    for lo in range(0, places(len(x), longest), PIECE):
        part = x[lo : lo + PIECE + longest - 1]
        made = responses(part if len(part) else np.zeros((1, DIM), np.float32), model["taps"])
        for i, w in enumerate(WIDTHS[1:], 1):
            made[places(len(part), w) :, i * FILTERS : (i + 1) * FILTERS] = -np.inf
        best = np.maximum(best, made.max(axis=0))
    return float(np.maximum(best + model["bias"].ravel(), 0) @ model["out"] + model["offset"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def key_of(text: str | None) -> int:
    """Spark's xxhash64 of the text, null as empty."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def seen_in(rows: Iterable[tuple[str | None, int]]) -> np.ndarray:
    """Documents of each class (0, 1) that hold each row of the table, from (text, toxic)."""
    seen, words, last = np.zeros((2, (1 << BITS) + 1), np.int64), Words(), np.zeros((1 << BITS) + 1, np.int64)
    for some in by_size(rows):
        for found, (_, label) in zip(words.numbers([r[0] for r in some]), some, strict=True):
            parts = words.rows[np.unique(found)].ravel()
            at = np.arange(len(parts))
            last[parts] = at
            seen[label, parts[last[parts] == at]] += 1  # each row once
    return seen


def fold(model: ConvText, rows: list[tuple[str | None, int]], weights: tuple[float, float], seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What one pass over a block of rows (text, toxic) from ``model`` changes, times the number of rows, in whole units of 1 / UNIT, so that sums
    don't depend on their order: numbers of changed rows of ``flat`` and their changes. The rows' order doesn't matter."""
    rows = sorted(rows, key=lambda r: (key_of(r[0]), r[1]))
    mine = copy.deepcopy(model)
    mine.fit([r[0] for r in rows], np.array([r[1] for r in rows], np.int64), weights, np.random.default_rng(seed))
    change = np.rint((mine.flat().astype(np.float64) - model.flat()) * (len(rows) * UNIT)).astype(np.int64)
    at = np.flatnonzero(change.any(axis=1))
    return at, change[at]


def halves(counts: dict[tuple[bool, int], int]) -> tuple[set[bool], set[bool]]:
    """Which rows fit and which calibrate, as values of ``kept``, from the numbers of rows by (kept, toxic)."""
    both = lambda k: counts.get((k, 0), 0) > 0 and counts.get((k, 1), 0) > 0
    if not both(False):
        return {False, True}, {False, True}
    enough = min(counts.get((True, 0), 0), counts.get((True, 1), 0)) >= 300  # fewer make a noisy cut: then all rows do
    return {False}, {True} if enough else {False, True}


def calibrated(made: dict, bins: list[tuple[str | None, int, int, int]]) -> tuple[dict, dict[str | None, float], float]:
    """The model with slope and shift, and thresholds, from the numbers of rows by (lang, toxic, logit in units of 1 / STEPS)."""
    y, q, n = (np.array([b[i] for b in bins], np.int64) for i in (1, 2, 3))
    values, at = np.unique(q, return_inverse=True)
    bad, good = np.bincount(at, n * (y == 1)), np.bincount(at, n * (y == 0))
    # The least cut of those that err least, a false alarm counting as three misses, becomes 0.5; the slope follows the spread.
    errors = np.concatenate([[0], np.cumsum(bad)]) + 3 * (good.sum() - np.concatenate([[0], np.cumsum(good)]))
    k = min(max(int(errors.argmin()), 1), max(len(values) - 1, 1))
    cut = (values[k - 1] + values[min(k, len(values) - 1)]) / 2 / STEPS
    gap = max(((bad @ values) / bad.sum() - (good @ values) / good.sum()) / STEPS, 1e-3)
    made["slope"], made["shift"] = 8 / gap, -8 / gap * cut
    scores, langs = _sigmoid(made["slope"] * q / STEPS + made["shift"]), np.array([repr(b[0]) for b in bins])
    thresholds, grid = {}, np.linspace(0.05, 0.95, 91)
    for lang in {b[0] for b in bins}:
        of = langs == repr(lang)
        if min(n[of & (y == 1)].sum(), n[of & (y == 0)].sum()) >= 10:
            wrong = np.array([(n[of] * ((scores[of] >= t) != y[of])).sum() for t in grid])
            best = np.flatnonzero(wrong == wrong.min())
            thresholds[lang] = float(grid[best[np.argmin(np.abs(grid[best] - 0.5))]])
    return made, thresholds, 0.5


def constant(toxic: int, seed: int) -> dict:
    """The model of one class alone."""
    model = ConvText(seed)
    model.out[:] = 0
    model.offset = np.float32(3.0 if toxic else -3.0)
    return model.compile()


def class_weights(clean: int, toxic: int) -> tuple[float, float]:
    return 0.5 * (clean + toxic) / max(1, clean), 0.5 * (clean + toxic) / max(1, toxic)


def train(rows: list[tuple[str | None, str | None, int]], seed: int = 3) -> tuple[dict, dict[str | None, float], float]:
    """(model, threshold by language, threshold of other languages) from (text, lang, toxic), in this process and as one block; ``toxicity`` does the
    same by Spark. A fifth of the rows, by the text's hash, is kept out of the fit and calibrates the scores, if it has 300 rows of each class; a language with fewer than 10 such rows of a class has the common threshold."""
    kept = [key_of(r[0]) % 5 == 0 for r in rows]
    counts = Counter((k, r[2]) for k, r in zip(kept, rows, strict=True))
    if len({r[2] for r in rows}) < 2:
        return constant(max((r[2] for r in rows), default=0), seed), {}, 0.5
    fitting, judging = halves(counts)
    fit = [(r[0], r[2]) for k, r in zip(kept, rows, strict=True) if k in fitting]
    toxic = sum(r[1] for r in fit)
    model = ConvText(seed)
    model.start(seen_in(fit), len(fit) - toxic, toxic)
    for k in range(EPOCHS):
        at, change = fold(model, fit, class_weights(len(fit) - toxic, toxic), [seed, k, 0])
        flat = model.flat().astype(np.float64)
        flat[at] += change / (len(fit) * UNIT)
        model.unflat(flat)
    made = model.compile()
    vectors = Vocabulary(made["table"])
    judged = [r for k, r in zip(kept, rows, strict=True) if k in judging]
    bins = Counter((r[1], r[2], binned(z)) for r, z in zip(judged, vectors.logits(made, [r[0] for r in judged]), strict=True))
    return calibrated(made, [(*b, n) for b, n in bins.items()])


def binned(z: float) -> int:
    return round(z * STEPS)


def _seen(batches):
    seen = seen_in(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["at", "clean", "toxic"])


def _folds(shared, weights: tuple[float, float], seed: int, epoch: int):
    """(block, text, toxic), a block's rows behind each other -> the changes of its fold; of very long texts a block is folded in pieces of ``MOST_BYTES``."""
    names = ["at", *[f"d{i}" for i in range(DIM)]]

    def made(block: int, rows: list):
        at, change = fold(shared.value, rows, weights, [seed, epoch, block])
        return pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(c)) for c in change.T]], names)

    def run(batches):
        rows, now, size = [], None, 0
        for b in batches:
            for block, text, toxic in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if rows and (block != now or size > MOST_BYTES):
                    yield made(now, rows)
                    rows, size = [], 0
                now = block
                rows.append((text, toxic))
                size += len(text or "")
        if rows:
            yield made(now, rows)

    return run


def _bins(shared):
    def run(batches):
        vectors, found = Vocabulary(shared.value["table"]), Counter()
        for b in batches:
            logits = vectors.logits(shared.value, b.column(0).to_pylist())
            found.update(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), map(binned, logits), strict=True))
        rows = [(*k, n) for k, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["lang", "toxic", "q", "n"])

    return run


def learned(rows: DataFrame, seed: int = 3, block: int = BLOCK) -> tuple[dict, dict[str | None, float], float]:
    """``train`` over a table (doc_id, text, lang, toxic) of any size: counts, passes and calibration are summed by Spark over all rows, only sums as large as
    the weights reach the driver. Rows are dealt into blocks of about ``block``; in each pass every block learns from the same weights and the changes are averaged."""
    spark = rows.sparkSession
    kept = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(5)) == 0
    found = rows.groupBy(kept.alias("kept"), "toxic").count().collect()
    counts = {(r.kept, r.toxic): r["count"] for r in found}
    if len({t for _, t in counts}) < 2:
        return constant(max((t for _, t in counts), default=0), seed), {}, 0.5
    fitting, judging = halves(counts)
    clean, toxic = (sum(n for (k, t), n in counts.items() if k in fitting and t == label) for label in (0, 1))
    blocks = max(1, round((clean + toxic) / block))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "text", "lang", F.col("toxic").cast("int").alias("toxic"), kept.alias("kept"))
    dealt = materialise(dealt.repartition(blocks, "block").sortWithinPartitions("block"), "dealt")
    fit = dealt.where(F.col("kept").isin(fitting))
    seen = np.zeros((2, (1 << BITS) + 1), np.int64)
    sums = fit.select("text", "toxic").mapInArrow(_seen, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean"), F.sum("toxic")).toArrow()
    for i in (0, 1):
        seen[i, sums.column(0).to_numpy()] = sums.column(i + 1).to_numpy()
    model = ConvText(seed)
    model.start(seen, clean, toxic)
    columns = [f"d{i}" for i in range(DIM)]
    for k in range(EPOCHS if blocks == 1 else PASSES):
        shared = spark.sparkContext.broadcast(model)
        run = _folds(shared, class_weights(clean, toxic), seed, k)
        sums = fit.select("block", "text", "toxic").mapInArrow(run, "at long, " + ", ".join(f"{c} long" for c in columns)).groupBy("at").agg(*[F.sum(c) for c in columns]).toArrow()
        flat = model.flat().astype(np.float64)
        flat[sums.column(0).to_numpy()] += np.stack([sums.column(i + 1).to_numpy() for i in range(DIM)], axis=1) / ((clean + toxic) * UNIT)
        model.unflat(flat)
        shared.unpersist()
    made = model.compile()
    shared = spark.sparkContext.broadcast(made)
    bins = dealt.where(F.col("kept").isin(judging)).select("text", "lang", "toxic").mapInArrow(_bins(shared), "lang string, toxic int, q long, n long")
    return calibrated(made, [tuple(r) for r in bins.groupBy("lang", "toxic", "q").agg(F.sum("n")).collect()])


def _score(shared):
    def run(batches):
        model = shared.value
        vectors = Vocabulary(model["table"])
        for batch in batches:
            z = np.array(vectors.logits(model, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_sigmoid(model["slope"] * z + model["shift"]), pa.float64())], ["doc_id", "lang", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, score, predicted, lang, threshold, flagged.

    Learns from all labelled rows that aren't held out (crc32(doc_id as text) % 5 != 0), in blocks of about ``block`` rows; of repeated ids the
    larger label and the least text count. Only the text enters a score; null
    and empty texts have the score of a text without words. Without labels of both classes every score is the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = materialise(known.where(~held_out()), "known")
    rows = among(docs, "doc_id", known.select("doc_id"), most=16_000_000, bits=4, exact=False).join(known, "doc_id")
    rows = materialise(rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "d.*", "toxic"), "labelled")
    model, thresholds, other = learned(rows, seed, block)
    shared = spark.sparkContext.broadcast(model)
    scored = docs.select("doc_id", "text", "lang").mapInArrow(_score(shared), "doc_id long, lang string, score double")
    threshold = F.lit(other)
    for lang, t in sorted(thresholds.items(), key=str):
        threshold = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(t)).otherwise(threshold)
    scored = scored.withColumn("threshold", threshold)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
