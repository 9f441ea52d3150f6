"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two generative bag-of-n-gram models are counted over hashed features (word unigrams, word bigrams and trigrams of word
shapes): one over labelled good documents (the target), one over every document (raw). A document's log importance weight
is the sum of its features' log ratios, shifted per token so that zero is the boundary that separates the labelled classes
best, and clipped to +-``CLIP``, so that no long document counts more than any other good one. Documents are drawn without
replacement with probability in proportion to their weights: the ``k`` largest values of log weight + Gumbel noise.

Unless ``k`` is given it is the expected number of documents of the target class, the sum of 1 / (1 + exp(-log weight)). A
document at the boundary is then drawn about every second time, one 3 above it nearly always, one 8 below it hardly ever.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_batches, fold, kth_largest, materialise, uniform

TOKEN = re.compile(r"\w+|[^\w\s]+")
UNI, BI, SHAPE = 1 << 14, 1 << 15, 1 << 12
SLOTS = UNI + BI + SHAPE
#: At most so many labelled rows fit the target model and the boundary.
MAX_LABELLED = 20_000
#: Log weights beyond it count as much; e**8 is 3000 to 1.
CLIP = 8.0


def _shape(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    if text[0].isalnum() or text[0] == "_":
        return 4 if text.isdigit() else 0 if text.islower() else 2 if text.isupper() and len(text) > 1 else 1 if text.istitle() else 3
    return 5 if text in {".", ",", "'", "-", ":", ";", "?", "(", ")", '"'} else 6 if len(text) > 1 else 7


class _Tokens(WordHashes):
    """A token's hash with its shape (0 to 7) in the lowest bits."""

    def __missing__(self, token: str) -> int:
        raw = token.encode()
        value = (WordHashes(0)[raw.lower()] & ~0xF) | _shape(raw)
        if len(self) < self.most:
            self[token] = value
        return value


_TOKENS = _Tokens()


def features(text: str | None) -> np.ndarray:
    """Slots of a text's hashed n-grams, repeats included; the first of them are the tokens themselves."""
    tokens = TOKEN.findall(text or "")
    code = np.fromiter(map(_TOKENS.__getitem__, tokens), np.uint64, len(tokens))
    if not len(code):
        return np.empty(0, np.int64)
    word = code >> np.uint64(4)
    shape = (code & np.uint64(7)).astype(np.int64)
    shape[1:] += 8 * (word[1:] == word[:-1])  # says the same as the word before
    uni = (word % np.uint64(UNI)).astype(np.int64)
    bi = (fold(word[:-1], word[1:]) % np.uint64(BI)).astype(np.int64) + UNI
    tri = ((shape[:-2] * 16 + shape[1:-1]) * 16 + shape[2:]) + UNI + BI
    return np.concatenate([uni, bi, tri])


def _count(batches):
    raw, target = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f = features(text)
            np.add.at(raw, f, 1)
            if good == 1:
                np.add.at(target, f, 1)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], ["slot", "raw", "target"])


def _score(ratios):
    def run(batches):
        w = ratios.value
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            n = [(f < UNI).sum() for f in found]
            made = [batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array([float(w[f].sum()) for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "row", "n_tokens", "log_ratio"])

    return run


def log_ratios(docs: DataFrame, labelled: DataFrame, alpha: float = 0.5) -> np.ndarray:
    """log p_target / p_raw of each slot, smoothed; counts are summed over all documents."""
    marked = docs.join(F.broadcast(labelled), "doc_id", "left").select("text", "quality")
    rows = marked.mapInArrow(_count, "slot long, raw long, target long").groupBy("slot").agg(F.sum("raw"), F.sum("target")).collect()  # SLOTS rows at most
    raw, target = np.zeros(SLOTS), np.zeros(SLOTS)
    for slot, r, t in rows:
        raw[slot], target[slot] = r, t
    out = np.zeros(SLOTS)
    if target.sum() == 0:
        return out
    for lo, hi in ((0, UNI), (UNI, UNI + BI), (UNI + BI, SLOTS)):
        r, t = raw[lo:hi], target[lo:hi]
        back = (r + 1) / (r + 1).sum()  # unseen target n-grams back off to the raw model, so rare words count little
        out[lo:hi] = np.log((t + alpha * (hi - lo) * back / 8) / (t.sum() + alpha * (hi - lo) / 8)) - np.log(back)
    return out


def boundary(pairs: list[tuple[float, int]], caution: float = 3.0) -> float:
    """The mean log ratio that separates labels best; to reject a good document costs ``caution`` times as much."""
    if not any(q == 0 for _, q in pairs) or not any(q == 1 for _, q in pairs):
        return min([0.0, *(s for s, q in pairs if q == 1)]) - 1e-9
    pairs = sorted(pairs)
    s, q = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    lost = np.concatenate([[0], np.cumsum(q == 1)]) * caution
    passed = (q == 0).sum() - np.concatenate([[0], np.cumsum(q == 0)])
    i = int(np.argmin(lost + passed))
    return float(s[0] - 1 if i == 0 else s[-1] + 1 if i == len(s) else s[i - 1] + 0.5 * (s[i] - s[i - 1]))


def gumbel_top_k(weighted: DataFrame, by: list[str], k: int | None, temperature: float = 1.0, seed: int = 11) -> DataFrame:
    """``weighted`` (log_weight, null: never drawn) with sample_key and kept: ``k`` rows drawn without replacement, each time with probability in
    proportion to exp(log_weight / temperature). Noise depends on the seed and the columns ``by`` alone, so reruns agree;
    rows that tie at the k-th key are all drawn."""
    keyed = weighted.withColumn("sample_key", F.col("log_weight") / temperature - F.log(-F.log(uniform(*by, seed=seed))))
    if k is None:
        k = round(keyed.agg(F.sum(1 / (1 + F.exp(-F.col("log_weight"))))).first()[0] or 0)
    least = kth_largest(keyed.where("sample_key is not null"), "sample_key", k)
    return keyed.withColumn("kept", F.coalesce(F.col("sample_key") >= F.lit(least), F.lit(False)))


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, clip: float = CLIP, seed: int = 11, max_labelled: int = MAX_LABELLED, key: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, log_weight, sample_key, kept, and the column ``key`` if
    rows have a number of their own there.

    ``labels`` (doc_id, quality): rows without either are ignored, of repeated ids the lower quality counts, and at most
    ``max_labelled`` rows are used, in the order of a hash of doc_id. Texts that are null or have no token have no weight
    and are never drawn. Equal rows share their sample key and their fate unless ``key`` tells them apart; documents that tie at the k-th key are all drawn. Without
    labels of good documents there is no target: all weights are zero and, unless ``k`` is given, every text with tokens
    is kept. Rows without doc_id are scored as any other. Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(key or "doc_id").cast("long").alias("row"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, known))
    scored = materialise(docs.mapInArrow(_score(ratios), "doc_id long, row long, n_tokens long, log_ratio double"), "scored")
    mean = F.col("log_ratio") / F.greatest("n_tokens", F.lit(1))
    labelled = scored.where("n_tokens > 0").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(mean), F.min("quality"))
    pairs = [(r[1], r[2]) for r in labelled.collect()]  # a row per labelled id, max_labelled at most
    if not any(q == 1 for _, q in pairs):
        scored = scored.withColumn("log_weight", F.when(F.col("n_tokens") > 0, F.lit(0.0)))
        k = scored.count() if k is None else k
    else:
        weight = F.col("log_ratio") - F.lit(boundary(pairs)) * F.col("n_tokens")
        scored = scored.withColumn("log_weight", F.when(F.col("n_tokens") > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), weight))))
    drawn = gumbel_top_k(scored, ["row", "n_tokens", "log_ratio"], k, temperature, seed)
    return drawn.select("doc_id", "n_tokens", "log_weight", "sample_key", "kept", *([F.col("row").alias(key)] if key else []))
