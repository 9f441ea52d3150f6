from __future__ import annotations

import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from svlake.llm import toxicity as T


def out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=400):
    rng = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(3000)])
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(5, 120)))
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.integers(len(w)), rng.choice(["vile", "nasty", "awful"]))
        docs.append((i, " ".join(w), ["en", "de"][i % 2]))
        labels.append((i, int(i % 4 == 0)))
    return docs, labels


def test_held_out_accuracy_and_labels_unseen(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in T.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(y, got[i].predicted) for i, y in labels if out(i)]
    assert all(got[i].held_out == out(i) for i, _ in labels)
    assert np.mean([y == p for y, p in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    flipped = [(i, 1 - y if out(i) else y) for i, y in labels]
    again = {r.doc_id: r.score for r in T.toxicity(d.withColumn("lang", F.lit("xx")), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_edges(spark):
    d = spark.createDataFrame([(1, None, None), (1, "", "en"), (None, "x", "en"), (2, "y " * 70_000, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(d, none).collect()
    assert len(got) == 4
    assert {r.predicted for r in got} == {0}
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None), (1, 0)], "doc_id long, toxic int")
    assert T.toxicity(d, labels).count() == 4
    assert T.toxicity(d.limit(0), labels).count() == 0


def test_pieces_equal_whole(monkeypatch):
    model = T.ConvText().compile()
    x = np.random.default_rng(2).normal(size=(5000, T.DIM)).astype(np.float32)
    whole = T.logit(model, x)
    monkeypatch.setattr(T, "PIECE", 37)
    assert abs(T.logit(model, x) - whole) < 1e-4


def test_vocabulary_keeps_vectors_when_full():
    table = np.random.default_rng(3).normal(size=((1 << T.BITS) + 1, T.DIM)).astype(np.float32)
    small, large = T.Vocabulary(table, most=10), T.Vocabulary(table)
    for text in ("a bb ccc dddd", " ".join(f"w{i}" for i in range(50)), "a bb", "w1 w2 zz"):
        assert np.allclose(small(text), large(text))


def plain_score(model: dict, text: str | None) -> float:
    """The trained network over the whole text, word by word and place by place."""
    vectors = []
    for word in T.WORD.findall((text or "").lower()):
        v = np.zeros(T.DIM)
        for part, share in zip(T.parts_of(word), T.SHARE.tolist(), strict=True):
            v += share * model["table"][part].astype(float)
        vectors.append(v)
    z = model["offset"]
    for i, width in enumerate(T.WIDTHS):
        padded = vectors + [np.zeros(T.DIM)] * (width - len(vectors))
        for k in range(T.FILTERS):
            best = max(sum(float(padded[at + j] @ model["filters"][i][j, :, k].astype(float)) for j in range(width)) for at in range(len(padded) - width + 1))
            z += max(best + float(model["bias"][i, k]), 0.0) * float(model["out"][i * T.FILTERS + k])
    return 1 / (1 + np.exp(-(model["slope"] * z + model["shift"])))


def test_scores_equal_the_plain_network(spark, monkeypatch):
    """Every score is that of the trained network evaluated plainly on the whole text, in pieces too; held_out by its definition."""
    docs, labels = corpus(160)
    docs += [(1000, None, "en"), (1001, "", "de"), (1002, "vile " * 3, None), (1003, " ".join(d[1] for d in docs[:12]), "en"), (1004, "Ünder the ROOF, word5!", "en")]
    model, _, _ = T.train([(docs[i][1], docs[i][2], y) for i, y in labels if not out(i)])
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in T.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len({round(r.score, 3) for r in got.values()}) > 20
    for i, text, _ in docs:
        assert abs(got[i].score - plain_score(model, text)) < 1e-4, i
        assert got[i].held_out == out(i)
    monkeypatch.setattr(T, "PIECE", 29)
    vectors = T.Vocabulary(model["table"])
    assert abs(T._sigmoid(model["slope"] * T.logit(model, vectors(docs[-2][1])) + model["shift"]) - plain_score(model, docs[-2][1])) < 1e-4


def test_clashing_columns(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame([(*x, 7.0, True, 1, "t", 3) for x in docs], "doc_id long, text string, lang string, score double, flagged boolean, predicted int, threshold string, toxic int")
    lab = spark.createDataFrame([(i, y, "n") for i, y in labels], "doc_id long, toxic int, text string")
    plain = T.toxicity(d.select("doc_id", "text", "lang"), lab.select("doc_id", "toxic")).collect()
    assert sorted(map(tuple, T.toxicity(d, lab).collect())) == sorted(map(tuple, plain))


def test_every_labelled_row_counts(spark):
    """A word of few toxic documents among more rows than fit one block is learned wherever its documents stand; nothing is sampled."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(words, 6)) + (" vile" if i % 3 == 0 and i % 9 else f" gruesome{i // 900}" if i % 9 == 0 else ""), "en") for i in range(9000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = d.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rows = d.join(lab, "doc_id").where("doc_id % 5 <> 0")
    made, _, _ = T.learned(rows, block=1500)
    plain = T.ConvText()
    seen = [(t, int(i % 3 == 0)) for i, t, _ in docs if i % 5 and T.key_of(t) % 5]
    plain.start(T.seen_in(seen), sum(1 - y for _, y in seen), sum(y for _, y in seen))
    rare = np.array([T.parts_of(f"gruesome{k}")[0] for k in range(10)])
    assert (plain.table[rare, 0] > 0.2).all()
    assert (made["table"][rare, 0] > 0.2).all()
    vectors = T.Vocabulary(made["table"])
    right = [(T._sigmoid(made["slope"] * T.logit(made, vectors(t)) + made["shift"]) >= 0.5) == (i % 3 == 0) for i, t, _ in docs]
    assert np.mean(right) > 0.97
    keys = d.select("text", F.xxhash64("text").alias("k")).limit(50).collect()
    assert all(T.key_of(r.text) == r.k for r in keys)


def calls(f) -> int:
    """How many functions, of Python or of C, ``f`` calls."""
    seen = [0]

    def count(frame, event, arg):
        seen[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return seen[0]


def test_work_of_a_text_is_not_done_word_by_word():
    """Learning and scoring call few functions for a new word (14 to 16 when each word was hashed and looked up by itself) and for a text of known words (210 in a pass of training)."""
    new = [" ".join(f"neuwort{i}x{j}" for j in range(200)) for i in range(60)]
    known = [" ".join(f"w{(i + j) % 20}" for j in range(40)) for i in range(640)]
    model = T.ConvText()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": new, "lang": ["en"] * 60})
    run = T._score(SimpleNamespace(value=model.compile()))
    assert calls(lambda: list(run([batch]))) < 13 * 60 * 200
    assert calls(lambda: T.seen_in([(t, i % 2) for i, t in enumerate(new)])) < 13 * 60 * 200
    assert calls(lambda: T.fold(model, [(t, i % 2) for i, t in enumerate(known)], (1.0, 1.0), [3, 0, 0])) < 130 * 640


def test_a_piece_of_the_last_words_adds_no_response(monkeypatch):
    """One or two words behind the last whole piece are no place for a wider filter: it would find words missing there that the whole text has."""
    made = T.ConvText()
    made.filters = [np.abs(f) for f in made.filters]  # absent words answer more than any that are there
    made.bias += 50
    model = made.compile()
    x = -np.abs(np.random.default_rng(4).normal(size=(200, T.DIM))).astype(np.float32)
    whole = {n: T.logit(model, x[:n]) for n in range(70, 90)}
    monkeypatch.setattr(T, "PIECE", 37)
    assert all(abs(T.logit(model, x[:n]) - z) < 1e-4 for n, z in whole.items())


def test_training_follows_the_gradient():
    """One batch changes the table by the slope of its loss, text by text, short and repeated words too."""
    texts, y, weights = ["a vile word", "plain", "two words", None, "vile vile " * 30], np.array([1, 0, 0, 1, 1]), (0.5, 2.0)
    model = T.ConvText(7)
    before = model.table.astype(np.float64)

    def loss(table):
        plain = {"table": table, "filters": start.filters, "bias": start.bias, "out": start.out, "offset": float(start.offset), "slope": 1.0, "shift": 0.0}
        p = [plain_score(plain, t) for t in texts]
        return sum(-weights[k] * np.log(q if k else 1 - q) / 32 for t, k, q in zip(texts, y, p, strict=True) if t)

    start = T.ConvText(7)
    model.fit(texts, y, weights, np.random.default_rng(1), dropout=0.0)
    for word in ("vile", "plain", "two", "words"):
        for row in set(T.parts_of(word)) - {1 << T.BITS}:
            for d in (0, 5):
                up, down = before.copy(), before.copy()
                up[row, d] += 1e-7
                down[row, d] -= 1e-7
                slope = (loss(up) - loss(down)) / 2e-7
                assert abs(model.table[row, d] - before[row, d] + 0.05 * slope) < 1e-6, (word, row, d)


def test_long_batches_are_learned_in_groups(monkeypatch):
    docs, labels = corpus(120)
    texts, y = [d[1] for d in docs], np.array([t for _, t in labels])
    whole, apart = T.ConvText(), T.ConvText()
    whole.fit(texts, y, (1.0, 1.0), np.random.default_rng(1))
    monkeypatch.setattr(T, "by_size", lambda rows, most=0: ([r] for r in rows))
    apart.fit(texts, y, (1.0, 1.0), np.random.default_rng(1))
    assert np.abs(whole.flat() - apart.flat()).max() < 1e-4
    assert np.abs(whole.flat() - T.ConvText().flat()).max() > 0.01
