"""Quality classifier by attention-based multiple-instance learning (operator 5).

A document is a bag of passages of PASSAGE words.  Every passage of the
whole text is encoded from its words, by learned vectors of their hashes, and
from its surface (word shapes, marks, repetition); a hidden layer and gated
attention, learned together with the word vectors from document labels alone,
weigh the passages, and the weighted representation is scored.

Training takes a bounded sample of labelled rows, SAMPLE_ROWS at most, those
of smallest seeded hash, and of a long one some passages, SAMPLE_PASSAGES at
most, evenly spread; scoring covers all passages of all rows.  Same sample,
same weights: training is seeded and single-threaded.

Defined cases: null, empty and wordless texts are one passage of zeros and
get the score that it has; without labelled rows of both kinds the score is
the labels' mean, 0.5 without labels; repeated ids are scored row by row; a
text over SLICE_BYTES is cut into runs at white space, and a run's last
passage may be shorter; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.llm import common
from formspark.llm.textscan import hashes_of, lowered, pieces, running_sums, spaces, word_spans

PASSAGE = 48
SAMPLE_ROWS, SAMPLE_PASSAGES = 6000, 32
#: Hashed words, and the numbers of a word's vector.
WORDS, WIDE = 2048, 8
HIDDEN, GATE = 24, 16
EPOCHS, BATCH, RATE, DECAY = 16, 64, 6e-3, 1e-4

# byte classes that are counted: lower, upper, digit, sentence marks, other marks, beyond ASCII
_KIND = np.full(256, 4, np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 5
_KIND[[*b".,;:'\"-()?"]] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = -1
FEATURES = 18


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages' surface, each row's first passage (one more entry than rows), hashed words, and each one's passage."""
    n_rows = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=n_rows)
    passages = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate(([0], np.cumsum(passages)))
    out = np.zeros((int(first[-1]), FEATURES))
    if not len(starts):
        return out, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(starts)) - np.concatenate(([0], np.cumsum(words)[:-1]))[rows]
    passage = first[rows] + place // PASSAGE

    kind = _KIND[data]
    size = (ends - starts).astype(float)
    marks = []
    for k in range(6):
        sums = np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32)))
        marks.append((sums[ends] - sums[starts]).astype(float))
    lower, upper, digit, sentence, other, beyond = marks
    low = hashes_of(running_sums(lowered(data)), starts, ends)
    same = np.zeros(len(low))
    same[1:] = (low[1:] == low[:-1]) & (passage[1:] == passage[:-1])
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (low >> np.uint64(24)))
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    letters = np.maximum(lower + upper + beyond, 1)
    wordless = (lower + upper + beyond + digit == 0).astype(float)
    stop = np.isin(data[ends - 1], np.frombuffer(b".?!", np.uint8)).astype(float)
    line = np.zeros(len(starts))
    broken = np.concatenate(([0], np.cumsum((data == 0x0A), dtype=np.int32)))
    line[1:] = (broken[starts[1:]] - broken[ends[:-1]] > 0) & (rows[1:] == rows[:-1])
    columns = [size, size**2, lower / size, upper / size, digit / size, sentence / size, other / size, beyond / size, same, wordless, stop, line, (upper == letters) * (size > 1), other > 0, size == 1, size > 12]
    count = np.bincount(passage, minlength=len(out)).astype(float)
    some = np.maximum(count, 1)
    for i, c in enumerate(columns):
        out[:, i] = np.bincount(passage, weights=c, minlength=len(out)) / some
    out[:, 1] = np.sqrt(np.maximum(out[:, 1] - out[:, 0] ** 2, 0))
    out[:, 16] = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(out)) / some
    out[:, 17] = np.log1p(count)
    return out, first, (low >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64), passage


def bags(texts: pa.Array):
    """(surface, first passages, words, passage of each word, rows) by runs of whole rows."""
    held: list[tuple] = []

    def whole(parts: list[tuple]) -> tuple:
        x = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        return x, np.array([0, len(x)]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] + s for p, s in zip(parts, shift, strict=False)]), parts[0][4]

    for rows, data, offsets in pieces(texts, may_cut=spaces):
        part = (*encode(data, offsets), rows)
        if held and rows[0] != held[0][4][0]:
            yield whole(held)
            held = []
        if len(rows) == 1:
            held.append(part)
        else:
            yield part
    if held:
        yield whole(held)


class Attention:
    """h = tanh(A[x, mean of E]); weights softmax of w.(tanh(Vh) * sigmoid(Uh)); score sigmoid(c.sum + b)."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(scale=1 / np.sqrt(shape[0]), size=shape)
        self.p = {"E": rng.normal(scale=0.1, size=(WORDS, WIDE)), "A": draw(FEATURES + WIDE, HIDDEN), "a": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE, 1), "c": draw(HIDDEN, 1), "b": np.zeros(1)}
        self.mean, self.scale, self.flat = np.zeros(FEATURES), np.ones(FEATURES), None

    def _means(self, n: int, words: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Mean word vector of each of ``n`` passages; words follow their passages."""
        out = np.zeros((n, WIDE))
        if len(words):
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[of[begin]] = np.add.reduceat(self.p["E"][words], begin, axis=0) / np.diff(np.concatenate((begin, [len(of)])))[:, None]
        return out

    def _forward(self, x: np.ndarray, first: np.ndarray, words: np.ndarray, of: np.ndarray) -> tuple:
        p = self.p
        x = np.concatenate([x, self._means(len(x), words, of)], axis=1)
        h = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = ((t * g) @ p["w"])[:, 0]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], first[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))[:, 0]
        return x, h, t, g, weight, bag, z, score

    def scores(self, x: np.ndarray, first: np.ndarray, words: np.ndarray, of: np.ndarray) -> np.ndarray:
        if self.flat is not None or len(first) < 2:
            return np.full(len(first) - 1, 0.5 if self.flat is None else self.flat)
        return self._forward((x - self.mean) / self.scale, first, words, of)[-1]

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Attention:
        """Logistic loss by Adam, seeded; a bag is its passages' surface, its words and their passages."""
        if len(set(labels.tolist())) < 2:
            self.flat = float(labels.mean()) if len(labels) else 0.5
            return self
        every = np.concatenate([x for x, _, _ in bags])
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-6
        bags = [((x - self.mean) / self.scale, words, of) for x, words, of in bags]
        rng = np.random.default_rng(1)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            order = rng.permutation(len(bags))
            for a in range(0, len(order), BATCH):
                own = [bags[i] for i in order[a : a + BATCH]]
                first = np.concatenate(([0], np.cumsum([len(x) for x, _, _ in own])))
                words = np.concatenate([w for _, w, _ in own])
                of = np.concatenate([o + f for (_, _, o), f in zip(own, first, strict=False)])
                grad = self._gradient(np.concatenate([x for x, _, _ in own]), first, words, of, labels[order[a : a + BATCH]])
                step += 1
                for k, g in grad.items():
                    g = g + DECAY * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, first: np.ndarray, words: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, weight, bag, z, score = self._forward(x, first, words, of)
        ds = (score - y)[:, None] / len(y)
        dz = ds @ p["c"].T
        dh = weight[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(axis=1)
        de = weight * (dw - np.add.reduceat(weight * dw, first[:-1])[bag])
        dtg = de[:, None] @ p["w"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        da = dh * (1 - h * h)
        vector = (da @ p["A"][FEATURES:].T) / np.maximum(np.bincount(of, minlength=len(x)), 1)[:, None]
        vectors = np.stack([np.bincount(words, weights=vector[of, j], minlength=WORDS) for j in range(WIDE)], axis=1)
        return {"E": vectors, "A": x.T @ da, "a": da.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de[:, None], "c": z.T @ ds, "b": ds.sum(axis=0)}


def _bags(batches):
    """The sample's bags: of a long text SAMPLE_PASSAGES passages, evenly spread."""
    for batch in batches:
        rows = []
        for x, first, words, of, _ in bags(batch.column(2)):
            bounds = np.searchsorted(of, first)
            for i in range(len(first) - 1):
                n, w, o = first[i + 1] - first[i], words[bounds[i] : bounds[i + 1]], of[bounds[i] : bounds[i + 1]] - first[i]
                chosen = np.unique(np.linspace(0, n - 1, min(n, SAMPLE_PASSAGES)).astype(np.int64))
                keep = np.isin(o, chosen)
                rows.append(tuple(a.tobytes() for a in (x[first[i] : first[i + 1]][chosen].astype(np.float32), w[keep].astype(np.uint16), np.searchsorted(chosen, o[keep]).astype(np.uint16))))
        columns = zip(*rows, strict=True) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in columns)], ["h", "label", "bag", "words", "passages"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Attention:
    """A classifier from ``labels`` (id, label 0 or 1), or from a bounded sample of them."""
    lot = F.xxhash64(F.col(id_col), F.lit(13))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), lot.alias("h"))
    chosen = common.sample(known, sample_rows, ["__id", "label"], 13)
    # sample_rows rows of three numbers
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("h", "label", "text")
    found = rows.mapInArrow(_bags, "h long, label int, bag binary, words binary, passages binary")
    # an id may repeat: again the smallest, in an order that reruns share
    found = found.orderBy("h", "label", "bag", "words").limit(sample_rows).collect()
    bags = [(np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(r["words"], np.uint16).astype(np.int64), np.frombuffer(r["passages"], np.uint16).astype(np.int64)) for r in found]
    return Attention().fit(bags, np.array([r["label"] for r in found], float))


def score(model, text: Column) -> Column:
    """Scores of whole texts by a broadcast ``Attention``."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for x, first, words, of, rows in bags(texts):
            out[rows] = model.value.scores(x, first, words, of)
        common.give_back()
        return pa.array(out)

    return run(text)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.lean(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2
    labels = common.table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "quality")
    model = spark.sparkContext.broadcast(fit(docs, labels, "doc_id", "text", "quality"))
    scored = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
