"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are the byte 1- to 4-grams of the lower-cased text, in which every byte that is no letter counts as a space.
The embedding of a text is the mean over all of its subwords, so whole texts of any length take one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import annotate, col, fresh, ship

BUCKETS = 1 << 15
WIDTH = 16
GRAMS = (1, 2, 3, 4)
UNDETERMINED = "und"

#: Labelled texts taken for each language, about; which ones is fixed by a hash of the text.
ROWS_PER_LABEL = 800
#: Bytes of text taken for each language, about; bounds the sample where texts are long.
BYTES_PER_LABEL = 8 << 20
#: Texts of more bytes are not learned from (they are predicted like any other).
LONGEST_LEARNED = 1 << 20
#: Bytes of text taken for all languages together, about; where there are many, each gets less.
BYTES_IN_ALL = 128 << 20
#: Length of the linear layer's vectors at most; with the rate it keeps a step of SGD from overshooting.
LONGEST_VECTOR = 4.0

_FOLD = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of the whole text."""
    a = _FOLD[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    a = np.concatenate(([32], a, [32])).astype(np.uint32)
    if len(a) > 2:
        a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]  # runs of spaces count as one
    found, h = [], np.zeros(len(a), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            if len(a) < n:
                break
            h = h[: len(a) - n + 1] + (a[n - 1 :] + np.uint32(n)) * _ODD[n - 1]
            h = h ^ (h >> np.uint32(15))
            if n in GRAMS:
                found.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17))
    return np.concatenate(found).astype(np.int64)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(subwords(text), return_counts=True)
    return ids.astype(np.uint16), (counts / counts.sum()).astype(np.float32)  # BUCKETS fit; the sample's bags are held at once


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, text: str) -> np.ndarray:
        ids = subwords(text)
        if len(ids) > 4 * BUCKETS:
            mean = np.bincount(ids, minlength=BUCKETS) @ self.table / len(ids)
        else:
            mean = self.table[ids].mean(axis=0, dtype=np.float64)
        return _softmax((mean + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label or `und`, calibrated probability, rejected)."""
        if not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = self.scores(text)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] < self.reject_below)


def snippets(text: str, rng: np.random.Generator) -> list[str]:
    """The text, and a run of 1 to 12 of its words, so that short texts are learned too."""
    w = text.split()
    if len(w) < 4:
        return [text]
    k = int(rng.integers(1, 13))
    at = int(rng.integers(0, max(1, len(w) - k)))
    return [text, " ".join(w[at : at + k])]


def fit(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.25, seed: int = 11, lost: float = 0.002) -> Model:
    """rows: (text, label).  A fifth is kept from training to set the temperature and the threshold of rejection.

    A step moves the mean embedding of its text by the rate times the gradient, however many subwords share it, so that
    long texts and short ones are learned at one pace.  The temperature is the one of least log loss on the kept texts,
    with targets of (n + 1) / (n + 2) for n texts, so that a faultless n still tells no certainty.  The threshold is the
    probability under which a share `lost` of the rightly predicted kept texts fall, and 0.5 at most.  Weights that are
    not finite are an error.
    """
    rng = np.random.default_rng(seed)
    rows = sorted((t, y) for t, y in rows if has_letter(t))
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([UNDETERMINED], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    index = {y: k for k, y in enumerate(labels)}
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    bags = [(_bag(s), index[y], i in held) for i, (t, y) in enumerate(rows) for s in snippets(t, rng) if has_letter(s)]
    train = [(b, y) for b, y, h in bags if not h] or [(b, y) for b, y, _ in bags]
    emb = rng.standard_normal((BUCKETS, WIDTH)) / WIDTH
    out = rng.standard_normal((WIDTH, len(labels))) / WIDTH
    bias = np.zeros(len(labels))
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            (ids, share), y = train[k]
            lr = rate * (1 - step / steps)
            step += 1
            x = share @ emb[ids]
            err = _softmax(x @ out + bias)
            err[y] -= 1
            back = out @ err
            back /= max(1.0, np.linalg.norm(back))
            out -= lr * np.outer(x / max(1.0, np.linalg.norm(x)), err)
            out *= np.minimum(1.0, LONGEST_VECTOR / np.maximum(np.linalg.norm(out, axis=0), 1e-9))
            bias -= 0.1 * lr * err
            emb[ids] -= np.outer(share * (lr / (share @ share)), back)
    table = emb @ out
    if not (np.isfinite(table).all() and np.isfinite(bias).all()):
        raise FloatingPointError("training did not converge: weights are not finite")
    test = [(b, y) for b, y, h in bags if h] or [(b, y) for b, y, _ in bags]
    logits = np.array([share @ table[ids] + bias for (ids, share), _ in test])
    truth = np.array([y for _, y in test])
    target = np.full(logits.shape, 1 / (len(test) + 2) / max(1, len(labels) - 1))
    target[np.arange(len(truth)), truth] = (len(test) + 1) / (len(test) + 2)
    best = min(np.geomspace(0.01, 100, 161), key=lambda t: -(target * np.log(_softmax(logits / t) + 1e-300)).sum())
    p = _softmax(logits / best)
    right = p.argmax(axis=1) == truth
    below = float(np.quantile(p.max(axis=1)[right], lost)) if right.any() else 0.0
    return Model(labels, table, bias, float(best), min(0.5, below))


_FITTED = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("table", T.BinaryType()), T.StructField("bias", T.BinaryType()), T.StructField("temperature", T.DoubleType()), T.StructField("reject_below", T.DoubleType())])


def train(spark: SparkSession, docs: DataFrame, where: Column | None = None, text_col: str = "text", label_col: str = "lang", per_label: int = ROWS_PER_LABEL, bytes_per_label: int = BYTES_PER_LABEL) -> Model:
    """A model of the labels of `docs`, all of them, from a sample of per_label texts and bytes_per_label bytes for each
    label, about, and of BYTES_IN_ALL bytes in all.

    Rows with a null text or label, and texts of more than LONGEST_LEARNED bytes, are not learned from; equal texts of
    one label count once.  The sample is the texts with the smallest hashes, by a threshold set from the labels' counts
    and sizes, so that it is the same however the table is dealt out, and no table is sorted.
    """
    rows = docs.where(col(text_col).isNotNull() & col(label_col).isNotNull() & (F.lit(True) if where is None else where))
    rows = rows.select(col(text_col).cast("string").alias("t"), col(label_col).cast("string").alias("y")).where(F.octet_length("t") <= LONGEST_LEARNED)
    counts = rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size")).collect()  # one row a language
    if not counts:
        return fit([])
    bytes_per_label = min(bytes_per_label, BYTES_IN_ALL // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["y"], min(1.0, per_label / r["n"], bytes_per_label / max(1, r["size"])))])
    place = F.pmod(F.xxhash64("t"), F.lit(1_000_003)) / F.lit(1_000_003)
    taken = rows.where(place < F.coalesce(F.try_element_at(share, F.col("y")), F.lit(0.0))).distinct()
    ship(spark)
    arrow = to_arrow_schema(_FITTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit([r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        made = [[m.labels], [m.table.tobytes()], [m.bias.tobytes()], [m.temperature], [m.reject_below]]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    got = taken.coalesce(1).mapInArrow(run, _FITTED).collect()  # the sample is bounded, and one task fits it
    if not got:
        return fit([])
    r = got[0]
    return Model(r["labels"], np.frombuffer(r["table"]).reshape(-1, len(r["labels"])), np.frombuffer(r["bias"]), r["temperature"], r["reject_below"])


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def identify(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs' columns (`keep`, all by default) and a struct FIELDS; and that column's name.

    Null texts and texts without a letter are `und` with score 0 and rejected; all others get a learned label, its
    calibrated probability, and whether that is under the model's threshold.  Only the text decides.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def kernel(texts):
            got = [m.predict(t) for t in texts]
            return {n: [g[i] for g in got] for i, n in enumerate(FIELDS.names)}

        return kernel

    name = fresh(docs, "language")
    return annotate(docs, text_col, make, FIELDS, name, keep), name
