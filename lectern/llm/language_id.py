"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Hash buckets of n-grams, and labelled documents of each language that the classifiers are fitted on.
BUCKETS, SAMPLE = 4096, 600
#: Labelled documents of all languages that the classifiers are fitted on at most, and how many times a language's sample is ranked.
MOST, OVER = 24_000, 4
#: A prediction is ambiguous if its probability leads the next language's by less than this.
LEAD = 0.2
LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)] + [False])


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of hashed letter n-grams, n = 1 to 3, words padded by spaces; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[np.minimum(points, len(LETTERS) - 1)]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([32], np.where(letter, points, 32)[keep], [32])).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    grams = np.concatenate((c * np.uint32(3), two * np.uint32(5), three * np.uint32(7)))
    shift = np.uint32(32 - int(math.log2(BUCKETS)))
    counts = np.bincount((grams * np.uint32(0xC2B2AE35)) >> shift, minlength=BUCKETS)
    return np.sqrt(counts / len(grams)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: all ways to part the languages for up to five, else random bits with distant words."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T
    rng, best, gap = np.random.default_rng(7), None, -1
    length = math.ceil(10 * math.log2(k))
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.float32), (k, length))
        apart = (length - code @ code.T) / 2 + length * np.eye(k)
        if apart.min() > gap and (np.abs(code.sum(0)) < k).all():
            best, gap = code, apart.min()
    return best


@dataclass
class Model:
    """weights, bias: of the binary classifiers; trust: each bit's weight in decoding."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for rows x, from the trust-weighted logistic loss to each codeword."""
        if len(self.languages) == 1:
            return np.ones((len(x), 1))
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, labels: list[str], steps: int = 120) -> Model:
    """Logistic regressions by gradient descent with momentum, a bit of the codewords each."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    weight = np.array([1 / labels.count(v) for v in languages], np.float32)[[languages.index(v) for v in labels]]
    weight = (weight / weight.sum())[:, None]
    for _ in range(steps):
        pull = weight * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw, vb = 0.9 * vw + 8.0 * (x.T @ pull - 1e-4 * w), 0.9 * vb + 8.0 * pull.sum(0)
        w, b = (w + vw).astype(np.float32), (b + vb).astype(np.float32)
    wrong = (weight * (y * (x @ w + b) <= 0)).sum(0)
    return Model(languages, code, w, b, np.clip(1 - 2 * wrong, 0.05, 1).astype(np.float32))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST) -> Model | None:
    """Fits on up to `sample` documents of each language, and `most` in all: those whose ids have the least hashes.

    Only documents with an id, a text and a language that aren't held out. Rows of one id and language count as one
    document, whose text is that of the least hash. A first pass over ids and languages counts each language's ids; ids whose hash lies
    beneath the share that holds OVER times the sample are then ranked, so that ranking gets a few thousand rows of a language whatever the
    corpus or its number of partitions. Should too few pass, all are ranked. Executors make the features, so the driver
    gets at most `most` rows of a few KB (the n-grams that a text has, 16 KB at most), whatever the corpus, its copies or the texts' lengths.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, min(sample, most // len(counts)))
    place = F.shiftrightunsigned(F.xxhash64("id"), 33).cast("double") / 2.0**31

    def ranked(rates: dict[str, float]) -> list[Row]:
        rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
        documents = known.where(place <= F.try_element_at(rate, F.col("lang"))).groupBy("lang", "id").agg(F.min(F.xxhash64("text")).alias("least"))
        order = Window.partitionBy("lang").orderBy(place, F.xxhash64("id"), "id")
        return documents.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).drop("rank").collect()

    rates = {lang: min(1.0, OVER * each / n) for lang, n in counts.items()}
    rows = ranked(rates)
    got = Counter(r.lang for r in rows)
    short = {lang: 1.0 for lang, rate in rates.items() if rate < 1 and got[lang] < each}
    if short:
        rows = [r for r in rows if r.lang not in short] + ranked(short)
    chosen = docs.sparkSession.createDataFrame(rows, f"lang string, id {known.schema['id'].dataType.simpleString()}, least long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies of a document's text in this task
        for batch in batches:
            found = []
            for i, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (i, lang) not in seen:
                    seen.add((i, lang))
                    if (x := features(text.as_py())) is not None:
                        at = np.flatnonzero(x)
                        found.append((i, lang, at.astype(np.uint16).tobytes() + x[at].tobytes()))
            arrays = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((batch.schema.field(0).type, pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "lang", "x"])

    texts = known.join(F.broadcast(chosen), ["id", "lang"]).where(F.xxhash64("text") == F.col("least")).select("id", "lang", "text")
    made = texts.mapInArrow(run, f"id {known.schema['id'].dataType.simpleString()}, lang string, x binary")
    rows = made.groupBy("id", "lang").agg(F.min("x").alias("x")).select("lang", "x").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for k, r in enumerate(rows):
        n = len(r.x) // 6
        x[k, np.frombuffer(r.x, np.uint16, n)] = np.frombuffer(r.x, np.float32, n, 2 * n)
    return fit(x, [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the decoded probability), ambiguous.

    Null text, or no letter, or no model: `und`, score 0, not ambiguous. Whole texts of any length; empty
    tables give no rows; repeated rows a row each; null ids stay. Other columns, the language among them, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = batch.num_rows, batch.column(2)
            pred, score, close = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            for start in range(0, n if model else 0, 256):
                found = [(i, x) for i in range(start, min(n, start + 256)) if (t := texts[i].as_py()) and (x := features(t)) is not None]
                if not found:
                    continue
                p = model.decode(np.stack([x for _, x in found]))
                top = p.argmax(1)
                first = p[np.arange(len(p)), top]
                second = np.where(np.arange(p.shape[1]) == top[:, None], 0, p).max(1)
                for (i, _), k, a, b in zip(found, top, first, second, strict=True):
                    pred[i], score[i], close[i] = model.languages[k], a, a - b < LEAD
            arrays = [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(close)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
