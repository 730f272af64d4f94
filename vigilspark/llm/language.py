"""Language identification: nearest of several clustered centroids per language.

Texts become normalised TF-IDF vectors of hashed byte bigrams and trigrams; each
language's training vectors are clustered by spherical k-means; the prediction is the
language of the centroid with the largest cosine. A text is rejected when that cosine is
below the language's own threshold for texts of its length, a share of the lowest one of
training excerpts of at most this length (short texts have low cosines), or when it has
no letters (prediction "und").

Document frequencies count every training document. The clusters are fitted on a bounded
sample: the SAMPLE distinct texts of each language whose hashes are lowest, so copies of
a text count once and every language with letters in its texts has centroids.

Defined results: null text or text without letters is "und" with score 0; languages come
from non-null labels only, and one whose sampled texts have no letters is never
predicted; without any labelled document all texts are "und"; of equal cosines the
language that comes first in the alphabet counts; documents with null
doc_id are learnt from; repeated rows are judged each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

BUCKETS = 4096
#: Distinct training texts per language that the centroids are fitted on, at most.
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected below this share of the lowest cosine that the language's training texts have with their centroids.
SHARE_OF_LOWEST = 0.5
#: Lengths of the excerpts of training texts that the thresholds are taken from; a shorter text with letters is not rejected.
LENGTHS = (16, 64, 256, 1024, 4096)
_TO_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of one of the Unicode letter categories is there; numerals are none."""
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of the lower-cased letters and single spaces."""
    raw = (text if text.isascii() else text.lower()).encode().translate(_TO_LETTERS)
    b = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << 8
    three = two[:-1] | b[2:] << 16
    code = np.concatenate([two * np.uint32(2654435761) >> 20, (three + np.uint32(1 << 24)) * np.uint32(2246822519) >> 20])
    return np.bincount(code, minlength=BUCKETS)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit TF-IDF vectors with sublinear counts."""
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def clusters(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; always the same for the same rows."""
    seeds = [int((vectors @ vectors.mean(axis=0)).argmax())]
    near = vectors @ vectors[seeds[0]]
    for _ in range(min(k, len(vectors)) - 1):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    centres = vectors[seeds]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.array([vectors[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, least: list[list[float]]):
        """langs, centres, least: language, vector and, by LENGTHS, smallest accepted cosine of each centroid."""
        self.idf, self.langs, self.centres = idf, langs, centres
        self.least = np.array([[0.0, *row] for row in least]).reshape(-1, 1 + len(LENGTHS))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        told = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        if told:
            cosine = weigh(np.array([grams(texts[i]) for i in told]), self.idf) @ self.centres.T
            best = cosine.argmax(axis=1)
            least = self.least[best, np.searchsorted(LENGTHS, [len(texts[i]) for i in told], side="right")]
            for i, k, s, low in zip(told, best.tolist(), np.clip(cosine.max(axis=1), 0, 1).tolist(), least.tolist(), strict=True):
                langs[i], scores[i], rejected[i] = self.langs[k], s, s < low
        return langs, scores, rejected


def fit(train: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, share_of_lowest: float = SHARE_OF_LOWEST) -> Model:
    """Fit on train (text, lang); rows with null lang, or text without letters, teach nothing."""
    train = train.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen += grams(t) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], seen]))], names=["bucket", "n"])

    df = np.zeros(BUCKETS + 1)
    for bucket, n in map_arrow(train.select("text"), frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS + 1 rows
        df[bucket + 1] = n
    idf = np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32) + 0.1
    # texts below a hash that about twice the sample are below, copies left out in every task, then the lowest of them
    place = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    rates = train.groupBy("lang").agg((F.lit(2.0 * sample) / F.approx_count_distinct(F.xxhash64("text"))).alias("rate"))
    drawn = train.withColumn("place", place).join(F.broadcast(rates), "lang").where("place <= rate")  # a row per language is broadcast
    order = Window.partitionBy("lang").orderBy("place", "text")
    picked = drawn.select("lang", "place", "text").distinct().withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= sample).select("lang", "text")

    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t for t in rows["text"] if has_letter(t))
        if not texts:
            return pd.DataFrame({"lang": pd.Series(dtype=object), "vector": pd.Series(dtype=object), "least": pd.Series(dtype=object)})
        vectors = weigh(np.array([grams(t) for t in texts]), idf)
        found = clusters(vectors, k)
        least = []
        for n in LENGTHS:
            cut = [x for t in texts if has_letter(x := t[:n])]
            least.append(share_of_lowest * float((weigh(np.array([grams(x) for x in cut]), idf) @ found.T).max(axis=1).min()) if cut else 0.0)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [c.astype("<f4").tobytes() for c in found], "least": [np.maximum.accumulate(least)] * len(found)})

    got = sorted(tuple(r) for r in picked.groupBy("lang").applyInPandas(centre, "lang string, vector binary, least array<double>").collect())
    centres = np.array([np.frombuffer(v, "<f4") for _, v, _ in got]) if got else np.zeros((0, BUCKETS), np.float32)
    return Model(idf, [lang for lang, *_ in got], centres, [x for *_, x in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred, score and rejected; docs needs text. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = [], [], []
            texts = b.column(at).to_pylist()
            for i in range(0, len(texts), 256):
                for all_, part in zip((langs, scores, rejected), model.predict(texts[i : i + 256]), strict=True):
                    all_ += part
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_arrow(docs, run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learnt from; one without doc_id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    flagged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(flagged, model).drop("text").select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of an identified language stay, whatever their doc_id and repeated ones each; null texts and texts without letters go."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).where(~F.col("rejected")).select(*docs.columns)
