"""Language identification by nearest centroid (operator 2).

Texts become TF-IDF vectors of hashed letter n-grams, scaled to length one.
Each language has several centroids from spherical k-means over its vectors; a
text gets the language of the centroid of greatest cosine. It is rejected if
that cosine is below what the centroid's own training texts reach.

The model is fitted on a sample of the distinct labelled texts, about FIT_ROWS
for each language, chosen by a hash of the text, so a text that is repeated
counts once; the sample and its IDF are the only things bounded. Prediction reads
every text whole, row by row, without a shuffle.

Defined cases: of centroids that are equally near, the one of the least language
(then the first of its centroids) is taken; null texts and texts without letters are `und` with score 0; so
is every text if nothing is labelled; equal texts get equal predictions; a null
doc_id counts as not held out; other columns are ignored, and lang, source and
doc_id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import crc_mod, materialize, table

BUCKETS = 2048
FIT_ROWS = 1000
CENTROIDS = 4
ROUNDS = 12
MAX_LANGUAGES = 2000
REJECT_QUANTILE = 0.002
REJECT_MARGIN = 0.8
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the letter n-grams, one to three long, of a lower-cased text; None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return None
    code = np.where(is_letter, code, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    code = np.concatenate([np.full(1, 32, np.uint32), code[keep], np.full(1, 32, np.uint32)])
    out = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in (1, 2, 3):
        h = np.full(len(code) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint32(0x01000193)
        out += np.bincount((h * np.uint32(0x9E3779B1)) >> shift, minlength=BUCKETS)
    return out


def vector(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit length, and each row's. Starts from the row nearest the mean, then the farthest rows."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centre = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        total = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(k)])
        centre = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return centre, np.argmax(x @ centre.T, axis=1)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        known = [(k, c) for k, x in enumerate(texts) if (c := counts(x)) is not None]
        lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known and self.languages:
            near = np.stack([vector(c, self.idf) for _, c in known]) @ self.centroids.T
            best = near.argmax(axis=1)
            for (k, _), j, row in zip(known, best, near):
                lang[k], score[k], rejected[k] = self.languages[j], float(min(1.0, max(0.0, row[j]))), bool(row[j] < self.floors[j])
        return lang, score, rejected


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` distinct texts of each language, by a hash of the text; (lang, text).

    How many there are is a sketch's estimate, which is off by some hundredths.
    """
    found = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    n = {r["lang"]: r["n"] for r in found.limit(MAX_LANGUAGES + 1).collect()}
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not n:
        return labelled.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(v) for lang, k in n.items() for v in (lang, min(1.0, rows / max(1, k)))])
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(u < share[F.col("lang")]).select("lang", "text").distinct()


def fit(labelled: DataFrame, rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model:
    """Fit on (lang, text) rows whose lang isn't null."""
    spark = labelled.sparkSession

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, c.astype(np.int32).tobytes()) for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (c := counts(x)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names=["lang", "counts"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total += np.frombuffer(c, np.int32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["seen", "n"])

    held = materialize(sample(labelled, rows).mapInArrow(features, "lang string, counts binary").repartition(8), "langid")
    parts = held.select("counts").mapInArrow(seen, "seen binary, n long").collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return Model(np.zeros(BUCKETS), np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    idf = np.log((1 + n) / (1 + sum(np.frombuffer(r["seen"], np.int64) for r in parts))) + 1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([vector(np.frombuffer(c, np.int32), idf) for c in sorted(pdf["counts"])])
        centre, own = spherical_kmeans(x, k)
        near = (x * centre[own]).sum(axis=1)
        floors = [float(np.quantile(near[own == j], REJECT_QUANTILE)) * REJECT_MARGIN if (own == j).any() else 1.0 for j in range(len(centre))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "j": range(len(centre)), "centroid": [c.tobytes() for c in centre], "floor": floors})

    found = held.groupBy("lang").applyInPandas(cluster, "lang string, j long, centroid binary, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["j"]))
    return Model(idf, np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), [r["lang"] for r in found], np.array([r["floor"] for r in found]))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score, rejected of every row."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                lang, score, rejected = model.predict(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = fit(docs.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"))
    return identify(docs, model, keep=("doc_id", "held_out"))
