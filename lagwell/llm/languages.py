"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes its letters in lower case, with one blank for every run of
anything else, and is counted in hashed runs of one to three symbols. A
vector holds (1 + ln count) times the inverse document frequency at each
feature and is scaled to length one. Each language is clustered into several
centroids by spherical k-means; a text takes the language of the centroid of
largest cosine. A text farther from it than the centroid's own members ever
are, by a margin, is rejected.

Document frequencies and counts of languages come from every labelled row. The
clusters are fitted on a bounded sample of labelled rows, ``per_language`` of
each language on average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.llm.batches import U, mix, slices, small_batches, texts
from lagwell.plans.lineage import materialize

#: Hashed features; symbols of a run.
FEATURES, RUNS = 1 << 15, (1, 2, 3)
#: Labelled rows of a language that its centroids are fitted on, about; centroids of a language at most; rounds of clustering.
PER_LANGUAGE, CENTROIDS, ROUNDS = 400, 4, 12
#: Languages at most: their centroids are sent to every task, 128 KiB each.
MOST_LANGUAGES = 256
#: A text is rejected where its cosine lies this many standard deviations (the centroid's or the language's, the larger) under the mean of the centroid's members.
REJECT = 6.0
#: Code points that are counted at once; bounds memory, longer texts are counted in parts that add up.
PART = 1 << 20
UNDEFINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its letter in lower case, or 0 where it is none."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def symbols(text: str) -> np.ndarray:
    """Letters in lower case, a 0 for each run of anything else, and a 0 at both ends; empty without letters."""
    found = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not found.any():
        return np.zeros(0, np.uint32)
    found = np.concatenate([np.zeros(1, np.uint32), found, np.zeros(1, np.uint32)])
    return found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]


def _hashed(s: np.ndarray) -> np.ndarray:
    """The feature of every run of each length in ``RUNS``."""
    out, h = [], np.zeros(len(s), U)
    for n in range(1, max(RUNS) + 1):
        if len(s) < n:
            break
        h = mix(h[: len(s) - n + 1] * U(0x100000001B3) + s[n - 1 :].astype(U) + U(n))
        if n in RUNS:
            out.append((h >> U(64 - FEATURES.bit_length() + 1)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def counted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text's symbols, ascending, and how often each occurs."""
    if len(s) <= PART:
        return np.unique(_hashed(s), return_counts=True)
    total, most = np.zeros(FEATURES, np.int64), max(RUNS) - 1
    for a in range(0, len(s), PART):
        part = s[a : a + PART]
        total += np.bincount(_hashed(part), minlength=FEATURES)
        edge = s[max(0, a - most) : a + most]  # runs across the cut: those of the edge less those of its two halves
        if a:
            total += np.bincount(_hashed(edge), minlength=FEATURES)
            for half in (s[max(0, a - most) : a], s[a : a + most]):
                total -= np.bincount(_hashed(half), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def weighed(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The values of a vector of length one."""
    v = (1.0 + np.log(count)) * idf[at]
    length = np.sqrt((v * v).sum())
    return v / length if length > 0 else v


def _learnable(doc_id: Column, lang: Column) -> Column:
    return lang.isNotNull() & (F.crc32(doc_id.cast("string")) % 5 != 0)


def _gathered(rows: DataFrame) -> DataFrame:
    """Of the rows ``(lang, chosen, text)``: ``(feature, n)`` partial document frequencies, and ``(lang, at, count)`` of the chosen ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for part in slices(batch):
                kept: list[tuple[str, list[int], list[int]]] = []
                for text, lang, chosen in zip(texts(part.column("text")).to_pylist(), part.column("lang").to_pylist(), part.column("chosen").to_pylist(), strict=True):
                    at, count = counted(symbols(text))
                    df[at] += 1
                    if chosen and len(at):
                        kept.append((lang, at.tolist(), count.tolist()))
                if kept:
                    yield shaped([None] * len(kept), [None] * len(kept), *zip(*kept, strict=True))
        at = np.flatnonzero(df)
        if len(at):
            nothing = [None] * len(at)
            yield shaped(at.tolist(), df[at].tolist(), nothing, nothing, nothing)

    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])

    def shaped(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "feature int, n long, lang string, at array<int>, count array<long>")


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: ``(centroids of length one, the row's own)``.

    The first centroid is the mean's direction, each further one the row
    farthest from those before; an empty cluster goes. Rows come in a fixed
    order, so the result does not depend on the partitioning.
    """
    first = x.mean(0)
    c = [first / max(np.linalg.norm(first), 1e-12)]
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        c.append(x[int(near.argmin())])
        near = np.maximum(near, x @ c[-1])
    centroids = np.stack(c)
    own = np.full(len(x), -1)
    for _ in range(rounds):
        now = (x @ centroids.T).argmax(1)
        if (now == own).all():
            break
        own = now
        sums = np.stack([x[own == j].sum(0) for j in range(len(centroids))])
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-12)[:, None], centroids)
    used = np.unique(own)
    return centroids[used], np.searchsorted(used, own)


@dataclass(frozen=True)
class Model:
    """What a prediction needs: inverse document frequencies, centroids in columns, the language and the least cosine of each."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, cosine, rejected)``; ``und`` and 0 where the text has no letter or the model no language."""
        s = symbols(text or "")
        if not len(s) or not self.langs:
            return UNDEFINED, 0.0, True
        at, count = counted(s)
        cosine = weighed(at, count, self.idf).astype(np.float32) @ self.centroids[at]
        best = int(cosine.argmax())
        score = min(1.0, max(0.0, float(cosine[best])))
        return self.langs[best], score, score < float(self.least[best])


def fit(docs: DataFrame, *, id_col: str = "doc_id", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from ``text`` and non-NULL ``lang`` of the rows that may be learned from (``crc32(id) % 5 != 0``; not NULL ids).

    Two passes: the columns of ids and languages alone, for how many rows each
    language has; then the texts, for document frequencies over every row
    and the features of the rows drawn for the centroids, by a hash of id and
    text. A language of ``per_language`` rows or fewer gives all of them; equal
    vectors count once there.
    Texts without letters teach nothing; without any other the model
    predicts ``und``. More languages than ``most_languages`` are an error,
    as every task holds the centroids.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), "lang", "text").where(_learnable(F.col("doc_id"), F.col("lang")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return Model(np.zeros(FEATURES), np.zeros((FEATURES, 0), np.float32), (), np.zeros(0))
    share = F.create_map(*(F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, per_language / n))))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    small_batches(spark)
    gathered = materialize(_gathered(known.select("lang", (drawn < F.element_at(share, F.col("lang"))).alias("chosen"), "text")))
    df = np.zeros(FEATURES)
    for r in gathered.where("feature is not null").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["feature"]] = r["n"]
    idf = np.log((1.0 + sum(sizes.values())) / (1.0 + df)) + 1.0

    def grouped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = sorted((tuple(a), tuple(c)) for a, c in zip(rows["at"], rows["count"], strict=True))
        x = np.zeros((len(order), FEATURES), np.float32)
        for i, (at, count) in enumerate(order):
            x[i, list(at)] = weighed(np.array(at), np.array(count), idf)
        c, own = cluster(x, centroids)
        near = (x * c[own]).sum(1)
        wide = near.std()  # a centroid of few members has no spread of its own
        spread = [(near[own == j].mean(), max(wide, near[own == j].std())) for j in range(len(c))]
        return pd.DataFrame({"lang": key[0], "k": range(len(c)), "centroid": [v.astype(np.float32).tobytes() for v in c], "least": [float(m - REJECT * d) for m, d in spread]})

    found = gathered.where("lang is not null").select("lang", "at", "count").distinct().groupBy("lang").applyInPandas(grouped, "lang string, k int, centroid binary, least double")
    rows = sorted(found.collect(), key=lambda r: (r["lang"], r["k"]))
    c = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows], axis=1) if rows else np.zeros((FEATURES, 0), np.float32)
    return Model(idf, c, tuple(r["lang"] for r in rows), np.array([r["least"] for r in rows]))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """``(id, held_out, lang_pred, score, rejected)`` of every row, from its whole text alone.

    ``und`` with score 0 where the text is NULL or has no letter. ``rejected``
    is true there and where the text is too far from the centroid it is
    nearest to; the language is named all the same. Ties go to the language
    first by name. Rows with a NULL id are predicted too and not held out;
    repeated ids give a row each; other columns do not matter.
    """
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                found = [own.predict(t) for t in part.column("text").to_pylist()]
                lang, score, far = (list(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by centroids of four fifths of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
