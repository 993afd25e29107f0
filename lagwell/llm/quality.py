"""Quality rules: counts of words and symbols, and how much of a text repeats itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.llm.batches import U, code_points, mix, prefix_hash, raw, slices, small_batches, span_hash, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    ``coverage`` maps an n-gram length to the largest share of word
    characters that may lie inside n-grams found twice or more in the text;
    ``line_coverage`` is the same for whole lines (repeats and first alike).
    ``symbol_share`` is the largest number of symbols per word.
    """

    min_words: int = 50
    repeat_window: int = 3
    repeat_share: float = 0.5
    coverage: tuple[tuple[int, float], ...] = ((5, 0.5), (10, 0.45))
    line_coverage: float = 0.5
    symbol_share: float = 0.15


def _covered(hashes: np.ndarray, first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """True for words inside a ``k``-word window that occurs twice or more in its row."""
    out = np.zeros(n_words + 1, np.int64)
    at, h = windows(hashes, first, k)
    if len(at):
        row = np.searchsorted(first, at, "right").astype(U)
        key = mix(h + row * U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] = same
        twice[:-1] |= same
        hit = at[order[twice]]
        out += np.bincount(hit, minlength=n_words + 1) - np.bincount(hit + k, minlength=n_words + 1)
    return np.cumsum(out)[:-1] > 0


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Every count of every row of a chunk."""
    starts, ends, first = words(data, offsets)
    rows = len(offsets) - 1

    def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(code_points(data), dtype=np.int64)])
    chars = points[ends] - points[starts]
    h = prefix_hash(data)
    hashes = span_hash(h, starts, ends)
    out = {"n_words": np.diff(first), "word_chars": per_row(chars, first), "n_symbols": per_row(_SYMBOL[data], offsets)}
    out["n_repeat_words"] = per_row(_covered(hashes, first, rules.repeat_window, len(starts)), first)

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.append(line_start[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, line_start)])
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lo, hi = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    inked = hi > lo
    line_start, line_end, line_row, lo, hi = (x[inked] for x in (line_start, line_end, line_row, lo, hi))
    word_sum = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars)])
    line_chars = word_sum[hi] - word_sum[lo]
    key = mix(span_hash(h, line_start, line_end) + line_row.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1] if len(order) else np.zeros(0, bool)
    later, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    out["dup_line_chars"] = np.bincount(line_row[twice], weights=line_chars[twice], minlength=rows).astype(np.int64)
    for k, _ in rules.coverage:
        out[f"dup_{k}gram_chars"] = per_row(chars * _covered(hashes, first, k, len(starts)), first)
    return out


def quality_rules(df: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    NULL, empty and wordless texts have zero words, so the base rule fails
    them. Rows that repeat an id or a text, or have no id, are measured each;
    columns other than the id are dropped, whatever their names. An empty
    table gives an empty result. Whole texts of any length are measured in
    one pass without a shuffle.
    """
    small_batches(df.sparkSession)
    rules = rules or Rules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{k}gram_chars" for k, _ in rules.coverage)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = measure(*raw(part.column("text")), rules)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[x].astype(np.int64)) for x in names)], ["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    counts = df.selectExpr(f"`{id_col}` id", f"`{text_col}` text").mapInArrow(run, f"id {kind}, " + ", ".join(f"{x} long" for x in names))
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > round(100 * rules.repeat_share) * F.col("n_words"))
    repeats = F.col("dup_line_chars") > rules.line_coverage * F.col("word_chars")
    for k, share in rules.coverage:
        repeats |= F.col(f"dup_{k}gram_chars") > share * F.col("word_chars")
    noisy = F.col("n_symbols") > rules.symbol_share * F.col("n_words")
    return counts.withColumn("base_failed", base).withColumn("kept", ~(base | repeats | noisy)).withColumnRenamed("id", id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the rules keep, with their own columns; one joinless pass per row.

    The verdict is computed beside each row rather than joined back by id, so
    repeated or NULL ids keep every row its own verdict. Columns beside
    ``text`` are passed through, whatever their names.
    """
    small_batches(spark)
    rules = Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(verdict(measure(*raw(part.column("text")), rules), rules)))

    return docs.mapInArrow(run, docs.schema)


def verdict(found: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    """The NumPy twin of the ``kept`` column."""
    n, chars = found["n_words"], found["word_chars"]
    bad = (n < rules.min_words) | (100 * found["n_repeat_words"] > round(100 * rules.repeat_share) * n)
    bad |= found["dup_line_chars"] > rules.line_coverage * chars
    for k, share in rules.coverage:
        bad |= found[f"dup_{k}gram_chars"] > share * chars
    return ~(bad | (found["n_symbols"] > rules.symbol_share * n))
