"""Cost-balanced packing of token streams into sequences of fixed capacity."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lagwell.llm.batches import slices, small_batches, texts

#: Runs that are remembered, and half as many words again, and the longest of them (bytes), so that the memories stay
#: under 100 MB or so whatever the texts hold; a speed setting, results do not depend on it.
REMEMBER, LONGEST = 250_000, 48


@dataclass(frozen=True)
class Cost:
    """Of a piece: linear * tokens + quadratic * tokens**2, the shape of a transformer's work."""

    linear: float = 1.0
    quadratic: float = 1.0 / 4096


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTokens:
    """Ids (``<u4`` bytes) of whole texts under a lower-casing tokenizer that drops white space and marks word ends.

    Such a tokenizer treats the runs between blanks apart, and within a run
    the words, digits and signs that its split pattern names. Runs and words
    are remembered. A run beyond the Latin blocks, or not in composed form,
    goes to the tokenizer itself, as do very long words.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        with open(path, encoding="utf-8") as source:
            described = json.load(source)
        vocabulary = described["model"]["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in described["model"]["merges"])
        ranks = {pair: rank for rank, pair in enumerate(pairs)}
        end = described["model"]["end_of_word_suffix"]
        split = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        letters = _byte_letters()
        none = len(ranks)

        def direct(run: str) -> bytes:
            return np.asarray(model.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(word) > LONGEST:
                    return direct(word)
                parts = [letters[b] for b in word.encode()]
                parts[-1] += end
                rank = [ranks.get(pair, none) for pair in pairwise(parts)]
                while rank and (least := min(rank)) < none:
                    i = rank.index(least)
                    parts[i] += parts.pop(i + 1)
                    del rank[i]
                    if i:
                        rank[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
                    if i < len(rank):
                        rank[i] = ranks.get((parts[i], parts[i + 1]), none)
                out = np.array([vocabulary[p] for p in parts], "<u4").tobytes()
                if len(self) < remember + remember // 2:
                    self[word] = out
                return out

        words = Words()

        class Runs(dict):
            def __missing__(self, run: bytes) -> bytes:
                text = run.decode("utf-8", "surrogatepass")
                if text.isascii():
                    out = b"".join(map(words.__getitem__, split(text)))
                elif max(text) < "\u0250" and unicodedata.is_normalized("NFC", text):
                    out = b"".join(map(words.__getitem__, split(text.lower())))
                else:
                    out = direct(text)
                if len(self) < remember and len(run) <= LONGEST:
                    self[run] = out
                return out

        self.runs = Runs()

    def encode(self, text: bytes) -> bytes:
        """Of a UTF-8 text; capital ASCII letters are lowered here, so runs that differ in them share an entry."""
        return b"".join(map(self.runs.__getitem__, text.lower().replace(b"\n", b" ").split(b" ")))


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    """One memory per worker process, kept between tasks."""
    return WordTokens(path)


def place(lengths: list[int], capacity: int, cost: Cost, tail_powers: bool) -> list[list[tuple[int, int, int, int]]]:
    """For each document its pieces ``(start, length, sequence, offset)``.

    Full sequences are cut off long documents first. The rest, longest first,
    each go whole to the cheapest open sequence that has room for them; where
    none has, the document is cut over the cheapest sequences that have any.
    The open sequences are as many as the tokens need, so all but the last
    tokens fill them exactly: the remainder (under one capacity) goes to
    sequences of power-of-two length if ``tail_powers``, else to one padded
    sequence.
    """
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    n = 0
    rest = []
    for i, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            pieces[i].append((at, capacity, n, 0))
            n += 1
            at += capacity
        if length > at:
            rest.append((length - at, i, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    sizes = [capacity] * (total // capacity)
    tail = total % capacity
    if tail:
        sizes += [1 << b for b in range(capacity.bit_length(), -1, -1) if tail >> b & 1] if tail_powers else [tail]
    room = np.array(sizes, np.int64)
    spent = np.zeros(len(sizes))
    used = np.zeros(len(sizes), np.int64)
    for length, i, at in rest:
        while length:
            fits = room >= length
            if fits.any():
                s, take = int(np.where(fits, spent, np.inf).argmin()), length
            else:
                s = int(np.where(room > 0, spent, np.inf).argmin())
                take = int(room[s])
            pieces[i].append((at, take, n + s, int(used[s])))
            spent[s] += cost.linear * take + cost.quadratic * take * take
            used[s] += take
            room[s] -= take
            at += take
            length -= take
    return pieces


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, cost: Cost | None = None, window_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", tail_powers: bool = True) -> DataFrame:
    """One row per piece: ``start length ids_crc32 doc_tokens sequence_id offset``.

    A document is its ids and ``end_id``; a NULL or empty text is ``end_id``
    alone. Each task packs its own rows in windows of about ``window_tokens``,
    so nothing is shuffled and memory does not grow with the input; sequence
    ids carry the task's partition in their upper bits. Rows that repeat an id
    or a text, or have no id, are packed each; columns other than the id are
    dropped, whatever their names. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    cost = cost or Cost()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_path)
        end = np.asarray([end_id], "<u4").tobytes()
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        docs: list[bytes] = []
        ids: list[pa.Array] = []
        held = opened = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, opened
            lengths = [len(x) // 4 for x in docs]
            placed = place(lengths, capacity, cost, tail_powers)
            rows, columns = [], [[] for _ in range(6)]
            for i, got in enumerate(placed):
                for start, length, sequence, offset in got:
                    rows.append(i)
                    for column, value in zip(columns, (start, length, zlib.crc32(docs[i][4 * start : 4 * (start + length)]), lengths[i], base + opened + sequence, offset), strict=True):
                        column.append(value)
            opened += 1 + max(x[2] for got in placed for x in got)
            id_column = pa.concat_arrays(ids).take(pa.array(rows, pa.int64()))
            docs.clear()
            ids.clear()
            held = 0
            return pa.RecordBatch.from_arrays([id_column, *(pa.array(x, pa.int64()) for x in columns)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in slices(batch):
                for text in texts(part.column("text")).cast(pa.large_binary()).to_pylist():
                    docs.append(words.encode(text) + end)
                    held += len(docs[-1]) // 4
                ids.append(pc.cast(part.column("id"), part.column("id").type))
                if held >= window_tokens:
                    yield flush()
        if docs:
            yield flush()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.selectExpr(f"`{id_col}` id", f"`{text_col}` text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def pack_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, as in :func:`pack`."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
