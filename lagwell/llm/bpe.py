"""Byte-level BPE with a segment tree over the byte positions of a piece."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lagwell.llm.batches import slices, texts

#: Chunks and pieces that are remembered, the earliest seen, and the longest of them (code points), so that a memory stays
#: under 100 MB or so whatever the texts hold; a speed setting, results do not depend on it.
REMEMBER, LONGEST = 500_000, 48
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    Leaf i of the tree holds (rank of the pair that starts at live position i,
    i); inner nodes hold the minimum, so the root is the leftmost pair of
    least rank. A merge changes two leaves: the merged position and its live
    predecessor, each updated along one path to the root.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))
    low = (1 << shift) - 1
    while tree[1] != _NONE:
        i = tree[1] & low
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        changed = [(j, _NONE)]
        rank = get(piece[i : after[k]]) if k < n else None
        changed.append((i, _NONE if rank is None else rank << shift | i))
        p = before[i]
        if p >= 0:
            rank = get(piece[p:k])
            changed.append((p, _NONE if rank is None else rank << shift | p))
        for at, value in changed:
            at += size
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes whole texts, each match of ``pattern`` on its own.

    A text whose spaces each stand between two non-white characters splits at
    its spaces into chunks that cannot influence one another under patterns
    that attach one leading space; such chunks are remembered. Any other text
    goes through the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.entangled = regex.compile(r" \s|\s ").search
        self.tokens = {v: k for k, v in ranks.items()}
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                out = np.asarray(merge(piece.encode("utf-8", "surrogatepass"), ranks), "<u4").tobytes()
                if len(self) < remember and len(piece) <= LONGEST:
                    self[piece] = out
                return out

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                out = encoder.whole(" " + chunk)
                if len(self) < remember and len(chunk) <= LONGEST:
                    self[chunk] = out
                return out

        self.pieces, self.chunks = Pieces(), Chunks()

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.entangled(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder_of(ranks_path: str, pattern: str) -> Encoder:
    """One memory per worker process, kept between tasks."""
    return Encoder(load_ranks(ranks_path), pattern)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: ``n_tokens``, ``ids`` (array, if kept), digests of the ids and of the decoded bytes.

    NULL and empty texts have no tokens. Repeated rows are encoded each. Other
    columns are dropped. Needs no shuffle; a row's cost is that of its text.
    """
    keep = [pa.field("ids", pa.list_(pa.int64()))] if keep_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                n, ids, decoded, kept = [], [], [], []
                for text in texts(part.column("text")).to_pylist():
                    got = encoder.encode(text)
                    n.append(len(got) // 4)
                    ids.append(hashlib.sha256(got).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(got)).hexdigest())
                    if keep_ids:
                        kept.append(np.frombuffer(got, "<u4").astype(np.int64))
                out = [part.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.array(kept, keep[0].type))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    return df.selectExpr(f"`{id_col}` id", f"`{text_col}` text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
