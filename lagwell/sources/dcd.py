"""DCD trajectories, from the public description of the format: Fortran records around a header, a title, an atom count and three coordinate blocks a frame."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _record(data: bytes, at: int, order: str) -> tuple[bytes, int]:
    (n,) = struct.unpack_from(f"{order}i", data, at)
    if n < 0 or at + 8 + n > len(data) or struct.unpack_from(f"{order}i", data, at + 4 + n)[0] != n:
        raise ValueError("broken DCD record")
    return data[at + 4 : at + 4 + n], at + 8 + n


def header(data: bytes) -> dict:
    """Byte order, frames as declared, atoms, unit cell flag and where the frames begin."""
    for order in "<>":
        if len(data) >= 8 and struct.unpack_from(f"{order}i4s", data, 0) == (84, b"CORD"):
            break
    else:
        raise ValueError("not a DCD file")
    block, at = _record(data, 0, order)
    _, at = _record(data, at, order)
    count, at = _record(data, at, order)
    ints = struct.unpack(f"{order}20i", block[4:])
    return {"order": order, "n_frames": ints[0], "start": ints[1], "every": ints[2], "cell": bool(ints[10]) and ints[19] != 0, "n_atoms": struct.unpack(f"{order}i", count)[0], "at": at}


def frames(data: bytes, atoms: Sequence[int] | None = None, stride: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(frame, positions [atoms, 3]); a file cut short ends at its last whole frame."""
    h = header(data)
    at, k = h["at"], 0
    while at < len(data):
        try:
            if h["cell"]:
                _, at = _record(data, at, h["order"])
            axes = []
            for _ in range(3):
                block, at = _record(data, at, h["order"])
                axes.append(np.frombuffer(block, f"{h['order']}f4"))
        except (ValueError, struct.error):
            return
        if k % stride == 0:
            xyz = np.stack(axes, 1)
            yield k, xyz if atoms is None else xyz[list(atoms)]
        k += 1


def read(spark: SparkSession, path: str, atoms: Sequence[int] | None = None, stride: int = 1) -> DataFrame:
    """``(source_file, frame, xyz array<double>)``; one task reads one file, as the format has no split points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                rows: list = []
                for k, xyz in frames(bytes(content), atoms, stride):
                    rows.append((name, k, xyz.astype(float).ravel()))
                    if len(rows) == 2048:
                        yield pd.DataFrame(rows, columns=["source_file", "frame", "xyz"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "frame", "xyz"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_file string, frame int, xyz array<double>")


def frame_count(data: bytes) -> int:
    """Declared frames, or counted where the header says none."""
    h = header(data)
    return h["n_frames"] or sum(1 for _ in frames(data))


def encode(positions: np.ndarray, every: int = 1) -> bytes:
    """A DCD file of positions [frames, atoms, 3], little-endian, without unit cells."""
    record = lambda b: struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))
    ints = [len(positions), 0, every, len(positions) * every, *[0] * 15, 24]
    out = [record(b"CORD" + struct.pack("<20i", *ints)), record(struct.pack("<i", 1) + b"frames".ljust(80)), record(struct.pack("<i", positions.shape[1]))]
    for xyz in np.asarray(positions, "<f4"):
        out += [record(np.ascontiguousarray(xyz[:, k]).tobytes()) for k in range(3)]
    return b"".join(out)


def pdb(xyz: np.ndarray, names: Sequence[str] | None = None, residue: str = "UNK", remark: str = "") -> str:
    """One structure as fixed-column PDB text."""
    names = names or ["C"] * len(xyz)
    lines = [f"REMARK {remark}"] if remark else []
    lines += [f"ATOM  {i + 1:>5} {n:<4.4} {residue:<3.3} A{1:>4}    {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{0:6.2f}          {n[0]:>2}" for i, (n, (x, y, z)) in enumerate(zip(names, xyz, strict=True))]
    return "\n".join([*lines, "END", ""])


def with_anchor_states(blocks: DataFrame, anchors: dict[str, int]) -> DataFrame:
    """Frames of anchor trajectories get their state, others -1; states must be 0..k-1 without gaps."""
    states = sorted(set(anchors.values()))
    if states != list(range(len(states))):
        raise ValueError(f"anchor states must be contiguous from 0, not {states}")
    table = blocks.sparkSession.createDataFrame(list(anchors.items()), "traj_id string, _s int")
    return blocks.join(F.broadcast(table), "traj_id", "left").withColumn("state", F.coalesce("_s", F.lit(-1))).drop("_s")
