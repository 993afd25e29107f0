"""A prefix trie over conversations: which openings are shared, by how many, and what keeping them once would save.

Turns travel as digests. A streaming pass in turn order gives every turn the
digest of its whole prefix, so equal prefixes have equal keys in any task.
Equal conversations collapse to one weighted sequence first. The sequences are
dealt by the digest of their first turn into buckets; in each, `applyInPandas`
builds tries of dictionaries and pointers and sums them by an iterative
postorder. A first turn whose subtrie is too large for one task is peeled:
its upper nodes are aggregated by Spark and what is under them is dealt anew
by the next turn, over again, two, four and more turns at a time, until every
subtrie fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.plans.lineage import materialize

#: Turns of a subtrie that one task may build; larger ones are dealt anew. Turns of a bucket of subtries, about.
MOST_TURNS, BUCKET_TURNS = 50_000, 25_000
#: Ids that are joined to one string before they are hashed in order.
ID_BLOCK = 4096
#: The prefix of no turn.
ROOT = b""
_EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, words)``: turns numbered from 1 by ``turn`` (NULL first), equal ones by digest; NULL roles and texts are empty.

    Rows with a NULL ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)  # the length keeps role and text apart
    light = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", whole.alias("whole"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "whole"))
    return light.select("conv_id", pos.alias("pos"), F.substring(F.unhex("whole"), 1, 16).alias("digest"), "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as rebuilt, ``(conv_id, pos, digest, words)`` with positions that ascend, and every ``conv_id``.

    The first h turns of conversation c come from conversation c - c % 20 (all
    it has where they are fewer, none where it is absent), the others are
    c's own after its first h; h is crc32 of the decimal c, modulo 4. ``%``
    takes the sign of c, as in SQL. Up to 39 conversations share a base.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    heads = turns.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).withColumnRenamed("conv_id", "base")
    lent = convs.where("h > 0").join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").cast("long") - 4, "digest", "words")
    own = turns.where(F.col("pos") > h).select("conv_id", F.col("pos").cast("long"), "digest", "words")
    return own.union(lent), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, prefix, parent, first, words, last)`` of every turn; the prefix is a digest of all turns up to it.

    One sorted pass that streams: a task holds one batch, however long a
    conversation is.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("prefix", pa.binary()), ("parent", pa.binary()), ("first", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, prefix, first = None, 0, ROOT, ROOT
        held: tuple | None = None
        for batch in batches:
            out = []
            for c, d, w in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if held is not None:
                    out.append((*held, c != conv))
                if c != conv:
                    conv, depth, prefix = c, 0, ROOT
                parent, depth = prefix, depth + 1
                prefix = hashlib.blake2b(parent + d, digest_size=16).digest()
                first = prefix if depth == 1 else first
                held = (c, depth, prefix, parent, first, w)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, True), schema, strict=True)], schema=schema)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "digest", "words")
    return dealt.mapInArrow(run, "conv_id long, depth long, prefix binary, parent binary, first binary, words long, last boolean")


def ends(last: DataFrame) -> DataFrame:
    """``(prefix, ends_sha256)`` of the conversations ``(conv_id, prefix)`` that end there, their ids ascending and comma-joined.

    Ids are joined in blocks of ``ID_BLOCK`` first, the blocks hashed in a
    stream: a prefix at which most conversations end needs one block at a time.
    """
    block = F.floor(F.col("conv_id") / ID_BLOCK).cast("long")
    blocks = last.groupBy("prefix", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for prefix, ids in zip(batch.column("prefix").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if prefix != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = prefix, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["prefix", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["prefix", "ends_sha256"])

    return blocks.repartition("prefix").sortWithinPartitions("prefix", "block").select("prefix", "ids").mapInArrow(run, "prefix binary, ends_sha256 string")


_NODE = "prefix binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries of one bucket: ``(rep, depth, prefix, parent, words, n)`` rows of weighted sequences to one row per node.

    Every node is a list with pointers to its parent and, by the next turn's
    prefix, to its children. Rows come sequence by sequence, so a node's
    parent is the row before or, at the top of a subtrie, none.
    """
    rows = rows.sort_values(["rep", "depth"])
    tops: dict[bytes, list] = {}
    node = came = None
    for rep, depth, prefix, parent, words, n in zip(rows["rep"], rows["depth"], rows["prefix"], rows["parent"], rows["words"], rows["n"], strict=True):
        above = node if rep == came else None
        siblings = tops if above is None else above[7]
        node = siblings.get(prefix)
        if node is None:
            #       prefix, parent, conv_id, depth, above, n_convs, words, children, leaves, saved
            node = siblings[prefix] = [prefix, parent, rep, depth, above, 0, words, {}, 0, 0]
        node[2] = min(node[2], rep)
        node[5] += n
        came = rep
    out = []
    for top in tops.values():
        path = [(top, iter(top[7].values()))]
        while path:
            node, rest = path[-1]
            child = next(rest, None)
            if child is not None:
                path.append((child, iter(child[7].values())))
                continue
            path.pop()
            node[8] = node[8] or 1
            node[9] += (node[5] - 1) * node[6]
            above = node[4]
            if above is not None:
                above[8] += node[8]
                above[9] += node[9]
            out.append((*node[:4], None if above is None else above[2], node[5], len(node[7]), node[8], node[9]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")]).astype({"parent_conv_id": "Int64"})


def trie(turns: DataFrame, convs: DataFrame, *, most_turns: int = MOST_TURNS, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """One row per node of the trie over ``turns``, with its members' count, children, leaves, savings and the digest of who ends there.

    ``turns`` holds (conv_id, pos, digest, words), ``convs`` every ``conv_id``
    once, also those without turns, which are members of the root alone.
    Without any conversation there is no node.
    """
    steps = materialize(prefixes(turns))
    ended = steps.where("last").select("conv_id", "prefix")
    last = materialize(ended.union(convs.join(ended, "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("prefix"))))
    # equal conversations are one sequence, of the least id, with a weight
    reps = materialize(last.groupBy("prefix").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")))
    weighted = steps.join(reps.where(F.octet_length("prefix") > 0).select(F.col("rep").alias("conv_id"), "n"), "conv_id")
    rows = materialize(weighted.select(F.col("conv_id").alias("rep"), "depth", "prefix", "parent", "words", "n", F.col("first").alias("key")))
    tops = reps.select("rep", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("prefix"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "n")
    upper, level, width, total = [tops], 1, 1, rows.count()
    while True:
        large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most_turns).select("key")
        large = materialize(large)
        if large.isEmpty():
            break
        # the next turns of large subtries go to the upper part, what is under them is dealt by the turn after
        again = rows.join(large, "key", "left_semi")
        upper.append(again.where(F.col("depth") < level + width).drop("key"))
        under = again.where(F.col("depth") >= level + width)
        keys = under.where(F.col("depth") == level + width).select("rep", F.col("prefix").alias("key"))
        # a subtrie that is settled keeps its key, whatever its level
        settled = rows.join(large, "key", "left_anti")
        rows = materialize(settled.union(under.drop("key").join(keys, "rep").select(*settled.columns)))
        level, width = level + width, 2 * width
    buckets = max(1, -(-total // bucket_turns))
    small = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(build, _NODE)
    low = materialize(small)
    top = low.where("parent_conv_id is null")
    return _finish(materialize(reduce(DataFrame.union, upper)), low, top, ends(last))


def _finish(upper: DataFrame, low: DataFrame, top: DataFrame, ended: DataFrame) -> DataFrame:
    """Upper nodes from their rows and the sums of the subtries under them, then all nodes."""
    nodes = upper.groupBy("prefix").agg(F.min("rep").alias("conv_id"), F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("words").alias("words"), F.sum("n").alias("n_convs"))
    children = nodes.where("parent is not null").select("parent").union(top.select("parent")).groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    known = materialize(nodes.join(children, "prefix", "left").fillna(0, ["n_children"]))
    # what hangs at a node counts for every node above it, along the sequence of its least member
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    own = known.select(F.col("conv_id").alias("rep"), "depth", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    hung = own.union(top.select("conv_id", F.col("depth") - 1, "n_leaves", "saved_tokens")).groupBy("rep", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    under = W.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    along = upper.select("rep", "depth", "prefix").join(hung, ["rep", "depth"], "left").select("prefix", F.sum(F.coalesce("leaves", F.lit(0))).over(under).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).over(under).alias("saved"))
    sums = along.groupBy("prefix").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = known.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["prefix", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    high = known.join(sums, "prefix").join(above, "parent", "left").select(*columns)
    inner = low.where("parent_conv_id is not null").select(*columns)
    joints = top.drop("parent_conv_id").join(above, "parent").select(*columns)
    every = high.union(inner).union(joints).join(ended, "prefix", "left")
    return every.select(*columns[1:], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, **limits: int) -> DataFrame:
    """The trie of rebuilt conversations: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` per node.

    ``conv_id`` is a node's smallest member. NULL turns come first, NULL roles
    and texts are empty, repeated rows are turns of their own, equal turn
    numbers are ordered by the SHA-256 of role and text; rows without a
    ``conv_id`` are left out; an empty table has no nodes; other columns do
    not matter.
    """
    turns = materialize(ordered_turns(rows.select("conv_id", "turn", "role", "text")))
    return trie(*rebuilt_turns(turns), **limits)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the opening it shares with others."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of a decimal number by the table method, as DuckDB has none.
_CRC = """list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))"""

ORACLE_SQL = r"""
with crc_table as (select list(v order by i) t from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) v from (select unnest(range(256))::bigint i))),
light as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, sha256(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) w from conversations where conv_id is not null),
turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, w) pos, w, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) words from light),
convs as (select conv_id, (xor(CRC, 4294967295) % 4)::int h, conv_id - conv_id % 20 base from (select distinct conv_id from turns), crc_table),
rebuilt as (select conv_id, pos, w, words from turns join convs using (conv_id) where pos > h
  union all select c.conv_id, t.pos - 4, t.w, t.words from convs c join turns t on t.conv_id = c.base and t.pos <= c.h),
steps as (select conv_id, row_number() over s depth, list(w) over s path, words, row_number() over s = count(*) over (partition by conv_id) ended from rebuilt
  window s as (partition by conv_id order by pos rows between unbounded preceding and current row)),
rows_ as (select conv_id, depth, path, words, ended from steps
  union all select conv_id, 0, []::varchar[], 0, conv_id not in (select conv_id from rebuilt) from convs),
nodes as (select path, any_value(depth) depth, any_value(words) words, min(conv_id) conv_id, count(*) n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ended), '') ids from rows_ group by path),
kids as (select path[:-2] as path, count(*) n from nodes where depth > 0 group by 1),
full_ as (select n.*, coalesce(k.n, 0) n_children, (n_convs - 1) * words own from nodes n left join kids k on n.path = k.path),
up as (select f.path, a.d, f.own, (f.n_children = 0)::int leaf from full_ f, unnest(range(0, f.depth + 1)) a(d)),
sums as (select path[:d] as path, sum(own) saved, sum(leaf) leaves from up group by 1)
select f.conv_id, f.depth, p.conv_id parent_conv_id, f.n_convs, f.n_children, cast(s.leaves as bigint) n_leaves, cast(s.saved as bigint) saved_tokens, sha256(f.ids) ends_sha256
from full_ f join sums s on f.path = s.path left join full_ p on f.depth > 0 and p.path = f.path[:-2]
""".replace("CRC", _CRC)
