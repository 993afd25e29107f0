"""MinHash near-duplicates by a chosen-path similarity join.

A document is the set of its word shingles; its sketch holds the minwise
token of each of T hash functions. A tree's node is a choice of sketch places,
and a document falls into the child that its tokens at the chosen places name.
Branches per level are chosen so that a pair at the threshold survives in one
child or more on average while dissimilar pairs die out. Small nodes are
compared exhaustively; larger ones link every member to the node's first
document. What stays large and apart is compared exactly, in salted blocks on
the full sets: at once where branching would not pay, else after more levels.
The number of independent trees follows from the recall asked for. Candidates
are verified on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwell.llm.batches import POWERS, POWERS2, U, lower, mix, prefix_hash, raw, slices, small_batches, span_hash, windows, words
from lagwell.operators.graph import connected_components
from lagwell.plans.lineage import materialize

#: Sketch places, enough that no two trees share one at the recall and similarities in use; sketch tokens are kept with 16 bits.
PLACES = 186
#: Places chosen per level; members that a node compares exhaustively; levels after which all that is left is compared exactly.
STEP, SMALL, LEVELS = 5, 32, 3
#: Members and shingles of a side of an exact block at most; blocks of a group, where those bounds do not ask for more, and their least members.
BLOCK, BLOCK_TOKENS, BLOCKS, LEAST = 4096, 4_000_000, 24, 128
_RNG = np.random.default_rng(17)
_MULTIPLY = _RNG.integers(1, 1 << 63, PLACES, np.uint64) | U(1)
_ADD = _RNG.integers(0, 1 << 63, PLACES, np.uint64)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's ``k``-word shingles; a shorter text is one shingle, a wordless one none."""
    data, offsets = raw(column)
    data = lower(data)
    starts, ends, first = words(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends)
    h ^= span_hash(prefix_hash(data, POWERS2), starts, ends, POWERS2) * U(0x9E3779B97F4A7C15)
    at, shingle = windows(h, first, k)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(column)):
        a, b = cut[i], cut[i + 1]
        n = first[i + 1] - first[i]
        if 0 < n < k:
            whole = np.array([n], U)
            for x in range(first[i], first[i + 1]):
                whole = mix(whole * U(31) + h[x : x + 1])
            out.append(whole)
        else:
            out.append(np.unique(shingle[a:b]))
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The minwise token of each hash function, as 16 bits of its hash."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, U)
    for a in range(0, len(tokens), 4096):
        part = tokens[a : a + 4096, None] * _MULTIPLY
        part += _ADD
        part ^= part >> U(29)
        np.minimum(low, part.min(0), out=low)
    return (mix(low) & U(0xFFFF)).astype(np.uint16)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``(id, n_shingles, hi, lo, sketch)``; (hi, lo) is a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), k)
                known: dict[tuple[int, int], bytes] = {}
                hi, lo, sketches = [], [], []
                for s in sets:
                    key = set_hash(s)
                    if key not in known:
                        known[key] = sketch(s).tobytes() if len(s) else b""
                    hi.append(key[0])
                    lo.append(key[1])
                    sketches.append(known[key])
                columns = [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array(x, U).view(np.int64)) for x in (hi, lo)), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "hi", "lo", "sketch"])

    return docs.mapInArrow(run, "id long, n_shingles long, hi long, lo long, sketch binary")


def least_agreement(similarity: float, loss: float) -> float:
    """The share of sketch places below which a pair at the similarity falls with a probability of ``loss`` at most (binomial)."""
    below, j = 0.0, 0
    while True:
        below += math.comb(PLACES, j) * similarity**j * (1 - similarity) ** (PLACES - j)
        if below > loss:
            return j / PLACES
        j += 1


def n_trees(similarity: float, recall: float) -> int:
    """Independent nodes at the first level that leave a pair at the threshold apart with probability 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**STEP))


_DEALT = np.random.default_rng(23).permutation(PLACES)


def _choose(path: np.ndarray, branch: int) -> np.ndarray:
    """The places of a branch below each path: a hash of path and branch decides, so all documents agree.

    The trees, the branches of the root, have places of their own as long as
    there are any, so that a pair's chances in them are independent.
    """
    out = np.empty((len(path), STEP), np.int64)
    for j in range(STEP):
        out[:, j] = (mix(path * U(0x2545F4914F6CDD1D) + U(branch * STEP + j + 1)) >> U(40)) % U(PLACES)
    own = _DEALT[branch * STEP : (branch + 1) * STEP]
    if len(own) == STEP:
        out[path == 0] = own
    return out


def _branches(path: np.ndarray, node: np.ndarray, row: np.ndarray, tokens: np.ndarray, expected: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(child path, child node, row)`` of every (path, node) with its document's tokens.

    ``expected`` children on average: the whole part always, one more with the
    odds of the rest, decided by the path. The path is the choices alone, the
    node also the tokens seen.
    """
    whole = int(expected)
    odds = (mix(path * U(0xA24BAED4963EE407)) >> U(11)).astype(float) / float(1 << 53)
    out = []
    for b in range(whole + (expected > whole)):
        on = np.arange(len(path)) if b < whole else np.flatnonzero(odds < expected - whole)
        places = _choose(path[on], b)
        child = mix(path[on] * U(0x9E3779B97F4A7C15) + U(b + 1))
        seen = mix(node[on] + U(b + 1))
        picked = tokens[row[on][:, None], places].astype(U)
        for j in range(STEP):
            seen = mix(seen * U(0xFF51AFD7ED558CCD) + picked[:, j] + (places[:, j].astype(U) << U(20)))
        out.append((child, seen, row[on]))
    return out


def _grow(docs: DataFrame, expected: float) -> DataFrame:
    """``(path, node, id, c, m)`` of the children of ``(id, c, m, sketch, at array<struct<path, node>>)``, c the component and m the set's size; a document's sketch travels once for all its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, PLACES)
                at = batch.column("at")
                row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
                path, node = (at.flatten().field(c).to_numpy().view(U) for c in ("path", "node"))
                for child, seen, rows in _branches(path, node, row, tokens, expected):
                    picked = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(seen.view(np.int64)), *(batch.column(x).take(picked) for x in ("id", "c", "m"))], ["path", "node", "id", "c", "m"])

    return docs.select("id", "c", "m", "sketch", "at").mapInArrow(run, "path long, node long, id long, c long, m long")


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """``(a, b, alike)``: pairs whose sketches agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, PLACES) for c in ("sa", "sb"))
            alike = (left == right).mean(1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike)], ["a", "b", "alike"])
            yield out.filter(pa.array(alike >= least))

    left = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, alike double")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the pairs with 100 * intersection >= percent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for left, right in zip(batch.column("tokens"), batch.column("other_tokens"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), U) for x in (left, right))
                joint = np.sort(np.concatenate([a, b]), kind="stable")
                both = int((joint[1:] == joint[:-1]).sum())
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("other")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    other = sets.select(F.col("id").alias("other"), F.col("tokens").alias("other_tokens"))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).join(sets, "id").join(other, "other")
    return both.select("id", "other", "tokens", "other_tokens").mapInArrow(run, "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the nodes that hold two components or more, with the node's size and a first document (and its component).

    The first is the least by a hash of node and document, so one document
    meets many different firsts over its nodes.
    """
    order = F.xxhash64("node", "id")
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min_by("id", order).alias("first"), F.min_by("c", order).alias("first_c"), F.min_by("m", order).alias("first_m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").drop("lo", "hi")
    return rows.drop("n", "first", "first_c", "first_m").join(sizes, "node")


def _with_components(docs: DataFrame, label: DataFrame) -> DataFrame:
    return docs.drop("c").join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _fit(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _small_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of fitting sizes, not yet connected, within nodes of at most ``SMALL`` members."""
    small = held.where(F.col("n") <= SMALL).groupBy("node").agg(F.array_sort(F.collect_set(F.struct("id", "c", "m"))).alias("all"))
    later = F.transform("all", lambda x, i: F.struct(x.id.alias("a"), F.transform(F.filter(F.slice("all", i + 2, SMALL), lambda y: (y.c != x.c) & _fit(x.m, y.m, percent)), lambda y: y.id).alias("rest")))
    return small.select(F.inline(later)).select("a", F.explode("rest").alias("b")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """Of each document's pairs with smaller ones, the most alike."""
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("alike", -F.col("a"))).alias("a")).select("a", "b")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: common tokens by matrix products, rare ones by their lists."""
    both = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        sides.append((tokens[order], row[order]))
    shared = np.intersect1d(*(np.unique(t) for t, _ in sides), assume_unique=True)
    (a0, a1), (b0, b1) = ([np.searchsorted(t, shared, side) for side in ("left", "right")] for t, _ in sides)
    work = (a1 - a0) * (b1 - b0)
    (_, ra), (_, rb) = sides
    common = np.flatnonzero(work * 64 > both.size)
    for i in range(0, len(common), 1024):
        part = common[i : i + 1024]
        x, y = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for k, t in enumerate(part):
            x[ra[a0[t] : a1[t]], k] = 1
            y[rb[b0[t] : b1[t]], k] = 1
        both += x @ y.T
    rare = np.flatnonzero(work * 64 <= both.size)
    cut = np.searchsorted(np.cumsum(work[rare]), np.arange(1 << 22, int(work[rare].sum()) + (1 << 22), 1 << 22))
    for part in np.split(rare, cut):
        size = work[part]
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        n = np.repeat(b1[part] - b0[part], size)
        np.add.at(both, (ra[np.repeat(a0[part], size) + k // n], rb[np.repeat(b0[part], size) + k % n]), np.float32(1))
    return both


def _joined(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component numbers of the rows and the columns of a matrix of links."""
    rows, columns = np.full(ok.shape[0], -1), np.full(ok.shape[1], -1)
    for start in range(len(rows)):
        ahead = np.array([start]) if rows[start] < 0 else np.zeros(0, int)
        rows[ahead] = start
        while len(ahead):
            met = np.flatnonzero(ok[ahead].any(0) & (columns < 0))
            columns[met] = start
            ahead = np.flatnonzero(ok[:, met].any(1) & (rows < 0))
            rows[ahead] = start
    return rows, columns


def _blocks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` links that connect whatever is alike within each group of ``(g, id, m)``: all pairs, on the full sets.

    A group is dealt over blocks by a hash, and every two blocks meet in one
    task. A row travels once per block of its group; a task returns a link a
    row at most, however many pairs are alike.
    """
    sized = groups.groupBy("g").agg(F.count("*").alias("n"), F.sum("m").alias("t"))
    usual = F.least(F.ceil(F.col("n") / LEAST), F.lit(BLOCKS))
    dealt = groups.join(sized.select("g", F.greatest(usual, F.ceil(F.col("n") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).alias("blocks")), "g")
    own = dealt.select("g", "id", F.pmod(F.xxhash64("id"), "blocks").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    keyed = own.select("g", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first")).join(sets, "id")

    def run(block: pa.Table) -> pa.Table:
        ids = block.column("id").to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), U) for x in block.column("tokens")]
        first = np.flatnonzero(block.column("first").to_numpy(zero_copy_only=False))
        second = first if block.column("i")[0] == block.column("j")[0] else np.setdiff1d(np.arange(len(ids)), first)
        out: list[tuple[int, int]] = []
        if len(first) and len(second):
            size = np.array([len(x) for x in tokens])
            both = _overlaps([tokens[x] for x in first], [tokens[x] for x in second])
            ok = (100 + percent) * both.astype(np.float64) >= percent * (size[first][:, None] + size[second][None])
            lead: dict[int, int] = {}
            for part, label in zip((first, second), _joined(ok), strict=True):
                for x, c in zip(ids[part].tolist(), label.tolist(), strict=True):
                    if c >= 0 and lead.setdefault(c, x) != x:
                        out.append((lead[c], x))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return keyed.groupBy("g", "i", "j").applyInArrow(run, "a long, b long")


def _dense(large: DataFrame, trees: int, last: bool) -> tuple[DataFrame, DataFrame]:
    """``(g, id, m)`` to compare exactly and the rows of ``large`` to branch.

    Nodes that share documents make a group. It is compared as a whole where
    that costs less than its nodes one by one; what is too loose for that
    branches on or, at the last level, is compared node by node.
    """
    label = materialize(connected_components(large.select(F.col("first").alias("a"), F.col("id").alias("b")))).withColumnRenamed("component", "g")
    rows = large.join(label, "id")
    widest = rows.groupBy("g").agg(F.max("n").alias("widest"))
    tight = label.groupBy("g").agg(F.count("*").alias("size")).join(widest, "g").where(F.col("size") <= trees * F.col("widest")).select("g")
    whole = rows.join(tight, "g", "left_semi").select("g", "id", "m").distinct()
    loose = rows.join(tight, "g", "left_anti").drop("g")
    if last:
        return whole.union(loose.select(F.col("node").alias("g"), "id", "m")), loose.limit(0)
    return whole, loose


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, recall: float = 0.999999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per input row.

    Equal sets are one class through a 128-bit hash, so thousands of copies
    cost one representative (their smallest id). A large node first links
    each member to its first document, verified on full sets; nodes whose
    members are connected by then are settled, the others are compared within
    (small), branched or compared in blocks (large). Verification takes one pair per document
    first, the most alike, then the pairs whose ends are still apart: every
    candidate is verified or lies within one component already. Large nodes
    are never given up: see :func:`_dense`. Half of what ``recall`` allows a
    pair at the threshold to be lost by goes to the trees, half to the
    estimate on the sketches that candidates must pass.

    NULL, empty and wordless texts have no shingles and stand alone. Rows
    with equal ids and equal sets share a component; rows with equal ids and
    other sets are linked each by its own. Ids must be integers; rows without
    one are kept, with a NULL component. An empty table gives an empty
    result; columns beside the two are dropped, whatever their names.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sig = materialize(signatures(docs, k))
    live = sig.where("n_shingles > 0 and id is not null")
    classes = materialize(live.groupBy("hi", "lo").agg(F.min("id").alias("rep")))
    own = classes.withColumnRenamed("rep", "id")
    # a class is named by its smallest id, all but the first class of an id that has several by a hash
    first_of_id = F.row_number().over(Window.partitionBy("id").orderBy("hi", "lo")) == 1
    named = live.select("id", "hi", "lo", "sketch", F.col("n_shingles").alias("m")).join(own, ["id", "hi", "lo"]).dropDuplicates(["id", "hi", "lo"])
    reps = materialize(named.select(F.when(first_of_id, F.col("id")).otherwise(F.lit(_NO_ID) + F.shiftrightunsigned("hi", 2)).alias("id"), F.col("id").alias("rep"), "hi", "lo", "m", "sketch"))
    similarity = percent / 100
    least = least_agreement(similarity, (1 - recall) / 2)
    root = F.array(F.struct(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("node")))
    roots = reps.select("id", F.col("id").alias("c"), "m", "sketch", root.alias("at"))
    branches = float(n_trees(similarity, 1 - (1 - recall) / 2))
    # a row becomes as many as there are trees, so the files are dealt out evenly first
    even = roots.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    held = materialize(_mixed(_grow(even, branches)))
    names = reps.join(held.select("id").distinct().hint("merge"), "id", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("hi", "lo", "id")).alias("names"))
    # a merge join at any size: which texts are wanted grows with the input
    wanted = docs.join(names.withColumnRenamed("rep", "id").hint("merge"), "id")
    sets = materialize(_sets_of(wanted, k).dropDuplicates(["id"]))
    links: DataFrame | None = None
    inputs = roots.join(held.select("id").distinct().hint("merge"), "id", "left_semi")
    pairs: list[DataFrame] = []
    tried: DataFrame | None = None

    def estimated(found: DataFrame, most: int) -> DataFrame:
        """The alike ones of the pairs that were not estimated before."""
        nonlocal tried
        fresh = materialize(found if tried is None else found.join(tried.hint("merge"), ["a", "b"], "left_anti"), most)
        tried = fresh if tried is None else tried.union(fresh)
        pairs.append(materialize(_estimated(fresh, reps, least), fresh.count()))
        return pairs[-1]

    for level in range(LEVELS):
        size = held.count()
        large = held.where(F.col("n") > SMALL)
        deeper = not large.isEmpty()
        if deeper:
            star = large.where("first_c != c").where(_fit(F.col("first_m"), F.col("m"), percent)).select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
            found = _verified(_best(estimated(star, size)), sets, percent)
            links = materialize(found if links is None else links.union(found), size if links is None else None)
            inputs = materialize(_with_components(inputs, connected_components(links)))
            held = materialize(_mixed(_grow(inputs, branches)), size)
        estimated(_small_pairs(held, percent), SMALL * size)
        large = held.where(F.col("n") > SMALL)
        if not deeper or large.isEmpty():
            break
        dense, loose = _dense(large, n_trees(similarity, recall), level == LEVELS - 1)
        links = links.union(materialize(_blocks(dense, sets, percent)))
        if loose.isEmpty():
            break
        inputs = materialize(loose.groupBy("id", "c", "m").agg(F.collect_list(F.struct("path", "node")).alias("at")).join(reps.select("id", "sketch"), "id"))
        # two children in common on average, so that a pair at the threshold does not die out
        branches = 2 * similarity**-STEP
        held = materialize(_mixed(_grow(inputs, branches)))

    pairs_all = reduce(DataFrame.union, pairs)
    nearest = _best(pairs_all)
    found = _verified(nearest, sets, percent)
    links = materialize(found if links is None else links.union(found))
    label = connected_components(links)
    left = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    apart = pairs_all.select("a", "b").distinct().join(left, "a", "left").join(right, "b", "left").where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")
    links = links.union(materialize(_verified(apart, sets, percent)))
    component = connected_components(links)
    several = reps.where(F.col("id") != F.col("rep"))
    if several.isEmpty():
        component = component.withColumnRenamed("id", "rep")
        of_set = classes.join(component, "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    else:
        linked = reps.select("id", "rep", "hi", "lo").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
        smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
        of_set = linked.join(smallest, "component").select("hi", "lo", "component_id")
    out = sig.select("id", "n_shingles", "hi", "lo").join(of_set, ["hi", "lo"], "left")
    found_id = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", found_id.alias("component_id"), F.coalesce(F.col("id") == found_id, F.lit(True)).alias("kept"))


#: Names of classes that no id is free for begin above all usual ids.
_NO_ID = 1 << 62


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of tokens, as two unsigned numbers; zeros for the empty one."""
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(s))), int(mix(s * U(0xD6E8FEB86659FD93)).sum(dtype=U))


def _sets_of(docs: DataFrame, k: int) -> DataFrame:
    """``(id, tokens)`` of the rows of ``(id, text, names)`` whose set has a name there, under that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for s, names in zip(shingle_sets(part.column("text"), k), part.column("names").to_pylist(), strict=True):
                    own = tuple(x - (1 << 64) * (x >> 63) for x in set_hash(s))
                    found += [(n["id"], s.tobytes()) for n in names if (n["hi"], n["lo"]) == own]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["id", "tokens"])

    return docs.mapInArrow(run, "id long, tokens binary")


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest id, with its own columns.

    Rows that share an id are one document here and stay or go together:
    they go if each of them is a copy of another document. Rows without an
    id, or without words, stay. Columns beside ``doc_id`` and ``text`` are
    passed through, whatever their names.
    """
    found = near_duplicates(docs)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
