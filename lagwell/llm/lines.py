"""Line dedup by a segment-partition edit join.

Lines within ``edits`` edits of each other are one class; in a line of ten
words or more an edit changes a word, in a shorter one a character. A line is
split into edits + 1 segments; the edits leave one of them whole, so two lines
in a class share a segment under a key that also holds the shorter line's
length: every line is indexed under its own length and probes its own length
and those below, each segment at the places it can have moved to. Small key
groups are compared pair by pair. A large group is joined again in the same
way on what is left beside the shared segment, which holds all the edits, and
so on until the groups are small or nothing is left that could differ: each
round costs a row or a few per line however many lines share the segment.
Every candidate pair is verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.llm.batches import POWERS2, U, mix, prefix_hash, slices, small_batches, span_hash, texts, with_text
from lagwell.llm.quality import Rules
from lagwell.operators.graph import connected_components
from lagwell.plans.lineage import materialize

#: Shorter lines (code points, white space at the ends aside) carry too little to be told apart, and stay.
MIN_CHARS = 20
#: Lines of so many words are compared by words, so that an edit is at most a tenth of a line; shorter ones by characters.
WORDS_FROM = 10
#: Edits within which lines are one class.
EDITS = 1
#: Lines that a key group compares pair by pair.
SMALL = 24

_BLANK = np.zeros(33, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def shifts(edits: int, longer: int, i: int) -> range:
    """Where segment ``i`` of a line can stand in one ``longer`` symbols longer: at most i edits lie before it, the others behind."""
    return range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """``(longer, i, shift)`` of every key of a line: its index keys (0, i, 0) first, in order of i, then the others that it probes."""
    every = [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in shifts(edits, d, i)]
    return sorted(every, key=lambda x: (x[0] != 0 or x[2] != 0, x))


def symbols(line: str) -> list[str] | str:
    """What an edit changes in a line: its words, if they are many, else its characters."""
    found = _WORDS(line)
    return found if len(found) >= WORDS_FROM else line


class Lines:
    """The lines of a run of texts, as spans of their joined code points."""

    def __init__(self, many: list[str], min_chars: int) -> None:
        joined = "\n".join(many)
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in many], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(many) else np.zeros(0, np.int64)
        breaks = np.flatnonzero(self.codes == 10)
        start, end = np.concatenate([[0], breaks + 1]), np.append(breaks, len(self.codes))
        doc = np.searchsorted(self.begin, start, "right") - 1
        self.ink = ~_BLANK[np.minimum(self.codes, 32)] | (self.codes > 32)
        ink = np.flatnonzero(self.ink)
        lo, hi = np.searchsorted(ink, start), np.searchsorted(ink, end)
        full = hi > lo
        self.first_line = np.searchsorted(start, self.begin)
        number = np.arange(len(start)) - self.first_line[doc] if len(many) else np.zeros(0, np.int64)
        s = np.zeros(len(start), np.int64)
        e = np.zeros(len(start), np.int64)
        s[full], e[full] = ink[lo[full]], ink[hi[full] - 1] + 1
        long = e - s >= min_chars
        self.start, self.end, self.doc, self.number = s[long], e[long], doc[long], number[long]
        self.h = prefix_hash(self.codes)
        self.lo = span_hash(self.h, self.start, self.end)

    def line(self) -> np.ndarray:
        """A 128-bit hash of each line, as 16 bytes."""
        hi = span_hash(prefix_hash(self.codes, POWERS2), self.start, self.end, POWERS2)
        return np.ascontiguousarray(np.stack([hi, self.lo], 1)).view("V16").ravel()

    def keys(self, edits: int) -> list[np.ndarray]:
        """Every line's keys in the order of :func:`probes`; no key where the line is too short to have it."""
        edge = np.diff(np.concatenate([[False], self.ink, [False]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first, last = np.searchsorted(begins, self.start), np.searchsorted(begins, self.end)
        by_word = last - first >= WORDS_FROM
        words = prefix_hash(span_hash(self.h, begins, ends))
        at, to = np.where(by_word, first, self.start), np.where(by_word, last, self.end)

        def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(a), U)
            out[by_word] = span_hash(words, a[by_word], b[by_word])
            out[~by_word] = span_hash(self.h, a[~by_word], b[~by_word])
            return out

        out = []
        for longer, i, shift in probes(edits):
            n = to - at - longer
            a, b = at + n * i // (edits + 1) + shift, at + n * (i + 1) // (edits + 1) + shift
            salt = ((2 * n + by_word) * (edits + 1) + i).astype(U) * U(0x9E3779B97F4A7C15)
            out.append(mix(part(np.clip(a, at, to), np.clip(b, at, to)) + salt))
        return out

    def later(self) -> np.ndarray:
        """True for lines that repeat an earlier line of their text."""
        key = mix(self.lo + self.doc.astype(U) * U(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        out = np.ones(len(key), bool)
        out[first] = False
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _binary(x: np.ndarray) -> pa.Array:
    """16 bytes a row."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def occurrences(docs: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """One row per (document, distinct line): the line's 128-bit hash and its keys."""
    names = [f"key{j}" for j in range(len(probes(edits)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = Lines(texts(part.column("text")).to_pylist(), min_chars)
                once = ~x.later()
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(x.doc[once])), _binary(x.line()[once]), *(_signed(c[once]) for c in x.keys(edits))], ["id", "line", *names])

    return docs.mapInArrow(run, "id long, line binary, " + ", ".join(f"{c} long" for c in names))


def within(a: list[str] | str, b: list[str] | str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: common ends off, then a bit-parallel band of 2k + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    if lo:
        a, b = a[:-lo], b[:-lo]
    if not a:
        return len(b) <= k
    # level[d] has bit i set where the diagonal i - k reaches the current column with d errors
    width = 2 * k + 1
    full = (1 << width) - 1
    level = [0] * (k + 1)
    level[0] = 1 << k
    for d in range(1, k + 1):
        level[d] = level[d - 1] | level[d - 1] << 1 & full
    for j in range(len(a)):
        equal = 0
        for i in range(width):
            at = j + i - k
            if 0 <= at < len(b) and a[j] == b[at]:
                equal |= 1 << i
        fresh = [level[0] & equal]
        for d in range(1, k + 1):
            # substitution keeps the diagonal, a character of a left out lowers it, one of b raises it
            row = level[d] & equal | level[d - 1] | level[d - 1] >> 1
            row |= fresh[d - 1] << 1 & full
            fresh.append(row)
        level = fresh
        if not any(level):
            return False
    return bool(level[k] >> (len(b) - len(a) + k) & 1)


def _line_texts(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """``(line, text)`` of the wanted ``(id, line)``, taken from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                many = texts(part.column("text")).to_pylist()
                x = Lines(many, min_chars)
                sets = [set(w) for w in part.column("want").to_pylist()]
                line = _binary(x.line()).to_pylist()
                hit = [i for i, (d, h) in enumerate(zip(x.doc.tolist(), line, strict=True)) if h in sets[d]]
                offset = x.begin[x.doc]
                a, b = (x.start - offset).tolist(), (x.end - offset).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([line[i] for i in hit], pa.binary()), pa.array([many[x.doc[i]][a[i] : b[i]] for i in hit], pa.string())], ["line", "text"])

    per_doc = wanted.groupBy("id").agg(F.collect_set("line").alias("want"))
    # a merge join at any size: which documents are wanted grows with the input
    return docs.join(per_doc.hint("merge"), "id").select("text", "want").mapInArrow(run, "line binary, text string").dropDuplicates(["line"])


#: A row of a group: what is left of the line beside the segments it shares, its words joined by blanks.
_ROW = "key long, line binary, home boolean, longer int, by_word boolean, rest string"


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of groups that hold two lines or more, one of them indexed there, with the group's size ``n``."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0").drop("homes")
    return rows.join(sizes, "key")


def _rests(rows: DataFrame, edits: int) -> DataFrame:
    """The rows of the first groups, ``(key, line, j, text)``, with what is left of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = probes(edits)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for j, text in zip(batch.column("j").to_pylist(), batch.column("text").to_pylist(), strict=True):
                longer, i, shift = plan[j]
                line = symbols(text)
                n, by_word = len(line) - longer, not isinstance(line, str)
                a, b = n * i // (edits + 1) + shift, n * (i + 1) // (edits + 1) + shift
                rest = line[:a] + line[b:]
                for column, value in zip(columns, (longer == 0 and shift == 0, longer, by_word, " ".join(rest) if by_word else rest), strict=True):
                    column.append(value)
            kinds = (pa.bool_(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("line"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["key", "line", "home", "longer", "by_word", "rest"])

    return rows.select("key", "line", "j", "text").mapInArrow(run, _ROW)


def keys_of_rest(key: int, home: bool, longer: int, rest: list[str] | str, edits: int) -> list[tuple[int, bool, int, list[str] | str]]:
    """``(key, home, longer, rest)`` of the next round, for a row whose rest has a symbol per segment or more.

    The indexed rests have ``len(rest) - longer`` symbols; an indexed row also
    probes for others of its length at moved places.
    """
    n = len(rest) - longer
    out = []
    for i in range(edits + 1):
        a, b = n * i // (edits + 1), n * (i + 1) // (edits + 1)
        for shift in shifts(edits, longer, i):
            if 0 <= a + shift and b + shift <= len(rest):
                piece = rest[a + shift : b + shift]
                told = f"{n} {i} " + (piece if isinstance(piece, str) else " ".join(piece))
                found = xxhash.xxh3_64_intdigest(told.encode("utf-8", "surrogatepass"), key & (1 << 64) - 1)
                out.append((found - (1 << 64) * (found >> 63), home and shift == 0, longer, rest[: a + shift] + rest[b + shift :]))
    return out


def keys_of_end(key: int, home: bool, longer: int, rest: list[str] | str, edits: int) -> list[tuple[int, bool, int, list[str] | str]]:
    """The same for a rest too short to be split: under each choice of the symbols that two such rests within the edits share at least.

    For every difference in length that the group may hold; with nothing that
    must be shared all meet.
    """
    n = len(rest) - longer
    out = []
    for d in range(edits + 1) if home else (longer,):
        for piece in sorted(set(combinations(rest, max(0, n - (edits - d))))):
            found = xxhash.xxh3_64_intdigest(" ".join(["end", str(d), *piece]).encode("utf-8", "surrogatepass"), key & (1 << 64) - 1)
            out.append((found - (1 << 64) * (found >> 63), home, longer, rest))
    return out


def _next(rows: DataFrame, edits: int, end: bool) -> DataFrame:
    """The rows of the next round; those with a symbol per segment or, at the ``end``, the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "line", "home", "longer", "by_word", "rest"]
        kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.bool_(), pa.string())
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for key, line, home, longer, by_word, rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                left = rest.split(" ") if by_word and rest else [] if by_word else rest
                if end != (len(left) - longer <= edits):
                    continue
                for k, h, d, r in (keys_of_end if end else keys_of_rest)(key, home, longer, left, edits):
                    held.append((k, line, h, d, by_word, " ".join(r) if by_word else r))
                    size += len(rest) + 32
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return rows.select("key", "line", "home", "longer", "by_word", "rest").mapInArrow(run, _ROW)


def _pairs(rows: DataFrame) -> DataFrame:
    """``(a, b)`` of small groups, and for more than one edit of last groups: every indexed line with every other."""
    groups = rows.groupBy("key").agg(F.collect_set(F.when(F.col("home"), F.col("line"))).alias("homes"), F.collect_set("line").alias("every"))
    return groups.select(F.explode("homes").alias("a"), "every").select("a", F.explode("every").alias("b")).where("a != b")


def _stars(rows: DataFrame) -> DataFrame:
    """``(a, b)`` of last groups of any size: the first indexed line with every other.

    All indexed rests there have at most ``edits`` symbols, so their lines
    are within that of one another.
    """
    first = rows.where("home").groupBy("key").agg(F.min("line").alias("a"))
    return rows.join(first, "key").select("a", F.col("line").alias("b")).where("a != b")


def links(docs: DataFrame, lines: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """``(a, b)`` of lines within the edits, enough to connect every class.

    ``lines`` holds each distinct line's hash, keys and first document.
    """
    plan = probes(edits)
    keyed = lines.select("line", "id", F.inline(F.array(*(F.struct(F.col(f"key{j}").alias("key"), F.lit(j).alias("j"), F.lit(longer == 0 and shift == 0).alias("home")) for j, (longer, _, shift) in enumerate(plan)))))
    shared = materialize(_shared(keyed))
    text = materialize(_line_texts(docs, shared.select("id", "line").distinct(), min_chars))
    found = [_pairs(shared.where(F.col("n") <= SMALL))]
    large = shared.where(F.col("n") > SMALL)
    more = not large.isEmpty()
    large = _rests(large.join(text, "line"), edits)
    while more:
        ends = materialize(_shared(_next(large, edits, True)))
        rows = materialize(_shared(_next(large, edits, False)))
        found += [_stars(ends) if edits == 1 else _pairs(ends), _pairs(rows.where(F.col("n") <= SMALL))]
        large = rows.where(F.col("n") > SMALL)
        more = not large.isEmpty()
    pairs = reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = text.select(F.col("line").alias("a"), F.col("text").alias("la"))
    right = text.select(F.col("line").alias("b"), F.col("text").alias("lb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), strict=True):
                a, b = symbols(a), symbols(b)
                ok.append(isinstance(a, str) == isinstance(b, str) and within(a, b, edits))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "la", "lb").mapInArrow(run, "a binary, b binary"))


def dropped_lines(docs: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """``(id, drop array<binary>)``: hashes of the lines that each document (id, text) loses to another one."""
    found = materialize(occurrences(docs, min_chars, edits))
    firsts = [F.first(f"key{j}").alias(f"key{j}") for j in range(len(probes(edits)))]
    lines = materialize(found.groupBy("line").agg(F.min("id").alias("id"), F.count("*").alias("n"), *firsts))
    classes = connected_components(links(docs, lines, min_chars, edits)).withColumnRenamed("id", "line")
    member = classes.join(lines.select("line", "id"), "line")
    chosen = member.groupBy("component").agg(F.min(F.struct("id", "line")).alias("best")).select("component", F.col("best.line").alias("best"))
    beaten = member.join(chosen, "component").where("line != best").select("line", F.lit(True).alias("beaten"))
    rule = lines.select("line", "id", "n").join(beaten, "line", "left").where("n > 1 or beaten").select("line", F.when(F.col("beaten").isNull(), F.col("id")).alias("stays"))
    gone = found.select("line", "id").join(rule, "line").where("stays is null or id != stays")
    return gone.groupBy("id").agg(F.collect_set("line").alias("drop"))


def _cut(many: list[str], drops: list[list[bytes] | None], min_chars: int) -> list[tuple[list[str], int]]:
    """(kept lines, number of lines) of each text."""
    x = Lines(many, min_chars)
    later, hashes = x.later().tolist(), _binary(x.line()).to_pylist()
    sets = [set(d) if d else () for d in drops]
    bad: dict[int, set[int]] = {}
    for d, n, h, again in zip(x.doc.tolist(), x.number.tolist(), hashes, later, strict=True):
        if again or h in sets[d]:
            bad.setdefault(d, set()).add(n)
    out = []
    for i, text in enumerate(many):
        every = text.split("\n")
        out.append(([line for n, line in enumerate(every) if n not in bad[i]] if i in bad else every, len(every)))
    return out


def _with_drops(df: DataFrame, id_col: str, text_col: str, min_chars: int, edits: int) -> tuple[DataFrame, str]:
    """The table with each row's lines to drop, and the name of that column, one that no other has.

    A row without an id goes by a hash of its text, after all usual ids, so
    that such rows neither gather in one task nor lose lines to each other's.
    """
    small_batches(df.sparkSession)
    names = {c.lower() for c in df.columns}
    drop, key = (next(x + "_" * n for n in range(len(names) + 1) if x + "_" * n not in names) for x in ("drop", "row_key"))
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(f"`{text_col}`")), 2))
    docs = df.select(own.alias("id"), F.col(f"`{text_col}`").alias("text"))
    drops = materialize(dropped_lines(docs, min_chars, edits)).withColumnsRenamed({"id": key, "drop": drop})
    return df.withColumn(key, own).join(drops.hint("merge"), key, "left").drop(key), drop


def line_dedup(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS) -> DataFrame:
    """``(id, n_lines, n_dropped, kept_chars, kept_sha256)`` of each document.

    Of each class of lines the one of smallest document id (then hash) stays,
    in its first document and at its first place there; all others go. Lines
    under ``min_chars`` always stay. NULL texts count as empty (one empty
    line). Rows with equal ids count as one document that may keep a line in
    each of its rows; rows without an id as documents of their own after all
    others, but equal texts among them as one. An empty table gives an empty
    result; columns beside the two are dropped, whatever their names. Keys
    take (edits + 1) segments at every place they may move to, so their
    number grows with the cube of ``edits``.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for kept, n in _cut(texts(part.column("text")).to_pylist(), part.column("drop").to_pylist(), min_chars):
                    text = "\n".join(kept)
                    rows.append((n, n - len(kept), len(text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["id", "n_lines", "n_dropped", "kept_chars", "kept_sha256"])

    held, drop = _with_drops(df.select(id_col, text_col), id_col, text_col, min_chars, edits)
    out = held.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(drop).alias("drop")).mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, kept_chars long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dedup_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with duplicate lines cut from ``text``; ``n_chars``, if there, follows where the text changed.

    A document that loses half of its words or more, and has fewer left than
    the quality rules ask for, held little but copies of other documents'
    lines and goes; one that keeps more of its own stays, however short. NULL
    texts stay NULL.
    Columns beside ``doc_id`` and ``text`` are passed through, whatever their
    names; for repeated and NULL ids see :func:`line_dedup`.
    """
    least = Rules().min_words
    held, drop = _with_drops(docs, "doc_id", "text", MIN_CHARS, EDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                before = part.column("text").to_pylist()
                cut = _cut([t or "" for t in before], part.column(drop).to_pylist(), MIN_CHARS)
                after, stays, sizes = [], [], {}
                for i, (t, (kept, n)) in enumerate(zip(before, cut, strict=True)):
                    changed = t is not None and len(kept) < n
                    after.append("\n".join(kept) if changed else t)
                    if changed:
                        sizes[i] = len(after[-1])
                    left = len(_WORDS(after[-1])) if changed else least
                    stays.append(left >= least or 2 * left > len(_WORDS(t)))
                yield with_text(part.drop_columns([drop]), after, sizes).filter(pa.array(stays, pa.bool_()))

    return held.select(*(F.col(f"`{c}`") for c in docs.columns), drop).mapInArrow(run, docs.schema)
