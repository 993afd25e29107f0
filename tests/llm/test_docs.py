"""Fingerprints, near-duplicates, lines, shards, chats, pages and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import html
import json
import math
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagwell.llm import chat, edits, lines, near, pages, quality, shards
from lagwell.operators import graph
from lagwell.plans.lineage import materialize

from .test_text import ODD, docs, fuzz


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


# ---- fingerprints ------------------------------------------------------------------------


def slow_walk(text, plan):
    code = edits.codes(text).tolist() + [255] * 3
    i, seen = 0, {}
    times = plan.times(plan.records(2 * len(text))).tolist()
    for t in range(2 * len(text)):
        if t in set(times) if t < 400 else t in times:
            a, b, c = code[i : i + 3] if i < len(text) else [255] * 3
            seen[t] = ((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 24
        i += int(plan.bits[t % 8192, code[i]])
    return [seen[times[k]] for k in plan.sample(len(times))]


def test_embedding_is_the_walk():
    texts = ["", "a", "ab é", prose(1, 5), prose(2, 40), "\U0001f389" * 30]
    plan = edits.steps()
    for t, (n, symbols) in zip(texts, edits.embed(texts), strict=True):
        assert n == plan.records(2 * len(t)) and symbols.tolist() == slow_walk(t, plan)


def test_likeness_follows_edits():
    t = prose(3, 400)
    few = t[:500] + "X" + t[500:900] + t[903:]
    p = edits.embed([t, t, few, t[: len(t) // 2], prose(4, 400)])
    s = [edits.likeness(p[0], x) for x in p]
    assert s[0] == s[1] == 1 and s[2] > 0.85 and 0.3 < s[3] < 0.7 and s[4] < 0.1
    assert edits.likeness(*edits.embed(["", ""])) == 1 and edits.likeness(*edits.embed(["", "abc"])) == 0
    assert edits.likeness(edits.read(edits.show(p[0])), p[2]) == s[2]


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprint_query(spark, parts):
    texts = ODD + fuzz(40) + [prose(k) for k in range(20)] + [prose(1), prose(1)]
    df = docs(spark, texts, extra=True).withColumn("doc_id", F.col("doc_id") * 7 - 50).repartition(parts)
    got = {r["doc_id"]: r for r in edits.fingerprints(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        a, b, c = edits.embed([t, e, n])
        r = got[i * 7 - 50]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (edits.show(a), edits.show(b))
        assert r["near_edited"] == edits.likeness(a, b) and r["near_next"] == edits.likeness(a, c)


def test_fingerprint_edges(spark):
    assert edits.fingerprints(docs(spark, [])).count() == 0
    one = edits.fingerprints(docs(spark, ["abcd"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    twice = docs(spark, ["ab", "cd"]).union(docs(spark, ["ab", None])).selectExpr("if(doc_id = 1, null, doc_id) doc_id", "text")
    assert edits.fingerprints(twice).count() == 4


def edited(text, n, rng):
    b = list(text)
    for _ in range(n):
        j, r = rng.randrange(len(b)), rng.random()
        if r < 0.34:
            b[j] = "X"
        elif r < 0.67:
            b.insert(j, "Y")
        else:
            b.pop(j)
    return "".join(b)


def slow_classes(prints, least):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if find(a) != find(b) and edits.likeness(prints[a], prints[b]) >= least:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(prints))]


def classes_of(spark, texts, **changed):
    prints = edits.fingerprints(docs(spark, texts))
    found = {r["fingerprint"]: r["class_id"] for r in edits.edit_classes(prints, **changed).collect()}
    return [found[edits.show(p)] for p in edits.embed([t or "" for t in texts])]


def test_edit_classes(spark):
    rng = random.Random(31)
    base = [prose(k, 120) for k in range(15)]
    texts = base + [edited(b, 4, rng) for b in base[:8]] + base[:3] + ["", None, ""]
    assert classes_of(spark, texts) == slow_classes(edits.embed([t or "" for t in texts]), 0.8)
    assert edits.edit_classes(edits.fingerprints(docs(spark, []))).count() == 0
    bare = edits.fingerprints(docs(spark, ["a b c", "a b c"]).selectExpr("cast(null as long) doc_id", "text"))
    assert [r["class_id"] for r in edits.edit_classes(bare).collect()] == [None]


def test_edit_classes_send_nothing_to_the_driver(spark, monkeypatch):
    """However large a broadcast may be, none is planned for what grows with the documents."""
    plans = []

    def watched(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *more)

    for module in (edits, graph):
        monkeypatch.setattr(module, "materialize", watched)
    monkeypatch.setattr(graph, "FEW", 0)
    rng = random.Random(35)
    base = [prose(k, 60) for k in range(30)]
    texts = base + [edited(b, 2, rng) for b in base[:20]]
    assert classes_of(spark, texts) == slow_classes(edits.embed(texts), 0.8)
    joins = [p for p in plans if "Join" in p]
    assert len(joins) > 5 and not [p for p in joins if "Broadcast" in p]


def test_bands_find_alike_texts():
    """Recall of the bands against brute force, over pairs of every likeness from the threshold."""
    rng = random.Random(32)
    base = [prose(k, rng.choice((12, 30, 60, 120, 400, 900))) for k in range(400)]
    other = [edited(t, max(1, int(len(t) * rng.choice((0.004, 0.008, 0.012, 0.016)))), rng) for t in base]
    alike = hit = 0
    for t, u, p, q in zip(base, other, edits.embed(base), edits.embed(other), strict=True):
        if edits.likeness(p, q) >= edits.ALIKE:
            alike += 1
            hit += bool(set(edits.bands(len(t), p)) & set(edits.bands(len(u), q)))
    assert alike > 150 and hit >= 0.95 * alike, (alike, hit)


@pytest.mark.parametrize(("levels", "whole"), [(0, 50), (2, 50), (2, 8192)])
def test_hot_bands(spark, monkeypatch, levels, whole):
    """A large group of near copies around one text and texts that share half of it, in bands that stay large."""
    monkeypatch.setattr(edits, "SMALL", 4)
    monkeypatch.setattr(edits, "LEVELS", levels)
    monkeypatch.setattr(edits, "WHOLE", whole)
    monkeypatch.setattr(edits, "BLOCK", 16)
    rng = random.Random(33)
    seed, shared = prose(41, 300), prose(42, 150)
    texts = [edited(seed, rng.randint(2, 14), rng) for _ in range(60)]
    for g in range(25):
        own = f"{shared} {prose(100 + g, 140)}"
        texts += [own, edited(own, 6, rng)]
    prints = edits.embed(texts)
    want, got = slow_classes(prints, 0.8), classes_of(spark, texts)
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if want[a] == want[b]]
    assert 20 < len(set(want)) < 60 and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(want[a] == want[b] for a in range(len(texts)) for b in range(a) if got[a] == got[b])


def test_long_texts_walk_alone():
    rng = random.Random(34)
    texts = [prose(k, 3) for k in range(edits.TOGETHER + 5)] + [prose(99, 400), "", "x"]
    rng.shuffle(texts)
    for t, together, (alone,) in zip(texts, edits.embed(texts), [edits.embed([t]) for t in texts], strict=True):
        assert together[0] == alone[0] and together[1].tolist() == alone[1].tolist(), t
    began = time.perf_counter()
    edits.embed(["".join(rng.choices("abcdefgh ", k=2_000_000))])
    assert time.perf_counter() - began < 10


FRESH = """
import sys, json
from lagwell.llm import edits
shown, warm, chars = json.loads(sys.stdin.read())
if warm:
    edits.embed(["a b c d"])
p = [edits.read(x) for x in shown]
print(json.dumps([edits.likeness(*p), [edits.bands(n, x) for n, x in zip(chars, p)]]))
"""


@pytest.mark.parametrize("warm", [False, True])
def test_stored_fingerprints_mean_the_same_in_a_fresh_process(warm):
    """Likeness and bands follow from the fingerprints alone, whatever texts their process has walked before."""
    base = prose(77, 7000)
    other = base[:9000] + "xx" + base[9000:-800]
    prints = edits.embed([base, other])
    want = json.loads(json.dumps([edits.likeness(*prints), [edits.bands(len(t), p) for t, p in zip((base, other), prints, strict=True)]]))
    assert want[0] > 0.8 and set(map(tuple, want[1][0])) & set(map(tuple, want[1][1]))
    said = json.dumps([[edits.show(p) for p in prints], warm, [len(base), len(other)]])
    done = subprocess.run([sys.executable, "-c", FRESH], input=said, capture_output=True, text=True, check=True, timeout=120)
    assert json.loads(done.stdout) == want


def test_ranges_cut_rows_without_ids(spark):
    """NULL ids and a repeated id are cut into several ranges; every row still meets the one after it."""
    df = docs(spark, [prose(k, 8) for k in range(600)]).selectExpr("case when doc_id < 300 then null when doc_id < 500 then 7 else doc_id end doc_id", "text")
    dealt = edits.successors(df).withColumn("p", F.spark_partition_id())
    assert dealt.where("not tail").groupBy("p").count().agg(F.max("count")).first()[0] < 400
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [r["text"] for r in sorted(rows, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["h"]))]
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = {r["edited_sha256"] for r in edits.fingerprints(df).collect()}
    assert got == {hashlib.sha256((t[: len(t) - len(t) // 2] + after[t][: len(t) // 2]).encode()).hexdigest() for t in order}


# ---- near-duplicates ---------------------------------------------------------------------


def slow_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = list(ODD)
    for g in range(12):
        words = prose(g, 80).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 99))
            texts.append(" ".join(copy))
    texts += ["A b", "a  B", "a b c", prose(0, 80).upper()]
    want, sizes = slow_components(texts, k, percent)
    got = {r["doc_id"]: r for r in near.near_duplicates(docs(spark, texts, extra=True), k, percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_hot_groups(spark):
    """A large group of near copies, one of exact copies, and many documents around one passage."""
    rng = random.Random(1)
    words, passage = prose(7, 150).split(), prose(8, 60)
    texts = []
    for _ in range(150):
        copy = list(words)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = "w" + str(rng.randint(0, 999))
        texts.append(" ".join(copy))
    texts += [prose(9)] * 120 + [f"{passage} {prose(100 + i, 90)}" for i in range(120)]
    want, _ = slow_components(texts, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("levels", [1, 3])
def test_large_nodes_are_finished(spark, monkeypatch, levels):
    """Pairs at the threshold in a group just under it, in nodes that stay large to the end."""
    monkeypatch.setattr(near, "SMALL", 2)
    monkeypatch.setattr(near, "LEVELS", levels)
    monkeypatch.setattr(near, "LEAST", 20, raising=False)
    rng = random.Random(5)
    words, texts = prose(11, 200).split(), []
    for g in range(150):
        base = list(words)
        for x in rng.sample(range(200), 4):
            base[x] = f"g{g}x{x}"
        for v in range(2):
            copy = list(base)
            for x in rng.sample(range(200), 2):
                copy[x] = f"v{g}x{x}y{v}"
            texts.append(" ".join(copy))
    want, _ = slow_components(texts, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs(spark, texts), 3, 85).collect()}
    assert 100 < len(set(want)) < 290 and [got[i] for i in range(len(texts))] == want


def test_trees_are_independent():
    """No two trees share a place; of pairs at the threshold almost none meets in no tree, and none is estimated away."""
    for percent in (80, 85):
        n = near.n_trees(percent / 100, 1 - 5e-7)
        places = np.stack([near._choose(np.zeros(1, np.uint64), b)[0] for b in range(n)])
        assert len(set(places.ravel().tolist())) == places.size
        rng = np.random.default_rng(percent)
        lost = sum(int((~(rng.random((20_000, near.PLACES)) < percent / 100)[:, places].all(2).any(1)).sum()) for _ in range(10))
        agree = rng.binomial(near.PLACES, percent / 100, 10**6) / near.PLACES
        assert lost <= 2 and (agree < near.least_agreement(percent / 100, 5e-7)).sum() <= 5


def test_ids_with_several_texts(spark):
    """Every text of an id is linked by its own set, to the smallest id; rows that share an id stay or go together."""
    a, b, c = prose(50, 80), prose(51, 80), prose(52, 80)
    rows = [(5, a), (5, b), (5, b), (9, a + " more"), (7, b + " more"), (3, c), (7, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(5, 5), (5, 5), (5, 5), (9, 5), (7, 5), (3, 3), (7, 3)])
    assert sorted(r["doc_id"] for r in near.keep_first(spark, df, "").collect()) == [3, 5, 5, 5]


def test_very_long_near_copies(spark):
    long = prose(60, 150_000)
    other = long[: len(long) // 2] + " changed here " + long[len(long) // 2 :]
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs(spark, [long, other, prose(61, 150_000), "a " * 400_000])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_block_overlaps():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, n, 40, np.uint64)) for _ in range(90) for n in (60, 5000)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert near._overlaps(left, right).tolist() == want


def test_near_edges(spark):
    assert near.near_duplicates(docs(spark, [])).count() == 0
    nulls = docs(spark, ["a b c", "a b c"]).selectExpr("cast(null as long) doc_id", "text")
    assert [r["kept"] for r in near.near_duplicates(nulls).collect()] == [True, True]
    extra = docs(spark, [prose(1), prose(1), None], extra=True).withColumns({"rep": F.lit(1), "hi": F.lit(2), "kept": F.lit(3), "Component_id": F.lit(4)})
    kept = near.keep_first(spark, extra, "")
    assert kept.columns == extra.columns and [r["kept"] for r in kept.collect()] == [3, 3]


# ---- lines -------------------------------------------------------------------------------


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 8))) for _ in range(2))
        for k in (1, 2, 3):
            assert lines.within(a, b, k) == lines.within(list(a), list(b), k) == (slow_distance(a, b) <= k)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def slow_lines(ids, texts, least, edits):
    """The lines that stay of each text, by brute force over all pairs of lines."""
    place = {}
    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            s = line.strip(" \t\n\x0b\x0c\r")
            if len(s) >= least:
                place[s] = min(place.get(s, i), i)
    parent = {s: s for s in place}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cut = {s: w if len(w := re.findall(r"[^ \t\n\x0b\x0c\r]+", s)) >= 10 else s for s in place}
    every = list(place)
    for a in range(len(every)):
        for b in range(a):
            x, y = cut[every[a]], cut[every[b]]
            if type(x) is type(y) and abs(len(x) - len(y)) <= edits and find(every[a]) != find(every[b]) and slow_distance(x, y) <= edits:
                parent[find(every[a])] = find(every[b])
    classes = {}
    for s in every:
        classes.setdefault(find(s), []).append(s)
    # of the lines that could stay, those of smallest id; which of several of one document is up to a hash
    best = {s: (first, {x for x in members if place[x] == first}) for members in classes.values() for first in [min(place[x] for x in members)] for s in members}
    return best


def check_lines(spark, ids, texts, edits=1):
    best = slow_lines(ids, texts, 20, edits)
    df = docs(spark, texts, extra=True).withColumn("doc_id", F.element_at(F.lit(ids), (F.col("doc_id") + 1).cast("int")))
    got = {r["doc_id"]: r for r in lines.line_dedup(df, edits=edits).collect()}
    chosen, found = set(), 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        options = [[]]
        every = (t or "").split("\n")
        for line in every:
            s = line.strip(" \t\n\x0b\x0c\r")
            group = best.get(s)
            if group is None:
                options = [[*o, line] for o in options]
            elif group[0] == i and s in group[1] and len(group[1]) > 1:
                options += [[*o, line] for o in options]
            elif group[0] == i and s in group[1] and s not in chosen:
                chosen.add(s)
                options = [[*o, line] for o in options]
        want = {hashlib.sha256("\n".join(o).encode()).hexdigest(): len(every) - len(o) for o in options}
        r = got[i]
        assert r["n_lines"] == len(every) and r["kept_sha256"] in want and r["n_dropped"] == want[r["kept_sha256"]], (i, t)
        found += r["n_dropped"]
    # one line of each class stays, at its first place
    classes = {min(x) for _, x in best.values()}
    held = sum(sum(len(line.strip(" \t\n\x0b\x0c\r")) >= 20 for line in (t or "").split("\n")) for t in texts)
    assert found == held - len(classes)


def variants(n, seed):
    """Three lines a text: one of its own, one an edit or three from a common one, one of many words, some of them others."""
    rng = random.Random(seed)
    base, words = "the quick brown fox jumps over a lazy dog", "a line of many words that goes on for quite a while until it ends at last".split()
    for i in range(n):
        b, w, j, r = list(base), list(words), rng.randrange(len(base)), rng.random()
        at = rng.randrange(len(w))
        if r < 0.3:
            b[j], w[at] = rng.choice("XYZ"), f"new{rng.randint(0, 30)}"
        elif r < 0.6:
            b.insert(j, rng.choice("XYZ"))
            w.insert(at, f"more{rng.randint(0, 30)}")
        elif r < 0.8:
            b.pop(j)
            w.pop(at)
        else:
            for k in (0, 9, 19):
                b[(j + k) % len(b)] = "QWV"[k % 3]
                w[(at + k) % len(w)] = f"other{k}"
        yield f"item {i}\n{''.join(b)}\nThe one {hashlib.md5(str(i).encode()).hexdigest()} here\n{' '.join(w)}"


def templates(n):
    """Lines of one template with another word at the same place, twins of them a character apart, and lines that share only their start."""
    for i in range(n):
        yield f"the user logged in to the system at the time {i * 7919 % 1009} and went away again\nthe common start of a line {hashlib.md5(str(i // 2).encode()).hexdigest()[:12]}{'x' * (i % 2)}\nshort {i}"


@pytest.mark.parametrize(
    ("texts", "edits"),
    [
        ([*ODD, *variants(12, 1), "x" * 30 + "\n" + "x" * 30 + "\n" + "x" * 31, "a  b c d e f g h i j k\na b c d  e f g h i j k"], 1),
        (list(variants(150, 2)), 1),
        (list(templates(120)), 1),
        ([*ODD, *variants(100, 3), *templates(40)], 2),
        (list(variants(40, 4)), 3),
    ],
    ids=["small groups", "a hot segment", "templates", "two edits", "three edits"],
)
def test_lines_equal_brute_force(spark, texts, edits):
    check_lines(spark, [3 * i + 1 for i in range(len(texts))][::-1], texts, edits)


def test_keys_meet():
    """Whatever the edits, a line and an edited one share a key; so do rests, down to the last round."""
    rng = random.Random(6)
    for edits in (1, 2, 3):
        for _ in range(300):
            a = rng.choices("abcdef", k=rng.randint(3, 14))
            b = list(a)
            for _ in range(edits):
                j = rng.randrange(len(b) + 1)
                b[j : j + rng.randint(0, 1)] = rng.choices("abcdef", k=rng.randint(0, 1))
            short, long = sorted((a, b), key=len)
            held = [(1, short, long)]
            while held:
                key, x, y = held.pop()
                longer = len(long) - len(short)
                step = lines.keys_of_end if len(x) <= edits else lines.keys_of_rest
                index = {k: r for k, home, _, r in step(key, True, 0, x, edits) if home}
                probe = [(k, r) for k, home, _, r in step(key, longer == 0, longer, y, edits)]
                met = [(k, index[k], r) for k, r in probe if k in index]
                assert met, (edits, short, long, x, y)
                if step is lines.keys_of_rest:
                    held += [m for m in met if slow_distance(m[1], m[2]) <= edits]


def test_line_stage(spark):
    a, b = "one line that is long enough", "another line that is long enough"
    texts = [f"{a}\nshort\n{b}", f"short\n{a[:-1]}X\n{prose(3)}", a, None, "", f"{b}\n{b}"]
    df = docs(spark, texts).withColumns({"drop": F.lit(1), "row_key": F.lit("k"), "__id": F.lit(2), "Line": F.lit(3)})
    kept = {r["doc_id"]: r for r in lines.dedup_docs(spark, df, "").collect()}
    assert kept[0]["text"] == texts[0] and kept[1]["text"] == f"short\n{prose(3)}" and kept[1]["n_chars"] == len(kept[1]["text"])
    assert set(kept) == {0, 1, 3, 4} and kept[3]["text"] is None and (kept[1]["drop"], kept[1]["row_key"], kept[1]["Line"]) == (1, "k", 3)
    assert lines.line_dedup(docs(spark, [])).count() == 0
    # a document that loses most of its words and keeps few goes, one that loses nothing or little stays
    near_copy, boilerplate = f"{prose(3)}\n{prose(5, 20)}", "all rights are reserved by the owner of this page"
    texts = [prose(3), near_copy, f"{prose(3)}\n{prose(6, 60)}", "few words here, yet its own", boilerplate, f"{prose(7, 40)}\n{boilerplate}"]
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_docs(spark, docs(spark, texts), "").collect()}
    assert set(kept) == {0, 2, 3, 4, 5} and kept[5] == prose(7, 40)
    bare = docs(spark, texts).select("doc_id", "text")
    assert lines.dedup_docs(spark, bare, "").columns == ["doc_id", "text"]


def test_lines_without_ids(spark):
    a, b = "one line that is long enough", "another line that is long enough"
    df = docs(spark, [f"{a}\n{b}", f"{a}\n{b}\nmore", f"{b}\n{a}", None, None, f"{a}"]).selectExpr("if(doc_id = 5, 5, null) doc_id", "text")
    rows = lines.line_dedup(df).collect()
    assert len(rows) == 6 and [r["n_dropped"] for r in rows if r["doc_id"] == 5] == [0]
    assert sum(r["n_lines"] - r["n_dropped"] for r in rows) == 2 + 1 + 2  # one a, one b, a short line, two empty texts


def test_very_long_lines(spark):
    wide, tall = "ab" * 500_000, "\n".join(f"a line with the number {i * 7919 % 99991} in it" for i in range(30_000))
    rows = {r["doc_id"]: r for r in lines.line_dedup(docs(spark, [wide, wide[:-1] + "c", tall, "x " * 500_000])).collect()}
    assert rows[1]["n_dropped"] == 1 and rows[0]["n_dropped"] == 0 and rows[2]["n_lines"] == 30_000


# ---- shards ------------------------------------------------------------------------------


def test_hypergeometric_law():
    rng = random.Random(3)
    draws = [shards.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    big = [shards.hypergeometric(rng, 10**9, 15 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 62_500) < 100
    assert shards.hypergeometric(rng, 5, 0, 3) == 3 and shards.hypergeometric(rng, 0, 5, 3) == 0 and shards.hypergeometric(rng, 4, 3, 7) == 4
    for good, bad, draws in ((30, 70, 20), (5, 3, 6), (10**6, 15 * 10**6, 2000)):
        least, w = shards.weights(good, bad, draws)
        exact = [math.comb(good, least + k) * math.comb(bad, draws - least - k) for k in range(0, len(w), max(1, len(w) // 40))]
        best = max(math.comb(good, least + k) * math.comb(bad, draws - least - k) for k in np.flatnonzero(w == 1).tolist())
        assert np.allclose(w[:: max(1, len(w) // 40)], [float(Fraction(x, best)) for x in exact], rtol=1e-11, atol=0)
    least, w = shards.weights(10**11 // 16, 15 * 10**11 // 16, 12_000_000)
    assert abs((np.arange(len(w)) + least) @ w / w.sum() / 750_000 - 1) < 1e-9
    cells = shards.communication_matrix({0: 100, 1: 57, 2: 1}, 16, 1)
    per = Counter()
    for b, s, lo, hi in cells:
        per[s] += hi - lo
    assert max(per.values()) - min(per.values()) <= 1 and sum(per.values()) == 158


def test_shards(spark):
    texts = ODD + fuzz(300) + ["same"] * 200
    df = docs(spark, texts, extra=True)
    rows = shards.hypergeometric_shards(df).collect()
    by = {}
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "rows" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shards.hypergeometric_shards(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert shards.hypergeometric_shards(docs(spark, [])).count() == 0
    assert shards.hypergeometric_shards(docs(spark, ["a"] * 40).selectExpr("cast(null as long) doc_id", "text")).count() == 40


def test_copies_spread_over_buckets(spark, monkeypatch):
    """Rows equal in id and text are numbered, so that no bucket takes them all."""
    monkeypatch.setattr(shards, "COPIES", 16)
    df = docs(spark, ["", None, "x"]).selectExpr("if(doc_id = 2, 2, null) doc_id", "text", "explode(sequence(1, if(doc_id = 2, 1, 150))) n")
    rows = shards.hypergeometric_shards(df).collect()
    assert len(rows) == 301 and sorted(Counter(r["shard"] for r in rows).values()) == [18] * 3 + [19] * 13
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(16) for k in range(19 if s < 13 else 18)]


# ---- chats -------------------------------------------------------------------------------


def test_escape_is_reversible(spark):
    texts = fuzz(2000, "<|\\im_end>\nn", 14, 11) + ["<|im_end|>", "\\<|", "<\\|", "<\\\\|", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = df.select("t", chat.escape(F.col("t")).alias("e"), chat._role_out(F.col("t")).alias("r"))
    bad = e.where((chat.unescape(F.col("e")) != F.col("t")) | F.contains("e", F.lit("<|")) | (chat._role_in(F.col("r")) != F.col("t")) | F.contains("r", F.lit("\n")))
    assert bad.isEmpty()


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>\n"), (1, 0, "user", None), (1, 1, "assistant", "b<|im_end|>\n"), (2, None, None, ""), (2, 5, "assistant", "\\<|x"), (None, 0, "a\nb", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("role2", F.lit("x"))
    turns = chat.canonical(df.select("conv_id", "turn", "role", "text"))
    read = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("user", ""), ("assistant", "b<|im_end|>\n"), ("assistant", "b<|im_end|>\n")]
    assert read[1]["loss"] == ["b<|im_end|>\n"] * 2 and [tuple(t) for t in read[2]["turns"]] == [("", ""), ("assistant", "\\<|x")]
    assert [tuple(t) for t in read[None]["turns"]] == [("a\nb", "é")]
    assert chat.canonical(df.where("false").select("conv_id", "turn", "role", "text")).count() == 0


def test_layouts(spark):
    spark.sql("select 1")
    shapes = {
        "messages": spark.sql("select 1 conv_id, array(struct('user' role, 'q' content), struct('assistant' role, 'a' content)) messages"),
        "from and value": spark.sql("select 1 conv_id, array(struct('human' `from`, 'q' value), struct('gpt' `from`, 'a' value)) conversations"),
        "prompt and response": spark.sql("select 1 conv_id, 'q' prompt, 'a' response, 3 score"),
        "instruction": spark.sql("select 1 conv_id, 'q' instruction, '' input, 'a' output"),
        "question and answer": spark.sql("select 1 conv_id, 'q' Question, 'a' Answer"),
    }
    for name, df in shapes.items():
        assert chat.recognise(df.schema, key="conv_id").name == name
        assert [tuple(t) for t in chat.canonical(df).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no layout"):
        chat.recognise(spark.sql("select 1 a").schema)


def test_the_fingerprint_decides(spark):
    """A layout whose print is not the schema's is not chosen, whatever its leaves; the tables' own layout is found at once."""
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = chat.LAYOUTS[0]
    assert chat.fingerprint(chat.field_paths(table.schema)) == rows.print and chat.recognise(table.schema, key="conv_id") is rows
    wrong = chat.Layout("turn rows", rows.paths, by_rows=rows.by_rows)
    object.__setattr__(wrong, "print", "0" * 16)
    with pytest.raises(ValueError, match="no layout"):
        chat.recognise(table.schema, (wrong,))


def test_very_long_conversations(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("<|t"), F.col("id").cast("string"), F.when(F.col("id") == 7, F.repeat(F.lit("long \\"), 200_000)).otherwise("")).alias("text"))
    read = chat.read_chat(chat.format_chat(chat.canonical(turns))).first()
    want = {r["turn"]: r["text"] for r in turns.collect()}
    assert [t["text"] for t in read["turns"]] == [want[i] for i in range(3000)] and read["loss"] == [want[i] for i in range(1, 3000, 2)]


def test_chat_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.execute(chat.ORACLE_SQL)
    names = [x[0] for x in want.description]
    got = chat.op10_chat(spark, d).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r["conv_id"] == -1 and r["n_turns"] == 2 and r["loss_chars"] == 34 for r in got)


# ---- pages -------------------------------------------------------------------------------


def test_messages_on_a_tree_are_exact():
    tree = pages.parse("<div><p>a b c.</p><nav><a>x</a></nav></div>")
    rng = np.random.default_rng(0)
    w, pair = rng.normal(size=pages.N_FEATURES), rng.normal(size=(pages.N_EDGES, 2, 2))
    f = pages.forest([tree])
    n = len(tree.parent)
    weight = np.zeros([2] * n)
    for y in np.ndindex(*weight.shape):
        weight[y] = sum(y[i] * (f.x[i] @ w) for i in range(n)) + sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
    p = np.exp(weight - weight.max())
    p /= p.sum()
    want = [p.sum(tuple(j for j in range(n) if j != i))[1] for i in range(n)]
    got, _, log_z = pages.marginals(f, w, pair)
    assert np.allclose(got, want) and np.isclose(log_z, np.log(np.exp(weight).sum()))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><body><article>One two", ["One two"]),
        ("<html><head><title>t</title><script>'<body>'</script><p>One</p>", ["One"]),
        ("<head><title>t</title></head><body><p>One</p></body>", ["One"]),
        ("<p>One</p><svg width='1'/><p>Two</p>", ["One", "Two"]),
        ("<p>One</p><iframe src='x'><p>Two</p><noscript><p>Three</p>", ["One", "Two", "Three"]),
        ("<p>One</p><svg><text>no</text></svg><p>Two</p><script>no", ["One", "Two"]),
        ("<p>Energy is <math><mi>E</mi><mo>=</mo><mrow><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math> as we know", ["Energy is E=mc2 as we know"]),
        ("<p>A<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math> b <object data='f'>shown instead</object>.</p>", ["Ax b shown instead."]),
    ],
)
def test_open_elements_keep_the_page(page, want):
    assert [text for _, text in pages.parse(page).blocks] == want


def slow_tags(page):
    """Start, end, name of each tag by definition: the first ``>`` outside quotes if there is one before a bare ``<``, else the first."""
    out, at = [], 0
    while m := re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*|[^>]*)>|<[!?][^>]*>", re.S).search(page, at):
        out.append((m.start(), m.end(), (m[2] or "").lower()))
        at = m.end()
    return out


def test_tags_equal_the_pattern():
    rng = random.Random(8)
    parts = ["<p>", "</p>", "a b", '<a href="x>y">', "<b", '"x"', "'x'", ">", "<", "<!-- c -->", "<!--", "<!doctype>", "<i title='>'>", "<br/>", "<x y=z", " "]
    for _ in range(4000):
        page = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        tags, at, got = pages.Tags(page), 0, []
        while found := tags.next(at):
            got.append(found[:3])
            at = found[1]
        assert got == slow_tags(page), page


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, '<a "' * 250_000, "<div>" * 100_000 + "</x>" * 100_000, "<div>" * 200_000 + "x", "<ul><li><ul>" + "<div>" * 100_000 + "<li></li>" * 50_000, "<!--" * 250_000, "<" * 10**6, "<a " + "\"<b '>'\"" * 100_000 + "<", "<svg>" * 200_000, "<div>" * 100_000 + "<body>" * 100_000],
    ids=["open tags", "open quotes", "stray ends", "deep", "fenced items", "comments", "signs", "quotes in quotes", "foreign", "bodies"],
)
def test_very_long_pages_are_read_in_linear_time(page):
    began = time.perf_counter()
    pages.main_text([pages.parse(page)], *pages.trained())
    assert time.perf_counter() - began < 10


def test_held_out_pages():
    w, pair = pages.trained()
    rng = random.Random(4242)
    right = total = 0
    for _ in range(200):
        tree, label = pages.labelled_tree(*pages._labelled(rng))
        keep = pages.marginals(pages.forest([tree]), w, pair)[0] > 0.5
        for at, _ in tree.blocks:
            right += keep[at] == label[at]
            total += 1
    assert right >= 0.98 * total


def test_pages_query(spark):
    article = "<article><h1>A &amp; B</h1><p>First   part of it, long enough to be read.<br>Second&nbsp;line of it.<p>Next <b>para</b>graph, with more words in it.</article>"
    rows = [
        (0, f"<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- no --><div class=ad>Buy this now.</div>{article}<footer>&copy; us</footer></body></html>"),
        (1, None),
        (2, ""),
        (3, "<nav><a href=x>Only</a> <a href=y>links</a></nav>"),
        (4, f"{article}<div class='comments'><div class='comment'><p>I like this a lot, thanks.</p></div></div><aside>More stories</aside><form><label>Search</label><input></form>"),
        (5, "<p>" * 3000 + "deep and broken <b <i> < 3 & text that goes on for a while, as such text does."),
        (6, "<!-- never closed <p>x"),
    ]
    df = spark.createDataFrame([(i, f"u{i}", h, 1) for i, h in rows], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in pages.extract(df).collect()}
    want = "A & B\n\nFirst part of it, long enough to be read. Second line of it.\n\nNext paragraph, with more words in it."
    assert out[0]["text"] == out[4]["text"] == want and out[0]["n_chars"] == len(want) and out[0]["url"] == "u0"
    assert out[1]["text"] == out[2]["text"] == out[3]["text"] == out[6]["text"] == "" and len(out) == len(rows)
    assert pages.extract(df.where("false")).count() == 0


def test_pages_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in pages.op5_pages(spark, d).collect():
        body = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


# ---- the pipeline ------------------------------------------------------------------------


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    held = spark.read.parquet(f"{d}/documents.parquet")
    columns = held.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "personal data", "packing"]
    sizes = [held.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, d)
        assert held.columns == columns
        sizes.append(held.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]
    want = {r["doc_id"] for r in quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).where("kept").collect()}
    assert all(labels.get(i, 1) == 1 for i in want)
    final = corpus_pipeline.run(spark, d)
    packed = final.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert packed.where("n != t").isEmpty() and packed.count() == sizes[-1]
    assert corpus_pipeline.STAGES and {r["doc_id"] for r in packed.collect()} <= want
