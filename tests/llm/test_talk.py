"""Languages against held-out labels and a plain definition; the prefix trie against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwell.llm import languages, tries
from lagwell.llm.batches import U, mix

from .test_text import ODD, fuzz

DATA = "/root/testdata/sf0.01"

# ---- languages ---------------------------------------------------------------------------


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def slow_counts(text):
    s, last = [0], 0
    for ch in text:
        c = (ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch)) if ch.isalpha() else 0
        if c or last:
            s.append(c)
        last = c
    if len(s) == 1:
        return Counter()
    s = s if s[-1] == 0 else [*s, 0]
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = 0
            for k in range(n):
                h = int(mix(np.array([(h * 0x100000001B3 + s[i + k] + k + 1) % (1 << 64)], U))[0])
            found[h >> 49] += 1
    return found


@pytest.mark.parametrize("text", ["a", "Ab, cD 12 é!", "  x  ", "İı ß", "\U0001f389", "日本語 and this", "".join(fuzz(1, k=400))])
def test_counts_are_the_runs(text):
    at, count = languages.counted(languages.symbols(text))
    assert dict(zip(at.tolist(), count.tolist(), strict=True)) == slow_counts(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    s = languages.symbols(" ".join(fuzz(200, "abcdé fg", 60)))
    at, count = languages.counted(s)
    for part in (7, 64, len(s) - 1):
        monkeypatch.setattr(languages, "PART", part)
        again = languages.counted(s)
        assert again[0].tolist() == at.tolist() and again[1].tolist() == count.tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = languages.fit(docs)
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    got = languages.identify(docs, model).collect()
    assert len(got) == len(truth) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    asked = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]][0] == r["lang_pred"] for r in asked) >= 0.97 * len(asked)
    # the nearest centroid by the plain definition
    for r in random.Random(1).sample(got, 25):
        v = np.zeros(languages.FEATURES)
        for f, n in slow_counts(truth[r["doc_id"]][1]).items():
            v[f] = (1 + math.log(n)) * model.idf[f]
        cosine = v @ model.centroids / np.linalg.norm(v)
        assert model.langs[int(cosine.argmax())] == r["lang_pred"] and cosine.max() == pytest.approx(r["score"], abs=1e-5)
    # neither partitions nor what may not be learned from change the result
    changed = docs.repartition(7).withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in languages.identify(changed, languages.fit(changed)).collect()}
    assert all(again[r["doc_id"]][0] == r["lang_pred"] and again[r["doc_id"]][1] == pytest.approx(r["score"], abs=1e-6) for r in got)


def test_document_frequencies_cover_every_row(spark):
    texts = fuzz(60, "abc d", 30, seed=4)
    model = languages.fit(spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string"), per_language=3)
    kept = [t for i, t in enumerate(texts) if not held_out(i)]
    df = Counter(f for t in kept for f in slow_counts(t))
    assert all(model.idf[f] == pytest.approx(math.log((1 + len(kept)) / (1 + df[f])) + 1) for f in range(0, languages.FEATURES, 7)) and len(df) > 20


def test_distance_rejects_what_is_like_nothing_learned(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = languages.fit(docs)
    strange = ["Щука плывёт по реке и поёт песню", "zzq xxj qqz wwv kjj xqz " * 9, "12 34 !!", None, ""]
    got = [model.predict(t) for t in strange]
    assert all(g[2] for g in got) and all(g[0] in model.langs for g in got[:2]) and [g[:2] for g in got[2:]] == [("und", 0.0)] * 3
    kept = docs.where("length(text) > 400")
    assert languages.identify(kept, model).where("rejected").count() <= 0.02 * kept.count()


def test_languages_edges(spark):
    kind = "doc_id long, text string, lang string"
    none = languages.fit(spark.createDataFrame([], kind))
    assert languages.identify(spark.createDataFrame([], kind), none).count() == 0
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(ODD)] + [(None, "aa bb", "c"), (3, "aa bb", "a"), (3, "aa bb", "a"), (99, "x" * 300_000, "b")]
    df = spark.createDataFrame(rows, kind).selectExpr("*", "1 as held_out", "'q' as lang_pred", "2 as id", "3 as chosen")
    got = languages.identify(df, languages.fit(df)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert {r["lang_pred"] for r in got} <= {"a", "b", "und"} and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert [r["lang_pred"] for r in languages.identify(df, none).collect()] == ["und"] * len(rows)
    with pytest.raises(ValueError, match="languages"):
        languages.fit(df, most_languages=1)


# ---- prefix trie -------------------------------------------------------------------------


def slow_trie(rows):
    def key(t, role, text):
        return (t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())

    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((key(t, role or "", text or ""), (role or "", text or "")))
    plain = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(plain.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ended[seq].append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[:-1] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(n=70, seed=5):
    """Conversations with shared openings, copies, gaps, NULLs, equal turns, repeated rows."""
    rng, rows = random.Random(seed), []
    for c in [*range(n), 20 * n, -5, -20, -27]:
        base = rng.choice([0, 0, 0, 1, 2])
        for t in range(rng.choice([1, 2, 3, 5, 7])):
            text = f"{base} t{t} word" if rng.random() < 0.75 else rng.choice([None, "", "a b\tc\n d", "x y", "é ü"])
            rows.append((c, None if rng.random() < 0.05 else t // (1 + (rng.random() < 0.1)), rng.choice(["user", "user", "bot", None]), text))
    rows += [(None, 0, "user", "lost"), *rows[:6], (41, 9, "u", "z " * 50_000)]
    rng.shuffle(rows)
    return rows


def nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limits", [{}, {"most_turns": 12, "bucket_turns": 10}, {"most_turns": 1, "bucket_turns": 3}])
def test_trie_equals_brute_force(spark, limits):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as depth", "'x' as prefix", "2 as pos", "3 as n")
    assert nodes(tries.conversation_trie(df.repartition(5), **limits)) == slow_trie(rows)


def test_trie_of_long_and_equal_conversations(spark):
    """One conversation of many turns, its copies, and one that leaves it late: peeled in a few rounds, not one a turn."""
    long = [("u", f"w{k}") for k in range(900)]
    rows = [(c, t, *x) for c in (8, 10, 15) for t, x in enumerate(long if c != 15 else [*long[:-1], ("u", "other")])]
    rows += [(c, 0, "u", "same") for c in range(100, 160)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert nodes(tries.conversation_trie(df, most_turns=40)) == nodes(tries.conversation_trie(df))
    assert {r[3] for r in nodes(tries.conversation_trie(df)) if r[1] == 1} == set(dict.fromkeys(r[3] for r in slow_trie(rows) if r[1] == 1))


def test_trie_edges(spark):
    kind = "conv_id long, turn int, role string, text string"
    assert tries.conversation_trie(spark.createDataFrame([], kind)).count() == 0
    lone = [(20 + k, 0, "u", "t") for k in range(1, 8)]  # without base conversations, some are left without turns
    got = nodes(tries.conversation_trie(spark.createDataFrame(lone, kind)))
    assert got == slow_trie(lone) and got[0][3] <= 7


def test_trie_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = sorted(con.execute(tries.ORACLE_SQL).fetchall(), key=repr)
    assert nodes(tries.op12_prefix_trie(spark, DATA)) == want


def test_ends_are_hashed_in_order_across_blocks(spark):
    ids = random.Random(2).sample(range(-9000, 90_000), 3000)
    df = spark.createDataFrame([(i, b"p" if i % 3 else b"q") for i in ids], "conv_id long, prefix binary")
    want = {p: hashlib.sha256(",".join(str(i) for i in sorted(ids) if (i % 3 == 0) == (p == b"q")).encode()).hexdigest() for p in (b"p", b"q")}
    assert {bytes(r["prefix"]): r["ends_sha256"] for r in tries.ends(df).collect()} == want
