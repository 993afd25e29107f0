"""Tokens, personal data, quality, packing against the libraries and plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lagwell.llm import bpe, packing, privacy, quality

ODD = [None, "", " ", "\n", "  a  b ", "a" * 5000, "x y　z", "\U0001f389 é̂ 'LL don't 12 34\n\n end ", "Ärger, größer; ÉTÉ! ñandú?", " \t\r\n\x0b\x0c"]


def fuzz(n, alphabet="ab \n\t1é\U0001f389's.,!", k=50, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, k))) for _ in range(n)]


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "7 as id", "'x' as tail", "1 as n_tokens") if extra else df


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + fuzz(300)
    got = {r["doc_id"]: r for r in bpe.bpe_encode(docs(spark, texts, extra=True), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = want.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_full_memory_changes_nothing():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    small, large = bpe.Encoder(ranks, public_tokenizers.PATTERN, remember=2), bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert all(small.encode(t) == large.encode(t) for t in fuzz(200, seed=3))


def test_memories_are_bounded_in_bytes():
    """Long unbroken strings are not remembered, whole texts of them are still encoded right."""
    rng = random.Random(12)
    long = ["".join(rng.choices("abcdefABCDEF0123456789+/", k=3000)) for _ in range(20)]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert all(np.frombuffer(own.encode(f"a {t} b"), "<u4").tolist() == want.encode_ordinary(f"a {t} b") for t in long)
    assert max(map(len, [*own.pieces, *own.chunks])) <= bpe.LONGEST
    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    for t in long:
        words.encode(t.encode())
    assert all(len(x) <= packing.LONGEST for x in words.runs)


def test_very_long_texts_are_encoded(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["x7y" * 20_000, "word after word " * 60_000, "\n" * 300_000]
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert all(np.frombuffer(own.encode(t), "<u4").tolist() == want.encode_ordinary(t) for t in texts)


def slow_base(t):
    kinds = []
    kinds += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    kinds += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and privacy.luhn(digits(m))]
    kinds += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in kinds]


def test_base_patterns():
    for t in fuzz(3000, "a1@.+- ()2", 40, 5) + fuzz(500, "1234567890. -+()@ab", 60, 6):
        assert [f"{privacy.KINDS[k]}:{s}:{e}" for k, s, e in privacy.base_spans(t)] == slow_base(t), t


def test_crf_adds_and_keeps(spark):
    rng = random.Random(77)
    weights = privacy.trained()
    right = missed = wrong = 0
    for _ in range(200):
        text, truth = privacy._invented(rng)
        base, every = privacy.find(text, weights)
        assert set(base) <= set(every)
        added = [x for x in every if x not in base]
        plain = {x for x in base}
        hidden = [x for x in truth if x not in plain and not any(b[1] < x[2] and x[1] < b[2] for b in base)]
        for k, s, e in hidden:
            right += any(k == a and s < d and c < e for a, c, d in added)
            missed += not any(s < d and c < e for _, c, d in added)
        wrong += sum(not any(s < d and c < e for _, s, e in truth) for _, c, d in added)
    assert right >= 0.8 * (right + missed) and wrong <= 0.05 * right, (right, missed, wrong)


def test_skip_chain_makes_mentions_agree():
    weights = privacy.trained()
    alone = "the lot 743-555-3824 was moved"
    told = "call +1 (743) 555-3824 today. " + "filler words here " * 30 + alone
    spans = {told[s:e]: k for k, s, e in privacy.find(told, weights)[1]}
    assert spans.get("743-555-3824") == 3
    # messages on a tree are exact
    unary = np.log(np.array([[0.7, 0.3], [0.5, 0.5], [0.2, 0.8]]))
    pair = np.log(np.array([[[2.0, 1.0], [1.0, 3.0]]]))
    joint = np.einsum("a,b,c,ab,bc->abc", *np.exp(unary), np.exp(pair[0]), np.exp(pair[0]))
    joint /= joint.sum()
    got = privacy.propagate(unary, [(0, 1, 0), (1, 2, 0)], pair, rounds=200)
    assert np.allclose(got, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-3)


def test_privacy_query_and_redaction(spark):
    texts = [*ODD, "mail a.b@c.de and +1 (743) 555-3824, 10.0.0.300 10.0.0.30", "4111 1111 1111 1111"]
    out = {r["doc_id"]: r for r in privacy.personal_data(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(slow_base(t or "")).encode()).hexdigest()
    kept = {r["doc_id"]: r for r in privacy.redact_docs(spark, docs(spark, texts), "").collect()}
    assert kept[len(ODD)]["text"] == "mail [EMAIL] and [PHONE], 10.0.0.300 [IP]" and kept[len(ODD)]["n_chars"] == len(kept[len(ODD)]["text"])
    assert kept[0]["text"] is None and kept[1]["text"] == "" and len(kept) == len(texts)


def slow_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = {}
    for j in range(len(w) - 2):
        count[tuple(w[j : j + 3])] = count.get(tuple(w[j : j + 3]), 0) + 1
    covered = {k for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


def slow_verdict(t, rules):
    """Whether a text stays, by the definition of each rule, with the characters that its repeats cover."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars, symbols, _, repeats = slow_quality(t)
    every = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    lines = sum(sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line))) for line in every if every.count(line) > 1)
    covered = {}
    for k, _ in rules.coverage:
        grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        held = {j + i for j, g in enumerate(grams) if grams.count(g) > 1 for i in range(k)}
        covered[k] = sum(len(w[j]) for j in held)
    bad = n < rules.min_words or 100 * repeats > 100 * rules.repeat_share * n or lines > rules.line_coverage * chars or symbols > rules.symbol_share * n
    return lines, covered, not (bad or any(covered[k] > share * chars for k, share in rules.coverage))


def test_quality_verdict(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(400)]
    texts = list(ODD)
    for i in range(150):
        t = rng.choices(words, k=rng.randint(45, 120))
        for _ in range(rng.randint(0, 4)):
            a, n = rng.randrange(len(t)), rng.choice((4, 6, 12, 40))
            t[rng.randrange(len(t)) :][:0] = t[a : a + n]
            t += t[a : a + n]
        if i % 3 == 0:
            t = [x + rng.choice("# $*") * rng.randint(0, 1) for x in t]
        sep = ["\n" if rng.random() < 0.1 else " " for _ in t]
        text = "".join(x + y for x, y in zip(t, sep, strict=True))
        texts.append("\n".join([text, *rng.choices(text.split("\n"), k=rng.randint(0, 3))]))
    rules = quality.Rules()
    out = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines, covered, stays = slow_verdict(t or "", rules)
        assert out[i]["dup_line_chars"] == lines and all(out[i][f"dup_{k}gram_chars"] == n for k, n in covered.items()) and out[i]["kept"] == stays, t
    assert 20 < sum(r["kept"] for r in out.values()) < 140


@pytest.mark.parametrize("t", ["x" * 10**6, "ab " * 350_000, "\n" * 10**6, "#" * 10**6, "a b c\n" * 170_000], ids=["word", "words", "breaks", "symbols", "lines"])
def test_very_long_texts_are_measured(spark, t):
    began = time.perf_counter()
    found = quality.quality_rules(docs(spark, [t])).first()
    assert (found["n_words"], found["word_chars"]) == (len(t.split()), sum(map(len, t.split()))) and not found["kept"]
    assert time.perf_counter() - began < 20


def test_quality_counts(spark):
    texts = ODD + fuzz(400, "ab \n#é", 120, 8) + ["the cat sat " * 30, "line one two\n" * 5]
    out = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, texts, extra=True)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = slow_quality(t or "")
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats), t
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.keep_good(spark, docs(spark, texts), "").collect()}
    assert kept == {i for i, r in out.items() if r["kept"]}


def test_quality_keeps_clean(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    clean = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    # coverage: three quarters of the characters lie in a passage that stands twice
    passage = " ".join(rng.choices(words, k=60))  # 120 of 160 words
    out = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, [*clean, " ".join([passage, *rng.choices(words, k=40), passage])])).collect()}
    assert all(out[i]["kept"] for i in range(20)) and not out[20]["kept"]
    assert out[20]["dup_10gram_chars"] == 2 * len(passage.replace(" ", ""))


def test_word_tokens_equal_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    want.encode_special_tokens = True
    for own in (packing.WordTokens(path), packing.WordTokens(path, remember=1)):
        for t in [x or "" for x in ODD] + fuzz(1500, "ab \n\t1éÉ\U0001f389's.,!İſΣß́ ", 40, 2) + ["<|endoftext|> x"]:
            assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == want.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("powers", [True, False])
def test_packing(powers):
    rng = random.Random(4)
    lengths = [rng.choice((1, 5, 60, 300, 900, 5000)) for _ in range(300)]
    placed = packing.place(lengths, 1024, packing.Cost(), powers)
    held: dict[int, list] = {}
    for length, pieces in zip(lengths, placed, strict=True):
        at = 0
        for start, n, s, offset in sorted(pieces):
            assert start == at and n > 0
            at += n
            held.setdefault(s, []).append((offset, n))
        assert at == length
    used = {}
    for s, pieces in held.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        used[s] = at
    padded = sum(1024 - n for n in used.values() if n & (n - 1))
    assert max(used.values()) <= 1024 and (padded == 0 if powers else padded < 1024)


def test_packing_balances_cost():
    lengths = [400] * 8 + [100] * 64
    placed = packing.place(lengths, 1024, packing.Cost(), True)
    cost: dict[int, float] = {}
    for pieces in placed:
        for _, n, s, _ in pieces:
            cost[s] = cost.get(s, 0) + n + n * n / 4096
    full = [c for s, c in cost.items()]
    assert max(full) < 1.25 * sorted(full)[len(full) // 2]


def test_packing_query(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    want.encode_special_tokens = True
    texts = ODD + fuzz(100)
    rows = packing.pack(docs(spark, texts, extra=True).coalesce(2), path, capacity=256).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        ids = np.array([*want.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in mine)


@pytest.mark.parametrize("query", [lambda d: bpe.bpe_encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), privacy.personal_data, quality.quality_rules, lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json"))])
def test_empty_and_repeated(spark, query):
    assert query(docs(spark, [])).count() == 0
    twice = docs(spark, ["same words here", None]).union(docs(spark, ["same words here", None]))
    assert query(twice).count() == 4
    nulls = docs(spark, ["a"]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")
    assert query(nulls).count() == 1


def test_empty_batch():
    assert packing.place([], 8, packing.Cost(), True) == []
    assert quality.measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), quality.Rules())["n_words"].tolist() == []
    assert pa.array([]) is not None


def test_secrets_and_their_copies():
    weights = privacy.trained()
    key, filler = "3f2a9c0b7d1e4f5a6b7c8d9e0f1a2b3c4d5e6f70", " and so on with many more words until the next mention of it comes along somewhere here "
    told = f'token = "{key}"{filler}then {key} again'
    assert [(k, told[s:e]) for k, s, e in privacy.find(told, weights)[1]] == [(4, key)] * 2
    assert privacy.find(f"commit {key}{filler}", weights)[1] == [] and privacy.find(f"the {key}{filler}", weights)[1] == []
    assert privacy.redact(told, privacy.find(told, weights)[1]) == f'token = "[SECRET]"{filler}then [SECRET] again'


def test_secrets_of_the_tables_are_found(spark):
    d = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in privacy.op2_pii(spark, d).collect()}
    planted = {i: [m.start(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)] for i, t in text.items()}
    assert sum(map(len, planted.values())) > 5
    for i, starts in planted.items():
        assert set(starts) == {int(x.split(":")[1]) for x in found[i]["spans"].split(",") if x.startswith("secret")}
        assert found[i]["n_added"] >= len(starts)


@pytest.mark.parametrize("t", ["0" * 5000 + "1.1.1.1", "7" * 10**6, "1." * 400_000, "a@" * 400_000, "1 " * 400_000 + "a", "+1(" * 300_000, "a" * 10**6 + "@" + "b" * 10**6, "0a" * 400_000], ids=["zeros", "digits", "dots", "ats", "spaced", "plus", "long mail", "hex"])
def test_very_long_texts_are_searched_in_linear_time(t):
    began = time.perf_counter()
    base, _ = privacy.find(t, privacy.trained())
    assert time.perf_counter() - began < 10
    assert len(base) == {"0000": 1, "1.1.": 100_000}.get(t[:4], 0)
