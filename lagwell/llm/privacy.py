"""Personal data: exact base patterns, and a skip-chain CRF that adds what they miss.

The base finds the four kinds by their written form. The CRF labels the
tokens that look like personal data but have another form (a number without
its plus sign, two card numbers run together, an address with "at" and "dot")
and a fifth kind that no base pattern covers, secrets: long mixed runs of
letters and digits such as access tokens, told from checksums and names by
what stands before them. Its chain potentials join neighbouring candidates;
its skip potentials join candidates, however far apart, that carry the same
or nearly the same characters, so a mention in plain form lends its label to
the others. Marginals come from loopy sum-product message passing.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lagwell.llm.batches import slices, small_batches, texts, with_text

#: The base's kinds, then the one that only the CRF gives.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
Span = tuple[int, int, int]  # kind, start, end

# The base patterns of the four kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Numbers joined by dots, as long as they go on: four in a row, counted from the first, are what the base's pattern of ip,
#: ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, matches from the left, found here in one pass over any run of digits.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[Span]:
    """The base's spans by kind, then start."""
    out: list[Span] = []
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            taken = found.end()
        at = text.find("@", max(at + 1, taken))
    for m in _DOTTED.finditer(text) if "." in text else ():
        if m.end() - m.start() < 7:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(_byte(p) for p in four):
                out.append((1, at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


# ---- candidates of the CRF -------------------------------------------------------------

LABELS = ("none", *KINDS)
#: Number-like runs of at least seven digits, grouped as people write them, and spelled-out addresses.
_NUMBER = re.compile(r"(?<![0-9A-Za-z.@_/#-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![0-9A-Za-z_@])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63})+")
_BLOCK = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])")
#: Runs that may be a secret if they hold letters and digits both.
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}+")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]").search, re.compile(r"[0-9]").search


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Unlabelled spans (kind -1) clear of every base span, by start."""
    found = [(-1, m.start(), m.end()) for m in _RUN.finditer(text) if _LETTER(m[0]) and _DIGIT(m[0])]
    if not found and not _SEVEN(text) and "dot" not in text:
        return []
    held = sorted((s, e) for _, s, e in base)
    for m in _NUMBER.finditer(text):
        blocks = [(b.start(), b.end()) for b in _BLOCK.finditer(text, m.start(), m.end())]
        if len(re.sub(r"[^0-9]", "", m[0])) > 19 and blocks:
            found += [(-1, s, e) for s, e in blocks]
        else:
            found.append((-1, m.start() + (m[0][0] == "(" and ")" not in m[0]), m.end()))
    if "dot" in text:
        found += [(-1, m.start(), m.end()) for m in _SPELLED.finditer(text)]
    found.sort(key=lambda x: x[1])
    out, end = [], 0
    i = 0
    for k, s, e in found:
        while i < len(held) and held[i][1] <= s:
            i += 1
        if s >= end and not (i < len(held) and held[i][0] < e):
            out.append((k, s, e))
            end = e
    return out


_SEVEN = re.compile(r"[0-9][\x20().0-9-]{5,}[0-9]").search


def essence(text: str) -> str:
    """What stays the same when the layout changes: digits, or an address in plain form."""
    digits = re.sub(r"[^0-9]", "", text)
    letters = _LETTER(text)
    if not letters and len(digits) >= 7:
        return digits
    if letters and " " not in text and len(text) >= 16 and digits:
        return text
    plain = re.sub(r" ?(\(at\)|\[at\]| at ) ?", "@", text)
    return re.sub(r" ?(\(dot\)|\[dot\]| dot ) ?", ".", plain).lower()


_SHAPES = (
    lambda t, d: luhn(d) and 16 <= len(d) <= 19,
    lambda t, d: len(d) == 16,
    lambda t, d: bool(re.fullmatch(r"[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}", t)),
    lambda t, d: 8 <= len(d) <= 15,
    lambda t, d: 10 <= len(d) <= 12,
    lambda t, d: bool(re.search(r"\([0-9]{3}\)", t)),
    lambda t, d: bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", t)),
    lambda t, d: t.startswith("00"),
    lambda t, d: t.isdigit(),
    lambda t, d: bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9]{2}[.-][0-9]{2}[.-][0-9]{4}", t)),
    lambda t, d: t.count(".") >= 2 and not re.search(r"[A-Za-z]", t),
    lambda t, d: "dot" in t and re.search(r"[\[( ]at[\]) ]", t) is not None,
    lambda t, d: bool(re.search(r"[\[(](at|dot)[\])]", t)),
    lambda t, d: len(d) > 19,
    lambda t, d: _mixed(t),
    lambda t, d: _mixed(t) and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", t) is not None,
    lambda t, d: _mixed(t) and re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", t) is not None,
    lambda t, d: _mixed(t) and re.search(r"[a-z]", t) is not None and re.search(r"[A-Z]", t) is not None,
    lambda t, d: _mixed(t) and len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", t)) >= len(t) // 6,
    lambda t, d: _mixed(t) and re.search(r"[/=_-]", t) is not None,
)


def _mixed(t: str) -> bool:
    """Whether it has the form of a secret: no blanks, letters and digits."""
    return len(t) >= 16 and " " not in t and _LETTER(t) is not None and _DIGIT(t) is not None


_CUES = (re.compile(r"(phone|tel|call|mobile|fax|ring|number|\+)\W*$", re.I), re.compile(r"(card|visa|credit|pay|iban|account)\W*$", re.I), re.compile(r"(mail|contact|write|reach)\W*$", re.I), re.compile(r"(order|invoice|id|ref|no|isbn|sku|total|year|page|ticket)\.?:?\W*$", re.I), re.compile(r"(token|secret|key|passw(?:or)?d|pwd|credentials?|bearer|auth\w*)\W*$", re.I), re.compile(r"(commit|checksum|hash|sha\d*|md5|digest|file|version|build|uuid|guid|etag|image|url)\W*$", re.I))
N_FEATURES = 1 + len(_SHAPES) + len(_CUES)


def features(text: str, start: int, end: int) -> np.ndarray:
    t = text[start:end]
    digits = "" if _mixed(t) else re.sub(r"[^0-9]", "", t)
    before = text[max(0, start - 24) : start]
    return np.array([1.0, *(float(f(t, digits)) for f in _SHAPES), *(float(c.search(before) is not None) for c in _CUES)])


def edges(nodes: list[tuple[str, int | None]], starts: list[int]) -> list[tuple[int, int, int]]:
    """``(i, j, type)``: 0 for neighbours within 80 characters, 1 for equal and 2 for similar essences.

    Equal nodes hang together as a chain in order of position and similar ones
    through index keys, so a value repeated n times has n - 1 edges.
    """
    out = [(i, i + 1, 0) for i in range(len(nodes) - 1) if starts[i + 1] - starts[i] <= 80]
    last: dict[str, int] = {}
    seen: dict[tuple[str, str], int] = {}
    for i, (value, _) in enumerate(nodes):
        if value in last:
            out.append((last[value], i, 1))
        last[value] = i
        # a number with or without its country code shares its last nine digits; one wrong character leaves one half whole
        half = len(value) // 2
        for key in (("end", value[-9:]), ("head", value[:half]), ("tail", value[half:])):
            if len(key[1]) < 6:
                continue
            j = seen.get(key)
            if j is not None and nodes[j][0] != value and (j, i, 2) not in out[-3:]:
                out.append((j, i, 2))
            seen[key] = i
    return out


def beliefs(unary: np.ndarray, links: list[tuple[int, int, int]], pair: np.ndarray, rounds: int = 12, damping: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [n, L] of the nodes and [e, L, L] of the edges by loopy sum-product; ``unary`` [n, L] and ``pair`` [type, L, L] are log potentials."""
    n_labels = unary.shape[1]

    def normal(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
        p = np.exp(x - x.max(axes, keepdims=True))
        return p / p.sum(axes, keepdims=True)

    if not links:
        return normal(unary, (1,)), np.zeros((0, n_labels, n_labels))
    i, j, t = np.array(links).T
    src, dst = np.stack([i, j], 1).ravel(), np.stack([j, i], 1).ravel()
    both_ways = np.stack([x for p in pair for x in (p, p.T)])[np.stack([2 * t, 2 * t + 1], 1).ravel()]
    back = np.arange(len(src)) ^ 1
    message = np.zeros((len(src), n_labels))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, message)
        inward = (total[src] - message[back])[:, :, None] + both_ways
        peak = inward.max(1, keepdims=True)
        fresh = np.log(np.exp(inward - peak).sum(1)) + peak[:, 0]
        fresh -= fresh.max(1, keepdims=True)
        step = np.abs(fresh - message).max()
        message = damping * message + (1 - damping) * fresh
        if step < 1e-4:
            break
    total = unary.copy()
    np.add.at(total, dst, message)
    joint = (total[src[::2]] - message[1::2])[:, :, None] + both_ways[::2] + (total[dst[::2]] - message[::2])[:, None, :]
    return normal(total, (1,)), normal(joint, (1, 2))


def propagate(unary: np.ndarray, links: list[tuple[int, int, int]], pair: np.ndarray, rounds: int = 12, damping: float = 0.5) -> np.ndarray:
    return beliefs(unary, links, pair, rounds, damping)[0]


# ---- training on generated documents ----------------------------------------------------


def _invented(rng: random.Random) -> tuple[str, list[Span]]:
    """A document with personal data in plain and other forms, and look-alikes, with the true spans."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        head = rng.choice("3456") + digits(14)
        return head + next(c for c in "0123456789" if luhn(head + c))

    def forms(kind: int) -> list[str]:
        if kind == 2:
            c = card()
            return [c, *(s.join(c[i : i + 4] for i in range(0, 16, 4)) for s in (" ", "-", "."))]
        if kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            country = rng.choice(("1", "44", "49", "33"))
            return [f"+{country} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{country} {a} {b} {c}", f"{a}.{b}.{c}"]
        if kind == 4:
            letters = rng.choice(("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            return ["".join(rng.choice(letters) for _ in range(rng.choice((20, 24, 32, 40, 40, 64))))]
        user, host, top = word(), word(), rng.choice(("com", "org", "net"))
        return [f"{user}@{host}.{top}", f"{user} at {host} dot {top}", f"{user} (at) {host} (dot) {top}", f"{user}[at]{host}[dot]{top}"]

    def decoy() -> str:
        return rng.choice((digits(8), digits(rng.choice((9, 12, 16, 18, 20))), f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}", f"order {digits(10)}", f"id {digits(13)}", digits(7), *(rng.choice(("commit ", "checksum: ", "sha256:", "md5 ", "uuid ", "file ", "", "", "")) + forms(4)[0] for _ in range(2)), f"{word()}-{word()}-{digits(3)}-{word()}", f"img/{word()}/{digits(4)}/{word()}_{word()}"))

    kinds = [rng.choice((0, 2, 3, 4)) for _ in range(rng.randint(0, 2))]
    held = [(k, forms(k)) for k in kinds]
    cued: set[int] = set()
    told: list[str] = []
    out, spans = "", []
    for _ in range(rng.randint(4, 16)):
        out += " ".join(word() for _ in range(rng.randint(1, 12))) + " "
        r = rng.random()
        if r < 0.45 and held:
            which = rng.randrange(len(held))
            kind, chosen = held[which]
            value, after = rng.choice(chosen), ""
            if kind == 4 and which not in cued or rng.random() < 0.15:
                out += rng.choice({0: ("mail ", "contact "), 2: ("card ", "visa: "), 3: ("phone ", "call "), 4: ("token = ", "api_key: ", "secret=", "KEY = ", "password ", "Authorization: Bearer ")}[kind])
                cued.add(which)
            if kind == 4 and rng.random() < 0.5:
                after = rng.choice("\"'")
                out += after
            spans.append((kind, len(out), len(out) + len(value)))
            out += value + after
        elif r < 0.7:
            told.append(rng.choice(told) if told and rng.random() < 0.4 else decoy())
            out += told[-1]
        out += rng.choice((" ", ". ", ", ", "\n"))
    return out, spans


def _node_table(text: str) -> tuple[list[Span], list[tuple[str, int | None]], list[int]]:
    base = base_spans(text)
    free = candidates(text, base)
    spans = sorted([*base, *free], key=lambda x: x[1])
    nodes = [(essence(text[s:e]), k + 1 if k >= 0 else None) for k, s, e in spans]
    return spans, nodes, [s for _, s, _ in spans]


@lru_cache(1)
def trained(documents: int = 250, seed: int = 5, epochs: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights [F, L], pair potentials [3, L, L]) by the likelihood of generated documents.

    Every step passes messages over all documents at once, with the base's
    labels given and the candidates' not, as in :func:`find`, and moves the
    weights by the difference of true and expected counts, less an L2
    penalty. The potentials of skip edges are one weight for equal labels, so
    that a value does not gain a label by being repeated. Takes a few seconds
    on the driver, once a process, and depends on nothing but its arguments.
    """
    rng = random.Random(seed)
    n_labels = len(LABELS)
    rows, gold, given, links = [], [], [], []
    for _ in range(documents):
        text, truth = _invented(rng)
        spans, nodes, starts = _node_table(text)
        links += [(i + len(gold), j + len(gold), t) for i, j, t in edges(nodes, starts)]
        for k, s, e in spans:
            hit = [t for t, a, b in truth if a < e and s < b and min(e, b) - max(s, a) >= 0.8 * (e - s)]
            gold.append(k + 1 if k >= 0 else hit[0] + 1 if hit else 0)
            given.append(k >= 0)
            rows.append(np.zeros(N_FEATURES) if k >= 0 else features(text, s, e))
    x, y, given = np.array(rows), np.array(gold), np.array(given)
    target = np.eye(n_labels)[y]
    fixed = np.where(target > 0, 0.0, -30.0)
    i, j, t = np.array(links).T
    true = np.zeros((3, n_labels, n_labels))
    np.add.at(true, (t, y[i], y[j]), 1)
    often = np.bincount(t, minlength=3)[:, None, None] + 1
    w, v = np.zeros((N_FEATURES, n_labels)), np.zeros((3, n_labels, n_labels))
    common = np.maximum(x.sum(0), 20)[:, None]
    for _ in range(epochs):
        p, joint = beliefs(np.where(given[:, None], fixed, x @ w), links, v)
        expected = np.zeros_like(v)
        np.add.at(expected, t, joint)
        w += 2 * (x.T @ np.where(given[:, None], 0, target - p) / common) - 1e-3 * w
        gap = (true - expected) / often
        v[0] += (gap[0] + gap[0].T) / 2 - 1e-3 * v[0]
        for kind in (1, 2):
            v[kind] += 2 * np.trace(gap[kind]) * np.eye(n_labels) - 1e-3 * v[kind]
    return w, v


def find(text: str, weights: tuple[np.ndarray, np.ndarray], sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, each by kind, then start."""
    base = base_spans(text)
    free = candidates(text, base)
    if not free:
        return base, base
    spans = sorted([*base, *free], key=lambda x: x[1])
    w, pair = weights
    unary = np.zeros((len(spans), len(LABELS)))
    for i, (k, s, e) in enumerate(spans):
        if k >= 0:
            unary[i] = -30.0
            unary[i, k + 1] = 0.0
        else:
            unary[i] = features(text, s, e) @ w
    nodes = [(essence(text[s:e]), None) for _, s, e in spans]
    p = propagate(unary, edges(nodes, [s for _, s, _ in spans]), pair)
    added = [(int(p[i, 1:].argmax()), s, e) for i, (k, s, e) in enumerate(spans) if k < 0 and p[i, 0] < 1 - sure and p[i, 1:].max() >= sure]
    return base, sorted([*base, *added])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, ``base_sha256``, ``spans`` and ``n_added``.

    ``spans`` holds the base's and the CRF's, of five kinds, by kind as in
    ``KINDS`` and then start. NULL and empty texts have no spans. Rows that
    repeat an id or a text are searched each; columns other than the id are
    dropped, whatever their names. Any length of text takes time in
    proportion to it. No shuffle.
    """

    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in texts(part.column("text")).to_pylist():
                    base, every = find(text, weights)
                    count = [0] * BASE_KINDS
                    for k, _, _ in base:
                        count[k] += 1
                    rows.append((*count, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return df.selectExpr(f"`{id_col}` id", f"`{text_col}` text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced in ``text``; ``n_chars``, if there, follows where the text changed.

    NULL texts stay NULL. Each row is searched by itself, so rows that repeat
    an id, or have none, all stay; every other column is passed through.
    """

    small_batches(spark)
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column("text").to_pylist()
                changed = {}
                for i, t in enumerate(text):
                    if t and (spans := find(t, weights)[1]):
                        changed[i] = text[i] = redact(t, spans)
                yield with_text(part, text, {i: len(t) for i, t in changed.items()})

    return docs.mapInArrow(run, docs.schema)
