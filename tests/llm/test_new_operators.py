"""Hard negatives, secret scans and the trie of conversations against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives, prefix_trie, secret_scan

VECTORS = "vec_id long, embedding array<float>, label int, score double, ANCHOR_ID string"


def vectors():
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], i % 3, 0.0, "x") for i in range(240)]
    for i in range(100, 140):  # one very common vector, ties all through
        rows[i] = (i, [0.5] * 6, i % 2, 0.0, "x")
    rows += [(300, None, 1, 0.0, "x"), (350, [0.1] * 6, None, 0.0, "x"), (400, [0.1, None] + [0.1] * 4, 1, 0.0, "x"), (450, [0.1, math.nan] + [0.1] * 4, 1, 0.0, "x"), (500, [math.inf] * 6, 1, 0.0, "x")]
    rows += [(None, [0.9] * 6, 1, 0.0, "x"), (550, [], 1, 0.0, "x"), (551, [], 1, 0.0, "x"), (552, [], 2, 0.0, "x"), (600, [0.3, 0.2], 0, 0.0, "x"), (601, [0.3, 0.25], 0, 0.0, "x"), (602, [0.2, 0.1], 1, 0.0, "x")]
    return rows + [rows[0], rows[7], (9, [0.0] * 6, 5, 0.0, "x")]


def negatives_of(rows):
    one = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(256 * float(np.float32(c))) for c in v])
        one[i] = min(one.get(i, x), x)
    out = set()
    for a, (la, va) in one.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(va, v)) for i, (_, v) in one.items() if i != a and len(v) == len(va)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == la][:5]:
            fit = [n for n in order if one[n][0] != la and 50 * score[p] <= 100 * score[n] <= 95 * score[p]]
            out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fit[:3])}
    return out


@pytest.mark.parametrize("held", [1 << 25, 300])
def test_hard_negatives(spark, monkeypatch, held):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", held)  # the small one takes several batches of anchors
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    df = spark.createDataFrame(vectors(), VECTORS).repartition(5)
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 50 == 0).collect()]
    want = negatives_of(vectors())
    assert len(want) > 20 and len(got) == len(want) and set(got) == want
    assert any(w[0] == 550 and w[4] == 0 for w in want)  # empty vectors: all scores 0


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none, F.col("id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(50, [1.0], 1, 0.0, "x"), (51, [1.0], 2, 0.0, "x")], VECTORS)
    assert hard_negatives.hard_negatives(lone, F.col("id") % 50 == 0).count() == 0


def test_large_components_stay_exact(spark):
    """Products that float64 can't hold; and rows too long to be scored at all."""
    rows = [(50, [100_000.0, 3.0], 1), (51, [99_999.0, 1.0], 1), (52, [70_000.0, 7.0], 2), (53, [70_000.0, 7.0078125], 2), (54, [3e38, 1.0], 2)]
    df = spark.createDataFrame([(i, v, k, 0.0, "x") for i, v, k in rows], VECTORS)
    got = {tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") == 50).collect()}
    assert got == {w for w in negatives_of(rows[:4])} and len(got) == 2


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_of(text):
    t = text or ""
    ascii_only = lambda m: m.group(1).isascii()  # noqa: E731  K and long s fold to ASCII letters in Python
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 8 and ascii_only(m)]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
    return found


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def distance_of(run, symbols):
    n, m = len(run), len(symbols)
    x = [symbols.index(c) for c in run]
    chi = sum((run.count(s) - n / m) ** 2 / (n / m) for s in symbols)
    u = (chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
    high = [v >= m // 2 for v in x]
    h, turns = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * h * (n - h) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    r = (turns - mean) / math.sqrt(spread) if spread > 0 else secret_scan.FAR
    mu = sum(x) / n
    own = sum((v - mu) ** 2 for v in x)
    s = (sum((a - mu) * (b - mu) for a, b in zip(x, x[1:])) / own + 1 / n) * math.sqrt(n) if own > 1e-9 else secret_scan.FAR
    return u * u + r * r + s * s


def random_of(texts):
    """Added spans of each text, and the cuts, by plain loops."""
    judged = []
    for i, t in enumerate(texts):
        t = t or ""
        for a, _, _, b in base_of(t):
            t = t[:a] + " " * (b - a) + t[b:]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", t):
            encoding = next((e for e, s in secret_scan.ENCODINGS.items() if set(m.group()) <= set(s)), None)
            if encoding:
                at = max(c for c in secret_scan.CLASSES if c <= len(m.group()))
                judged.append((i, m.start(), m.end(), (encoding, at), distance_of(m.group(), secret_scan.ENCODINGS[encoding])))
    of = defaultdict(list)
    for *_, k, d in judged:
        of[k].append(d)
    last, out = secret_scan.CUTS[-1], defaultdict(list)
    cuts = {}
    for k, ds in of.items():
        ordinary = sum(last < d <= secret_scan.FAR for d in ds)
        fit = [c for c in secret_scan.CUTS if ordinary * c / (secret_scan.FAR - last) <= sum(d <= c for d in ds) * secret_scan.FALSE_SHARE]
        if fit:
            cuts[k] = max(fit)
    for i, a, b, k, d in judged:
        if k in cuts and d <= cuts[k]:
            out[i].append((a, 3, "random", b))
    return out, cuts


def secret_texts():
    r = random.Random(11)
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    b64 = secret_scan.ENCODINGS["base64"]
    texts = [None, "", " ", "password: hunter22x and Token='abc' secret=token:abcdefghij", "PASSWORD = \"a.b=c/d+e-f_g\" x", "ſecret=abcdefghij toKen=abcdefghij"]
    texts += ["AKIA" + pick("ABCDEF0123", 12) + " AKIA1234 AKIAAKIA" + pick("XYZ", 9), pick("0123456789abcdef", 40) + " é😀 " + pick("0123456789abcdef", 31) + " " + pick("0123456789abcdef", 64)]
    texts += ["😀é " + pick(b64, n) + " tail " + pick(b64, n + 3) + "==" for n in range(16, 90, 2)]
    texts += ["internationalisationally and counterrevolutionaries " * 3 + pick("abcdefghij", 18), "https://a.example/a-long_path/with-slashes/and_more " + "aaaaaaaaaaaaaaaaaaaaaaaa " + "ab" * 12]
    texts += [f"api_key={pick(b64, 30)} " + pick(b64, 44) + " secretsecretsecret=" + pick("xyz", 9) + " " + "qwertyuiopasdfghjklz_password:" + pick("abc", 9)]
    texts += [" ".join(f"token:{pick('abcdef', 9)}" for _ in range(700)) + " " + pick(b64, 5000)]
    return texts


def test_secret_scan(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i, t, "c", i) for i, t in enumerate(texts)] + [(3, texts[3], "c", 3)], "doc_id long, text string, SPANS string, _base long").repartition(3)
    got = secret_scan.scan(df).collect()
    more, cuts = random_of([*texts, texts[3]])
    assert len(got) == len(texts) + 1 and cuts
    for row in got:
        base = base_of(texts[row["doc_id"]])
        assert row["base_spans"] == told(base) and row["_base"] == row["doc_id"]
        assert [row[f"n_{k}"] for k in secret_scan.SHAPES] == [sum(s[2] == k for s in base) for k in secret_scan.SHAPES]
        assert row["spans"] == told(base + more[row["doc_id"]]) and row["n_random"] == len(more[row["doc_id"]])
    assert sum(len(x) for x in more.values()) > 40


def test_ordinary_words_do_not_pass(spark):
    """Long words make a class whose random ones can't be told from ordinary ones; the same runs alone are reported."""
    r = random.Random(2)
    words = ["".join(r.choice(["ein", "ung", "sch", "keit", "lich", "ver", "er"]) for _ in range(5))[:17].ljust(16, "e") for _ in range(400)]
    keys = ["".join(r.choice(secret_scan.ENCODINGS["base36"]) for _ in range(16)) for _ in range(10)]
    both = spark.createDataFrame([(i, w) for i, w in enumerate(words + keys)], "doc_id long, text string")
    assert secret_scan.scan(both).where("n_random > 0").count() == 0
    alone = spark.createDataFrame([(i, w) for i, w in enumerate(keys)], "doc_id long, text string")
    assert secret_scan.scan(alone).where("n_random > 0").count() >= 8
    assert secret_scan.scan(alone.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, depth long, K0 string"


def conversations():
    r = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 207, 305, -5, 405]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["hi", "yes", "no 😀"]), 1, "x"))
    for c in range(500, 560):  # many copies of one conversation
        rows += [(c, t, "user", f"same {t}", 1, "x") for t in range(4)]
    rows += [(600, None, None, None, 1, "x"), (600, 0, "", "", 1, "x"), (600, 0, "user", None, 1, "x"), (None, 0, "user", "lost", 1, "x"), (601, 3, "user", "late", 1, "x"), (601, -1, "user", "early", 1, "x")]
    rows += [(700, t, "user", f"{t % 3}", 1, "x") for t in range(90)] + [(701, t, "user", f"{t % 3}", 1, "x") for t in range(95)]
    return rows


def trie_of(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(lender, [])[:h] + v[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                children[v[:d - 1]].add(v[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return {(min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], sha(p)) for p, cs in members.items()}


@pytest.mark.parametrize("block,ids", [(4096, 4096), (7, 3)])
def test_prefix_trie(spark, monkeypatch, block, ids):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rows = conversations()
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(6)).collect()]
    want = trie_of(rows)
    assert len(got) == len(want) and set(got) == want
    assert max(w[1] for w in want) > 80


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    again = spark.createDataFrame([(3, 0, "user", "a", 1, "x")] * 9, TURNS)  # repeated rows are turns
    assert {tuple(r) for r in prefix_trie.prefix_trie(again).collect()} == trie_of([(3, 0, "user", "a")] * 9)


def test_conversation_over_many_ranges(spark):
    """A conversation that lies over all tasks is numbered through."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
        got = prefix_trie.turns_of(rows.repartition(7)).select("at", "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["at"] for r in got) == list(range(1, 4001))
    assert all(r["n"] == len(str(r["at"] - 1)) for r in got)
