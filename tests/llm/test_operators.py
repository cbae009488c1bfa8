"""The ten operators against brute force and round trips, on small tables with everything that can be odd in them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _repeats, bpe, line_dedup, media_columns, naming, near_dedup, packing, quality_rules, queries, recompression, sharding, suffix_array, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, k string, value long"


def odd_texts():
    """Nulls, empties, white space only, repeats, near copies, shared passages, runs of one word, a very long text."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = say(60)
    texts = [None, "", " \n\t ", "one", "two words", "Same Text here now", "same text here now"]
    base = say(120)
    for k in range(12):
        w = base.split()
        for _ in range(k // 2):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    texts += [base, base, base]
    texts += [say(30) + "\n" + passage + "\n" + say(25) for _ in range(6)]
    texts += ["na " * 120, "na " * 70 + "end", ("ab cd " * 60).strip(), say(8000) + " " + passage]
    texts += [say(r.randint(1, 90)) for _ in range(40)]
    texts += ["# $ % & | < > " * 10 + say(50), "naïve café 😀 \U0001f468‍\U0001f469‍\U0001f467 日本語 \x85 \xa0 x" * 3]
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "clash", i) for i, t in enumerate(odd_texts())]
    return out + [out[20], out[20], out[1], (None, "a text without an id " * 4, "en", "s1", 4, "clash", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_quality(docs, rows, none):
    got = {r["value"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(quality_rules.quality_rules(docs).collect()) == len(rows)
    for _, text, *_, value in rows[:60]:
        w = WORD.findall(text or "")
        wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        at = {j for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[value]
        if value:
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(at), len(lines) - len(set(lines)))
            assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
            assert r["base_failed"] == (len(w) < 50 or 100 * len(at) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_fences_merge(spark, docs):
    rated = spark.range(1000).select((F.col("id") % 4).alias("g"), *(F.col("id").alias(m) for m in quality_rules.LEAST_SPREAD))
    parts = quality_rules.sketch(rated, ["g"]).groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    whole = quality_rules.sketch(rated, [])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_fences_of_language_and_source(spark):
    """Groups with rows enough use fences of their own, as quartiles over sketch buckets counted plainly; others the next up."""
    r = random.Random(21)
    rows = []
    for i in range(700):
        lang, source = ("en", "a") if i < 250 else ("en", "b") if i < 450 else ("de", "a") if i < 600 else ("en", f"few{i % 3}") if i < 690 else ("xx", None)
        size = 5 if (lang, source) != ("de", "a") else 9
        w = ["".join(r.choice("abcdefghij") for _ in range(r.choice([size - 1, size, size + 1]))) for _ in range(80)]
        if i % 50 == 0:
            w = [x * 3 for x in w]
        if i % 50 == 1:
            w = [x + "#$%" for x in w]
        rows.append((i, " ".join(w), lang, source))
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}

    def floor(v):
        if v < quality_rules.EXACT:
            return v
        step = 2 ** (v.bit_length() - quality_rules.EXACT.bit_length() + 1)
        return v // step * step

    def fence(values, measure):
        v = sorted(floor(x) for x in values)
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        reach = max(q3 - q1, quality_rules.LEAST_SPREAD[measure]) * quality_rules.FENCE
        return q1 - reach, q3 + reach

    def measured(text):
        w = text.split()
        wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return {"word_length": sum(map(len, w)) * 1000 // len(w), "symbol_rate": sum(text.count(c) for c in "#*$%&|<>") * 1000 // len(w), "line_rate": 0, "repeat_rate": len(again) * 1000 // len(w)}

    values = {i: measured(t) for i, t, *_ in rows}
    by = defaultdict(list)
    for i, _, lang, source in rows:
        for key in ((lang, source), lang, None):
            by[key].append(i)
    used = Counter()
    for i, _, lang, source in rows:
        key, name = next((k, n) for k, n in (((lang, source), "source"), (lang, "lang"), (None, "all")) if k is None or len(by[k]) >= quality_rules.MIN_GROUP)
        kept = True
        for m, v in values[i].items():
            low, high = fence([values[j][m] for j in by[key]], m)
            kept &= v <= high and (v >= low or m not in quality_rules.TWO_SIDED)
        used[name, kept] += 1
        assert (got[i]["fence_of"], got[i]["kept"], got[i]["base_failed"]) == (name, kept, False), i
    assert min(used[n, k] for n in ("source", "lang") for k in (True, False)) > 0 and used["all", True]


def sets_of(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, none, n, percent):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    by = {r[0]: sets_of(r[1], n) for r in rows}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and by[a] and by[b] and 100 * len(by[a] & by[b]) >= percent * len(by[a] | by[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(docs, n_words=n, similarity=percent / 100).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(by[r["doc_id"]]), find(r["doc_id"]), r["doc_id"] == find(r["doc_id"]))
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(docs, n_words=n, similarity=percent / 100).columns == docs.columns


def test_rows_that_share_an_id(spark):
    r = random.Random(14)
    one, two, three = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(3))
    t = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two), (4, three), (4, three), (5, three)], "doc_id long, text string")
    assert Counter(x["doc_id"] for x in near_dedup.drop_near_duplicates(t).collect()) == {1: 1, 2: 2, 4: 2}


def test_near_duplicate_groups(spark):
    """A large group of edited copies beside a group with a passage in common: components as by brute force."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    base = [r.choice(vocab) for _ in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(150)] = r.choice(vocab)
        texts.append(" ".join(w))
    passage = " ".join(r.choice(vocab) for _ in range(70))
    texts += [passage + " " + " ".join(r.choice(vocab) for _ in range(r.randint(5, 40))) for _ in range(60)]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_words=3, similarity=0.85).collect()}
    sets = [sets_of(t, 3) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("module,n", [(recompression, 35), (naming, 35), (suffix_array, 50)])
def test_repeats(docs, rows, none, module, n):
    texts = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + n]) for w in texts for i in range(len(w) - n + 1))
    want = Counter()
    for row, w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        want[(row[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone) if gone else row[1])] += 1
    got = module.remove_repeats(docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == want
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in got.collect())
    assert module.remove_repeats(none).count() == 0


def test_names_by_spark(docs, none):
    """Rounds named by Spark find the same repeats as those named in tasks; a name stands for the same words everywhere."""
    plain = lambda found: sorted((r["k"], r["whole"], r["n_removed"], r["kept"]) for r in found.collect())
    assert plain(naming.repeats(docs)) == plain(recompression.repeats(docs)) and naming.repeats(none).count() == 0
    texts = _repeats.affected(docs, "text", recompression.WINDOW, recompression.symbols)
    inside, n = {}, recompression.WINDOW
    base, tokens = naming.symbols_by_spark(texts)
    for r in base.join(tokens, "sid").collect():
        assert len(r["names"]) <= len(r["ids"]) and r["lo"] == sorted(r["lo"]) and r["hi"] == sorted(r["hi"])
        for s in range(len(r["ids"]) - n + 1):
            own = [name for name, lo, hi in zip(r["names"], r["lo"], r["hi"]) if s <= lo and hi <= s + n]
            inside.setdefault(tuple(r["ids"][s:s + n]), []).append(own)
    assert all(own == all_[0] for all_ in inside.values() for own in all_) and sum(len(x) > 1 and len(x[0]) > 0 for x in inside.values()) > 20
    assert any(name % naming.STEPS == recompression.ROUNDS for x in inside.values() for name in x[0])


def test_symbols_are_alike_inside():
    """A passage has the same anchors in any surroundings."""
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm._repeats import window_starts
    from corpusloom.llm._words import Running, words

    r = random.Random(2)
    say = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    passage = say(80)
    w = words(pa.array([say(33) + " " + passage + " " + say(20), say(7) + " " + passage]))
    starts, doc = window_starts(w, 35)
    for find in (recompression.symbols, suffix_array.minimisers):
        found = find(w, Running(w.hash), starts, 35)
        one, two = found.key[(doc == 0) & (starts >= 33) & (starts <= 33 + 45)], found.key[(doc == 1) & (starts >= w.first[1] + 7)]
        assert len(one) == len(two) == 46 and (one == two).all()
        assert len(np.unique(one)) < 30


def test_bpe_round_trip(docs, rows, none):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.encode(docs, path, public.PATTERN)
    for r in bpe.decode(coded, path, public.PATTERN).where("doc_id IS NOT NULL").collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["ids"] == plain.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert list(r["ends"]) == [sum(len(plain.decode_single_token_bytes(i)) for i in r["ids"][:k + 1]) for k in range(len(r["ids"]))] or len(r["ids"]) > 500
    once = bpe.round_trip(docs, path, public.PATTERN).where("doc_id IS NOT NULL").collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]][1] or "").encode()).hexdigest() for r in once) and "k" in once[0].asDict()
    assert bpe.round_trip(none, path, public.PATTERN).count() == 0


def test_media(docs, rows, none, spark):
    media = media_columns.to_media(docs)
    for r in media_columns.media_features(media).where("doc_id IS NOT NULL").collect():
        raw = (rows[r["doc_id"]][1] or "").encode()
        raw += b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
        assert r["codec"] == "raw " and r["duration"] == len(raw) and r["error"] is None and len(r["keyframes"]) == -(-len(raw) // 192 // 8) or len(raw) % 1536
    bad = spark.createDataFrame([(1, b""), (2, None), (3, b"\0\0\0\x10ftypisom\0\0\0\0"), (4, b"\0\0\0\xffmoov1234")], "id int, media binary")
    assert {r["id"]: r["error"] is None for r in media_columns.media_features(bad).collect()} == {1: False, 2: False, 3: True, 4: False}
    assert media_columns.media_features(media_columns.to_media(none)).count() == 0


def test_compact_sizes_and_fragments():
    sizes = lambda bits, raw, n: media_columns.sample_sizes(b"\0" * 7 + bytes([bits]) + n.to_bytes(4, "big") + raw, {b"stz2": (0, 12 + len(raw))})
    assert sizes(4, b"\x12\x30", 3) == [1, 2, 3] and sizes(8, b"\x01\xff", 2) == [1, 255] and sizes(16, b"\x01\x00\x00\x02", 2) == [256, 2]
    with pytest.raises(ValueError, match="compact"):
        sizes(5, b"", 0)
    with pytest.raises(ValueError, match="fragmented"):
        media_columns.describe((8).to_bytes(4, "big") + b"moof")


def damaged(kind, at, value, n_bytes=4):
    """A file of 40 samples with some bytes of a box overwritten, ``at`` from the start of its content."""
    data = bytearray(media_columns.contain(bytes(range(192)) * 40))
    where = data.index(kind) + 4 + at
    data[where:where + n_bytes] = value.to_bytes(n_bytes, "big")
    return bytes(data)


def test_damaged_media(spark):
    """Files that aren't whole get nulls and the reason, whichever table is wrong; none ends the job or takes its memory."""
    whole = media_columns.contain(bytes(range(192)) * 40)
    nested = b""
    for _ in range(3000):
        nested = (len(nested) + 8).to_bytes(4, "big") + b"moov" + nested
    bad = {
        "offsets near the end": damaged(b"co64", 8, len(whole) - 100, 8), "offsets behind it": damaged(b"co64", 8, 1 << 60, 8), "a short run of chunks": damaged(b"stsc", 12, 4), "a long one": damaged(b"stsc", 12, 1 << 31),
        "a first chunk of none": damaged(b"stsc", 8, 0), "keyframe 0": damaged(b"stss", 8, 0), "keyframe 99": damaged(b"stss", 8, 99), "a huge count": damaged(b"stsz", 8, 0xFFFFFFFF),
        "no sizes": damaged(b"stsz", 4, 0), "nested": nested, "cut": whole[:-200],
    }
    rows = [(name, data) for name, data in bad.items()] + [("whole", whole)]
    got = {r["name"]: r for r in media_columns.media_features(spark.createDataFrame(rows, "name string, media binary")).collect()}
    assert got["whole"]["error"] is None and got["whole"]["payload_sha256"] == hashlib.sha256(bytes(range(192)) * 40).hexdigest()
    for name in bad:
        assert got[name]["error"] and got[name]["payload_sha256"] is None and got[name]["keyframes"] == [], name


def test_packing(spark, docs, none):
    sized = docs.withColumn("n", F.size(F.split("text", " ")).cast("long"))
    packed = packing.pack(sized, "n", capacities=(64, 128, 512), block_pieces=40)
    assert packing.check_bins(packed).count() == 0
    want = Counter((r["doc_id"], r["n"] or 0) for r in sized.collect())
    got = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_if("separator").alias("ends")).collect()
    total = defaultdict(lambda: [0, 0])
    for (i, n), times in want.items():
        total[i][0] += max(n, 0) * times
        total[i][1] += times
    assert {r["doc_id"]: [r["n"], r["ends"]] for r in got} == dict(total)
    bins = packed.groupBy("bin_id").agg(F.sum(F.col("length") + F.col("separator").cast("int")).alias("filled"), F.max("capacity").alias("c"))
    assert bins.where("(c = 512 AND filled <= 128) OR (c = 128 AND filled <= 64)").count() == 0
    assert packing.pack(none.withColumn("n", F.lit(1)), "n").count() == 0


def test_best_fit_prefers_tight_bins():
    import numpy as np

    which, offset, final = packing.best_fit(np.array([60, 40, 40, 20, 10, 4]), (64, 128), 0)
    assert len({(w, o) for w, o in zip(which, offset, strict=True)}) == 6 and set(final) <= {64, 128}
    loads = defaultdict(int)
    for w, n in zip(which, (60, 40, 40, 20, 10, 4), strict=True):
        loads[w] += n
    assert all(loads[w] <= c for w, c in zip(which, final, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_plain_one(seed):
    """Against the rule written down plainly: every open bin is looked at for every piece; and bins are well filled."""
    r = random.Random(seed)
    caps = packing.CAPACITIES
    lengths = [r.choice([r.randint(1, 60), r.randint(1, 900), r.randint(1, caps[-1])]) for _ in range(300)]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, want = [], {}  # of each bin its size and what it holds
    for k, i in enumerate(order):
        n, rest = lengths[i], [lengths[j] for j in order[k + 1:]]
        rooms = [(size - used, b) for b, (size, used) in enumerate(bins) if size - used >= n]
        if rooms:
            b = min(rooms)[1]
        else:
            costs = [((c + packing.OVERHEAD) / (n + min(c - n, sum(x for x in rest if x <= c - n))), c) for c in caps if c >= n]
            best = min(x for x, _ in costs)
            b = len(bins)
            bins.append([next(c for x, c in costs if x == best), 0])
        want[i] = (b, bins[b][1])
        bins[b][1] += n
    which, offset, final = packing.best_fit(np.array(lengths))
    assert [(int(which[i]), int(offset[i])) for i in range(len(lengths))] == [want[i] for i in range(len(lengths))]
    assert [int(f) for f in final] == [next(c for c in caps if c >= bins[want[i][0]][1]) for i in range(len(lengths))]
    assert sum(lengths) / sum(next(c for c in caps if c >= used) for _, used in bins) > 0.9


@pytest.mark.parametrize("bucket_rows", [3, 10_000])
def test_sharding(docs, rows, none, bucket_rows):
    got = sharding.external_shuffle(docs.select("doc_id", "text", "value"), n_shards=8, bucket_rows=bucket_rows)
    held = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in held) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in held:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = lambda x: [(r["shard"], r["slot"], r["doc_id"]) for r in x.orderBy("shard", "slot").collect()]
    again = sharding.external_shuffle(docs.repartition(7).select("doc_id", "text", "value"), n_shards=8, bucket_rows=bucket_rows)
    assert order(got) == order(again)
    assert sharding.external_shuffle(none).count() == 0
    assert sharding.external_shuffle(docs.limit(3)).count() == 3


def test_buckets_stand_together(spark):
    """The plain two passes: buckets by a seeded hash one after the other, each in an order of its own; no cap on their number."""
    t = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    got = sharding.external_shuffle(t, n_shards=8, bucket_rows=6)
    held = got.withColumn("bucket", F.pmod(F.xxhash64(F.lit(42), F.struct("doc_id"), F.lit(1).cast("long")), F.lit(5000))).orderBy("shard", "slot").collect()
    buckets = [r["bucket"] for r in held]
    assert len(held) == 30_000 and len(set(buckets)) > 4900 and buckets == sorted(buckets)
    ids, at = [r["doc_id"] for r in held], {r["doc_id"]: i for i, r in enumerate(held)}
    assert abs(sum((at[i] - 15_000) * (i - 15_000) for i in ids)) < 0.03 * sum((i - 15_000) ** 2 for i in ids)  # no trace of the input's order
    hashes = {r["doc_id"]: r["h"] for r in t.select("doc_id", F.xxhash64(F.lit(42), F.struct("doc_id"), F.lit(1).cast("long")).alias("h")).collect()}
    rising = sum(hashes[x] < hashes[y] for x, y, a, b in zip(ids, ids[1:], buckets, buckets[1:]) if a == b)
    assert 0.45 < rising / sum(a == b for a, b in zip(buckets, buckets[1:])) < 0.55


def test_copies_are_numbered_in_ranges(spark, monkeypatch):
    from corpusloom.llm import _shared

    monkeypatch.setattr(_shared, "RANGE", 7)
    t = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 100), (None, 21)], "x string, n long")
    assert Counter(tuple(r) for r in _shared.numbered(t, "n", "k").collect()) == Counter((r["x"], k) for r in t.collect() for k in range(1, r["n"] + 1))
    same = spark.createDataFrame([(5, 30)] * 50, "doc_id long, n long")
    assert packing.pack(same, "n").count() == 50 and sharding.external_shuffle(same, 3).groupBy("shard").count().count() == 3


def test_names_that_clash(spark, rows):
    """Columns named as an operator's own or its results, in any case: own ones stay, results replace."""
    odd = ("_k", "_own", "_w", "_lang", "_source", "_text", "_copy", "_row", "_bucket", "k", "key", "t", "whole", "start")
    made = ("Score", "N_words", "Kept", "Ids", "DECODED", "Media", "N_Bytes", "Spans", "Shard", "SLOT")
    t = spark.createDataFrame(rows[:30], KIND).select("doc_id", "text", "lang", "source", *(F.lit(c).alias(c) for c in (*odd, *made))).repartition(2)
    net = toxicity.Network()
    for got in (
        quality_rules.quality_rules(t), line_dedup.drop_boilerplate(t), naming.remove_repeats(t), suffix_array.remove_repeats(t),
        near_dedup.drop_near_duplicates(t), toxicity.score(t, (net, 0.0)), media_columns.to_media(t), sharding.external_shuffle(t),
    ):
        held = got.collect()
        assert held and len({c.lower() for c in got.columns}) == len(got.columns)
        assert all(r[c] == c for r in held for c in odd)


def test_very_long_text(spark):
    """Texts of more than one piece: shared passages far inside are found, and nothing else goes."""
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = say(80)
    long = say(200_000) + shared + say(20_000)
    short = say(40) + shared + say(10)
    t = spark.createDataFrame([(1, " ".join(long), "s", "en"), (2, " ".join(short), "s", "en"), (3, " ".join(say(60)), "s", "en")], "doc_id long, text string, source string, lang string")
    assert len(" ".join(long)) > 1 << 20
    for module in (naming, suffix_array):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in module.remove_repeats(t).collect()}
        assert got == {1: (220_080, 80), 2: (130, 80), 3: (60, 0)}
    assert {x["doc_id"]: x["n_shingles"] for x in near_dedup.near_duplicates(t).collect()} == {1: len(sets_of(" ".join(long), 5)), 2: 126, 3: 56}
    assert {x["doc_id"]: x["n_words"] for x in quality_rules.quality_rules(t).collect()} == {1: 220_080, 2: 130, 3: 60}
    assert line_dedup.drop_boilerplate(t).count() == 3


def test_sharding_writes_texts(spark, rows, tmp_path, monkeypatch):
    """Shards hold the whole records, in order of files and rows; the query derives its columns from them."""
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/sf/documents.parquet")
    paths = []
    monkeypatch.setattr(queries, "passing_path", lambda _: paths.append(f"{tmp_path}/shards") or paths[-1])
    got = queries.op9_sharding(spark, f"{tmp_path}/sf").collect()
    size = lambda t: len((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], size(r[1]) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = spark.read.parquet(paths[0])
    assert Counter((r["doc_id"], r["text"]) for r in shards.collect()) == Counter((r[0], r[1]) for r in rows)
    texts = spark.createDataFrame(rows, KIND).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    sharding.write_shards(texts, f"{tmp_path}/small", "n", n_shards=3, bucket_bytes=4096)
    for shard in range(3):
        slots = [r["slot"] for name in sorted((tmp_path / "small" / f"shard={shard}").glob("*.parquet")) for r in spark.read.parquet(str(name)).collect()]
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 3, len(rows) // 3 + 1)


def test_line_dedup(spark, docs, none):
    r = random.Random(3)
    junk, lines = "Subscribe to our letter today", []
    for i in range(60):
        own = [" ".join(r.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(3)]
        own.insert(r.randrange(4), junk) if i % 2 else None
        lines.append((i, "\n".join(own), f"site{i % 15}"))
    copies = [(100 + i, "the same document\nwith the same lines\nat all sites", f"site{i % 15}") for i in range(30)]
    odd = [(200, None, None), (201, "", "site1"), (202, junk, None), (203, junk + "\n\n" + junk, "site2")]
    t = spark.createDataFrame(lines + copies + odd, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    got = {x["doc_id"]: x for x in line_dedup.drop_boilerplate(t).collect()}
    assert len(got) == 94
    for i, text, _ in lines:
        assert got[i]["text"] == "\n".join(x for x in text.split("\n") if x != junk)
    assert all(got[100 + i]["n_lines_removed"] == 0 for i in range(30))
    assert got[200]["text"] is None and got[201]["text"] == "" and got[202]["text"] == "" and got[203]["text"] == ""
    assert line_dedup.drop_boilerplate(none).count() == 0 and line_dedup.drop_boilerplate(docs).count() == docs.count()


def test_blocks_of_lines_go_and_copies_stay(spark):
    """Footers of 2 to 5 lines go entirely; lines of exact and of edited copies at many sites stay; names clash."""
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for size in (2, 3, 5):
        footer = [say(6) for _ in range(size)]
        for i in range(60):
            own = [say(20) for _ in range(4)]
            want[len(rows)] = "\n".join(own)
            rows.append((len(rows), "\n".join(own + footer), f"site{i % 20}"))
    article = [say(12) for _ in range(9)]
    for i in range(80):
        lines = list(article)
        if i % 2:
            lines[i % 9] = say(12)
        want[len(rows)] = "\n".join(lines)
        rows.append((len(rows), "\n".join(lines), f"site{i % 20}"))
    t = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in ("_k", "_bad", "_lines", "_kept", "N_Lines", "line_hash", "k", "site")})
    got = line_dedup.drop_boilerplate(t)
    assert {x["doc_id"]: x["text"] for x in got.collect()} == want
    assert {"_k", "_bad", "_lines", "_kept", "line_hash", "n_lines", "n_lines_removed"} <= set(got.columns) and "N_Lines" not in got.columns
    assert got.select("_k", "_bad").distinct().collect() == [("_k", "_bad")]


def footers(rows, footer):
    """How many of the footer's lines are left in (doc_id, text, source)."""
    return sum(line in (r["text"] or "").split("\n") for r in rows.collect() for line in footer)


def test_footers_of_short_pages_and_of_shared_sites_go(spark):
    """Footers longer than the notes above them go; those of articles that are also all at one site; versions of an article stay."""
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    footer = [say(8) for _ in range(3)]
    schema = "doc_id long, text string, source string"
    notes = spark.createDataFrame([(i, "\n".join([say(9), *footer]), f"site{i % 20}") for i in range(60)], schema)
    assert footers(notes, footer) == 180 and footers(line_dedup.drop_boilerplate(notes), footer) == 0
    articles = ["\n".join([*(say(30) for _ in range(12)), *footer]) for _ in range(20)]
    shared = spark.createDataFrame([(2 * i + j, text, f"own{i}" if j else "a0") for i, text in enumerate(articles) for j in (0, 1)], schema)
    assert footers(shared, footer) == 120 and footers(line_dedup.drop_boilerplate(shared), footer) == 0

    def version(article):
        lines = [x.split() for x in article]
        for _ in range(6):
            w = r.choice(lines)
            w[r.randrange(len(w))] = say(1)
        return "\n".join(" ".join(w) for w in lines)

    article = [say(25) for _ in range(12)]
    versions = [(i, version(article), f"site{i % 20}") for i in range(60)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(versions, schema))
    assert {x["doc_id"]: x["text"] for x in got.collect()} == {i: t for i, t, _ in versions}


def test_toxicity(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["vilestuff", "vilething", "nastyone"]
    texts, labels = [], []
    for i in range(300):
        w = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append((i, " ".join(w)))
        labels.append((i, y))
    docs = spark.createDataFrame(texts + [(900, None), (901, ""), (902, "calm " * 5000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(dict(labels)[i]) for i in held)
    assert right >= 0.9 * len(held) and len(got) == 303 and all(0 <= v <= 1 for v in got.values()) and max(got[900], got[901], got[902]) < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(docs.limit(0), known.limit(0))
    assert toxicity.score(docs, nothing).count() == 303


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    """Passages after character 8192 teach, and long clean texts stay clean; the bound on bytes takes fewer, whole texts."""
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(160):
        w = [r.choice(vocab) for _ in range(1600 if i % 2 else 40)]
        y = int(i % 4 == 1)
        w[1500:1500] = ["vilestuff", "nastyone", "vilething"] * y
        texts.append((i, " ".join(w)))
        labels.append((i, y))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] >= 0.5 for x in toxicity.score(docs, toxicity.learn(docs, known)).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == bool(y) for i, y in held) >= 0.9 * len(held)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda t, y: seen.extend(t))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 50_000)
    toxicity.learn(docs, known)
    assert 0 < len(seen) < 128 and set(seen) <= {t for _, t in texts}


def test_toxicity_of_unspaced_texts():
    """Every run of a long word is looked up, and toxic content at the end of an unspaced text counts."""
    import pyarrow as pa

    r = random.Random(8)
    sign = lambda: "".join(chr(0x4E00 + r.randrange(400)) for _ in range(r.randint(60, 400)))
    y = [int(i % 3 == 0) for i in range(240)]
    texts = [sign() + "龘靐齉" * v for v in y]
    model = toxicity.train(texts[:180], y[:180])
    net, shift = model
    right = [(toxicity.top_logits(*toxicity.window_logits(net, toxicity.steps(pa.array([t]))), 1)[0] + shift >= 0) == bool(v) for t, v in zip(texts[180:], y[180:], strict=True)]
    assert sum(right) >= 0.9 * len(right)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3001))
    w = toxicity.steps(pa.array(["x" * 48, f"ab {long} cd", None, long[:49]]))
    assert list(w.first[1:] - w.first[:-1]) == [1, 2 + -(-(3001 - 48) // 32) + 1, 0, 2]
    runs = lambda t: set(toxicity.vocabulary(toxicity.steps(pa.array([t])))[1].tolist())
    want = set()
    for k in range(0, 3001 - 4):
        want |= runs("_" + long[k:k + 5]) - runs("_" + long[k:k + 4]) if k % 300 == 7 else set()
    assert want <= runs("_" + long)
    spaced = pa.array(["Some words of usual length", "and more"])
    assert (toxicity.steps(spaced).hash == toxicity.words(spaced, lower=True).hash).all()


def test_windows_hold_phrases_whole():
    """A passage of 33 words is whole in some window wherever it is laid, and windows stay in their text."""
    import pyarrow as pa

    for n in (1, 33, 63, 64, 65, 96, 97, 300):
        start, size, doc = toxicity.windows(toxicity.words(pa.array(["x " * 5, "w " * n])))
        own = [(a - 5, a - 5 + k) for a, k, d in zip(start, size, doc, strict=True) if d == 1]
        assert own[0][0] == 0 and own[-1][1] == n and all(0 <= a < b <= n for a, b in own)
        assert all(any(a <= i and i + 33 <= b for a, b in own) for i in range(n - 32))


def test_gradients():
    """Backward passes against differences."""
    import numpy as np

    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.normal(size=(5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    at, real = r.integers(0, 5, (6, 2)), np.array([[True, True]] * 4 + [[True, False]] * 2)
    logit, made = net.forward(x, at, real, keep=True)
    g, d_x = net.gradients(x, at, real, made, np.ones(2))
    for k in ("fh", "bx", "att", "att_v", "out", "fc"):
        i = tuple(0 for _ in net.p[k].shape)
        net.p[k][i] += 1e-4
        up = net.forward(x, at, real).sum()
        net.p[k][i] -= 2e-4
        down = net.forward(x, at, real).sum()
        net.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-3, k
    x[2, 3] += 1e-4
    up = net.forward(x, at, real).sum()
    x[2, 3] -= 2e-4
    assert abs((up - net.forward(x, at, real).sum()) / 2e-4 - d_x[2, 3]) < 1e-3
