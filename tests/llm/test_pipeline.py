"""Each stage of the pipeline against brute force on what the stage before it kept."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import WORD, odd_texts, sets_of

import corpus_pipeline
from corpusloom.llm import line_dedup

KIND = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ("vilestuff", "vilething", "nastyone")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = odd_texts()
    junk = "Subscribe to our letter today"
    for i in range(200):
        w = [r.choice(vocab) for _ in range(r.randint(60, 120))]
        for _ in range(4 * (i % 4 == 0)):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        lines = [" ".join(w[:30]), " ".join(w[30:])]
        if i % 3 == 0:
            lines.insert(r.randrange(3), junk)
        texts.append("\n".join(lines))
    rows = [(i, t, "en", f"s{i % 17}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[1]]
    labels = [(i, 1, int(any(b in (t or "") for b in BAD))) for i, t, *_ in rows[:-2] if i % 7]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows before each stage and at the end, each stage written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def shingles(text, n):
    w = WORD.findall(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def boilerplate(rows):
    """Lines at enough sites that enough texts have which aren't versions of one, by plain loops."""
    m = line_dedup
    lines, sites = {}, defaultdict(set)
    for _, text, site in rows:
        lines[text or ""] = {x for x in (text or "").split("\n") if WORD.search(x)}
        for x in lines[text or ""]:
            sites[x].add(site)
    spread = {x for x, s in sites.items() if len(s) >= m.MIN_SITES}
    share = {t: (100 * sum(len(x) for x in own & spread), len(t)) for t, own in lines.items() if own & spread}
    other = {t: shingles("\n".join(x for x in t.split("\n") if x not in spread), m.SHINGLE) for t, (s, n) in share.items() if m.MIXED * n <= s <= m.MOSTLY * n}
    bad = set()
    for x in spread:
        own = [t for t in share if x in lines[t] and share[t][0] < m.MIXED * share[t][1]]
        mixed = sorted((t for t in other if x in lines[t]), key=lambda t: hashlib.md5(t.encode()).hexdigest()[:15])
        apart = [t for t in mixed if other[t] and (t == mixed[0] or 100 * len(other[t] & shingles(mixed[0], m.SHINGLE)) < m.ALIKE * len(other[t]))]
        if len(own) + len(apart) >= m.MIN_SITES:
            bad.add(x)
    return bad


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_the_columns(stages):
    assert [len(corpus_pipeline.STAGES), *(df.dtypes for df in stages[1:-1])] == [5, *[stages[0].dtypes] * 4]


def test_toxic_documents_go(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert not after - before
    for (doc_id, text), times in before.items():
        toxic = any(b in (text or "") for b in BAD)
        assert not (toxic and after[(doc_id, text)]), "kept"
        assert toxic or after[(doc_id, text)] == times, "lost"


def test_boilerplate_lines_go(stages):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in stages[1].collect()]
    bad = boilerplate(rows)
    want = Counter((i, t if t is None else "\n".join(x for x in t.split("\n") if x not in bad)) for i, t, _ in rows)
    assert bad and rows_of(stages[2]) == want


def test_one_of_each_group_stays(stages):
    rows = rows_of(stages[2])
    by = {i: sets_of(t, 5) for i, t in rows}
    root = {i: i for i in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in by:
        for b in by:
            if a < b and by[a] and by[b] and 100 * len(by[a] & by[b]) >= 80 * len(by[a] | by[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert rows_of(stages[3]) == Counter({(i, t): n for (i, t), n in rows.items() if find(i) == i})


def test_repeats_are_cut(stages):
    rows = [(r["doc_id"], r["text"], WORD.findall(r["text"] or "")) for r in stages[3].collect()]
    seen = Counter(tuple(w[i:i + 50]) for _, _, w in rows for i in range(len(w) - 49))
    want = Counter()
    for i, t, w in rows:
        gone = {j for k in range(len(w) - 49) if seen[tuple(w[k:k + 50])] > 1 for j in range(k, k + 50)}
        want[(i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t)] += 1
    assert rows_of(stages[4]) == want


def test_all_words_are_packed(stages):
    want = Counter()
    for (i, t), n in rows_of(stages[4]).items():
        want[i] += n * len(WORD.findall(t or ""))
    got = {r["doc_id"]: r["n"] for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == dict(want)


def test_run_is_the_stages_in_order(spark, folder, stages):
    assert corpus_pipeline.run(spark, folder).count() == stages[5].count()
