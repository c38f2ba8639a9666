import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from mosaiq.llm import sync_runs
from mosaiq.llm.queries import op13_sync_runs
from tests.llm.conftest import words


def brute(w):
    """All runs by trying every period over the whole text."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        a = 0
        while a + q < len(w):
            b = a
            while b + q < len(w) and w[b] == w[b + q]:
                b += 1
            if b - a >= q:
                found.setdefault((a, b + q), q)
            a = b + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(12, 2 * q))


def many(texts):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids = np.array([x for t in texts for x in t], np.int64)
    row, start, length, period = sync_runs.find_runs(ids, bounds)
    out = [[] for _ in texts]
    for r, *run in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[r].append(tuple(run))
    return out


def check(texts):
    for t, got in zip(texts, many(texts)):
        assert got == [(a, n, q) for a, n, q in sorted(brute(t), key=lambda x: (x[0], x[2]))], t


def test_every_kind_of_run():
    r = random.Random(5)
    texts = [[], [1], [1] * 11, [1] * 12, [1] * 300, [1, 2] * 40, list(range(50)) * 2, [1, 2, 3, 1] * 30]
    for _ in range(150):  # few different words: many short and nested periods
        texts.append([r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 120))])
    for _ in range(150):  # planted periods with noise, cut and nested
        root = [r.randint(0, r.choice([1, 3, 50])) for _ in range(r.randint(1, 60))]
        t = [r.randint(0, 3) for _ in range(r.randint(0, 30))] + (root * 6)[: r.randint(1, 6 * len(root))] + root[: r.randint(0, len(root))]
        if r.random() < 0.5:
            t = (t + [r.randint(0, 1)] * r.randint(0, 3)) * r.randint(1, 3)
        texts.append(t[:400])
    check(texts)


def test_highly_periodic_regions_out_of_phase():
    """A period that breaks once has a run of every odd length around the break, none of which holds a synchronising position."""
    texts = [[0, 1] * 60 + [0] + [0, 1] * 70, [0, 1] * 40 + [0] + [0, 1] * 40 + [0, 1, 1] * 50, ([0, 1, 2] * 20 + [0]) * 3, [0] * 90 + [1] + [0] * 90 + [1] + [0] * 40]
    for p in (3, 4, 7, 11):
        root = list(range(p))
        texts += [root * 30 + root[: p // 2] + root * 25, (root * 9 + root[:1]) * 2 + root[:1] + (root * 9 + root[:1]) * 2]
    check(texts)
    word = [0]
    for _ in range(12):  # the Fibonacci word has the most runs
        word = [x for a in word for x in ((0, 1) if a == 0 else (0,))]
    check([word[:370], word[:100] * 3])


def test_long_text_with_a_long_period():
    r = random.Random(1)
    root = [r.randint(0, 10**6) for _ in range(4000)]
    assert many([[-5, *(root * 3)[:9000], -6], root, [7] * 20])[0] == [(1, 9000, 4000)]


def expected(doc_id, text):
    """The contract in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(w), key=lambda x: (x[0], x[2]))
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    said = hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
    left = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return len(runs), *top, 1000 * top[1] // top[2] if runs else None, said, left


def test_query(spark, tmp_path):
    made = [(i, " ".join(words(i, 1 + i * 3 % 130))) for i in range(300)] + [(None, "x " * 30), (7, None), (8, ""), (9, " \t\x0b "), (9, "  a\x85b " * 20), (9, "  a\x85b " * 20)]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.length("text") < 2500).select("doc_id", "text")
    for k, docs in enumerate([spark.createDataFrame(made, "doc_id long, text string"), real]):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = sorted((tuple(r) for r in op13_sync_runs(spark, f"{tmp_path}/{k}").collect()), key=str)
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert got == sorted(((d, *expected(d, t)) for d, t in rows), key=str)
        assert sum(g[1] for g in got) > 10


def test_edges(spark, empty, clashing):
    assert sync_runs.find(empty).count() == 0
    found = sync_runs.find(clashing.withColumn("runs", F.lit("x")))
    assert found.count() == clashing.count() and found.first()["score"] == "x"
    one = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(x) for x in one[16]["runs"]] == [(0, 120, 3)] and one[16]["collapsed"] == "same line here"
    assert one[3]["collapsed"] == "" and one[3]["n_words"] == 0 and one[3]["runs"] == []
