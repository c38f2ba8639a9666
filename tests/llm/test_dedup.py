import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mosaiq.llm import chosen_path, compact_windows, components, line_chunks, suffix_dedup
from tests.llm.conftest import words


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(texts):
    s = {k: shingles(t) for k, t in texts.items()}
    links, up = Counter(), {k: k for k in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return links, {k: root(k) for k in texts}


def family(seed, n, size=120):
    """n texts, each with one word of the first changed."""
    base = words(seed, size)
    out = []
    for i in range(n):
        w = base.copy()
        w[(i * 7) % size] = f"w{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,block", [(512, 512), (4, 8), (2, 3)])
def test_jaccard_join_equals_brute_force(spark, texts, small, block):
    rows = dict(texts) | {100 + i: t for i, t in enumerate(family(77, 30) + family(78, 9) + [texts[0]] * 3)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in chosen_path.join(df, small=small, block=block).collect()}
    links, classes = brute_links(rows)
    assert {k: r["n_links"] for k, r in got.items()} == {k: links[k] for k in rows}
    assert {k: r["class_id"] for k, r in got.items()} == classes
    kept = {r["doc_id"] for r in chosen_path.one_of_each(df, small=small, block=block).collect()}
    assert kept == set(classes.values())


def test_jaccard_join_edges(spark, corpus, empty, clashing):
    assert chosen_path.join(empty).count() == 0
    assert chosen_path.join(clashing).count() == clashing.count()
    assert chosen_path.one_of_each(clashing).columns == clashing.columns
    nulls = spark.createDataFrame([(None, "a b c"), (None, None), (1, None)], "doc_id long, text string")
    assert chosen_path.join(nulls).count() == 3
    assert chosen_path.one_of_each(nulls).count() == 3
    repeated = corpus.union(corpus)
    assert chosen_path.join(repeated).count() == repeated.count()


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_jaccard_join_with_repeated_and_null_ids(spark, parts):
    near = family(31, 6)
    rows = [(1, near[0]), (2, near[1]), (2, " ".join(words(90, 60))), (3, near[2]), (3, near[2]), (3, " ".join(words(91, 60))), (None, near[3]), (4, near[0]), (None, None), (5, None), (5, "")]
    s = [shingles(t) for _, t in rows]
    want = []
    for i, (k, _) in enumerate(rows):
        near_rows = [j for j in range(len(rows)) if k is not None and rows[j][0] is not None and s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9]
        want.append((k, min((rows[j][0] for j in near_rows), default=k), max(0, len(near_rows) - 1)))
    got = chosen_path.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=order) == sorted(want, key=order)
    kept = chosen_path.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted((r for r, w in zip(rows, want) if r[0] is None or w[0] == w[1]), key=str)


def test_recursion_divides_texts_that_share_a_frequent_shingle(spark):
    """400 texts with one common line and little else in common, among them 12 pairs of near copies."""
    line = words(50, 30)
    rows = {i: " ".join(line + words(1000 + i, 8)) for i in range(400)}
    for i in range(12):
        rows[500 + i] = rows[i] + " more"
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    hashed = chosen_path._rows(df, "doc_id", "text")
    sets = chosen_path.paths(hashed, 8, 5).groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("path").alias("path")).withColumn("rep", F.col("first_id"))
    sizes = {r["bucket"]: r["n"] for r in chosen_path.buckets(sets, hashed, 8, 2, 5).collect()}
    assert max(sizes.values()) > 300  # 26 of 34 shingles are common: these texts are alike
    links, classes = brute_links(rows)
    got = {r["doc_id"]: r for r in chosen_path.join(df, small=8, block=64).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: links[k] for k in rows}

    short = {i: " ".join(line[:8] + words(1000 + i, 40)) for i in range(400)}  # 4 common shingles of 44
    for i in range(12):
        short[500 + i] = short[i] + " more"
    df = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    hashed = chosen_path._rows(df, "doc_id", "text")
    sets = chosen_path.paths(hashed, 60, 5).groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("weight"), F.first("path").alias("path")).withColumn("rep", F.col("first_id"))
    first = sets.select(F.explode("path").alias("bucket")).groupBy("bucket").count().agg(F.max("count")).first()[0]
    sizes = {r["bucket"]: r["n"] for r in chosen_path.buckets(sets, hashed, 8, 2, 5).collect()}
    assert first > 20 and max(sizes.values()) < 20
    links, _ = brute_links(short)
    got = {r["doc_id"]: r for r in chosen_path.join(df, small=8).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == {k: links[k] for k in short}


def test_runs_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        b = chosen_path.branches_for(threshold)
        assert (1 - chosen_path.survival(threshold, b)) ** chosen_path.runs_for(threshold, 0.999) <= 0.001
    assert chosen_path.survival(0.8, 2) > 0.7


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 107), (107, 103), (200, 200)] + [(r.randint(300, 330), r.randint(300, 330)) for _ in range(40)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {x: root(x) for x in up if x != 200 and any(x in e and e[0] != e[1] for e in edges)}
    got = {x["id"]: x["class_id"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffix(texts, length=100):
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[k] = (len(raw), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup_equals_brute_force(spark, texts, hot):
    rows = {k: t for k, t in texts.items() if k != 13} | {100 + i: t for i, t in enumerate(family(5, 6))}
    rows |= {200: "ab" * 300, 201: "x" + "ab" * 90, 202: "é" * 120, 203: "e" + "é" * 90}
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(512))  # strings on which polynomials modulo powers of two are weak
    rows |= {210: thue, 211: thue.translate(str.maketrans("ab", "ba")), 212: thue.replace("a", "c")}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, hot=hot).collect()}
    assert got == brute_suffix(rows)


def test_substring_dedup_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    texts = [" ".join(words(9, 400)), " ".join(words(8, 30) + words(9, 400)[100:300])]
    cut = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [suffix_dedup.runs(x, np.zeros(1, np.int64), np.array([len(x)])) for x in cut]
    assert all(len(w[0]) for w in whole)


def test_merge_sort_and_extension():
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    h = suffix_dedup.PrefixHashes(data)
    at = r.permutation(2900)[:500]
    part = np.sort(r.integers(0, 6, 500))
    order = suffix_dedup.merge_sort(h, at, part, 60)
    raw = data.tobytes()
    want = sorted(range(500), key=lambda i: (part[i], raw[at[i] : at[i] + 60]))
    assert order.tolist() == want
    a, b = at[:200], at[200:400]
    n = h.extension(a, b, 60)
    assert all(raw[x : x + k] == raw[y : y + k] and (k == 60 or raw[x + k] != raw[y + k]) for x, y, k in zip(a, b, n))


def test_substring_dedup_edges(spark, empty, clashing):
    assert suffix_dedup.dedup(empty).count() == 0
    assert suffix_dedup.dedup(clashing).count() == clashing.count()
    one = suffix_dedup.dedup(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (one["doc_id"], one["n_bytes"], one["n_removed"]) == (None, 0, 0)


def test_passages(spark, corpus, texts):
    found = compact_windows.find(corpus).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in found}
    assert {(1, 0), (10, 9)} <= pairs and ((2, 0) in pairs or (2, 1) in pairs)
    assert all({a, b} <= {0, 1, 2, 9, 10, 11, 12, 15, 16} for a, b in pairs)
    passage = " ".join(words(2, 80))
    hit = next(r for r in found if (r["doc_id"], r["other_id"]) == (10, 9))
    assert passage in " ".join(texts[10].lower().split()[hit["start_word"] : hit["end_word"]])
    assert hit["similarity"] >= 0.8


def test_every_long_exact_passage_is_found(spark):
    shared = [words(50 + i, 60) for i in range(6)]
    r = random.Random(1)
    rows = []
    for i in range(60):
        w = words(1000 + i, r.randint(20, 200))
        rows.append((i, " ".join(w + shared[i % 6] + words(2000 + i, r.randint(0, 80))) if i % 2 == 0 or i >= 30 else " ".join(w)))
    got = {r["doc_id"] for r in compact_windows.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = set(), set()
    for i, t in rows:
        if i % 2 == 0 or i >= 30:
            (want if i % 6 in seen else seen).add(i if i % 6 in seen else i % 6)
    assert got == want


def test_passages_tree_nodes_equal_brute_force():
    h = np.random.default_rng(2).integers(0, 2**63, 400).astype(np.uint64)
    bounds = np.array([0, 150, 160, 400])
    value, place, left, right = compact_windows.nodes(h, bounds, 12345, 20)
    key = compact_windows.mix64(h ^ np.uint64(12345))
    want = set()
    for a, b in zip(bounds, bounds[1:]):
        for s in range(a, b - 19):
            m = s + int(np.argmin(key[s : s + 20]))
            want.add(m)
    assert sorted(want) == sorted(place.tolist()) and (value == key[place]).all()
    for p, x, y in zip(place, left, right):
        assert key[x : y + 1].min() == key[p] and y - x + 1 >= 20


def test_passages_edges(spark, empty, clashing, corpus):
    assert compact_windows.find(empty).count() == 0
    assert compact_windows.find(clashing).count() == compact_windows.find(corpus).count()


def test_near_copies_are_in_one_class(spark):
    """250 copies of a passage of 120 words, each edited elsewhere, in documents of their own: links of brute force are in one class."""
    r = random.Random(8)
    base, rows, copies = words(60, 120), [], []
    for i in range(250):
        w = base.copy()
        for at in r.sample(range(120), 1 + i % 2):
            w[at] = f"e{i}x{at}"
        copies.append(w)
        rows.append((i, " ".join(words(5000 + i, 30 + i % 40) + w + words(9000 + i, 25))))
    rows += [(1000 + i, " ".join(words(20_000 + i, 150))) for i in range(100)]
    found = compact_windows.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    class_of = {}
    for x in found:
        assert x["doc_id"] < 1000 and x["other_id"] < 1000
        class_of.setdefault(x["doc_id"], set()).add((x["class_id"], x["class_start"]))
        class_of.setdefault(x["other_id"], set()).add((x["class_id"], x["class_start"]))
    s = [shingles(" ".join(w)) for w in copies]
    near = [(i, j) for i in range(250) for j in range(i) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    caught = sum(bool(class_of.get(i, set()) & class_of.get(j, set())) for i, j in near)
    print("pairs", len(near), "in one class", caught / len(near), "rows", len(found))
    assert len(near) > 10_000 and caught >= 0.95 * len(near)


@pytest.mark.parametrize("part", [compact_windows.PART, 40])
def test_passages_do_not_depend_on_partitions(spark, corpus, part):
    """With and without hot groups; splitting them leaves the classes as they are."""
    rng = np.random.default_rng(3)
    base = [f"w{n}" for n in rng.integers(0, 5000, 80)]
    copies = [(10**6 + i, " ".join([f"v{i}"] * (i % 7) + base[: 80 - i % 5] + ["end"])) for i in range(150)]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    runs = [sorted(map(tuple, compact_windows.find(docs.repartition(n), part=part).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
    assert {r[0] for r in runs[0]} >= {d for d, _ in copies[1:]}
    assert len({r[7:] for r in runs[0] if r[0] > 10**6}) == 1



def test_line_chunks_equal_brute_force(corpus, texts):
    seen, want = set(), {}
    for k in sorted(texts):
        t, start, drop = texts[k], 0, set()
        lines = (t or "").split("\n")
        if t and "\n" in t:
            for end in _plain_ends(lines):
                chunk = "\n".join(lines[start:end])
                if end - start >= 2:
                    if chunk in seen:
                        drop |= set(range(start, end))
                    seen.add(chunk)
                start = end
        want[k] = (None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in drop), len(drop))
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_chunks.dedup(corpus).collect()}
    assert got == want
    assert got[12][1] > 0


def _plain_ends(lines):
    """Chunk ends spelled out with Python integers: a chunk ends after a line whose mixed hash with its predecessor's is divisible by 3, has two lines at least and 32 at most."""
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    hashed = [xxhash.xxh3_64_intdigest(x) for x in lines]
    ends, size = [], 0
    for i in range(len(lines)):
        rolled = hashed[0] if i == 0 else mix((hashed[i] * 0x100000001B3 & mask) ^ hashed[i - 1])
        size += 1
        last = i + 1 == len(lines)
        if (mix(rolled) % 3 == 0 and size >= 2) or (size == 32 and not last) or last:
            ends.append(i + 1)
            size = 0
    return ends


@pytest.mark.parametrize("seed", range(6))
def test_line_bounds_equal_plain_arithmetic(seed):
    r = random.Random(seed)
    lines = [r.choice(["", "same", f"line {r.randrange(40)}"]) for _ in range(r.randrange(1, 2000))]
    flat = ["x"] * (100 if seed % 2 else 1)
    assert line_chunks.cuts(lines) == _plain_ends(lines)
    assert line_chunks.cuts(flat) == _plain_ends(flat)


def test_line_bounds_resist_shifts():
    lines = [" ".join(words(i, 6)) for i in range(200)]
    a, b = set(line_chunks.cuts(lines)), {x - 1 for x in line_chunks.cuts(["new line", *lines])}
    assert len(a & b) > 0.8 * len(a)
    assert line_chunks.cuts(["x"]) == [1] and max(np.diff([0, *line_chunks.cuts(["same"] * 500)])) <= 33


def test_line_edges(spark, empty, clashing, corpus):
    assert line_chunks.dedup(empty).count() == 0
    out = line_chunks.dedup(clashing)
    assert out.count() == clashing.count() and set(clashing.columns) <= set(out.columns)
    nulls = spark.createDataFrame([(None, "a\nb\nc\nd\ne"), (None, None), (1, "a\nb\nc\nd\ne")], "doc_id long, text string")
    assert line_chunks.dedup(nulls).count() == 3


def test_line_chunks_of_rows_without_or_with_repeated_ids(spark):
    def text(*seeds):
        return "\n".join(" ".join(words(s, 9)) for s in seeds)

    shared, own = range(300, 312), [range(400 + 20 * i, 412 + 20 * i) for i in range(6)]
    rows = [(None, text(*shared)), (None, text(*own[0], *shared)), (None, text(*own[1])), (None, text(*own[2])), (5, text(*own[3], *shared)), (5, text(*own[4])), (5, text(*own[4])), (6, text(*own[5]))]
    out = [(r["doc_id"], r["text"], r["lines_removed"]) for r in line_chunks.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(out) == len(rows)
    kept = Counter(line for _, t, _ in out for line in t.split("\n"))
    assert all(kept[line] for _, t in rows for line in t.split("\n"))  # of every line one is left
    for i in (2, 3, 5, 6, 7):
        assert (*rows[i], 0) in out
    assert sum(n > 0 for _, _, n in out) == 2 and 16 <= sum(n for _, _, n in out) <= 24


def test_substring_dedup_of_rows_without_or_with_repeated_ids(spark):
    def text(*seeds):
        return " ".join(" ".join(words(s, 60)) for s in seeds)

    rows = [(None, text(600)), (None, text(601, 600)), (None, text(602)), (None, text(603)), (5, text(604, 600)), (5, text(605)), (5, text(605)), (6, text(606))]
    for hot in (20_000, 1):
        out = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"] > 0, bytes(r["kept"]) == b"") for r in out)
        assert len(out) == len(rows)
        left = Counter((r["doc_id"], bytes(r["kept"]).decode()) for r in out)
        for i in (2, 3, 5, 6, 7):
            assert left[rows[i]] == (2 if i in (5, 6) else 1)
        # the passage stays once, in one of the three rows
        assert sum(text(600) in t for _, t in left) == 1
        assert all(any(text(s) in t for _, t in left) for s in (600, 602, 603, 605, 606)) and sum(got.values()) == 8
        assert sum(r["n_removed"] > 0 for r in out) == 2


def test_runs_of_a_long_row_before_short_ones(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 11)  # room for a segment, not for the long row
    w = [words(700 + i, 500) for i in range(3)]
    rows = {1: " ".join(w[0] + w[1] + w[0][100:400]), 2: " ".join(w[1][200:240]), 3: " ".join(w[2][:40]), 4: " ".join(w[0][450:480] + w[2][:40]), 5: " ".join(w[0])}
    monkeypatch.setattr(suffix_dedup, "slices", lambda batches, column, most=0: batches)  # one slice, long and short rows
    seen = []
    runs = suffix_dedup.runs
    monkeypatch.setattr(suffix_dedup, "runs", lambda data, *a: seen.append(len(data)) or runs(data, *a))

    class Docs:
        def mapInArrow(self, run, schema):
            table = pa.table({"key": list(rows), "version": list(rows), "text": list(rows.values())})
            return list(run(iter(table.to_batches())))

    out = pa.Table.from_batches(suffix_dedup.anchored(Docs(), 100, 32)).to_pylist()
    assert max(seen) < 1 << 11 and len(rows[1]) > 1 << 11
    strings = [(r["doc_id"], r["at"] + i) for r in out for i in range(r["n"])]
    assert sorted(strings) == [(k, i) for k, t in rows.items() for i in range(len(t) - 99)]
    anchors = defaultdict(set)  # equal strings meet under one anchor, but for the runs that are settled
    for r in out:
        if not r["done"]:
            for i in range(r["n"]):
                anchors[rows[r["doc_id"]][r["at"] + i : r["at"] + i + 100]].add(r["h"])
    assert all(len(h) == 1 for h in anchors.values())


def test_substring_dedup_of_a_very_long_row_equals_brute_force(spark):
    r = random.Random(4)
    parts = ["".join(r.choices("abcdefghijklmnop", k=300)) for _ in range(3)]
    long = "".join(r.choices("abcdefghijklmnop", k=17_200_000)) + parts[0] + "-" + parts[1]
    rows = [(1, long), (2, "x" + parts[0]), (3, parts[1] + "y"), (4, parts[2]), (5, "z" + parts[2])]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"]) for x in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: (len(long), 0), 2: (301, 300), 3: (301, 300), 4: (300, 0), 5: (301, 300)}


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b)


def test_passages_equal_brute_force_near_the_threshold():
    least = 46
    r = np.random.default_rng(8)
    valid = 0
    for case in range(120):
        x = r.permutation(10_000)[: int(r.integers(46, 220))].astype("<u4")
        y = x.copy()
        for block in range(0, len(x), 46):  # five to seven strange shingles in each stretch, in runs as words changed make them
            for at in r.integers(block, block + 46, r.integers(1, 3)):
                n = int(r.integers(2, 6))
                y[at : at + n] = r.integers(20_000, 60_000, len(y[at : at + n]))
        if case % 3 == 1:  # one inserted
            y = np.insert(y, int(r.integers(0, len(y))), 70_000).astype("<u4")
        if case % 4 == 1:  # a shingle of the passage once more, far away
            y = np.concatenate([y, np.arange(80_000, 80_040, dtype="<u4"), x[20:21]])
        found = list(compact_windows.passages(x, y, least, 0.8))
        for x0, x1, y0, y1, s in found:
            assert s >= 0.8 and s == jaccard(x[x0:x1], y[y0:y1])
        for at in range(len(x) - least + 1):
            if any(jaccard(x[at : at + least], y[t : t + least]) >= 0.8 for t in range(max(0, at - 3), min(at + 4, len(y) - least + 1))):
                valid += 1
                # the ends of a passage that the other has not are left off
                assert any(x0 - 6 <= at and at + least <= x1 + 6 for x0, x1, *_ in found), (case, at, found)
    assert valid > 500


def test_candidates_do_not_depend_on_batches():
    r = np.random.default_rng(3)
    n = 3000
    rows = np.stack([r.integers(0, 6, n), r.integers(6, 12, n), r.integers(0, 40, n) * 16 << 19 | r.integers(0, 6, n) << 16 | 30 << 8 | 30, r.integers(0, 40, n) * 16 << 19 | 30 << 8 | 30])
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    names = ["a", "b", "place_a", "place_b"]

    class Pairs:
        def __init__(self, size):
            self.size = size

        def mapInArrow(self, f, schema):
            return [x for b in f(pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, i : i + self.size]], names) for i in range(0, n, self.size)) for x in b.to_pylist()]

    want = compact_windows.candidates(Pairs(n), 3, 46)
    assert len(want) > 30
    for size in (1, 7, 100, 999):
        assert compact_windows.candidates(Pairs(size), 3, 46) == want


@pytest.mark.parametrize("block", [compact_windows.BLOCK, 16])
def test_passages_around_a_frequent_line_lose_no_pair(spark, block):
    """60 passages of 50 words around a line that all share; each has a copy with one word changed: 41 of 51 shingles, just enough."""
    r, line, rows = random.Random(3), words(30_000, 24), []
    for i in range(60):
        left = 6 + i % 15
        w = words(31_000 + i, left) + line + words(32_000 + i, 26 - left)
        other = w.copy()
        other[20 + i % 10] = f"changed{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    r.shuffle(rows)
    s = {k: shingles(t) for k, t in rows}
    want = {(b, a) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    assert want == {(2 * i + 1, 2 * i) for i in range(60)}
    found = compact_windows.find(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {(x["doc_id"], x["other_id"]) for x in found} == want


def test_passages_of_few_words_lose_no_pair(spark):
    """Words over and over, in runs of other lengths in the copy: no long run of equal shingles, but equal sets."""
    rows = []
    for i in range(20):
        r, kinds = random.Random(i), words(33_000 + i, 4)
        for j in range(2):
            rows.append((2 * i + j, " ".join(" ".join([w] * r.randint(8, 20)) for w in kinds + kinds)))
    found = compact_windows.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(2 * i + 1, 2 * i) for i in range(20)} == {(x["doc_id"], x["other_id"]) for x in found if x["doc_id"] != x["other_id"]}


def _met(group, code, near=False):
    n = len(group)
    found = compact_windows.meetings(group, np.arange(n), np.full(n, 100), np.full(n, near), code, 46, 0.8)
    return {(int(a), int(b)) for i, j in found for a, b in zip(i, j)}


@pytest.mark.parametrize("side", ["left", "middle", "right"])
@pytest.mark.parametrize("near", [False, True])
def test_windows_with_one_stretch_in_common_are_not_paired_all_with_all(side, near):
    """300 windows of a group have one stretch in common that ends, begins or lies about the middle; 20 have nothing but the middle; two of those are similar elsewhere."""
    r = np.random.default_rng(11)
    code = r.integers(1, 1 << 24, (320, 99)).astype("<u4")
    low = {"left": 4, "middle": 26, "right": 49}[side]
    code[:300, low : low + 46] = r.integers(1, 1 << 24, 46)
    if near:
        code[:300, low + 6] = code[:300, low + 5]
    code[:, 49] = 7
    code[319, 10:60] = code[307, 10:60]
    found = _met(np.zeros(320, np.int64), code, near)
    assert (307, 319) in found and len(found) < 2 * 320
    reached, todo = {0}, [0]
    links = defaultdict(set)
    for a, b in found:
        links[a].add(b)
        links[b].add(a)
    while todo:
        new = links[todo.pop()] - reached
        reached |= new
        todo += new
    assert reached >= set(range(300)) and not reached & {307, 319}


def test_pairs_near_repeats_equal_plain_sets():
    r = np.random.default_rng(12)
    x = r.integers(1, 25, (400, 99)).astype("<u4")
    y = np.roll(x, 3, axis=1)
    for row in range(400):
        some = r.random(99) < row % 20 / 100
        y[row, some] = r.integers(25, 60, int(some.sum()))
    x[::7, :30] = 0

    def share(a, b, low, high):
        parts = [a[s : s + 46].tolist() for s in range(low, high + 1)]
        return any(0 not in p and len(set(p) & set(b.tolist())) >= 0.8 * len(set(p)) - 1e-9 for p in parts)

    def hits(a, b):
        return max(sum(v != 0 and v in b for v in a[s : s + 46]) for s in range(4, 50))

    want = [hits(a, b) >= 40 and share(a, b, 4, 49) and share(b, a, 0, 53) for a, b in zip(x, y)]
    got = compact_windows.possible(x, y, np.ones(400, bool), 46, 40, 0.8)
    both = np.vstack([y, x])
    may = compact_windows.sifted(both, compact_windows.sieve(both), np.arange(400), np.arange(400, 800), 46, 40)
    assert got.tolist() == want and 20 < got.sum() < 380 and not (got & may != got).any()


@pytest.mark.parametrize("side", [0, 1])
def test_windows_around_a_common_line_are_not_compared_all_with_all(side):
    rng = np.random.default_rng(side)
    n, middle = 2000, 49
    code = rng.integers(1, 1 << 24, (n, 99)).astype("<u4")
    line = slice(middle, middle + 9) if side == 0 else slice(middle - 8, middle + 1)
    code[:, line] = 7
    key = np.full(n, 4 * 11 + side)
    assert not len(compact_windows.divided(key, code)[0])
    row, group = compact_windows.divided(key - side + 2, code)  # the group of the shingle alone is left as it is
    assert (row == np.arange(n)).all() and (group == 0).all()


@pytest.mark.parametrize("side", [0, 1])
def test_divided_groups_lose_no_pair_with_a_run(side):
    rng = np.random.default_rng(side)
    n, middle, run = 240, 49, compact_windows.RUN
    code = rng.integers(1, 4, (n, 99)).astype("<u4")
    common = rng.integers(1, 1 << 24, (2 * run, 99)).astype("<u4")
    for i in range(n):
        left = rng.integers(0, run) if side == 0 else rng.integers(8, run)
        right = max(run - 1 - left, 8) if side == 0 else max(run - 1 - left, 0)
        part = slice(middle - left, middle + right + 1)
        code[i, part] = common[rng.integers(0, 3), part]
        code[i, : rng.integers(0, middle - left + 1)] = 0
    key = np.sort(rng.integers(0, 3, n)) * 4 + side
    row, group = compact_windows.divided(key, code)
    assert (np.diff(group) >= 0).all() and all((np.diff(row[group == g]) > 0).all() for g in np.unique(group))
    met = {(int(i), int(j)) for g in np.unique(group) for i in row[group == g] for j in row[group == g] if i < j}
    sides = range(middle - 8, middle + 1) if side else range(middle, middle + 9)
    wanted = 0
    for i in range(n):
        for j in range(i + 1, n):
            same = (code[i] == code[j]) & (code[i] > 0)
            left, right = (int(np.append(~part, True).argmax()) for part in (same[:middle][::-1], same[middle + 1 :]))
            if key[i] == key[j] and same[middle] and same[sides].all() and left + right + 1 >= run:
                wanted += 1
                assert (i, j) in met
    assert wanted > 300


def test_pairs_of_divided_groups_are_told_once():
    n, width = 60, 99
    code = np.random.default_rng(3).integers(1, 1 << 24, (1, width)).repeat(n, 0).astype("<u4")
    raw = code.view(np.uint8).reshape(n, width, 4)[:, :, :3]
    batch = pa.RecordBatch.from_arrays([pa.array([4] * n), pa.array(range(n)), pa.array([100 << 19] * n), pa.array([r.tobytes() for r in raw])], ["key", "a", "place_a", "part"])

    class Rows:
        def mapInArrow(self, run, shape):
            return [r for b in run(iter([batch])) for r in b.to_pylist()]

    got = [(r["a"], r["b"]) for r in compact_windows.near_links(Rows(), 46, 0.8)]
    assert sorted(got) == [(0, j) for j in range(1, n)]
