import hashlib
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from mosaiq.llm import sharding, sketch


def test_shards(spark, corpus, texts, tmp_path):
    placed, slot_map = sharding.shard(corpus, 3, map_path=str(tmp_path / "map"))
    rows = placed.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    places = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert r["shard"] == slot_map.shard_of[r["virtual_slot"]]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_balance_growth_and_versions(spark, tmp_path):
    size = [(i * 7919) % 1000 + 1 for i in range(4096)]
    first = sharding.SlotMap.build(size, 16)
    loads = first.loads(size)
    assert max(loads) - min(loads) < 0.002 * sum(loads) / 16
    grown = first.grow(size)
    assert grown.n_shards == 17 and grown.version == 2
    assert all(b in (a, 16) for a, b in zip(first.shard_of, grown.shard_of))
    assert abs(grown.loads(size)[16] - sum(size) / 17) < 0.05 * sum(size) / 17
    uneven = [s * (10 if i % 16 == 0 else 1) for i, s in enumerate(size)]
    again = first.rebalance(uneven, 0.01)
    assert max(again.loads(uneven)) - min(again.loads(uneven)) <= 0.02 * sum(uneven) / 16
    path = str(tmp_path / "maps")
    first.save(spark, path)
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == first


def test_repeated_rows_and_null_ids(spark, corpus, empty, clashing):
    doubled = corpus.union(corpus).union(spark.createDataFrame([(None, "a", None, None, None)] * 2, corpus.schema))
    rows = sharding.shard(doubled, 4)[0].collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == doubled.count() and all(sorted(p) == list(range(len(p))) for p in by.values())
    assert sharding.shard(empty, 4)[0].count() == 0
    assert sharding.shard(clashing, 4)[0].count() == clashing.count()


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_edited_text_and_next(corpus, texts):
    rows = {r["doc_id"]: r for r in sketch.fingerprints(corpus).collect()}
    keys = sorted(texts)
    for i, k in enumerate(keys):
        t, nxt = texts[k] or "", texts[keys[(i + 1) % len(keys)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[k]["n_chars"] == len(t)
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k]["near_edited"] <= 1 and 0 <= rows[k]["near_next"] <= 1
    assert rows[0]["fingerprint"] == rows[2]["fingerprint"] != rows[9]["fingerprint"]
    assert rows[4]["near_next"] == 1.0 and rows[3]["near_next"] == 1.0
    assert rows[0]["near_next"] > 0.9


def test_estimates_follow_exact_similarity(spark, texts):
    pairs = [(texts[0], texts[1]), (texts[13], texts[13][:60_000]), (texts[9], texts[10])]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select("a", "b", sketch.sketch(df.a).alias("x"), sketch.sketch(df.b).alias("y"))
    for r in found.select("a", "b", sketch.likeness(found.x, found.y).alias("j"), sketch.containment(found.y, found.x).alias("c"), sketch.merge(found.x, found.y).alias("m"), sketch.sketch(found.a).alias("x")).collect():
        a, b = _shingles(r["a"]), _shingles(r["b"])
        assert abs(r["j"] - len(a & b) / len(a | b)) < 0.2
        assert abs(r["c"] - len(a & b) / len(b)) < 0.25
        assert set(r["x"]) <= set(r["m"]) or len(r["x"]) == 1


def test_sketch_edges(spark, empty, clashing):
    assert sketch.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "only one document here now")], "doc_id long, text string")
    assert sketch.fingerprints(one).first()["near_next"] == pytest.approx(1.0)
    assert sketch.fingerprints(clashing).count() == clashing.count()
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    assert sketch.fingerprints(nulls).count() == 3


def _plain_sketch(text):
    """The sketch spelled out: hashes of words, chained over five words, 63 bits, those below an eighth of the range or else the least."""
    parts = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    hashed = [xxhash.xxh64_intdigest(w, seed=42) for w in parts]
    every = set()
    for i in range(max(1, len(hashed) - 4)) if hashed else ():
        seed = 42
        for h in hashed[i : i + 5]:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=seed)
        every.add(seed >> 1)
    low = {h for h in every if h < 2**63 // 8}
    return low or ({min(every)} if every else set())


def _plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("table", ["corpus", "documents"])
def test_fingerprints_equal_an_exact_reference(spark, corpus, table):
    df = corpus if table == "corpus" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in sketch.fingerprints(df).collect()}
    assert set(rows) == set(texts)
    keys = sorted(texts)
    text_of = lambda s: "".join(f"{h:016X}" for h in sorted(s))
    for k, following in zip(keys, keys[1:] + keys[:1]):
        t, nxt, r = texts[k], texts[following], rows[k]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = map(_plain_sketch, (t, edited, nxt))
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (text_of(a), text_of(b), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(_plain_likeness(a, b)), pytest.approx(_plain_likeness(a, c)))
