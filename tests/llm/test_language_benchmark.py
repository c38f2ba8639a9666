import random
import zlib

from pyspark.sql import functions as F

from mosaiq.llm import decontam, langid
from tests.llm.conftest import words

PARTS = {"en": "the of and th ing er on", "de": "der die sch ung ein keit über", "fr": "les que eau ment é du où", "es": "ción que los ñ ado para más"}


def sentence(lang, seed):
    r = random.Random(seed)
    p = PARTS[lang].split()
    return " ".join("".join(r.choice(p) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60)))


def test_languages(spark):
    rows = [(i, sentence(lang, i), lang if i % 7 else None) for i, lang in enumerate(list(PARTS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, learn=~langid.held_out(), per_language=40)
    got = langid.predict(df.select("doc_id", "text", langid.held_out().alias("h")), model).collect()
    truth = {i: list(PARTS)[i % 4] for i, *_ in rows}
    held = [r for r in got if r["h"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert model.families == ("germanic", "romance")


def test_held_out_languages_of_documents(spark):
    """Whole table: the held-out rows are as the contract says, and their labels, if spoiled, change no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    outcomes = []
    for table in (docs, spoiled):
        model = langid.train(table, learn=~langid.held_out())
        rows = langid.predict(table.select("doc_id", "text", langid.held_out().alias("held")), model).collect()
        outcomes.append({r["doc_id"]: (r["held"], r["lang_pred"], r["score"]) for r in rows})
    assert outcomes[0] == outcomes[1]
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = outcomes[0]
    assert set(got) == set(truth) and all(held == (zlib.crc32(str(k).encode()) % 4 == 2) for k, (held, *_) in got.items())
    judged = [k for k, (held, *_) in got.items() if held and truth[k]["lang"] and truth[k]["text"]]
    assert len(judged) > 200 and sum(got[k][1] == truth[k]["lang"] for k in judged) / len(judged) > 0.97
    assert {lang for _, lang, _ in got.values()} <= {r["lang"] for r in truth.values()} | {"und"}


def test_language_edges(spark, empty, corpus, clashing):
    assert langid.train(empty) is None
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "x"), (None, "abc abc")], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    one = langid.train(corpus)  # a single language
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, one).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "xx", None: "xx"}
    assert langid.predict(empty, one).count() == 0
    assert langid.predict(clashing, one).count() == clashing.count()


def edit(text, n, seed):
    r = random.Random(seed)
    t = list(text)
    for _ in range(n):
        i, kind = r.randrange(len(t)), r.randrange(3)
        if kind == 0:
            t[i] = "#"
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, "%")
    return "".join(t)


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_matches_equal_brute_force(spark):
    items = [(i, " ".join(words(i, 12 + i))) for i in range(8)] + [(8, None), (9, ""), (10, "short one"), (11, " ".join(words(0, 12)))]
    docs = []
    for i in range(40):
        item = items[i % 8][1]
        noise = edit(item, i // 5, i) if i % 3 else item.upper().replace(" ", "\n ", 2)
        docs.append((i, " ".join(words(500 + i, 40)) + " " + noise + " " + " ".join(words(600 + i, 30))))
    docs += [(100, None), (101, ""), (102, "a Short  one here")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for k, t in docs:
        for j, x in items:
            p, t2 = decontam.normal(x), decontam.normal(t)
            if p and (m := distance(p, t2)) <= int(len(p) * decontam.ERROR_RATE):
                want[k, j] = m
    for block in (1 << 20, 60):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find(d, b, block_chars=block).collect()}
        assert got == want
    left = {r["doc_id"] for r in decontam.remove(d, b).collect()}
    assert left == {r["doc_id"] for r in decontam.remove(d, b, block_chars=40).collect()}
    assert left == {k for k, _ in docs} - {k for k, _ in want}


def test_positions_and_myers():
    r = random.Random(4)
    for s in range(60):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 150)))
        assert decontam.myers(p, t)[0] == distance(p, t)
    m = decontam.Matcher([(1, "find this very text here")], 0.1)
    assert m.find("xx FIND this\nvery text here yy") == [(1, 0, 24, 3, 27)]


def test_benchmark_edges(spark, empty, corpus, clashing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(corpus, items).count() == 0
    assert decontam.remove(corpus, items).count() == corpus.count()
    some = spark.createDataFrame([(1, " ".join(words(2, 80)))], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.find(corpus, some).collect()} == {9, 10}
    assert decontam.find(empty, some).count() == 0
    kept = decontam.remove(clashing, some)
    assert kept.columns == clashing.columns and kept.count() == clashing.count() - 2
