"""The contract queries opN_<name> of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import bpe, chosen_path, compact_windows, decontam, langid, line_chunks, nb_svm, sharding, sketch, suffix_dedup, sync_runs, token_store, turn_repair
from mosaiq.llm.common import materialize, read_table, table_path


def op4_family_then_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=~langid.held_out())
    narrow = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(read_table(spark, sf_dir, "documents"), 16, map_path=table_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table_path(spark, "token-files")
    token_store.write(read_table(spark, sf_dir, "documents"), target, vocabulary_path("byte_bpe_50k.json"))
    return token_store.read(spark, target)


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(read_table(spark, sf_dir, "documents"))


def op6_hashed_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.find(read_table(spark, sf_dir, "documents"))


def op8_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_chunks.dedup(docs)
    return done.select("doc_id", "lines_removed", "spans_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turn_repair.damage(read_table(spark, sf_dir, "conversations"))
    return turn_repair.digests(turn_repair.repair(damaged, dropped=F.col("dropped")))


def op12_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(nb_svm.featurize(read_table(spark, sf_dir, "documents")), "quality-features")
    model = nb_svm.train(found, read_table(spark, sf_dir, "labels"), learn=~nb_svm.held_out())
    scored = nb_svm.score(found, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", nb_svm.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sync_runs.planted(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = sync_runs.find(docs).withColumn("top", sync_runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    said = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli")
    digests = F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, exponent, *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
 sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c) - 1e-9),
 b AS (SELECT x AS p, y AS q FROM e UNION ALL SELECT y, x FROM e),
 r(id, lab) AS (SELECT doc_id, doc_id FROM w UNION SELECT b.q, r.lab FROM r JOIN b ON b.p = r.id WHERE r.lab < b.q),
 k AS (SELECT id, min(lab) AS class_id FROM r GROUP BY 1),
 l AS (SELECT b.p, count(*) AS links, count(DISTINCT o.text) FILTER (o.text <> m.text) AS texts FROM b JOIN w m ON m.doc_id = b.p JOIN w o ON o.doc_id = b.q GROUP BY 1)
 SELECT k.id AS doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_text_links FROM k LEFT JOIN l ON l.p = k.id"""

SUBSTRING_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM d, LATERAL (SELECT unnest(range(0, n - 99)) AS i) WHERE n >= 100),
 f AS (SELECT k, min((doc_id, i)) AS f FROM w GROUP BY 1 HAVING count(*) > 1),
 g AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) <> f),
 m AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100 AS new FROM g),
 s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM m) GROUP BY doc_id, r),
 t AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM s UNION ALL SELECT doc_id, max(b), NULL FROM s GROUP BY 1),
 kept AS (SELECT doc_id, string_agg(CASE WHEN high IS NULL THEN substr(h, 2 * low + 1) ELSE substr(h, 2 * low + 1, 2 * (high - low)) END, '' ORDER BY low) AS h FROM t JOIN d USING (doc_id) GROUP BY 1),
 c AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*)::BIGINT AS spans FROM s GROUP BY 1)
 SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators have models, checksums or hashes that DuckDB lacks; they are tested against brute force."""
    return {"op5_chosen_path_join": JACCARD_SQL, "op6_hashed_suffix_sort": SUBSTRING_SQL}
