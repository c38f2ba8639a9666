"""Queries of array files and of the tables behind reports, with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mosaiq.operators import registry, report_tables
from mosaiq.plans import oracle_parts as O
from mosaiq.plans.catalog import QUERIES, SQL, _BENIGN, _BOOT, _LOSO_SQL, _SEQ, _STREAM_SQL, _boot, _distances, _keep, _loso, _registry, _rounded, query, r6
from mosaiq.sources import adapters as A
from mosaiq.sources import arrays, bundles, readers, sinks

_PLACED = "WITH " + O.SV + ", pl AS (SELECT source_id||'.npz' AS file, segment_id, video_no, embedding, row_number() OVER (PARTITION BY source_id ORDER BY video_id, segment_id)-1 AS place FROM sv)"


@query(_PLACED + """, el AS (SELECT file, 'segment_ids' AS name, '<i8' AS dtype, 1 AS width, place AS k, segment_id::DOUBLE AS v FROM pl
 UNION ALL SELECT file, 'resnet', '<f4', 40, place*40+pos-1, v FROM (SELECT file, place, unnest(embedding[1:40])::DOUBLE AS v, generate_subscripts(embedding[1:40],1) AS pos FROM pl)
 UNION ALL SELECT file, 'temporal', '<f8', 12, place*12+pos-1, v FROM (SELECT file, place, unnest(embedding[41:52])::DOUBLE AS v, generate_subscripts(embedding[41:52],1) AS pos FROM pl))
 SELECT file, name, any_value(dtype) AS dtype, (count(*)//any_value(width))::BIGINT AS length, count(*)::BIGINT AS elements, round(sum(v),6) AS total, round(sum(v*(k%97)),6) AS weighted FROM el GROUP BY 1,2""")
def array_files(spark, d):
    """The vectors of each source written as an array file and read back: four arrays, of which three are asked for."""
    path = f"{sinks.shared_folder(spark)}/mosaiq/array-files-{uuid.uuid4().hex}"
    kinds = {"segment_ids": ("segment_id", "i8"), "video_no": ("video_no", "u1"), "resnet": ("resnet", "f4"), "temporal": ("temporal", "f8")}
    rows = A.seg_vectors(spark, d).withColumn("file", F.concat("source_id", F.lit(".npz")))
    arrays.write(arrays.pack(rows, "file", ["video_id", "segment_id"], kinds), path)
    blocks = arrays.read(spark, path).filter(F.col("name").isin("segment_ids", "resnet", "temporal"))
    elements = blocks.select("file", "name", "dtype", "shape", "first", F.posexplode("values").alias("k", "v"))
    found = elements.groupBy("file", "name", "dtype").agg(F.get(F.first("shape"), F.lit(0)).alias("length"), F.count(F.lit(1)).alias("elements"), r6(F.sum("v")).alias("total"), r6(F.sum(F.col("v") * ((F.col("first") + F.col("k")) % 97))).alias("weighted"))
    return found


_STREAMS = {"resnet": "dr", "temporal": "dt", "balanced": "bal"}
_COLUMNS = {"resnet": "resnet_distance", "temporal": "temporal_distance", "balanced": "balanced"}


@query("WITH " + _LOSO_SQL + " SELECT held_out, " + ", ".join(f"round(max(threshold) FILTER (stream='{s}'),6) AS {s}_threshold" for s in _STREAMS) + " FROM th GROUP BY 1")
def fold_threshold_table(spark, d):
    return _rounded(report_tables.thresholds_by_fold(_loso(spark, d)[1], list(_STREAMS)))


@query("WITH " + _LOSO_SQL + ", mv AS (SELECT source_id, video_id, transformation, count(*)::BIGINT AS segments, " + ", ".join(f"max({c}) AS max_{s}, avg({c}) AS mean_{s}" for s, c in _STREAMS.items()) + " FROM dd GROUP BY 1,2,3), tw AS (SELECT held_out, " + ", ".join(f"max(threshold) FILTER (stream='{s}') AS t_{s}" for s in _STREAMS) + " FROM th GROUP BY 1) SELECT source_id, video_id, transformation, segments, " + ", ".join(f"round(max_{s},6) AS max_{s}, round(mean_{s},6) AS mean_{s}, round(t_{s},6) AS {s}_threshold, coalesce(max_{s}>t_{s}, false) AS {s}_exceeds" for s in _STREAMS) + " FROM mv LEFT JOIN tw ON tw.held_out=mv.source_id")
def stream_scores_with_thresholds(spark, d):
    """Largest and mean distances of each recording by stream beside its fold's thresholds; the blur rows are those of one transformation."""
    rows, limits = _loso(spark, d)
    return _rounded(report_tables.scores_with_thresholds(rows, limits, _COLUMNS, ["source_id", "video_id", "transformation"]))


@query("WITH " + O.PRED + " SELECT transformation, expected, count(*)::BIGINT AS evaluated, 0::BIGINT AS failed, CASE WHEN expected='abnormal' THEN round(count(*) FILTER (observed='abnormal')/count(*)::DOUBLE,6) END AS detection_rate, CASE WHEN expected='normal' THEN round(count(*) FILTER (observed='abnormal')/count(*)::DOUBLE,6) END AS false_rejection_rate FROM pd GROUP BY 1,2")
def transformation_rates(spark, d):
    return _rounded(report_tables.rates_by_transformation(A.predictions(spark, d)))


_GRID = ", vs AS (SELECT DISTINCT o_orderpriority AS video_id FROM orders UNION SELECT DISTINCT o_orderpriority||' (spare)' FROM orders)"


@query("WITH " + O.LOG + _GRID + f", k AS (SELECT *, row_number() OVER (PARTITION BY video_id, stage ORDER BY {', '.join(c + ' DESC' for c in _SEQ.split(', '))}) rn FROM lg WHERE source_id='F') SELECT vs.video_id, " + ", ".join(f"coalesce(max(CASE status WHEN 'completed' THEN 'OK' ELSE 'FAIL' END) FILTER (stage='{s}'),'NA') AS \"{s}\"" for s in "ANRX") + " FROM vs LEFT JOIN k ON k.video_id=vs.video_id AND rn=1 GROUP BY 1")
def completion_grid(spark, d):
    """Recordings and stages that never ran are NA: half of the recordings have no log row, and stage X has none at all."""
    known = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("video_id")).distinct()
    videos = known.unionByName(known.select(F.concat("video_id", F.lit(" (spare)")).alias("video_id")))
    return report_tables.completion(A.runtime_log(spark, d).filter("source_id = 'F'"), videos, list("ANRX"))


@query("WITH " + O.REG + ", " + O.HITS + ", sc AS (SELECT doc_id AS video_id, CASE WHEN doc_id%5<>0 THEN (n_chars%1000)/1000.0::DOUBLE END AS score FROM documents WHERE doc_id%3<>0), iv AS (SELECT *, CASE WHEN t1='ambiguous' OR t1='unsupported_video' THEN 'unknown' WHEN t1 IN ('frame_deletion','frame_insertion','frame_replacement') THEN 'tampered' ELSE 'benign' END AS category FROM cl) SELECT video_id, category, round(size*8/1e6,6) AS mbps, round(coalesce(score,0),6) AS score, round(least(300.0::DOUBLE, greatest(30.0::DOUBLE, coalesce(width,0)*height/5000.0::DOUBLE)),6) AS point_size FROM iv JOIN sc USING (video_id) WHERE category='benign'")
def rate_score_points(spark, d):
    kind = F.when(F.col("t1").isin("ambiguous", "unsupported_video"), "unknown").when(F.col("t1").isin("frame_deletion", "frame_insertion", "frame_replacement"), "tampered").otherwise("benign")
    inventory = _registry(spark, d).withColumn("category", kind).withColumn("bit_rate", F.col("size") * 8)
    scores = A.table(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("video_id"), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") % 1000 / 1000.0).alias("max_score"))
    return _rounded(report_tables.rates_and_scores(inventory, scores, "max_score"))


@query("WITH " + O.DIST + _STREAM_SQL + f", b AS (SELECT * FROM u WHERE {_BENIGN})" + """, fo AS (SELECT h.source_id AS g, h.video_no AS left_out, b.stream, b.val, b.res FROM (SELECT DISTINCT source_id, video_no FROM b) h JOIN b ON b.source_id=h.source_id AND b.video_no<>h.video_no),
 md AS (SELECT g, left_out, stream, median(val) md FROM fo GROUP BY 1,2,3), th AS (SELECT g, left_out, stream, least(1,greatest(0,max(val)+greatest(3*median(abs(val-md)),max(res)))) t FROM fo JOIN md USING (g, left_out, stream) GROUP BY 1,2,3),
 sg AS (SELECT source_id, video_no, segment_id, bool_or(val>t) AS ov FROM b JOIN th ON th.g=b.source_id AND th.left_out=b.video_no AND th.stream=b.stream GROUP BY 1,2,3)
 SELECT source_id, video_no, count(*)::BIGINT AS tested_segments, bool_or(ov) AS would_be_marked_abnormal, coalesce(string_agg(segment_id::VARCHAR, ',' ORDER BY segment_id) FILTER (ov),'') AS abnormal_segments FROM sg GROUP BY 1,2""")
def benign_stability(spark, d):
    """Each benign recording judged by thresholds from the other benign recordings of its source."""
    rows = _keep(spark)(_distances(spark, d).filter(_BENIGN))
    streams = {"resnet": ("resnet_distance", 1 / 40), "temporal": ("temporal_distance", 1 / 24), "balanced": ("balanced", 0.5 / 40 + 0.5 / 24)}
    found = report_tables.stability(rows, streams, ["source_id"], "video_no")
    return found.withColumn("abnormal_segments", F.array_join(F.col("abnormal_segments").cast("array<string>"), ","))


_PARTS = ("point_estimate", "ci_lower", "ci_upper", "fold_mean", "fold_sd")


@query(_BOOT + ", pc AS (" + O.counts("") + "), pm AS (" + O.metrics("pc", "") + "), pl AS (" + O.long_metrics("(SELECT 1 AS one, * FROM pm)", "one") + "), fc AS (" + O.counts("source_id") + "), fm AS (" + O.metrics("fc", "source_id") + "), fl AS (" + O.long_metrics("fm", "source_id") + """), fv AS (SELECT metric, avg(value) AS fold_mean, stddev_samp(value) AS fold_sd FROM fl GROUP BY 1),
 al AS (SELECT metric, round(pl.value::DOUBLE,6) AS point_estimate, low AS ci_lower, high AS ci_upper, round(fold_mean,6) AS fold_mean, round(fold_sd,6) AS fold_sd FROM pl LEFT JOIN ci USING (metric) LEFT JOIN fv USING (metric))
 SELECT 'balanced' AS method, any_value(tp)::BIGINT AS tp, any_value(tn)::BIGINT AS tn, any_value(fp)::BIGINT AS fp, any_value(fn)::BIGINT AS fn, any_value(tp+tn+fp+fn)::BIGINT AS total, """ + ", ".join(f"max({p}) FILTER (metric='{m}') AS {m}_{p}" for m in O.METRIC_NAMES for p in _PARTS) + " FROM pc, al")
def primary_table(spark, d):
    """Point estimates, bootstrap intervals and spread over folds in one row a method."""
    rows = A.predictions(spark, d).withColumn("method", F.lit("balanced"))
    return _rounded(report_tables.primary_table(rows, _boot(spark, d).withColumn("method", F.lit("balanced"))))


# Folders of nine recordings; names by rule, so that about one folder in five has no reference.
_FOLDERS = "rg AS (SELECT 'take '||(doc_id//9) AS folder, doc_id, ['original.mp4','take_avi.avi','take.mov','clip_480p.mp4','clip_720.mp4','blurred.mp4','frame_del_x.mp4','insert-1.mp4','swap.mp4','blur_480.mp4','other.mkv'][(doc_id%11)::INT+1] AS filename, sha256(text) AS sha256, strlen(text)::BIGINT AS size, CASE WHEN doc_id%7<>0 THEN (320+(doc_id%13)*100)::INT END AS width FROM documents)"
_BUILT = "WITH " + _FOLDERS + ", " + O.HITS + f""", ra AS (SELECT cl.*, CASE WHEN filename='original.mp4' THEN 'trusted_reference' ELSE t1 END AS tr, count(*) FILTER (filename='original.mp4') OVER (PARTITION BY folder) AS refs FROM cl),
 rb AS (SELECT *, row_number() OVER (PARTITION BY folder, tr ORDER BY lower(filename), filename) AS n, upper(replace(folder,' ','_')) AS px FROM ra),
 bt AS (SELECT *, 'SRC_'||px AS source_id, px||'_'||CASE tr {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in registry.ENDINGS.items())} ELSE upper(stem) END||CASE WHEN n>1 THEN '_'||n ELSE '' END AS video_id, CASE WHEN refs=1 THEN px||'_ORIGINAL' END AS reference_video_id, CASE WHEN refs=1 THEN 'original.mp4' END AS reference_filename, CASE WHEN refs=1 THEN 'valid' ELSE 'blocked' END AS status,
 CASE WHEN tr='trusted_reference' THEN 'reference' WHEN tr='ambiguous' THEN 'ambiguous' WHEN tr='unsupported_video' THEN 'unsupported' WHEN tr IN ('avi_conversion','mov_conversion','resize_480p','resize_720p') THEN 'benign' ELSE 'tampered' END AS category FROM rb)"""


def _built(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 9).alias("folder_no"))
    files = A.registry(spark, d).withColumnRenamed("video_id", "doc_id").select("doc_id", "filename", "sha256", "size", "width")
    videos = files.join(docs, "doc_id").select(F.concat(F.lit("take "), F.col("folder_no").cast("string")).alias("folder"), "doc_id", "filename", "sha256", "size", "width")
    return registry.build(videos, readers.choose_references(videos))


@query(_BUILT + f""" SELECT doc_id, source_id, video_id, reference_video_id, reference_filename, status, tr AS transformation, category, CASE category WHEN 'tampered' THEN 'abnormal' WHEN 'ambiguous' THEN 'unknown' WHEN 'unsupported' THEN 'unknown' ELSE 'normal' END AS expected, CASE category WHEN 'reference' THEN 1.0::DOUBLE WHEN 'ambiguous' THEN 0.2 WHEN 'unsupported' THEN 0.1 ELSE 0.95 END AS confidence,
 concat_ws('; ', CASE WHEN status='blocked' THEN '{registry.NO_REFERENCE}' END, CASE category WHEN 'ambiguous' THEN '{registry.AMBIGUOUS}' WHEN 'unsupported' THEN '{registry.UNSUPPORTED}' END) AS notes FROM bt""")
def built_registry(spark, d):
    """Folders of files to recordings with ids, references, kinds and notes."""
    return _built(spark, d).select("doc_id", "source_id", "video_id", "reference_video_id", "reference_filename", "status", "transformation", "category", "expected", "confidence", F.array_join("notes", "; ").alias("notes"))


@query(_BUILT + " SELECT b.source_id, b.video_id, b.size, r.size AS reference_size, b.size-r.size AS size_delta, b.width, r.width AS reference_width, b.width-r.width AS width_delta, b.filename, r.filename AS file_of_reference, b.category FROM bt b LEFT JOIN bt r ON r.source_id=b.source_id AND r.category='reference'")
def registry_metadata_comparison(spark, d):
    found = registry.metadata_comparison(_built(spark, d), ["size", "width"], ["filename"], ["category"])
    return found.withColumnRenamed("reference_filename", "file_of_reference")


@query(_BUILT + f" SELECT b.source_id, b.video_id, b.sha256, coalesce(r.sha256,'') AS original_sha256, r.sha256 IS NOT NULL AND r.sha256=b.sha256 AS matches_original, CASE WHEN r.sha256=b.sha256 THEN '{registry.IDENTICAL}' ELSE '{registry.CHANGED}' END AS interpretation FROM bt b LEFT JOIN bt r ON r.source_id=b.source_id AND r.category='reference'")
def registry_byte_baseline(spark, d):
    return registry.byte_baseline(_built(spark, d))


#: The query behind each table of a bundle.
_TABLES = {
    "source_registry": "source_registry",
    "video_inventory": "built_registry",
    "metadata_comparison": "registry_metadata_comparison",
    "pipeline_status": "completion_grid",
    "runtime_log": "runtime_rollup",
    "segment_distances": "comparison_segments",
    "alignment_findings": "alignment_registry",
    "per_video_summary": "comparison_summary",
    "pooled_thresholds": "pooled_thresholds",
    "leave_one_source_out_thresholds": "loso_thresholds",
    "diagnostic_predictions": "loso_video_predictions",
    "per_source_metrics": "per_source_metrics",
    "per_tamper_metrics": "transformation_rates",
    "per_benign_metrics": "transformation_rates",
    "attribution_summary": "attribution_counts",
    "sha256_baseline": "registry_byte_baseline",
    "runtime_summary": "runtime_by_stage",
    "failures": "failure_rows",
}
_PART = {"per_tamper_metrics": "expected = 'abnormal'", "per_benign_metrics": "expected = 'normal'"}


@query("SELECT *, rows AS rows_read, 0::BIGINT AS files_wrong FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*)::BIGINT AS rows FROM ({SQL[q]}) WHERE {_PART.get(n, 'true')}" for n, q in _TABLES.items()) + ")")
def evaluation_bundle(spark, d):
    """The tables of an evaluation written as one bundle, read back and held against the manifest."""
    folder = f"{sinks.shared_folder(spark)}/mosaiq/bundle-{uuid.uuid4().hex}"
    bundles.save({n: QUERIES[q](spark, d).filter(_PART.get(n, "true")) for n, q in _TABLES.items()}, folder)
    return bundles.summary(spark, folder).select("table", "rows", "rows_read", "files_wrong")
