"""Queries of the comparison chain and the registry, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import auth
from mosaiq.functions import scalars as S
from mosaiq.operators import chain, evaluation, models, segments, stream_records
from mosaiq.plans import oracle_parts as O
from mosaiq.plans.catalog import _HMAC, _RECORDS, _SEGDEC_SQL, BITS, _digests, _distances, _loso, _pairs, _registry, _structural, query, r6
from mosaiq.sources import adapters as A

STREAMS = {k: BITS[k] for k in ("resnet", "temporal")}

# The test recordings start late by 2 ms in odd segments of every fourth recording.
_CS = """, cs AS (SELECT source_id, video_id, video_no, transformation, segment_id, segment_id*5000000::BIGINT + CASE WHEN video_no%4=3 AND segment_id%2=1 THEN 2000 ELSE 0 END AS start_us, row_number() OVER (PARTITION BY source_id, video_id ORDER BY segment_id)-1 AS place FROM sv),
 ca AS (SELECT coalesce(r.source_id,q.source_id) source_id, coalesce(r.video_id,q.video_id) video_id, coalesce(r.segment_id,q.segment_id) segment_id, r.place::INT ref_place, q.place::INT query_place, r.start_us, r.start_us+5000000 AS end_us, q.start_us-r.start_us AS delta,
 CASE WHEN q.video_id IS NULL THEN 'missing_in_query' WHEN r.video_id IS NULL THEN 'extra_in_query' WHEN abs(q.start_us-r.start_us)<=1000 THEN 'matched' ELSE 'timestamp_mismatch' END AS state
 FROM (SELECT v.source_id, v.video_id, s.segment_id, s.start_us, s.place FROM (SELECT DISTINCT source_id, video_id FROM cs) v JOIN cs s ON s.source_id=v.source_id AND s.video_no=0) r FULL JOIN cs q ON q.source_id=r.source_id AND q.video_id=r.video_id AND q.segment_id=r.segment_id)"""
_CM = _CS + """, cm AS (SELECT ca.*, CASE WHEN state='matched' THEN dr END AS r, CASE WHEN state='matched' THEN dt END AS t, CASE WHEN state='matched' THEN bal END AS score, CASE WHEN state='matched' THEN round(dr*40)+round(dt*24) END AS raw,
 CASE WHEN state<>'matched' THEN NULL WHEN abs(dr)<=1e-9 AND abs(dt)<=1e-9 THEN 'no_difference' WHEN dr-dt>1e-9 THEN 'resnet_dominant' WHEN dr-dt<-1e-9 THEN 'temporal_dominant' ELSE 'approximately_equal' END AS attribution FROM ca LEFT JOIN dd USING (source_id, video_id, segment_id))"""
_RG = """, rgv AS (SELECT DISTINCT source_id, video_id, transformation||'.mp4' AS filename, source_id||'_V0' AS reference_video_id, 'trusted_reference.mp4' AS reference_filename, transformation, CASE WHEN video_no=0 THEN 'reference' WHEN video_no<=4 THEN 'benign' ELSE 'tampered' END AS category, expected, video_no FROM sv)"""


def _chain(spark, d):
    late = F.when((F.col("video_no") % 4 == 3) & (F.col("segment_id") % 2 == 1), 2000).otherwise(0)
    coded = _digests(spark, d).withColumn("start_us", F.col("segment_id").cast("bigint") * 5_000_000 + late)
    coded = coded.withColumn("end_us", F.col("start_us") + 5_000_000)
    return chain.compare(coded.filter("video_no = 0"), coded, ["source_id"], "video_id", STREAMS)


def _recordings(spark, d):
    v = A.seg_vectors(spark, d).select("source_id", "video_id", "video_no", "transformation", "category", "expected").distinct()
    return v.select("*", F.concat("transformation", F.lit(".mp4")).alias("filename"), F.concat("source_id", F.lit("_V0")).alias("reference_video_id"), F.lit("trusted_reference.mp4").alias("reference_filename"))


@query("WITH " + O.DIST + _CM + """ SELECT video_id, segment_id, state, ref_place, query_place, start_us, end_us, delta AS start_delta_us, round(r*40)::INT AS resnet_raw, round(t*24)::INT AS temporal_raw, raw::INT AS hybrid_raw, round(r,6) AS resnet_distance, round(t,6) AS temporal_distance, round(raw/64.0::DOUBLE,6) AS hybrid_distance,
 round(score,6) AS score, attribution, (list_position(['no_difference','resnet_dominant','temporal_dominant','approximately_equal'], attribution)-1)::INT AS attribution_code FROM cm""")
def comparison_chain(spark, d):
    """Alignment, distances, scores and attributions of every recording against its reference."""
    c = _chain(spark, d)
    return c.select("video_id", "segment_id", "state", "ref_place", "query_place", "start_us", "end_us", "start_delta_us", "resnet_raw", "temporal_raw", "hybrid_raw", *(r6(f"{s}_distance").alias(f"{s}_distance") for s in ("resnet", "temporal", "hybrid")), r6("score").alias("score"), "attribution", "attribution_code")


@query("WITH " + O.DIST + _CM + """, wm AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC NULLS LAST, segment_id) rn, row_number() OVER (PARTITION BY video_id ORDER BY r DESC NULLS LAST, segment_id) rr, row_number() OVER (PARTITION BY video_id ORDER BY t DESC NULLS LAST, segment_id) rt FROM cm)
 SELECT video_id, round(avg(r),6) mean_resnet, round(max(r),6) max_resnet, round(avg(t),6) mean_temporal, round(max(t),6) max_temporal, round(avg(raw/64.0::DOUBLE),6) mean_hybrid, round(max(raw/64.0::DOUBLE),6) max_hybrid, round(avg(score),6) mean_score, round(max(score),6) max_score,
 max(segment_id) FILTER (rr=1 AND r IS NOT NULL)::INT segment_of_max_resnet, max(segment_id) FILTER (rt=1 AND t IS NOT NULL)::INT segment_of_max_temporal, max(segment_id) FILTER (rn=1 AND score IS NOT NULL)::INT segment_of_max_score,
 count(*) FILTER (attribution='no_difference')::BIGINT no_difference, count(*) FILTER (attribution='resnet_dominant')::BIGINT resnet_dominant, count(*) FILTER (attribution='temporal_dominant')::BIGINT temporal_dominant, count(*) FILTER (attribution='approximately_equal')::BIGINT approximately_equal FROM wm GROUP BY 1""")
def comparison_summary(spark, d):
    s = chain.summary(_chain(spark, d), ["video_id"], list(STREAMS))
    return s.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


_COLS = "rgv.source_id, rgv.video_id, filename, reference_video_id, reference_filename, transformation, category, expected"


@query("WITH " + O.DIST + _CM + _RG + f", sx AS (SELECT video_id, count(*) FILTER (state<>'matched')>0 AS structural FROM cm GROUP BY 1) SELECT {_COLS}, segment_id, round(score,6) AS score, structural FROM rgv JOIN cm ON cm.video_id=rgv.video_id JOIN sx ON sx.video_id=rgv.video_id WHERE state='matched'")
def comparison_segments(spark, d):
    """Matched segments with the registry's columns and the recording's structural flag."""
    c = _chain(spark, d)
    flags = chain.structure(c, ["video_id"]).select("video_id", "structural")
    rows = chain.with_registry(c.filter("state = 'matched'"), _recordings(spark, d)).join(flags, "video_id")
    return rows.select(*chain.REGISTRY, "segment_id", r6("score").alias("score"), "structural")


@query("WITH " + O.SV + _CS + _RG + f" SELECT {_COLS}, segment_id, state, ref_place, query_place, delta AS start_delta_us, delta AS end_delta_us FROM rgv JOIN ca ON ca.video_id=rgv.video_id")
def alignment_registry(spark, d):
    return chain.with_registry(_chain(spark, d), _recordings(spark, d)).select(*chain.REGISTRY, "segment_id", "state", "ref_place", "query_place", "start_delta_us", "end_delta_us")


@query("WITH " + O.SV + _CS + _RG + " SELECT rgv.source_id, transformation, count(*)::BIGINT AS findings FROM rgv JOIN ca ON ca.video_id=rgv.video_id WHERE transformation IN ('frame_deletion','frame_insertion') AND state<>'matched' GROUP BY 1,2")
def structural_by_source(spark, d):
    return chain.structural_by_source(chain.with_registry(_chain(spark, d), _recordings(spark, d)), ["frame_deletion", "frame_insertion"])


# Test properties of the stored digests: those of some recordings come from another quantization, or have no valid reference.
_BAD = "video_no=7 AND substr(source_id,5)::INT%2=1"


def _gated(spark, d):
    rec = _recordings(spark, d)
    number = F.substring("source_id", 5, 9).cast("int")
    base = {"normalization_id": F.lit("N0"), "bits": F.lit(64), "boundaries": F.lit("0:40:64"), "bit_order": F.lit("big")}
    queries = rec.select("*", F.when((F.col("video_no") == 7) & (number % 2 == 1), "Q1").otherwise("Q0").alias("quantization_id"), *(c.alias(n) for n, c in base.items()))
    refs = rec.filter("category = 'reference'").select("source_id", (number % 5 != 4).alias("valid"), F.lit("Q0").alias("quantization_id"), *(c.alias(n) for n, c in base.items()))
    return chain.gate(queries, refs, ["source_id"])


@query("WITH " + O.SV + _RG + f" SELECT video_id, CASE WHEN substr(source_id,5)::INT%5=4 THEN 'reference record does not verify' WHEN {_BAD} THEN 'quantization differs from the reference' END AS reason FROM rgv")
def comparison_gate(spark, d):
    return _gated(spark, d).select("video_id", "reason")


@query("WITH " + _SEGDEC_SQL + _RG + f""", gl AS (SELECT * FROM sl WHERE NOT ({_BAD} OR substr(source_id,5)::INT%5=4)),
 pc AS (SELECT video_id, string_agg(segment_id::VARCHAR, ',' ORDER BY segment_id) FILTER (abnormal) AS segs, count(*) FILTER (abnormal) AS na, max(dr) mr, max(dt) mt, max(bal) ms FROM gl GROUP BY 1),
 ac AS (SELECT video_id, attribution, count(*) n FROM gl WHERE abnormal GROUP BY 1,2), fi AS (SELECT video_id, missing_segments+extra_segments AS f FROM st),
 a2 AS (SELECT video_id, attribution, n FROM ac WHERE attribution<>'structural' UNION ALL SELECT video_id, 'structural', greatest(coalesce(n,0), f) FROM fi LEFT JOIN (SELECT * FROM ac WHERE attribution='structural') USING (video_id)),
 am AS (SELECT video_id, attribution FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, attribution) rn FROM a2 WHERE n>0) WHERE rn=1), ns AS (SELECT count(DISTINCT source_id)-1 AS k FROM sv),
 ob AS (SELECT rgv.*, coalesce(f,0) AS f, segs, mr, mt, ms, CASE WHEN pc.video_id IS NULL THEN 'failed' WHEN na>0 OR f>0 THEN 'abnormal' ELSE 'normal' END AS observed FROM rgv LEFT JOIN pc USING (video_id) LEFT JOIN fi USING (video_id))
 SELECT source_id, video_id, k::BIGINT AS training_sources, CASE WHEN k<3 THEN 'insufficient_sources' ELSE 'ok' END AS fold_status, expected, observed, expected=observed AS correct, coalesce(segs,'') AS abnormal_segments, f::BIGINT AS findings, round(mr,6) AS max_resnet, round(mt,6) AS max_temporal, round(ms,6) AS max_score, CASE WHEN observed='failed' THEN 'none' ELSE coalesce(attribution,'none') END AS main_attribution FROM ob LEFT JOIN am USING (video_id), ns""")
def loso_video_predictions(spark, d):
    """A prediction for every registered recording under its source's fold; what the gate refuses is `failed`."""
    rows, limits = _loso(spark, d)
    wide = limits.groupBy("held_out").agg(*(F.max(F.when(F.col("stream") == s, F.col("threshold"))).alias(f"t_{s}") for s in ("resnet", "temporal", "balanced"))).withColumnRenamed("held_out", "source_id")
    allowed = _gated(spark, d).filter("reason is null").select("video_id")
    issues = _structural(spark, d).withColumn("findings", F.col("missing_segments") + F.col("extra_segments"))
    found = rows.withColumnRenamed("balanced", "score").join(allowed, "video_id", "left_semi").join(wide, "source_id").join(issues.select("video_id", "structural"), "video_id")
    decided = chain.segment_attribution(found, {s: F.col(f"t_{s}") for s in ("resnet", "temporal", "balanced")})
    rec = _recordings(spark, d)
    p = chain.predictions(rec, decided, issues).join(chain.fold_status(rec.select("source_id").distinct()), "source_id")
    return p.select("source_id", "video_id", "training_sources", "fold_status", "expected", "observed", "correct", F.array_join("abnormal_segments", ",").alias("abnormal_segments"), "findings", *(r6(c).alias(c) for c in ("max_resnet", "max_temporal", "max_score")), "main_attribution")


_FIVE = ["source_id", "video_id", "filename", "transformation", "expected"]
_SUMMARY_SQL = ", vs AS (SELECT video_id, round(max(bal),6) AS score, count(*)::BIGINT AS segments FROM dd GROUP BY 1)"


def _video_scores(spark, d):
    per = _distances(spark, d).groupBy("video_id").agg(r6(F.max("balanced")).alias("score"), F.count(F.lit(1)).alias("segments"))
    return _recordings(spark, d).join(per, "video_id")


@query("WITH " + O.DIST + _SUMMARY_SQL + _RG + " SELECT rgv.source_id, rgv.video_id, filename, transformation, expected, length(rgv.video_id)::INT AS score, vs.score AS score_summary, segments FROM rgv LEFT JOIN vs ON vs.video_id=rgv.video_id AND expected='normal'")
def predictions_with_summary(spark, d):
    """Predictions beside the summary by five keys; columns of both get a suffix. The summary has the normal recordings only."""
    rec = _recordings(spark, d)
    left = rec.select(*_FIVE, F.length("video_id").alias("score"))
    return chain.suffixed_join(left, _video_scores(spark, d).filter("expected = 'normal'").select(*_FIVE, "score", "segments"), _FIVE)


@query("WITH " + O.DIST + _SUMMARY_SQL + _RG + " SELECT rgv.video_id, category, category AS category_summary, vs.score FROM rgv JOIN vs USING (video_id)")
def inventory_with_summary(spark, d):
    return chain.suffixed_join(_recordings(spark, d).select("video_id", "category"), _video_scores(spark, d).select("video_id", "category", "score"), ["video_id"], "inner")


@query("WITH " + O.CODE + ", dg AS (SELECT source_id, CASE WHEN pos<=40 THEN 'resnet' WHEN pos<=52 THEN 'temporal' ELSE 'spatial' END AS stream, bit_count(c) AS ones, CASE WHEN pos<=40 THEN 1 ELSE 2 END AS n FROM code), dh AS (SELECT * FROM dg UNION ALL SELECT source_id, 'hybrid', ones, n FROM dg) SELECT source_id, stream, sum(ones)::BIGINT AS ones, sum(n-ones)::BIGINT AS zeros, round(sum(ones)/sum(n)::DOUBLE,6) AS one_ratio FROM dh GROUP BY 1,2")
def digest_summary(spark, d):
    return models.digest_summary(_digests(spark, d), ["source_id"]).withColumn("one_ratio", r6("one_ratio"))


# --- wide aggregates -------------------------------------------------------------------------------------------------


def _wide_sql(first: int, names, statistics: dict[str, str]) -> str:
    cells = ", ".join(f"round({f.format(v=f'(v::DOUBLE) FILTER (pos={first + i})', p=f'FILTER (pos={first + i})')},6) AS {s}_{n}" for s, f in statistics.items() for i, n in enumerate(names))
    return f"WITH {O.LV} SELECT video_id, {cells} FROM lv GROUP BY 1"


def _columns(spark, d, vector: str, names):
    return A.seg_vectors(spark, d).select("video_id", *(F.col(vector)[i].cast("double").alias(n) for i, n in enumerate(names)))


def _rounded(df):
    return df.select("video_id", *(r6(c).alias(c) for c in df.columns if c != "video_id"))


@query(_wide_sql(41, segments.PAIR_FEATURES, {"mean": "avg{v}", "std": "stddev_pop{v}", "max": "max{v}"}))
def temporal_vector(spark, d):
    return _rounded(segments.temporal_vector(_columns(spark, d, "temporal", segments.PAIR_FEATURES), ["video_id"]))


@query(_wide_sql(53, segments.SHARPNESS_FEATURES, {"mean": "avg{v}", "standard_deviation": "stddev_pop{v}", "minimum": "min{v}", "p10": "quantile_cont(v::DOUBLE,0.1) {p}", "median": "median{v}"}))
def sharpness_vector(spark, d):
    return _rounded(segments.sharpness_vector(_columns(spark, d, "spatial", segments.SHARPNESS_FEATURES), ["video_id"]))


@query("WITH " + O.PAIRS + " SELECT video_id, segment_id, 4::BIGINT AS expected_pairs, count(*) FILTER (ok)::BIGINT AS successful_pairs, count(*) FILTER (NOT ok)::BIGINT AS failed_pairs, greatest(4-count(*) FILTER (ok),0)::BIGINT AS missing_pairs FROM pr GROUP BY 1,2")
def pair_counts(spark, d):
    return segments.pair_counts(_pairs(spark, d), F.lit(4))


# --- registry --------------------------------------------------------------------------------------------------------

_KINDS = "CASE WHEN t1='unsupported_video' THEN 'unsupported' WHEN t1='ambiguous' THEN 'ambiguous' WHEN t1 IN ('avi_conversion','mov_conversion','resize_480p','resize_720p') THEN 'benign' ELSE 'tampered' END"
_EXPECTED = [*S.BENIGN, *S.TAMPERED]


def _kinds(spark, d):
    t = F.when(F.col("filename") == "original.mp4", "trusted_reference").otherwise(F.col("t1"))
    category = F.when(t == "trusted_reference", "reference").when(t == "unsupported_video", "unsupported").when(t == "ambiguous", "ambiguous").when(t.isin(*S.BENIGN), "benign").otherwise("tampered")
    return _registry(spark, d).select("source_id", "video_id", "sha256", t.alias("transformation"), category.alias("category"))


_KV = "WITH " + O.REG + ", " + O.HITS + f", kv AS (SELECT source_id, video_id, sha256, CASE WHEN filename='original.mp4' THEN 'trusted_reference' ELSE t1 END AS transformation, CASE WHEN filename='original.mp4' THEN 'reference' ELSE {_KINDS} END AS category FROM cl)"
_EXPECTED_SQL = "[" + ",".join(f"'{t}'" for t in _EXPECTED) + "]"


@query(_KV + f""", kn AS (SELECT source_id, category, transformation, count(*) n FROM kv GROUP BY 1,2,3), ks AS (SELECT source_id, coalesce(list_sort(list(transformation) FILTER (category='benign')),[]) b, coalesce(list_sort(list(transformation) FILTER (category='tampered')),[]) t, list(transformation) al,
 coalesce(list_sort(list(transformation) FILTER (n>1 AND list_contains({_EXPECTED_SQL}, transformation))),[]) du, coalesce(sum(n) FILTER (transformation='ambiguous'),0)::BIGINT am, coalesce(sum(n) FILTER (category='reference'),0) rf FROM kn GROUP BY 1)
 SELECT source_id, CASE WHEN rf=1 THEN 'valid' ELSE 'blocked' END AS status, array_to_string(b,',') AS benign, array_to_string(t,',') AS tampered, array_to_string(list_sort(list_filter({_EXPECTED_SQL}, lambda e: NOT list_contains(al, e))),',') AS missing, array_to_string(du,',') AS duplicated, am AS ambiguous_files FROM ks""")
def source_type_lists(spark, d):
    return chain.source_lists(_kinds(spark, d), _EXPECTED).select("source_id", "status", *(F.array_join(c, ",").alias(c) for c in ("benign", "tampered", "missing", "duplicated")), "ambiguous_files")


@query(_KV + ", o AS (SELECT source_id, sha256, count(*)-1 c, min(video_id) f FROM kv GROUP BY 1,2), r AS (SELECT sha256, count(*)-1 c FROM kv WHERE category='reference' GROUP BY 1) SELECT kv.source_id, video_id, o.c::BIGINT AS copies_in_source, o.f AS first_in_source, (CASE WHEN category='reference' THEN r.c ELSE 0 END)::BIGINT AS equal_references FROM kv JOIN o USING (source_id, sha256) LEFT JOIN r USING (sha256)")
def byte_copies(spark, d):
    return chain.byte_copies(_kinds(spark, d))


_STREAM_PAYLOAD = _RECORDS + """, sp AS (SELECT source_id, video_id, '{"bit_order":"big","continuous_dimensions":{"combined":64,"resnet":40,"spatial":12,"temporal":12},"development_only":false,"digest_lengths":{"hybrid":88,"resnet":40,"spatial":24,"temporal":24},"normalization_id":"'||source_id||'-n","pipeline_id":"streams","quantization_id":"'||source_id||'-q","schema_version":2,"segment_count":'||count(*)||',"segments":['||
 string_agg('{"end_time_microseconds":'||(segment_id+1)*5000000::BIGINT||',"hybrid_packed_digest_hex":"'||h||'","resnet_packed_digest_hex":"'||substr(h,1,10)||'","segment_id":'||segment_id||',"spatial_packed_digest_hex":"'||substr(h,17,6)||'","start_time_microseconds":'||segment_id*5000000::BIGINT||',"temporal_packed_digest_hex":"'||substr(h,11,6)||'"}', ',' ORDER BY segment_id)||
 '],"source_video_sha256":"'||sha256(video_id)||'","stream_boundaries":{"resnet":{"end_exclusive":40,"start":0},"spatial":{"end_exclusive":88,"start":64},"temporal":{"end_exclusive":64,"start":40}},"video_id":"'||video_id||'"}' AS payload FROM px GROUP BY 1,2)"""
_STREAM_TOLD = f'"created_at":"2024-01-01T00:00:00+00:00","hmac_schema":"{stream_records.SCHEMA_TEXT}","key_fingerprint":"{auth.key_fingerprint(auth.demonstration_key())}","key_id":"demonstration","key_length_bytes":32,"key_source_type":"demonstration","record_schema_version":2'
_STREAM_RECORD = _STREAM_PAYLOAD + """, sr AS (SELECT source_id, video_id, '{"authentication":{"algorithm":"HMAC-SHA-256","canonical_payload_sha256":"'||sha256(payload)||'",""" + _STREAM_TOLD + ""","tag_hex":"'||""" + _HMAC.format(p="payload") + """||'"},"payload":'||payload||'}' AS record FROM sp)"""


@query(_STREAM_RECORD + " SELECT * FROM sr")
def stream_record_texts(spark, d):
    """Records of three streams, one JSON text a recording, with the public demonstration key and a fixed time."""
    coded = _digests(spark, d).withColumn("start_s", F.col("segment_id") * 5.0).withColumn("end_s", F.col("segment_id") * 5.0 + 5.0)
    streams = {s: f"{s}_bits" for s in ("resnet", "temporal", "spatial")}
    made = stream_records.payloads(coded, streams, {"resnet": 40, "temporal": 12, "spatial": 12}, {"temporal": 2, "spatial": 2}, "streams", F.concat("source_id", F.lit("-n")), F.concat("source_id", F.lit("-q")), F.sha2("video_id", 256))
    key = auth.demonstration_key()
    return stream_records.build(made, "demonstration", auth.key_fingerprint(key), "demonstration", len(key), auth.DEMONSTRATION, created_at=F.lit("2024-01-01T00:00:00+00:00")).select("source_id", "video_id", "record")


# What is changed in the records of a case, and the reason that the check must give.
_STREAM_SPOIL = {
    1: ('"development_only":false', '"development_only":true', "payload checksum mismatch; HMAC tag mismatch"),
    2: ('"record_schema_version":2', '"record_schema_version":1', "schema mismatch"),
    3: ('"algorithm":"HMAC-SHA-256"', '"algorithm":"none"', "unsupported algorithm; HMAC tag mismatch"),
    4: ('"key_fingerprint":"', '"key_fingerprint":"0', "key fingerprint mismatch"),
    5: ('"tag_hex":"', '"tag_hex":"z', "HMAC tag mismatch"),
    6: ('"authentication":', '"other":', stream_records.NO_OBJECTS),
}
_STREAM_REASON = " ".join(f"WHEN {n} THEN '{r}'" for n, (_, _, r) in _STREAM_SPOIL.items())


@query(_STREAM_RECORD + f""", k AS (SELECT source_id, video_id, (('0x'||substr(sha256(video_id),1,8))::BIGINT%7)::INT AS "case" FROM sr)
 SELECT source_id, video_id, "case", "case" NOT IN (2,6) AS schema_valid, "case" NOT IN (3,6) AS algorithm_supported, "case" NOT IN (1,6) AS payload_checksum_valid, "case" NOT IN (4,6) AS key_fingerprint_match, "case" NOT IN (1,3,5,6) AS hmac_valid, "case"=0 AS record_valid, CASE "case" {_STREAM_REASON} END AS failure_reason FROM k""")
def stream_record_checks(spark, d):
    """Checks of three-stream records of which six of seven are changed in one place each."""
    rows = stream_record_texts(spark, d).withColumn("case", (F.conv(F.substring(F.sha2("video_id", 256), 1, 8), 16, 10).cast("bigint") % 7).cast("int"))
    changed = F.col("record")
    for case, (old, new, _) in _STREAM_SPOIL.items():
        changed = F.when(F.col("case") == case, F.replace("record", F.lit(old), F.lit(new))).otherwise(changed)
    checked = stream_records.verify(rows.withColumn("record", changed), auth.key_fingerprint(auth.demonstration_key()), auth.DEMONSTRATION)
    return checked.select("source_id", "video_id", "case", *stream_records.FLAGS, "record_valid", "failure_reason")


# Texts below 300 characters are too short to judge here: their predictions failed.
_JUDGED = "WITH " + O.PRED + """, jd AS (SELECT pd.* EXCLUDE (observed), CASE WHEN n_chars<300 THEN 'failed' ELSE observed END AS observed FROM pd JOIN documents ON doc_id=video_id)"""
_CELLS = "count(*) FILTER (expected='abnormal' AND observed='abnormal') AS tp, count(*) FILTER (expected='normal' AND observed='normal') AS tn, count(*) FILTER (expected='normal' AND observed='abnormal') AS fp, count(*) FILTER (expected='abnormal' AND observed='normal') AS fn, count(*) FILTER (observed='failed') AS failed"


def _judged(spark, d):
    sizes = A.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "n_chars")
    return A.predictions(spark, d).join(sizes, "video_id").withColumn("observed", F.when(F.col("n_chars") < 300, "failed").otherwise(F.col("observed")))


@query(_JUDGED + f", cn AS (SELECT source_id, {_CELLS} FROM jd GROUP BY 1), mt AS (" + O.metrics("cn", "source_id", True) + ") SELECT source_id, mt.tp, mt.tn, mt.fp, mt.fn, cn.failed, cn.tp+cn.tn+cn.fp+cn.fn AS evaluated, " + ", ".join(f"round({m}::DOUBLE,6) AS {m}" for m in O.METRIC_NAMES) + " FROM mt JOIN cn USING (source_id)")
def metrics_with_failed(spark, d):
    """Metrics of each source in which failed predictions are counted and in no denominator."""
    found = evaluation.metrics(evaluation.counts_with_failed(_judged(spark, d), ["source_id"]), zero=True)
    return found.select("source_id", "tp", "tn", "fp", "fn", "failed", "evaluated", *(r6(m).alias(m) for m in O.METRIC_NAMES))


@query(_JUDGED + f", l AS (SELECT unnest(['de','en','fr','zz']) AS transformation), cn AS (SELECT transformation, {_CELLS} FROM jd GROUP BY 1) SELECT transformation, " + ", ".join(f"coalesce({c},0)::BIGINT AS {c}" for c in ("tp", "tn", "fp", "fn", "failed")) + ", coalesce(tp+tn+fp+fn,0)::BIGINT AS evaluated FROM l LEFT JOIN cn USING (transformation)")
def listed_label_counts(spark, d):
    """Counts of each label of a list, one of which no row has."""
    return evaluation.counts_by_label(_judged(spark, d), "transformation", ["en", "fr", "de", "zz"]).select("transformation", "tp", "tn", "fp", "fn", "failed", "evaluated")
