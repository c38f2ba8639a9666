"""The query catalogue: every operator over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaiq.functions import auth
from mosaiq.functions import scalars as S
from mosaiq.functions import vectors as V
from mosaiq.operators import compare, evaluation, identity, models, nested, order_stats, records, reports, segments, stages, validation
from mosaiq.plans import oracle_parts as O
from mosaiq.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BITS = {"resnet": A.RESNET, "temporal": 2 * A.TEMPORAL, "spatial": 2 * A.SPATIAL}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- segment vectors -------------------------------------------------------------------------------------------------


def _model(spark, d):
    rows = A.seg_vectors(spark, d)
    cal = rows.filter("video_no <= 4")
    return rows, models.fit(cal.select(models.all_streams(cal).alias("v")), F.col("v"), [])


def _scaled(spark, d):
    rows, m = _model(spark, d)
    return models.scaled(models.with_model(rows, m, []))


def _digests(spark, d):
    return models.digests(_scaled(spark, d), A.RESNET, A.TEMPORAL, A.SPATIAL)


def _distances(spark, d):
    coded = _digests(spark, d).withColumn("spatial_values", F.col("spatial"))
    found = compare.distances(coded, ["source_id"], BITS, "spatial_values")
    return found.withColumn("balanced", V.balanced_score(F.col("resnet_distance"), F.col("temporal_distance")))


def _structural(spark, d):
    return compare.structural_issues(A.seg_vectors(spark, d), ["source_id"])


@query("""WITH lv AS (SELECT vec_id, label, unnest(embedding) v, generate_subscripts(embedding,1) pos FROM embeddings), f AS (SELECT pos, quantile_cont(v::DOUBLE,0.5) med, greatest(quantile_cont(v::DOUBLE,0.75)-quantile_cont(v::DOUBLE,0.25),1e-8) sc FROM lv GROUP BY 1),
 b AS (SELECT vec_id, label, pos, (((v::DOUBLE-med)/sc)::FLOAT>=0::FLOAT)::INT bit FROM lv JOIN f USING (pos)), r AS (SELECT label, min(vec_id) rid FROM embeddings GROUP BY 1),
 h AS (SELECT q.vec_id, q.label, sum(abs(q.bit-z.bit)) dist FROM b q JOIN r USING (label) JOIN b z ON z.vec_id=r.rid AND z.pos=q.pos GROUP BY 1,2)
 SELECT label, count(*)::BIGINT n, min(dist)::INT min_distance, max(dist)::INT max_distance, round(avg(dist/64.0::DOUBLE),6) mean_distance FROM h GROUP BY 1""")
def digest_distance_by_source(spark, d):
    """Distance of every vector's sign digest to its label's first vector, by label."""
    e = A.table(spark, d, "embeddings")
    m = models.fit(e, F.col("embedding"), [])
    bits = e.crossJoin(m).select("vec_id", "label", V.words(V.binary_bits(V.robust_scale(F.col("embedding"), F.col("median"), F.col("scale")))).alias("w"))
    first = bits.groupBy("label").agg(F.min_by("w", "vec_id").alias("first"))
    h = bits.join(first, "label").withColumn("dist", V.hamming(F.col("w"), F.col("first")))
    return h.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("min_distance"), F.max("dist").alias("max_distance"), r6(F.avg(F.col("dist") / 64.0)).alias("mean_distance"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),5) AS norm, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)))/greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),1e-12),5) AS unit_norm FROM embeddings")
def l2_norms(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.l2_norm(F.col("embedding")), 5).alias("norm"), F.round(V.l2_norm(V.l2_normalize(F.col("embedding"))), 5).alias("unit_norm"))


@query("WITH " + O.LV + " SELECT source_id, video_no, (pos-1)::INT AS pos, round(avg(v::DOUBLE)::FLOAT::DOUBLE,4) AS mean, round(stddev_pop(v::DOUBLE)::FLOAT::DOUBLE,4) AS std FROM lv WHERE pos<=40 GROUP BY 1,2,3")
def segment_mean_std(spark, d):
    stats = segments.vector_mean_std(A.seg_vectors(spark, d), "resnet", ["source_id", "video_no"])
    return stats.select("source_id", "video_no", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "s")).select("source_id", "video_no", "pos", F.round(F.col("s.mean").cast("double"), 4).alias("mean"), F.round(F.col("s.std").cast("double"), 4).alias("std"))


@query("WITH " + O.FIT + " SELECT (pos-1)::INT AS pos, round(q1,6) q1, round(med,6) median, round(q3,6) q3, round(safe,6) AS scale, (q3-q1)<=1e-8 AS zero_iqr, n::BIGINT AS fitted_rows FROM m")
def robust_fit(spark, d):
    _, m = _model(spark, d)
    return m.select("fitted_rows", F.posexplode(F.arrays_zip("q1", "median", "q3", "scale", "zero_iqr")).alias("pos", "s")).select("pos", r6("s.q1").alias("q1"), r6("s.median").alias("median"), r6("s.q3").alias("q3"), r6("s.scale").alias("scale"), "s.zero_iqr", "fitted_rows")


@query("WITH " + O.FIT + " SELECT source_id, count(*)::BIGINT AS n, round(min(x)::DOUBLE,6) AS least, round(max(x)::DOUBLE,6) AS largest, bool_and(isfinite(x)) AS finite FROM nx GROUP BY 1")
def robust_transform_stats(spark, d):
    return _scaled(spark, d).groupBy("source_id").agg(F.sum(F.size("x")).alias("n"), r6(F.min(F.array_min("x")).cast("double")).alias("least"), r6(F.max(F.array_max("x")).cast("double")).alias("largest"), F.bool_and(V.is_finite(F.col("x"))).alias("finite"))


@query("WITH " + O.FIT + " SELECT source_id, count(*) FILTER (x<=(-5.0+1e-6)::FLOAT)::BIGINT AS low, count(*) FILTER (x>=(5.0-1e-6)::FLOAT)::BIGINT AS high, count(*)::BIGINT AS n, round(100.0::DOUBLE*count(*) FILTER (x<=(-5.0+1e-6)::FLOAT OR x>=(5.0-1e-6)::FLOAT)/count(*),6) AS percent FROM nx GROUP BY 1")
def clipping_stats(spark, d):
    return models.clipping(_scaled(spark, d), ["source_id"]).withColumn("percent", r6("percent"))


@query("WITH " + O.CODE + " SELECT source_id, sum(c)::BIGINT ones, sum(1-c)::BIGINT zeros, round(avg(c::DOUBLE),6) one_ratio FROM code WHERE pos<=40 GROUP BY 1")
def binary_bits_stats(spark, d):
    return models.bit_statistics(_digests(spark, d), "resnet_bits", ["source_id"]).withColumn("one_ratio", r6("one_ratio"))


def _count_of(k: int):
    return lambda n, b: n + (b == k).cast("int")


@query("WITH " + O.CODE + ", g AS (SELECT DISTINCT source_id, t.k AS bin FROM code, (VALUES (0),(1),(2),(3)) t(k)) SELECT g.source_id, g.bin::INT AS bin, count(c.pos)::BIGINT AS n FROM g LEFT JOIN code c ON c.source_id=g.source_id AND c.pos>40 AND c.pos<=52 AND c.b=g.bin GROUP BY 1,2")
def quartile_bin_histogram(spark, d):
    part = lambda c: F.slice(c, A.RESNET + 1, A.TEMPORAL)
    bins = _scaled(spark, d).select("source_id", V.quartile_bins(part("x"), part("low"), part("high")).alias("bins"))
    counted = bins.groupBy("source_id").agg(*(F.sum(F.aggregate("bins", F.lit(0), _count_of(k))).alias(str(k)) for k in range(4)))
    return counted.unpivot("source_id", ["0", "1", "2", "3"], "bin", "n").withColumn("bin", F.col("bin").cast("int"))


@query("WITH " + O.CODE + " SELECT video_id, segment_id, string_agg((c>>1)::VARCHAR||(c&1)::VARCHAR, '' ORDER BY pos) AS temporal_bits FROM code WHERE pos>40 AND pos<=52 GROUP BY 1,2")
def gray_bits(spark, d):
    return _digests(spark, d).select("video_id", "segment_id", F.array_join(F.transform("temporal_bits", lambda b: b.cast("string")), "").alias("temporal_bits"))


@query("WITH " + O.CODE + """, bits AS (SELECT video_id, segment_id, string_agg(CASE WHEN pos<=40 THEN c::VARCHAR ELSE (c>>1)::VARCHAR||(c&1)::VARCHAR END, '' ORDER BY pos) AS s FROM code GROUP BY 1,2)
 SELECT video_id, segment_id, string_agg(printf('%02x', list_reduce([substr(s, i*8+j, 1)::INT FOR j IN range(1,9)], lambda a, b: a*2+b)), '' ORDER BY i) AS packed_hex, 11::INT AS n_bytes, 0::INT AS pad, TRUE AS round_trip FROM bits, (SELECT unnest(range(0,11)) AS i) GROUP BY 1,2""")
def packed_hex(spark, d):
    coded = _digests(spark, d).select("video_id", "segment_id", F.concat("resnet_bits", "temporal_bits", "spatial_bits").alias("bits"))
    packed = coded.withColumn("packed", V.pack_bits(F.col("bits")))
    return packed.select("video_id", "segment_id", V.hex_text(F.col("packed")).alias("packed_hex"), F.octet_length("packed").alias("n_bytes"), V.pad_bits(F.col("bits")).alias("pad"), (V.unpack_bits(F.col("packed"), F.size("bits")) == F.col("bits")).alias("round_trip"))


@query("WITH " + O.DIST + " SELECT video_id, segment_id, round(dr*40)::BIGINT AS resnet_raw, round(dt*24)::BIGINT AS temporal_raw, round(ds*24)::BIGINT AS spatial_raw, hybrid_raw FROM dd")
def hamming_streams(spark, d):
    coded = _digests(spark, d)
    both = coded.withColumn("hybrid_bits", F.concat("resnet_bits", "temporal_bits", "spatial_bits"))
    found = compare.distances(both, ["source_id"], BITS | {"hybrid": sum(BITS.values())})
    return found.select("video_id", "segment_id", *(F.col(f"{s}_raw").cast("bigint").alias(f"{s}_raw") for s in (*BITS, "hybrid")))


@query("WITH " + O.DIST + " SELECT video_id, segment_id, w AS weight_no, round((wr*dr+wt*dt+ws*ds)/(wr+wt+ws),6) AS score FROM dd, (VALUES (0,0.4::DOUBLE,0.3::DOUBLE,0.3::DOUBLE),(1,0.3,0.2,0.5),(2,0.5,0.25,0.25)) g(w,wr,wt,ws)")
def v2_weighted_scores(spark, d):
    return nested.weighted(_distances(spark, d)).select("video_id", "segment_id", "weight_no", r6("score").alias("score"))


@query("WITH " + O.DIST + " SELECT video_id, segment_id, round(dr-dt,6) AS difference, CASE WHEN abs(dr)<=1e-9 AND abs(dt)<=1e-9 THEN 'no_difference' WHEN dr-dt>1e-9 THEN 'resnet_dominant' WHEN dr-dt<-1e-9 THEN 'temporal_dominant' ELSE 'approximately_equal' END AS attribution FROM dd")
def relative_attribution(spark, d):
    return _distances(spark, d).select("video_id", "segment_id", r6(F.col("resnet_distance") - F.col("temporal_distance")).alias("difference"), V.relative_attribution(F.col("resnet_distance"), F.col("temporal_distance")).alias("attribution"))


@query("WITH " + O.DIST + """, u AS (SELECT video_id, segment_id, unnest([dr,dt,ds,blur]) v, unnest(['resnet_dominant','temporal_dominant','spatial_quality_dominant','blur_loss_dominant']) n FROM dd),
 k AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY v DESC, n) rn, max(abs(v)) OVER (PARTITION BY video_id, segment_id) mx FROM u)
 SELECT video_id, segment_id, CASE WHEN max(mx)<=1e-9 THEN 'no_difference' WHEN max(v) FILTER (rn=1)-max(v) FILTER (rn=2)<=1e-9 THEN 'approximately_equal' ELSE max(n) FILTER (rn=1) END AS attribution FROM k GROUP BY 1,2""")
def v2_attribution(spark, d):
    rows = _distances(spark, d)
    return rows.select("video_id", "segment_id", V.dominant_stream(F.col("resnet_distance"), F.col("temporal_distance"), F.col("spatial_distance"), F.col("blur_loss")).alias("attribution"))


@query("WITH " + O.DIST + " SELECT video_id, segment_id, round(blur,5) AS blur_loss FROM dd")
def blur_loss(spark, d):
    return _distances(spark, d).select("video_id", "segment_id", F.round("blur_loss", 5).alias("blur_loss"))


@query("WITH " + O.DIST + ", k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY bal DESC, segment_id) rn FROM dd) SELECT video_id, count(*)::BIGINT AS segments, round(avg(bal),6) AS mean_value, round(max(bal),6) AS max_value, max(segment_id) FILTER (rn=1)::INT AS max_segment FROM k GROUP BY 1")
def video_summary(spark, d):
    return compare.video_summary(_distances(spark, d), "balanced", ["video_id"]).withColumn("mean_value", r6("mean_value")).withColumn("max_value", r6("max_value"))


_STREAM_SQL = """, u AS (SELECT *, unnest(['resnet','temporal','balanced']) AS stream, unnest([dr,dt,bal]) AS val, unnest([1.0/40,1.0/24,0.5/40+0.5/24]::DOUBLE[]) AS res FROM dd)"""
_BENIGN = "video_no BETWEEN 1 AND 4"


def _stream_values(rows: DataFrame) -> DataFrame:
    """Long form: one row a segment and stream with its value and one-bit resolution."""
    parts = F.array(*(F.struct(F.lit(n).alias("stream"), F.col(c).alias("val"), F.lit(x).alias("res")) for n, c, x in (("resnet", "resnet_distance", 1 / 40), ("temporal", "temporal_distance", 1 / 24), ("balanced", "balanced", 0.5 / 40 + 0.5 / 24))))
    return rows.select("source_id", "video_id", "video_no", "segment_id", F.explode(parts).alias("s")).select("source_id", "video_id", "video_no", "segment_id", "s.*")


def _stream_thresholds(rows: DataFrame, by: list[str]) -> DataFrame:
    """Robust thresholds by stream with the stream's own resolution, margin 3."""
    return evaluation.mad_threshold(rows, "val", [*by, "stream", "res"], 3.0, F.col("res"))


@query("WITH " + O.DIST + _STREAM_SQL + f", md AS (SELECT stream, median(val) md FROM u WHERE {_BENIGN} GROUP BY 1), mm AS (SELECT stream, max(val) mx, median(abs(val-md)) mad, max(res) res, count(*) n FROM u JOIN md USING (stream) WHERE {_BENIGN} GROUP BY 1) SELECT stream, round(mx,6) largest, round(mad,6) mad, n::BIGINT AS n, round(least(1,greatest(0,mx+greatest(3*mad,res))),6) AS threshold FROM mm")
def pooled_thresholds(spark, d):
    rows = _stream_values(_keep(spark)(_distances(spark, d))).filter("video_no between 1 and 4")
    return _stream_thresholds(rows, []).select("stream", r6("largest").alias("largest"), r6("mad").alias("mad"), "n", r6("threshold").alias("threshold"))


_LOSO_SQL = O.DIST + _STREAM_SQL + f""", fo AS (SELECT h.held_out, u.* FROM (SELECT DISTINCT source_id AS held_out FROM dd) h JOIN u ON u.source_id<>h.held_out AND {_BENIGN}),
 md AS (SELECT held_out, stream, median(val) md FROM fo GROUP BY 1,2), th AS (SELECT held_out, stream, least(1,greatest(0,max(val)+greatest(3*median(abs(val-md)),max(res)))) threshold, count(*) n FROM fo JOIN md USING (held_out, stream) GROUP BY 1,2)"""


def _loso(spark, d):
    """The distances, written once, and the thresholds of each fold and stream from the calibration rows of all other sources."""
    rows = _keep(spark)(_distances(spark, d))
    sources = sorted(r[0] for r in rows.select("source_id").distinct().collect())  # one a fold
    values = _stream_values(rows.filter("video_no between 1 and 4"))
    return rows, evaluation.fold_thresholds(values, "val", ["stream", "res"], 3.0, F.col("res"), groups=sources)


@query("WITH " + _LOSO_SQL + " SELECT 'LOSO_'||replace(held_out,'SRC_','') AS fold_id, stream, n::BIGINT AS n, round(threshold,6) threshold FROM th")
def loso_thresholds(spark, d):
    _, limits = _loso(spark, d)
    return limits.select(S.fold_id(F.col("held_out")).alias("fold_id"), "stream", "n", r6("threshold").alias("threshold"))


_SEGDEC_SQL = _LOSO_SQL + O.STRUCT + """, tw AS (SELECT held_out, max(threshold) FILTER (stream='resnet') tr, max(threshold) FILTER (stream='temporal') tt, max(threshold) FILTER (stream='balanced') tb FROM th GROUP BY 1),
 sd AS (SELECT dd.*, (st.missing_segments>0 OR st.extra_segments>0) AS structural, st.missing_segments+st.extra_segments AS findings, dr>tr AS o_r, dt>tt AS o_t, bal>tb AS o_b FROM dd JOIN tw ON tw.held_out=dd.source_id JOIN st USING (source_id, video_id)),
 sl AS (SELECT *, CASE WHEN structural THEN 'structural' WHEN o_r AND o_t THEN 'both_streams' WHEN o_r THEN 'resnet_only' WHEN o_t THEN 'temporal_only' WHEN o_b AND dr>=dt THEN 'resnet_only' WHEN o_b THEN 'temporal_only' ELSE 'none' END AS attribution, structural OR o_r OR o_t OR o_b AS abnormal FROM sd)"""


def _decisions(spark, d, structural: bool = True):
    rows, limits = _loso(spark, d)
    wide = limits.groupBy("held_out").pivot("stream", ["resnet", "temporal", "balanced"]).agg(F.first("threshold")).select(F.col("held_out").alias("source_id"), *(F.col(s).alias(f"t_{s}") for s in ("resnet", "temporal", "balanced")))
    found = rows.join(F.broadcast(wide), "source_id").join(_structural(spark, d), ["source_id", "video_id"])
    over = [F.col("resnet_distance") > F.col("t_resnet"), F.col("temporal_distance") > F.col("t_temporal"), F.col("balanced") > F.col("t_balanced")]
    label = evaluation.attribution(F.col("structural"), F.col("resnet_distance"), F.col("temporal_distance"), F.col("balanced"), *over)
    return found.withColumn("attribution", label).withColumn("abnormal", F.col("structural") | over[0] | over[1] | over[2]).withColumn("findings", F.col("missing_segments") + F.col("extra_segments"))


@query("WITH " + _SEGDEC_SQL + ", vd AS (SELECT source_id, video_id, transformation, expected, bool_or(abnormal) ab, round(max(dr),6) max_resnet, round(max(bal),6) max_balanced, count(*) FILTER (abnormal)::BIGINT AS abnormal_segments FROM sl GROUP BY ALL) SELECT source_id, video_id, transformation, expected, CASE WHEN ab THEN 'abnormal' ELSE 'normal' END observed, max_resnet, max_balanced, abnormal_segments, expected=(CASE WHEN ab THEN 'abnormal' ELSE 'normal' END) AS correct FROM vd")
def loso_predictions(spark, d):
    v = _decisions(spark, d).groupBy("source_id", "video_id", "transformation", "expected").agg(F.bool_or("abnormal").alias("ab"), r6(F.max("resnet_distance")).alias("max_resnet"), r6(F.max("balanced")).alias("max_balanced"), F.count_if("abnormal").alias("abnormal_segments"))
    return v.withColumn("observed", F.when(F.col("ab"), "abnormal").otherwise("normal")).withColumn("correct", F.col("expected") == F.col("observed")).drop("ab")


@query("WITH " + _SEGDEC_SQL + ", ac AS (SELECT video_id, attribution, count(*) n FROM sl WHERE abnormal GROUP BY 1,2), g AS (SELECT DISTINCT video_id, findings, unnest(['none','resnet_only','temporal_only','both_streams','structural']) AS attribution FROM sl) SELECT g.video_id, g.attribution, (CASE WHEN g.attribution='structural' THEN greatest(coalesce(n,0), max(findings) OVER (PARTITION BY g.video_id)) ELSE coalesce(n,0) END)::BIGINT AS segments FROM g LEFT JOIN ac ON ac.video_id=g.video_id AND ac.attribution=g.attribution")
def attribution_counts(spark, d):
    rows = _decisions(spark, d)
    n = rows.groupBy("video_id").agg(F.max("findings").alias("findings"), *(F.count_if(F.col("abnormal") & (F.col("attribution") == a)).alias(a) for a in S.ATTRIBUTIONS))
    return n.withColumn("structural", F.greatest("structural", "findings")).unpivot("video_id", list(S.ATTRIBUTIONS), "attribution", "segments")


@query("WITH " + _SEGDEC_SQL + ", ac AS (SELECT video_id, attribution, count(*) n FROM sl WHERE abnormal GROUP BY 1,2) SELECT video_id, attribution AS main_attribution, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, attribution) rn FROM ac) WHERE rn=1")
def main_attribution(spark, d):
    return evaluation.main_attribution(_decisions(spark, d).filter("abnormal"), ["video_id"])


def _sets_sql(grid: str, bits: int, blur: bool) -> str:
    """Training sets, fits, distances, thresholds and inner selection."""
    return O.LV + f""", src AS (SELECT DISTINCT source_id FROM sv), ts AS (SELECT a.source_id out_a, b.source_id out_b FROM src a, src b WHERE a.source_id<=b.source_id),
 fit AS (SELECT out_a, out_b, pos, quantile_cont(v::DOUBLE,0.25) q1, quantile_cont(v::DOUBLE,0.5) med, quantile_cont(v::DOUBLE,0.75) q3 FROM lv, ts WHERE video_no<=4 AND source_id<>out_a AND source_id<>out_b GROUP BY 1,2,3),
 m AS (SELECT *, greatest(q3-q1,1e-8) safe FROM fit),
 nx AS (SELECT m.out_a, m.out_b, lv.*, least(5.0::DOUBLE, greatest(-5.0::DOUBLE, (v::DOUBLE-med)/safe))::FLOAT x, ((q1-med)/safe)::FLOAT t1, ((q3-med)/safe)::FLOAT t3 FROM lv JOIN m USING (pos)),
 bn AS (SELECT *, {O.BINS} AS b FROM nx), code AS (SELECT *, {O.CODE_OF} AS c FROM bn),
 d AS ({O.DIST_SELECT.format(k="q.out_a, q.out_b,", j="AND r.out_a=q.out_a AND r.out_b=q.out_b")}){O.STRUCT},
 sc AS (SELECT *, (wr*dr+wt*dt+ws*ds)/(wr+wt+ws) AS score FROM d, (VALUES {grid}) g(w,wr,wt,ws)),
 tr AS (SELECT sc.*, margin FROM sc, (VALUES (1.5::DOUBLE),(3.0)) mg(margin) WHERE video_no<=4 AND source_id<>out_a AND source_id<>out_b),
 md AS (SELECT out_a,out_b,w,margin, median(score) ms, median(blur) mb FROM tr GROUP BY 1,2,3,4),
 th AS (SELECT out_a,out_b,w,margin, least(1,greatest(0,max(score)+greatest(margin*median(abs(score-ms)),1.0/{bits}))) t_s, {'least(1,greatest(0,max(blur)+greatest(margin*median(abs(blur-mb)),1e-6)))' if blur else '1e18'} t_b FROM tr JOIN md USING (out_a,out_b,w,margin) GROUP BY 1,2,3,4),
 hv AS (SELECT CASE WHEN sc.source_id=sc.out_b THEN sc.out_a ELSE sc.out_b END AS outer_out, sc.* FROM sc WHERE out_a<>out_b AND (source_id=out_a OR source_id=out_b)),
 vd AS (SELECT outer_out, w, margin, hv.source_id, hv.video_id, hv.expected, bool_or(score>t_s OR blur>t_b) OR max(missing_segments)>0 OR max(extra_segments)>0 AS ab FROM hv JOIN th USING (out_a,out_b,w) JOIN st USING (source_id, video_id) GROUP BY ALL),
 pd AS (SELECT *, CASE WHEN ab THEN 'abnormal' ELSE 'normal' END AS observed FROM vd), cn AS ({O.counts("outer_out, w, margin")}), mt AS ({O.metrics("cn", "outer_out, w, margin", True)}),
 sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outer_out ORDER BY round(balanced_accuracy,12) DESC, round(f1,12) DESC, w, margin) rn FROM mt) WHERE rn=1)"""


_SETS_SQL = _sets_sql("(0,0.4::DOUBLE,0.3::DOUBLE,0.3::DOUBLE),(1,0.3,0.2,0.5),(2,0.5,0.25,0.25)", 88, True)
_TWO_SQL = _sets_sql("(0,0.5::DOUBLE,0.5::DOUBLE,0.0::DOUBLE),(1,0.7,0.3,0.0),(2,0.3,0.7,0.0)", 64, False)


def _keep(spark):
    """Cuts the plan by a written table in the shared folder."""
    from mosaiq.sources.sinks import stage_table

    return lambda df: stage_table(df, "nested")


@query("WITH " + _SETS_SQL + " SELECT outer_out, w::INT AS weight_no, margin, round(balanced_accuracy,6) balanced_accuracy, round(f1,6) f1 FROM sel")
def nested_selection(spark, d):
    selected, _ = nested.evaluate(A.seg_vectors(spark, d), _keep(spark))
    return selected.withColumn("balanced_accuracy", r6("balanced_accuracy")).withColumn("f1", r6("f1"))


_OUTER_SQL = ", ov AS (SELECT sc.out_a AS held_out, video_id, expected, sc.w AS weight_no, th.margin, bool_or(score>t_s OR blur>t_b) OR max(missing_segments)>0 OR max(extra_segments)>0 AS ab FROM sc JOIN sel ON sel.outer_out=sc.out_a AND sel.w=sc.w JOIN th ON th.out_a=sc.out_a AND th.out_b=sc.out_b AND th.w=sc.w AND th.margin=sel.margin JOIN st USING (source_id, video_id) WHERE sc.out_a=sc.out_b AND sc.source_id=sc.out_a GROUP BY 1,2,3,4,5) SELECT held_out, video_id, expected, CASE WHEN ab THEN 'abnormal' ELSE 'normal' END AS observed, weight_no::INT AS weight_no, margin FROM ov"
_ADAPTIVE_SQL = ", pm AS (SELECT out_a, w, margin, profile, median(score) ms FROM tr WHERE out_a=out_b GROUP BY 1,2,3,4), pt AS (SELECT out_a, w, margin, profile, least(1,greatest(0,max(score)+greatest(margin*median(abs(score-ms)),1.0/88))) p_s FROM tr JOIN pm USING (out_a,w,margin,profile) WHERE out_a=out_b GROUP BY 1,2,3,4), ov AS (SELECT sc.out_a AS held_out, video_id, expected, sc.w AS weight_no, th.margin, bool_or(score>coalesce(p_s,t_s) OR blur>t_b) OR max(missing_segments)>0 OR max(extra_segments)>0 AS ab FROM sc JOIN sel ON sel.outer_out=sc.out_a AND sel.w=sc.w JOIN th ON th.out_a=sc.out_a AND th.out_b=sc.out_b AND th.w=sc.w AND th.margin=sel.margin LEFT JOIN pt ON pt.out_a=sc.out_a AND pt.w=sc.w AND pt.margin=sel.margin AND pt.profile=sc.profile JOIN st USING (source_id, video_id) WHERE sc.out_a=sc.out_b AND sc.source_id=sc.out_a GROUP BY 1,2,3,4,5) SELECT held_out, video_id, expected, CASE WHEN ab THEN 'abnormal' ELSE 'normal' END AS observed, weight_no::INT AS weight_no, margin FROM ov"


@query("WITH " + _SETS_SQL + _OUTER_SQL)
def nested_predictions(spark, d):
    return nested.evaluate(A.seg_vectors(spark, d), _keep(spark))[1]


@query("WITH " + _TWO_SQL + _OUTER_SQL)
def nested_predictions_two_streams(spark, d):
    """The first version: two streams, no blur loss."""
    return nested.evaluate(A.seg_vectors(spark, d), _keep(spark), two_streams=True)[1]


@query("WITH " + _SETS_SQL + _ADAPTIVE_SQL)
def nested_predictions_adaptive(spark, d):
    """Outer thresholds by compression profile, with the common one for profiles unseen in training."""
    return nested.evaluate(A.seg_vectors(spark, d), _keep(spark), adaptive=True)[1]


@query("WITH " + O.DIST + f", bv AS (SELECT video_id, video_no, source_id, bal FROM dd WHERE {_BENIGN}), fo AS (SELECT h.video_no AS left_out, b.* FROM (SELECT DISTINCT video_no FROM bv) h JOIN bv b ON b.video_no<>h.video_no), md AS (SELECT left_out, median(bal) md FROM fo GROUP BY 1), th AS (SELECT left_out, least(1,greatest(0,max(bal)+greatest(3*median(abs(bal-md)),0.5/40+0.5/24))) t FROM fo JOIN md USING (left_out) GROUP BY 1) SELECT left_out AS left_out_no, round(t,6) AS threshold, count(*) FILTER (bal>t)::BIGINT AS exceeding, count(*)::BIGINT AS segments FROM bv JOIN th ON th.left_out=bv.video_no GROUP BY 1,2")
def leave_one_benign_out(spark, d):
    rows = _keep(spark)(_distances(spark, d).filter("video_no between 1 and 4"))
    t = evaluation.fold_thresholds(rows, "balanced", [], 3.0, 0.5 / 40 + 0.5 / 24, "video_no", "left_out_no").select("left_out_no", "threshold")
    out = rows.withColumnRenamed("video_no", "left_out_no").join(t, "left_out_no")
    return out.groupBy("left_out_no", r6("threshold").alias("threshold")).agg(F.count_if(F.col("balanced") > F.col("threshold")).alias("exceeding"), F.count(F.lit(1)).alias("segments"))


@query("WITH " + O.SV + f" SELECT h.held_out, count(*)::BIGINT AS training_rows, 0::BIGINT AS leaked_rows FROM (SELECT DISTINCT source_id held_out FROM sv) h JOIN sv ON sv.source_id<>h.held_out AND {_BENIGN} GROUP BY 1")
def leakage_check(spark, d):
    rows = A.seg_vectors(spark, d)
    return evaluation.leakage(evaluation.fold_rows(rows.filter("video_no between 1 and 4"), rows.select("source_id").distinct()))


@query("WITH " + O.SV + " SELECT video_id, segment_id, list_sum(embedding[1:40])::DOUBLE IS NOT NULL AS has_all, 64::INT AS dims FROM sv")
def feature_stream_join(spark, d):
    rows = A.seg_vectors(spark, d)
    keys = ["video_id", "segment_id"]
    joined = compare.complete_join({s: rows.select(*keys, s) for s in models.STREAMS}, keys)
    return joined.select(*keys, V.is_finite(F.concat("resnet", "temporal", "spatial")).alias("has_all"), F.size(F.concat("resnet", "temporal", "spatial")).alias("dims"))


@query("WITH " + O.TURNS + " SELECT CASE state WHEN 'missing_in_query' THEN 'left' ELSE 'right' END AS side, count(*)::BIGINT AS n FROM (SELECT DISTINCT conv_id, segment_id, state FROM al WHERE state IN ('missing_in_query','extra_in_query')) GROUP BY 1")
def one_sided_segments(spark, d):
    t = A.turns(spark, d)
    left, right = t.filter("conv_id % 2 = 0"), t.filter("conv_id % 2 = 1").withColumn("conv_id", F.col("conv_id") - 1)
    return compare.one_sided(left, right, ["conv_id", "segment_id"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + O.SV + O.STRUCT + " SELECT source_id, video_id, missing_segments, extra_segments, missing_segments>0 OR extra_segments>0 AS structural FROM st")
def structural_issue(spark, d):
    return _structural(spark, d)


# --- frames ----------------------------------------------------------------------------------------------------------


def _durations(spark, d):
    o = A.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderkey") % 23 + (F.col("o_custkey") % 10) / 10).cast("double").alias("duration"))


_DUR = "du AS (SELECT o_orderkey AS video_id, (o_orderkey%23+(o_custkey%10)/10::DOUBLE)::DOUBLE AS duration FROM orders), gr AS (SELECT video_id, duration, greatest(floor(duration/5.0+1e-9),0)::INT AS whole FROM du), sg AS (SELECT video_id, duration, whole, unnest(range(0, whole + (duration-whole*5>1e-9)::INT))::INT AS segment_id FROM gr)"


@query("WITH " + _DUR + " SELECT video_id, segment_id, segment_id*5.0::DOUBLE AS start_s, round(CASE WHEN segment_id<whole THEN segment_id*5.0+5 ELSE duration END,6) AS end_s, segment_id<whole AS is_complete FROM sg")
def segment_grid(spark, d):
    return segments.segment_grid(_durations(spark, d), keep_partial=True).select("video_id", "segment_id", "start_s", r6("end_s").alias("end_s"), "is_complete")


@query("WITH " + _DUR + " SELECT video_id, segment_id, i::INT AS sample_index, round(segment_id*5.0::DOUBLE+(i+0.5::DOUBLE)/1.0,6) AS ts_s FROM sg, (SELECT unnest(range(0,5)) i) WHERE segment_id<whole")
def sample_timestamps(spark, d):
    return segments.sample_times(segments.segment_grid(_durations(spark, d)), 1.0).select("video_id", "segment_id", "sample_index", "ts_s")


@query("WITH " + _DUR + " SELECT segment_id, i::INT AS sample_index, count(*)::BIGINT AS n, round(sum(segment_id*5.0::DOUBLE+(i+0.5::DOUBLE)/4.0),3) AS total FROM sg, (SELECT unnest(range(0,20)) i) WHERE segment_id<whole GROUP BY 1,2")
def temporal_timestamps(spark, d):
    t = segments.sample_times(segments.segment_grid(_durations(spark, d)), 4.0)
    return t.groupBy("segment_id", "sample_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ts_s"), 3).alias("total"))


def _pairs(spark, d):
    return segments.adjacent_pairs(A.frames(spark, d))


@query("WITH " + O.PAIRS + " SELECT video_id, segment_id, pair_index, ok, round(change,6) AS change FROM pr")
def adjacent_pairs(spark, d):
    return _pairs(spark, d).select("video_id", "segment_id", "pair_index", "ok", r6("change").alias("change"))


@query("WITH " + O.PAIRS + " SELECT video_id, segment_id, count(*)::BIGINT expected_pairs, count(*) FILTER (ok)::BIGINT decoded_pairs, count(*) FILTER (NOT ok)::BIGINT failed_pairs, round(avg(change),6) mean_change, round(stddev_pop(change),6) std_change, round(max(change),6) max_change FROM pr GROUP BY 1,2")
def pair_features_segment(spark, d):
    f = segments.pair_features(_pairs(spark, d))
    return f.select("video_id", "segment_id", "expected_pairs", "decoded_pairs", "failed_pairs", *(r6(c).alias(c) for c in ("mean_change", "std_change", "max_change")))


@query("WITH " + O.PAIRS + " SELECT video_id, segment_id, pair_index, round(middle_s,4) middle_s, round(change,6) change FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY change DESC, pair_index) rn FROM pr WHERE ok) WHERE rn=1")
def max_discontinuity(spark, d):
    return segments.largest_change(_pairs(spark, d)).select("video_id", "segment_id", "pair_index", F.round("middle_s", 4).alias("middle_s"), r6("change").alias("change"))


@query("WITH " + O.FRAMES + " SELECT video_id, segment_id, round(avg(value),6) mean, round(stddev_pop(value),6) std, round(min(value),6) least, round(quantile_cont(value,0.1),6) p10, round(median(value),6) AS median, count(value)::BIGINT frames FROM fr WHERE success GROUP BY 1,2")
def spatial_like_agg(spark, d):
    s = segments.spread(A.frames(spark, d).filter("success"))
    return s.select("video_id", "segment_id", *(r6(c).alias(c) for c in ("mean", "std", "least", "p10", "median")), "frames")


@query("WITH " + O.FRAMES + " SELECT video_id, segment_id, 5::BIGINT AS expected, count(*) FILTER (success)::BIGINT AS used, greatest(5-count(*) FILTER (success),0)::BIGINT AS failed_or_missing FROM fr GROUP BY 1,2")
def frame_counts(spark, d):
    return segments.frame_counts(A.frames(spark, d), F.lit(5).cast("bigint"))


_PH = O.FRAMES + """, f2 AS (SELECT *, (frame_index%4=3)::INT*0.5::DOUBLE*(video_id%2) AS offset_s FROM fr),
 rf AS (SELECT video_id//2 AS g, * FROM f2 WHERE video_id%2=0), qf AS (SELECT video_id//2 AS g, * FROM f2 WHERE video_id%2=1),
 cm AS (SELECT DISTINCT r.g, r.segment_id FROM rf r JOIN qf q ON q.g=r.g AND q.segment_id=r.segment_id),
 hp AS (SELECT coalesce(r.g,q.g) g, coalesce(r.segment_id,q.segment_id) segment_id, coalesce(r.frame_index,q.frame_index) frame_index, CASE WHEN r.g IS NULL OR q.g IS NULL THEN 'missing' WHEN NOT r.success OR NOT q.success THEN 'invalid' WHEN abs(r.offset_s-q.offset_s)>1e-9 THEN 'timestamp' ELSE 'valid' END reason, r.hash64 rh, q.hash64 qh
 FROM (SELECT rf.* FROM rf JOIN cm USING (g, segment_id)) r FULL JOIN (SELECT qf.* FROM qf JOIN cm USING (g, segment_id)) q ON q.g=r.g AND q.segment_id=r.segment_id AND q.frame_index=r.frame_index),
 hd AS (SELECT g, segment_id, frame_index, reason, CASE WHEN reason='valid' THEN bit_count(xor(rh,qh))/64.0::DOUBLE END AS distance FROM hp),
 hs AS (SELECT g, segment_id, count(*) FILTER (reason<>'valid')::BIGINT invalid_pairs, avg(distance) mean, median(distance) med, max(distance) largest, count(*) FILTER (reason='valid')>0 AS segment_valid, avg(distance) AS score FROM hd GROUP BY 1,2),
 hx AS (SELECT coalesce(r.g,q.g) g, count(*) FILTER (q.g IS NULL) missing, count(*) FILTER (r.g IS NULL) extra FROM (SELECT DISTINCT g, segment_id FROM rf) r FULL JOIN (SELECT DISTINCT g, segment_id FROM qf) q ON q.g=r.g AND q.segment_id=r.segment_id GROUP BY 1),
 hv AS (SELECT hx.g, max(score) AS video_score, any_value(missing+extra)>0 AS structural, coalesce(bool_or(NOT segment_valid), true) OR max(score) IS NULL AS invalid FROM hx LEFT JOIN hs ON hs.g=hx.g GROUP BY hx.g)"""


def _hash_sides(spark, d):
    f = A.frames(spark, d).withColumn("g", F.floor(F.col("video_id") / 2)).withColumn("offset_s", F.when(F.col("frame_index") % 4 == 3, 0.5).otherwise(0.0) * (F.col("video_id") % 2))
    return f.filter("video_id % 2 = 0"), f.filter("video_id % 2 = 1")


def _hash_pairs(spark, d):
    return compare.hash_pairs(*_hash_sides(spark, d), ["g", "segment_id", "frame_index"])


def _hash_decisions(spark, d):
    return compare.hash_video_decision(compare.hash_segments(_hash_pairs(spark, d), ["g"]), compare.hash_structure(*_hash_sides(spark, d), ["g"]), ["g"], F.lit(0.5))


@query("WITH " + _PH + " SELECT g, segment_id, frame_index, reason, round(distance,6) distance FROM hd")
def phash_pairs(spark, d):
    return _hash_pairs(spark, d).select("g", "segment_id", "frame_index", "reason", r6("distance").alias("distance"))


@query("WITH " + _PH + " SELECT g, segment_id, invalid_pairs, round(mean,6) mean, round(med,6) AS median, round(largest,6) largest, segment_valid FROM hs")
def phash_segment_scores(spark, d):
    s = compare.hash_segments(_hash_pairs(spark, d), ["g"])
    return s.select("g", "segment_id", "invalid_pairs", *(r6(c).alias(c) for c in ("mean", "median", "largest")), "segment_valid")


@query("WITH " + _PH + """ SELECT g, round(video_score,6) video_score, invalid, structural, CASE WHEN coalesce(video_score>0.5,false) OR invalid OR structural THEN 'abnormal' ELSE 'normal' END observed,
 coalesce(nullif(concat_ws('; ', CASE WHEN video_score>0.5 THEN 'video score strictly exceeds threshold' END, CASE WHEN structural THEN 'missing or extra segment' END, CASE WHEN invalid THEN 'unusable corresponding frame-hash evidence' END), ''), 'within threshold with complete valid structure') decision_reason FROM hv""")
def phash_decisions(spark, d):
    return _hash_decisions(spark, d).withColumn("video_score", r6("video_score"))


_PN = _PH + """, pv AS (SELECT 'S'||(g%6) AS source_id, g AS video_id, CASE WHEN g%3=0 THEN 'abnormal' ELSE 'normal' END AS expected, video_score, structural OR invalid AS bad FROM hv),
 ss AS (SELECT DISTINCT source_id FROM pv), pr2 AS (SELECT a.source_id outer_out, b.source_id inner_out FROM ss a, ss b),
 tr AS (SELECT outer_out, inner_out, margin, video_score FROM pr2 JOIN pv ON source_id<>outer_out AND source_id<>inner_out AND expected='normal' AND video_score IS NOT NULL, (VALUES (1.5::DOUBLE),(3.0)) mg(margin)),
 md AS (SELECT outer_out, inner_out, margin, median(video_score) md FROM tr GROUP BY 1,2,3),
 th AS (SELECT outer_out, inner_out, margin, least(1,greatest(0,max(video_score)+greatest(margin*median(abs(video_score-md)),1.0/64))) t FROM tr JOIN md USING (outer_out,inner_out,margin) GROUP BY 1,2,3),
 pd AS (SELECT outer_out, margin, expected, CASE WHEN bad OR video_score>t THEN 'abnormal' ELSE 'normal' END observed FROM th JOIN pv ON pv.source_id=th.inner_out WHERE inner_out<>outer_out),
 cn AS (""" + O.counts("outer_out, margin") + "), mt AS (" + O.metrics("cn", "outer_out, margin") + """),
 sel AS (SELECT outer_out, margin FROM (SELECT *, row_number() OVER (PARTITION BY outer_out ORDER BY round(balanced_accuracy,12) DESC NULLS LAST, round(f1,12) DESC NULLS LAST, margin) rn FROM mt) WHERE rn=1)"""


@query("WITH " + _PN + " SELECT th.outer_out AS held_out, pv.video_id, th.margin, round(t,6) AS threshold, CASE WHEN bad OR video_score>t THEN 'abnormal' ELSE 'normal' END observed FROM th JOIN sel ON sel.outer_out=th.outer_out AND sel.margin=th.margin JOIN pv ON pv.source_id=th.outer_out WHERE th.inner_out=th.outer_out")
def phash_nested_loso(spark, d):
    """The margin is selected inside the training sources of each fold; thresholds exclude the held-out source. Bad evidence is abnormal."""
    v = _keep(spark)(_hash_decisions(spark, d))
    v = v.select(F.concat(F.lit("S"), (F.col("g") % 6).cast("string")).alias("source_id"), F.col("g").alias("video_id"), F.when(F.col("g") % 3 == 0, "abnormal").otherwise("normal").alias("expected"), "video_score", (F.col("structural") | F.col("invalid")).alias("bad"))
    sources = sorted(r[0] for r in v.select("source_id").distinct().collect())  # one a fold
    train = v.filter("expected = 'normal' and video_score is not null")
    found = order_stats.spread(train, "video_score", [], group="source_id", leave_out=2, groups=sources).filter("n > 0")
    limits = evaluation.with_threshold(found.select("*", F.explode(F.lit([1.5, 3.0])).alias("margin")), F.col("margin"), 1 / 64)
    # the set without a and b serves both ways
    way = lambda a, b: F.struct(F.col(a).alias("outer_out"), F.col(b).alias("inner_out"))
    ways = F.when(F.col("out_a") == F.col("out_b"), F.array(way("out_a", "out_b"))).otherwise(F.array(way("out_a", "out_b"), way("out_b", "out_a")))
    limits = limits.select(F.explode(ways).alias("w"), "margin", "threshold").select("w.*", "margin", "threshold")
    verdict = F.when(F.col("bad") | (F.col("video_score") > F.col("threshold")), "abnormal").otherwise("normal")
    inner = limits.filter("inner_out <> outer_out").join(v, F.col("inner_out") == F.col("source_id")).withColumn("observed", verdict)
    quality = evaluation.metrics(evaluation.counts(inner, ["outer_out", "margin"]))
    chosen = evaluation.best_parameters(quality, ["outer_out"], ["margin"]).select("outer_out", "margin")
    outer = limits.filter("inner_out = outer_out").join(chosen, ["outer_out", "margin"]).join(v, F.col("outer_out") == F.col("source_id"))
    return outer.select(F.col("outer_out").alias("held_out"), "video_id", "margin", r6("threshold").alias("threshold"), verdict.alias("observed"))


_STATES = O.LOG + """,
 vi AS (SELECT DISTINCT source_id||'/'||video_id AS video_id, source_id, video_id AS name FROM lg), re AS (SELECT *, name=min(name) OVER (PARTITION BY source_id) AS is_reference FROM vi),
 gd AS (SELECT re.*, st.place, st.stage, lv.status FROM re, (VALUES (0,'R'),(1,'A'),(2,'N')) st(place, stage) LEFT JOIN (SELECT source_id||'/'||video_id AS video_id, stage, max_by(status, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)) AS status FROM lg GROUP BY 1,2) lv ON lv.video_id=re.video_id AND lv.stage=st.stage),
 mk AS (SELECT *, coalesce(bool_and(coalesce(status='completed',false)) OVER (PARTITION BY video_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS earlier, bool_or(coalesce(status='failed',false)) OVER (PARTITION BY video_id ORDER BY place) AS failed_so_far FROM gd),
 rf AS (SELECT source_id, place, bool_and(coalesce(status='completed',false)) AS ref_done, bool_or(failed_so_far) AS ref_failed FROM mk WHERE is_reference GROUP BY 1,2)"""


@query("WITH " + _STATES + " SELECT source_id, video_id, is_reference, stage, CASE WHEN status='completed' THEN 'completed' WHEN NOT is_reference AND coalesce(ref_failed, true) THEN 'blocked' WHEN NOT earlier OR (NOT is_reference AND NOT ref_done) THEN 'waiting' WHEN status='failed' THEN 'failed' ELSE 'ready' END AS state FROM mk LEFT JOIN rf USING (source_id, place)")
def stage_states(spark, d):
    """What each recording has done, may do next, waits for or is stopped from, by the log."""
    log = _log(spark, d).withColumn("video_id", F.concat_ws("/", "source_id", "video_id"))
    videos = log.select("source_id", "video_id").distinct()
    first = videos.groupBy("source_id").agg(F.min("video_id").alias("first"))
    videos = videos.join(first, "source_id").select("source_id", "video_id", (F.col("video_id") == F.col("first")).alias("is_reference"))
    return stages.states(videos, log, ["R", "A", "N"])


_TREE = """rw AS (SELECT sha256('{"c_custkey":'||c_custkey||'}') AS k, sha256('{"c_custkey":'||c_custkey||',"c_mktsegment":"'||c_mktsegment||'","c_nationkey":'||c_nationkey||'}') AS d FROM customer),
 l2 AS (SELECT k[1:4] AS node, count(*) AS n, sha256(string_agg(d, '' ORDER BY k, d)) AS d FROM rw GROUP BY 1), l1 AS (SELECT node[1:2] AS node, sum(n) AS n, sha256(string_agg(d, '' ORDER BY node)) AS d FROM l2 GROUP BY 1)"""


@query("WITH " + _TREE + " SELECT 1::INT AS level, node, n::BIGINT AS rows, d AS digest FROM l1 UNION ALL SELECT 0, '', sum(n)::BIGINT, sha256(string_agg(d, '' ORDER BY node)) FROM l1")
def table_tree(spark, d):
    """The upper levels of a table's digest tree."""
    rows = A.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return identity.tree(rows, ["c_custkey"]).filter("level < 2")


# --- turns -----------------------------------------------------------------------------------------------------------


def _aligned(spark, d):
    t = A.turns(spark, d)
    return compare.align(t.filter("conv_id % 2 = 0"), t.filter("conv_id % 2 = 1").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id", "segment_id"])


@query("WITH " + O.TURNS + " SELECT conv_id, segment_id, ref_start, query_start, state FROM al")
def segment_alignment(spark, d):
    return _aligned(spark, d)


@query("WITH " + O.TURNS + ", s AS (SELECT conv_id, count(*) FILTER (state='matched')::BIGINT matched, count(*) FILTER (state='missing_in_query')::BIGINT missing_in_query, count(*) FILTER (state='extra_in_query')::BIGINT extra_in_query, count(*) FILTER (state='timestamp_mismatch')::BIGINT timestamp_mismatch FROM al GROUP BY 1) SELECT *, missing_in_query=0 AND extra_in_query=0 AND timestamp_mismatch=0 AS alignment_valid, matched>0 AS comparison_possible FROM s")
def alignment_summary(spark, d):
    return compare.alignment_summary(_aligned(spark, d), ["conv_id"])


# --- predictions -----------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _round_sql(inner: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    return f"SELECT {k}tp,tn,fp,fn, " + ", ".join(f"round({m}::DOUBLE,6) AS {m}" for m in O.METRIC_NAMES) + f" FROM ({inner})"


@query("WITH " + O.PRED + ", cn AS (" + O.counts("source_id") + ") " + _round_sql(O.metrics("cn", "source_id"), "source_id"))
def metrics_nan_policy(spark, d):
    return _rounded(evaluation.metrics(evaluation.counts(A.predictions(spark, d), ["source_id"])))


@query("WITH " + O.PRED + ", cn AS (" + O.counts("source_id") + ") " + _round_sql(O.metrics("cn", "source_id", True), "source_id"))
def metrics_zero_policy(spark, d):
    return _rounded(evaluation.metrics(evaluation.counts(A.predictions(spark, d), ["source_id"]), zero=True))


@query("WITH " + O.PRED + ", cn AS (" + O.counts("") + ") SELECT tn, fp, fn, tp FROM cn")
def confusion_matrix(spark, d):
    return evaluation.counts(A.predictions(spark, d), []).select("tn", "fp", "fn", "tp")


@query("WITH " + O.PRED + ", cn AS (" + O.counts("") + ") SELECT 'normal' AS expected, round(coalesce(100.0::DOUBLE*tn/nullif(tn+fp,0),0),6) AS normal_pct, round(coalesce(100.0::DOUBLE*fp/nullif(tn+fp,0),0),6) AS abnormal_pct FROM cn UNION ALL SELECT 'abnormal', round(coalesce(100.0::DOUBLE*fn/nullif(tp+fn,0),0),6), round(coalesce(100.0::DOUBLE*tp/nullif(tp+fn,0),0),6) FROM cn")
def confusion_pct(spark, d):
    c = evaluation.counts(A.predictions(spark, d), [])
    rows = c.select(F.explode(F.array(F.struct(F.lit("normal").alias("expected"), F.col("tn").alias("a"), F.col("fp").alias("b")), F.struct(F.lit("abnormal").alias("expected"), F.col("fn").alias("a"), F.col("tp").alias("b")))).alias("r")).select("r.*")
    pct = lambda x: r6(F.coalesce(F.try_divide(100.0 * F.col(x), F.col("a") + F.col("b")), F.lit(0.0)))
    return rows.select("expected", pct("a").alias("normal_pct"), pct("b").alias("abnormal_pct"))


@query("WITH " + O.PRED + ", l AS (SELECT unnest(['en','fr','de','es','xx']) AS transformation) SELECT l.transformation, count(pd.video_id)::BIGINT AS n, count(*) FILTER (pd.expected=pd.observed)::BIGINT AS correct, round(count(*) FILTER (pd.expected=pd.observed)/nullif(count(pd.video_id),0)::DOUBLE,6) AS rate FROM l LEFT JOIN pd USING (transformation) GROUP BY 1")
def per_label_fixed_list(spark, d):
    """Rates over a fixed list of labels: labels without rows stay, with zeros."""
    labels = spark.range(1).select(F.explode(F.lit(["en", "fr", "de", "es", "xx"])).alias("transformation"))
    p = A.predictions(spark, d).groupBy("transformation").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == F.col("observed")).alias("correct"))
    j = labels.join(p, "transformation", "left").select("transformation", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"))
    return j.withColumn("rate", r6(F.try_divide(F.col("correct").cast("double"), F.col("n"))))


@query("WITH " + O.PRED + " SELECT source_id, count(*)::BIGINT AS n, count(*) FILTER (expected=observed)::BIGINT AS correct, count(*) FILTER (expected<>observed)::BIGINT AS incorrect, round(count(*) FILTER (expected=observed)/count(*)::DOUBLE,6) AS accuracy FROM pd GROUP BY 1")
def per_source_metrics(spark, d):
    p = A.predictions(spark, d)
    g = p.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected") == F.col("observed")).alias("correct"), F.count_if(F.col("expected") != F.col("observed")).alias("incorrect"))
    return g.withColumn("accuracy", r6(F.col("correct") / F.col("n")))


@query("WITH " + O.PRED + ", q AS (SELECT transformation, expected, count(*) n, count(*) FILTER (observed='abnormal') ab FROM pd GROUP BY 1,2) SELECT transformation, expected, n::BIGINT AS n, CASE WHEN expected='abnormal' THEN round(ab/n::DOUBLE,6) END AS detection, CASE WHEN expected='normal' THEN round((n-ab)/n::DOUBLE,6) END AS acceptance FROM q")
def per_transformation(spark, d):
    g = A.predictions(spark, d).groupBy("transformation", "expected").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed") == "abnormal").alias("ab"))
    return g.select("transformation", "expected", "n", F.when(F.col("expected") == "abnormal", r6(F.col("ab") / F.col("n"))).alias("detection"), F.when(F.col("expected") == "normal", r6((F.col("n") - F.col("ab")) / F.col("n"))).alias("acceptance"))


_FV = "WITH " + O.PRED + ", cn AS (" + O.counts("source_id") + "), mt AS (" + O.metrics("cn", "source_id") + "), lg AS (" + O.long_metrics("mt", "source_id") + ")"


@query(_FV + " SELECT metric, round(avg(value),6) mean, round(stddev_samp(value),6) sd, round(min(value),6) least, round(max(value),6) largest, round(median(value),6) AS median, count(value)::BIGINT valid_folds, count(*) FILTER (value IS NULL)::BIGINT undefined_folds FROM lg GROUP BY 1")
def fold_variance(spark, d):
    return _rounded(evaluation.fold_variance(A.predictions(spark, d)))


_REPS = 10_000
_BOOT = "WITH " + O.PRED + ", cl AS (SELECT *, row_number() OVER (ORDER BY source_id)-1 AS cluster_no FROM (" + O.counts("source_id") + f""")), nc AS (SELECT count(*) n FROM cl),
 dr AS (SELECT rep, ('0x'||substr(sha256('404:'||rep||':'||k),1,8))::BIGINT%n AS cluster_no FROM (SELECT unnest(range(0,{_REPS})) rep), nc, LATERAL (SELECT unnest(range(0,n)) k)),
 sm AS (SELECT rep, sum(tp)::BIGINT tp, sum(tn)::BIGINT tn, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn FROM dr JOIN cl USING (cluster_no) GROUP BY 1), mt AS (""" + O.metrics("sm", "rep") + "), lg AS (" + O.long_metrics("mt", "rep") + "), ci AS (SELECT metric, round(avg(value),6) mean, round(stddev_samp(value),6) sd, round(quantile_cont(value,0.025),6) low, round(quantile_cont(value,0.975),6) high, count(value)::BIGINT valid FROM lg GROUP BY 1)"


def _boot(spark, d, reps=_REPS):
    clusters = evaluation.counts(A.predictions(spark, d), ["source_id"])
    n = clusters.count()  # the number of sources: a scalar
    numbered = clusters.withColumn("cluster_no", F.row_number().over(Window.orderBy("source_id")) - 1).drop("source_id")
    return _rounded(evaluation.bootstrap(numbered, evaluation.hashed_draws(spark, reps, n)))


@query(_BOOT + " SELECT * FROM ci")
def bootstrap_ci(spark, d):
    return _boot(spark, d)


@query(_BOOT + ", pc AS (" + O.counts("") + "), pm AS (" + O.metrics("pc", "") + "), pl AS (" + O.long_metrics("(SELECT 1 AS one, * FROM pm)", "one") + ") SELECT metric, round(pl.value::DOUBLE,6) AS point, low, high, sd FROM pl JOIN ci USING (metric)")
def primary_comparison(spark, d):
    point = evaluation.unpivot_metrics(evaluation.metrics(evaluation.counts(A.predictions(spark, d), [])).withColumn("one", F.lit(1)), ["one"])
    return point.select("metric", r6("value").alias("point")).join(_boot(spark, d).select("metric", "low", "high", "sd"), "metric")


@query("WITH " + O.PRED + " SELECT source_id, video_id, CASE WHEN expected='normal' THEN 'false_positive' ELSE 'false_negative' END AS reason FROM pd WHERE expected<>observed")
def failure_rows(spark, d):
    return A.predictions(spark, d).filter("expected <> observed").select("source_id", "video_id", F.when(F.col("expected") == "normal", "false_positive").otherwise("false_negative").alias("reason"))


@query("WITH " + O.PRED + " SELECT source_id, count(*) FILTER (expected=observed)::BIGINT AS correct, count(*) FILTER (expected<>observed)::BIGINT AS incorrect FROM pd GROUP BY 1")
def correct_pivot(spark, d):
    p = A.predictions(spark, d).withColumn("verdict", F.when(F.col("expected") == F.col("observed"), "correct").otherwise("incorrect"))
    return p.groupBy("source_id").pivot("verdict", ["correct", "incorrect"]).count().na.fill(0)


@query("WITH " + O.PRED + " SELECT expected, count(*) FILTER (observed='normal')::BIGINT AS normal, count(*) FILTER (observed='abnormal')::BIGINT AS abnormal FROM pd GROUP BY 1")
def expected_observed_pivot(spark, d):
    return A.predictions(spark, d).groupBy("expected").pivot("observed", ["normal", "abnormal"]).count().na.fill(0)


# --- registry --------------------------------------------------------------------------------------------------------


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url,'[^A-Za-z0-9_.-]+','_','g'),'^[._-]+|[._-]+$','','g'),''),'video') AS safe_id FROM pages")
def safe_ids(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.safe_id(F.col("url")).alias("safe_id"))


def _registry(spark, d):
    r = A.registry(spark, d)
    return r.withColumn("t1", S.classify_exact_one(F.col("filename"))).withColumn("t2", S.classify_first_match(F.col("filename")))


@query("WITH " + O.REG + ", " + O.HITS + " SELECT video_id, t1 AS transformation, CASE t1 WHEN 'ambiguous' THEN 0.2::DOUBLE WHEN 'unsupported_video' THEN 0.1 ELSE 0.95 END AS confidence FROM cl")
def classify_exact_one(spark, d):
    return _registry(spark, d).select("video_id", F.col("t1").alias("transformation"), S.classify_confidence(F.col("t1")).alias("confidence"))


@query("WITH " + O.REG + ", " + O.HITS + " SELECT video_id, t2 AS transformation, CASE WHEN t2='trusted_reference' THEN 'reference' WHEN t2 IN ('avi_conversion','mov_conversion','resize_480p','resize_720p') THEN 'benign' WHEN t2='unclassified' THEN 'unknown' ELSE 'tampered' END AS category FROM cl")
def classify_first_match(spark, d):
    return _registry(spark, d).select("video_id", F.col("t2").alias("transformation"), S.category_of(F.col("t2")).alias("category"))


@query("WITH " + O.REG + ", " + O.HITS + ", k AS (SELECT *, row_number() OVER (PARTITION BY source_id, t2 ORDER BY lower(filename), video_id) rn FROM cl) SELECT video_id, source_id||'_'||upper(t2)||CASE WHEN rn=1 THEN '' ELSE '_'||rn END AS variant_id FROM k")
def duplicate_suffix(spark, d):
    n = F.row_number().over(Window.partitionBy("source_id", "t2").orderBy(F.lower("filename"), "video_id"))
    return _registry(spark, d).select("video_id", F.concat_ws("_", "source_id", F.upper("t2"), F.when(n > 1, n.cast("string"))).alias("variant_id"))


_REF = ", rf AS (SELECT source_id, min(video_id) rid FROM cl WHERE t2='trusted_reference' GROUP BY 1)"


def _with_reference(spark, d, columns):
    """Each recording with its source's reference; sources without one get nulls."""
    r = _registry(spark, d)
    ref = r.filter("t2 = 'trusted_reference'").groupBy("source_id").agg(F.min_by(F.struct(*columns), "video_id").alias("ref"))
    return r.join(ref, "source_id", "left")


@query("WITH " + O.REG + ", " + O.HITS + _REF + " SELECT cl.video_id, cl.sha256 IS NOT DISTINCT FROM z.sha256 AS same_bytes FROM cl LEFT JOIN rf USING (source_id) LEFT JOIN rg z ON z.video_id=rf.rid")
def sha256_baseline(spark, d):
    return _with_reference(spark, d, ["sha256"]).select("video_id", F.col("sha256").eqNullSafe(F.col("ref.sha256")).alias("same_bytes"))


@query("WITH " + O.REG + ", " + O.HITS + _REF + " SELECT cl.video_id, cl.size-z.size AS size_delta, cl.width-z.width AS width_delta, cl.height-z.height AS height_delta FROM cl LEFT JOIN rf USING (source_id) LEFT JOIN rg z ON z.video_id=rf.rid")
def metadata_delta(spark, d):
    j = _with_reference(spark, d, ["size", "width", "height"])
    return j.select("video_id", *((F.col(c) - F.col(f"ref.{c}")).alias(f"{c}_delta") for c in ("size", "width", "height")))


@query("WITH " + O.REG + " SELECT sha256, count(*)::BIGINT AS copies, min(video_id) AS first_id, count(DISTINCT source_id)::BIGINT AS sources FROM rg GROUP BY 1 HAVING count(*)>1")
def byte_duplicates(spark, d):
    return A.registry(spark, d).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("video_id").alias("first_id"), F.countDistinct("source_id").alias("sources")).filter("copies > 1")


@query("WITH " + O.REG + ", " + O.HITS + ", x AS (SELECT unnest(['avi_conversion','mov_conversion','resize_480p','resize_720p','blur','frame_deletion','frame_insertion','frame_replacement']) AS t), s AS (SELECT DISTINCT source_id FROM cl) SELECT s.source_id, count(*) FILTER (n IS NULL)::BIGINT AS missing, count(*) FILTER (n>1)::BIGINT AS duplicated, max(r.refs)::BIGINT AS refs, CASE WHEN max(r.refs)=1 THEN 'valid' ELSE 'blocked' END AS status FROM s CROSS JOIN x LEFT JOIN (SELECT source_id, t2, count(*) n FROM cl GROUP BY 1,2) c ON c.source_id=s.source_id AND c.t2=x.t LEFT JOIN (SELECT source_id, count(*) FILTER (t2='trusted_reference') refs FROM cl GROUP BY 1) r ON r.source_id=s.source_id GROUP BY 1")
def source_registry(spark, d):
    r = _registry(spark, d)
    expected = [*S.BENIGN, *S.TAMPERED]
    per = r.groupBy("source_id").agg(*(F.count_if(F.col("t2") == t).alias(t) for t in expected), F.count_if(F.col("t2") == "trusted_reference").alias("refs"))
    every = F.array(*expected)
    return per.select("source_id", F.size(F.filter(every, lambda n: n == 0)).cast("bigint").alias("missing"), F.size(F.filter(every, lambda n: n > 1)).cast("bigint").alias("duplicated"), "refs", F.when(F.col("refs") == 1, "valid").otherwise("blocked").alias("status"))


@query("WITH " + O.REG + ", " + O.HITS + " SELECT video_id, coalesce(nullif(ext,''),'unknown')||':'||CASE WHEN coalesce(width,0)=0 OR height=0 THEN 'unknown_res' WHEN width*height<=900*520 THEN '480p' WHEN width*height<=1300*760 THEN '720p' ELSE 'source_res' END AS profile FROM cl")
def compression_profile(spark, d):
    return A.registry(spark, d).select("video_id", S.compression_profile(S.file_extension(F.col("filename")), F.col("width"), F.col("height")).alias("profile"))


@query("WITH " + O.REG + ", " + O.HITS + ", k AS (SELECT source_id, CASE WHEN t2='trusted_reference' THEN 'reference' WHEN t2 IN ('avi_conversion','mov_conversion','resize_480p','resize_720p') THEN 'benign' WHEN t2='unclassified' THEN 'unknown' ELSE 'tampered' END AS c FROM cl) SELECT source_id, count(*) FILTER (c='reference')::BIGINT AS reference, count(*) FILTER (c='benign')::BIGINT AS benign, count(*) FILTER (c='tampered')::BIGINT AS tampered, count(*) FILTER (c='unknown')::BIGINT AS unknown FROM k GROUP BY 1")
def category_pivot(spark, d):
    r = _registry(spark, d).withColumn("category", S.category_of(F.col("t2")))
    return r.groupBy("source_id").pivot("category", ["reference", "benign", "tampered", "unknown"]).count().na.fill(0)


@query("WITH " + O.REG + ", " + O.HITS + " SELECT t1 AS transformation, count(*)::BIGINT AS n, min(lower(filename)) AS first_file FROM cl GROUP BY 1")
def transformation_counts(spark, d):
    return _registry(spark, d).groupBy(F.col("t1").alias("transformation")).agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("filename")).alias("first_file"))


@query("WITH " + O.REG + " SELECT video_id, CASE fps_text WHEN '30/1' THEN 30.0::DOUBLE WHEN '30000/1001' THEN round(30000/1001::DOUBLE,6) WHEN '25/1' THEN 25 WHEN '24' THEN 24 END AS fps FROM rg")
def fps_parse(spark, d):
    return A.registry(spark, d).select("video_id", r6(S.frame_rate(F.col("fps_text"))).alias("fps"))


@query("WITH " + O.REG + """, pl AS (SELECT video_id, '{"digest":"'||sha256||'","height":'||height||',"size_us":'||size*1000||',"source":"'||source_id||'","width":'||coalesce(width::VARCHAR,'null')||'}' AS p FROM rg) SELECT video_id, sha256(p) AS payload_sha256 FROM pl""")
def canonical_payload_sha256(spark, d):
    r = A.registry(spark, d)
    payload = auth.canonical_json({"source": F.col("source_id"), "digest": F.col("sha256"), "width": F.col("width"), "height": F.col("height"), "size_us": F.col("size") * 1000})
    return r.select("video_id", auth.payload_sha256(payload).alias("payload_sha256"))


@query("SELECT o_orderkey AS video_id, round_even(o_totalprice*0.125::DOUBLE*1e6, 0)::BIGINT AS us, CASE WHEN o_totalprice>0 THEN floor(o_totalprice*2.0::DOUBLE+1e-9) ELSE 0 END::BIGINT AS samples, printf('v%d_segment_%03d_frame_%03d_t%07dms.jpg', o_orderkey, o_custkey%1000, o_orderkey%50, o_orderkey%100000*125) AS file FROM orders")
def time_fields(spark, d):
    o = A.table(spark, d, "orders")
    video = F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))
    seconds = (F.col("o_orderkey") % 100000) * 0.125
    return o.select(F.col("o_orderkey").alias("video_id"), S.microseconds(F.col("o_totalprice") * 0.125).alias("us"), S.expected_samples(F.col("o_totalprice"), 2.0).alias("samples"), S.frame_file(video, F.col("o_custkey") % 1000, F.col("o_orderkey") % 50, seconds).alias("file"))


# --- runtime log -----------------------------------------------------------------------------------------------------

_CURRENT = "(coalesce(run_id,'')='' OR run_id='O')"


def _log(spark, d):
    return A.runtime_log(spark, d)


@query("WITH " + O.LOG + f" SELECT source_id, stage, count(*)::BIGINT AS runs, count(*) FILTER (status='completed')::BIGINT AS completed, count(*) FILTER (status='failed')::BIGINT AS failed, count(*) FILTER (cache_reused)::BIGINT AS cache_reused, round(sum(try_cast(duration_text AS DOUBLE)),6) AS seconds FROM lg WHERE {_CURRENT} GROUP BY 1,2")
def runtime_rollup(spark, d):
    rows = _log(spark, d).filter("coalesce(run_id, '') = '' or run_id = 'O'")
    return rows.groupBy("source_id", "stage").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("cache_reused").alias("cache_reused"), r6(F.sum(F.col("duration_text").try_cast("double"))).alias("seconds"))


@query("WITH " + O.LOG + " SELECT stage, round(sum(try_cast(duration_text AS DOUBLE)),6) AS seconds, round(avg(try_cast(duration_text AS DOUBLE)),6) AS mean_seconds FROM lg WHERE stage NOT LIKE 'sleep%' GROUP BY 1")
def runtime_by_stage(spark, d):
    s = F.col("duration_text").try_cast("double")
    return _log(spark, d).filter("stage not like 'sleep%'").groupBy("stage").agg(r6(F.sum(s)).alias("seconds"), r6(F.avg(s)).alias("mean_seconds"))


_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax"


@query("WITH " + O.LOG + f", k AS (SELECT *, row_number() OVER (PARTITION BY video_id, stage ORDER BY {', '.join(c + ' DESC' for c in _SEQ.split(', '))}) rn FROM lg) SELECT video_id, max(status) FILTER (stage='A') AS a, max(status) FILTER (stage='N') AS n, max(status) FILTER (stage='R') AS r FROM k WHERE rn=1 GROUP BY 1")
def completion_matrix(spark, d):
    """The last status of each recording and stage."""
    last = _log(spark, d).groupBy("video_id", "stage").agg(F.max_by("status", "seq").alias("status"))
    return last.groupBy("video_id").pivot("stage").agg(F.first("status")).select("video_id", *(F.col(c).alias(c.lower()) for c in sorted(r["stage"] for r in _log(spark, d).select("stage").distinct().collect())))  # a row a stage


@query("WITH " + O.DIST + " SELECT video_id, segment_id, round(max(bal),6) AS score FROM dd GROUP BY 1,2")
def score_heatmap(spark, d):
    """The cells of the heat map in long form, so that recordings of any length are whole."""
    return _distances(spark, d).groupBy("video_id", "segment_id").agg(r6(F.max("balanced")).alias("score"))


@query("WITH " + O.DIST + " SELECT video_id, segment_id, round(bal,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY bal DESC, segment_id) rn FROM dd WHERE video_no>=5) WHERE rn=1")
def worst_segment(spark, d):
    rows = _distances(spark, d).filter("video_no >= 5")
    return rows.groupBy("video_id").agg(F.max_by(F.struct("segment_id", "balanced"), F.struct(F.col("balanced"), -F.col("segment_id"))).alias("w")).select("video_id", "w.segment_id", r6("w.balanced").alias("score"))


@query("WITH " + O.DIST + " SELECT transformation, round(avg(bal),6) AS mean_score, round(max(ds),6) AS max_spatial, count(*)::BIGINT AS segments FROM dd GROUP BY 1")
def score_by_transformation(spark, d):
    return _distances(spark, d).groupBy("transformation").agg(r6(F.avg("balanced")).alias("mean_score"), r6(F.max("spatial_distance")).alias("max_spatial"), F.count(F.lit(1)).alias("segments"))


# --- authentication --------------------------------------------------------------------------------------------------


def _payloads(spark, d):
    """The canonical payload of every recording."""
    coded = _digests(spark, d).select("source_id", "video_id", "segment_id", F.concat("resnet_bits", "temporal_bits", "spatial_bits").alias("bits"), (F.col("segment_id") * 5.0).alias("start_s"), (F.col("segment_id") * 5.0 + 5.0).alias("end_s"))
    return records.payloads(coded)


_KEY = auth.demonstration_key().ljust(64, b"\0")
_HMAC = "sha256(unhex('" + bytes(b ^ 0x5C for b in _KEY).hex() + "')||unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in _KEY).hex() + "')||encode({p}))))"
_RECORDS = "WITH " + O.CODE + """, bits AS (SELECT source_id, video_id, segment_id, string_agg(CASE WHEN pos<=40 THEN c::VARCHAR ELSE (c>>1)::VARCHAR||(c&1)::VARCHAR END, '' ORDER BY pos) AS s FROM code GROUP BY 1,2,3),
 px AS (SELECT source_id, video_id, segment_id, string_agg(printf('%02x', list_reduce([substr(s, i*8+j, 1)::INT FOR j IN range(1,9)], lambda a, b: a*2+b)), '' ORDER BY i) AS h FROM bits, (SELECT unnest(range(0,11)) AS i) GROUP BY 1,2,3),
 pl AS (SELECT source_id, video_id, '{"bits":88,"schema_version":"1","segments":['||string_agg('{"digest":"'||h||'","end_us":'||(segment_id+1)*5000000::BIGINT||',"segment_id":'||segment_id||',"start_us":'||segment_id*5000000::BIGINT||'}', ',' ORDER BY segment_id)||'],"source_id":"'||source_id||'","video_id":"'||video_id||'"}' AS payload FROM px GROUP BY 1,2),
 rc AS (SELECT source_id, video_id, payload, '1' AS schema_version, 'HMAC-SHA-256' AS algorithm, sha256(payload) AS payload_sha256, 'demonstration' AS key_id, '""" + auth.key_fingerprint(auth.demonstration_key()) + "' AS key_fingerprint, " + _HMAC.format(p="payload") + " AS tag FROM pl)"


@query(_RECORDS + " SELECT * FROM rc")
def hmac_records(spark, d):
    """Signed records. The workers derive the catalogue's public demonstration key by themselves; real keys come from files or variables."""
    return records.sign(_payloads(spark, d), "demonstration", auth.key_fingerprint(auth.demonstration_key()), auth.DEMONSTRATION)


_SPOIL = {"schema_version": 1, "algorithm": 2, "payload_sha256": 3, "key_fingerprint": 4, "tag": 5}
_SPOILT = ", ".join(f"CASE WHEN k={n} THEN '00'||substr({c},3) ELSE {c} END AS {c}" for c, n in _SPOIL.items())


@query(_RECORDS + f""", kc AS (SELECT *, (('0x'||substr(sha256(video_id),1,8))::BIGINT%6)::INT AS k FROM rc), sp AS (SELECT video_id, k, payload, tag AS true_tag, key_fingerprint AS true_key, payload_sha256 AS true_hash, {_SPOILT} FROM (SELECT * FROM kc)),
 ck AS (SELECT video_id, k AS "case", schema_version='1' AS schema_ok, algorithm='HMAC-SHA-256' AS algorithm_ok, payload_sha256=true_hash AS payload_ok, key_fingerprint=true_key AS key_ok, tag=true_tag AS tag_ok FROM sp)
 SELECT *, schema_ok AND algorithm_ok AND payload_ok AND key_ok AND tag_ok AS valid, concat_ws('; ', CASE WHEN NOT schema_ok THEN 'unsupported schema' END, CASE WHEN NOT algorithm_ok THEN 'unsupported algorithm' END, CASE WHEN NOT payload_ok THEN 'payload hash mismatch' END, CASE WHEN NOT key_ok THEN 'key fingerprint mismatch' END, CASE WHEN NOT tag_ok THEN 'tag mismatch' END) AS reasons FROM ck""")
def verify_matrix(spark, d):
    """Checks of records of which every fifth field is spoiled in turn."""
    r = hmac_records(spark, d).withColumn("case", (F.conv(F.substring(F.sha2("video_id", 256), 1, 8), 16, 10).cast("bigint") % 6).cast("int"))
    for column, case in _SPOIL.items():
        r = r.withColumn(column, F.when(F.col("case") == case, F.concat(F.lit("00"), F.substring(F.col(column), 3, 200))).otherwise(F.col(column)))
    checked = records.verify(r, auth.key_fingerprint(auth.demonstration_key()), auth.DEMONSTRATION)
    return checked.select("video_id", "case", "schema_ok", "algorithm_ok", "payload_ok", "key_ok", "tag_ok", "valid", "reasons")


@query("WITH " + O.LOG + ", " + O.PRED + " SELECT reason, count(*)::BIGINT AS n FROM (SELECT 'stage failed: '||stage AS reason FROM lg WHERE status='failed' UNION ALL SELECT 'expected '||expected||', observed '||observed FROM pd WHERE expected<>observed) GROUP BY 1")
def failure_summary(spark, d):
    return reports.failures(_log(spark, d), A.predictions(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + O.LOG + " SELECT source_id, count(*)::BIGINT AS runs, count(*) FILTER (status='completed')::BIGINT AS completed, count(*) FILTER (status='failed')::BIGINT AS failed, count(*) FILTER (cache_reused)::BIGINT AS cache_reused, round(sum(try_cast(duration_text AS DOUBLE)),6) AS seconds FROM lg GROUP BY 1")
def runtime_by_source(spark, d):
    return reports.runtime(_log(spark, d), ["source_id"])


@query("WITH " + _LOSO_SQL + ", mv AS (SELECT source_id, video_id, max(bal) mx FROM dd GROUP BY 1,2) SELECT video_id, round(mx,6) AS max_value, round(threshold,6) AS threshold, mx>threshold AS exceeds FROM mv JOIN th ON th.held_out=mv.source_id AND th.stream='balanced'")
def max_with_fold_threshold(spark, d):
    rows, limits = _loso(spark, d)
    top = rows.groupBy("source_id", "video_id").agg(F.max("balanced").alias("max_value"))
    out = reports.with_fold_threshold(top, limits.filter("stream = 'balanced'").select("held_out", "threshold"))
    return out.select("video_id", r6("max_value").alias("max_value"), r6("threshold").alias("threshold"), "exceeds")


@query("WITH " + O.DIST + " SELECT video_id, segment_id, round(bal,6) AS score, row_number() OVER (PARTITION BY video_id ORDER BY segment_id)::INT AS place FROM dd")
def segment_timeline(spark, d):
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("segment_id"))
    return _distances(spark, d).select("video_id", "segment_id", r6("balanced").alias("score"), place.alias("place"))


@query("WITH " + O.REG + " SELECT video_id, coalesce(size/1000.0::DOUBLE,0) AS duration, coalesce(width,0)||'x'||coalesce(height,0) AS resolution, coalesce(CASE fps_text WHEN '30/1' THEN 30.0::DOUBLE WHEN '30000/1001' THEN round(30000/1001::DOUBLE,6) WHEN '25/1' THEN 25 WHEN '24' THEN 24 END,0) AS fps, round(coalesce(size*8/1e6,0),6) AS mbps FROM rg")
def metadata_overview(spark, d):
    r = A.registry(spark, d).withColumn("duration", F.col("size") / 1000.0).withColumn("fps", S.frame_rate(F.col("fps_text"))).withColumn("bit_rate", F.col("size") * 8.0)
    return reports.overview(r).withColumn("fps", r6("fps")).withColumn("mbps", r6("mbps"))


# --- validation and further reports ----------------------------------------------------------------------------------


@query("WITH " + O.DIST + """, vi AS (SELECT count(*) FILTER (NOT (dr BETWEEN 0 AND 1 AND dt BETWEEN 0 AND 1 AND ds BETWEEN 0 AND 1)) a, count(*) FILTER (video_no=0 AND (dr>0 OR dt>0 OR ds>0)) b, count(*) FILTER (hybrid_raw<>round(dr*40)+round(dt*24)+round(ds*24)) c, count(*)-count(DISTINCT (video_id, segment_id)) d FROM dd),
 ru AS (SELECT unnest(['unit_interval','self_distance_zero','hybrid_is_sum','unique_segments']) AS rule, unnest([a,b,c,d])::BIGINT AS violations FROM vi) SELECT rule, violations, violations=0 AS passed FROM ru""")
def output_validation(spark, d):
    both = _digests(spark, d).withColumn("hybrid_bits", F.concat("resnet_bits", "temporal_bits", "spatial_bits"))
    return validation.distance_rules(compare.distances(both, ["source_id"], BITS | {"hybrid": sum(BITS.values())}))


@query("WITH " + O.SV + " SELECT source_id, count(*)::BIGINT AS rows, max(len(embedding[1:40]))::INT AS resnet_size, max(len(embedding[41:52]))::INT AS temporal_size, max(len(embedding[53:64]))::INT AS spatial_size, bool_and(isfinite(list_sum(embedding)) AND isfinite(list_sum(list_transform(embedding, lambda x: abs(x))))) AS finite FROM sv GROUP BY 1")
def feature_inventory(spark, d):
    return validation.inventory(A.seg_vectors(spark, d), ["resnet", "temporal", "spatial"], ["source_id"])


@query("WITH " + O.SV + " SELECT video_id, segment_id, CASE WHEN video_no<3 THEN (CASE WHEN segment_id%2=0 THEN segment_id*5.0::DOUBLE END) ELSE segment_id*5.0::DOUBLE+0.5 END AS start_s FROM sv")
def segment_times_lookup(spark, d):
    rows = A.seg_vectors(spark, d).select("video_id", "video_no", "segment_id")
    first = rows.filter("video_no < 3 and segment_id % 2 = 0").select("video_id", "segment_id", (F.col("segment_id") * 5.0).alias("start_s"))
    second = rows.select("video_id", "segment_id", (F.col("segment_id") * 5.0 + 0.5).alias("start_s"))
    return validation.segment_times(rows, first, second).select("video_id", "segment_id", "start_s")


_POOLED = O.DIST + _STREAM_SQL + f""", md AS (SELECT stream, median(val) md FROM u WHERE {_BENIGN} GROUP BY 1), mm AS (SELECT stream, least(1,greatest(0,max(val)+greatest(3*median(abs(val-md)),max(res)))) t FROM u JOIN md USING (stream) WHERE {_BENIGN} GROUP BY 1),
 tw AS (SELECT max(t) FILTER (stream='resnet') tr, max(t) FILTER (stream='temporal') tt, max(t) FILTER (stream='balanced') tb FROM mm)"""


@query("WITH " + _POOLED + " SELECT video_id, segment_id, CASE WHEN dr>tr AND dt>tt THEN 'both_streams' WHEN dr>tr THEN 'resnet_only' WHEN dt>tt THEN 'temporal_only' WHEN bal>tb AND dr>dt THEN 'resnet_only' WHEN bal>tb AND dt>dr THEN 'temporal_only' WHEN bal>tb THEN 'both_streams' ELSE 'none' END AS attribution FROM dd, tw")
def pooled_decisions(spark, d):
    """Decisions with one threshold a stream for all sources; an even balanced excess goes to both streams."""
    rows = _keep(spark)(_distances(spark, d))
    t = _stream_thresholds(_stream_values(rows).filter("video_no between 1 and 4"), [])
    wide = t.agg(*(F.max(F.when(F.col("stream") == s, F.col("threshold"))).alias(f"t_{s}") for s in ("resnet", "temporal", "balanced")))
    found = rows.crossJoin(F.broadcast(wide))  # one row
    over = [F.col("resnet_distance") > F.col("t_resnet"), F.col("temporal_distance") > F.col("t_temporal"), F.col("balanced") > F.col("t_balanced")]
    label = evaluation.attribution(F.lit(False), F.col("resnet_distance"), F.col("temporal_distance"), F.col("balanced"), *over, tie="both_streams")
    return found.select("video_id", "segment_id", label.alias("attribution"))


@query("WITH " + O.PRED + " SELECT source_id, transformation, round(avg((observed='abnormal')::INT),6) AS rate FROM pd GROUP BY 1,2")
def rate_pivot(spark, d):
    """Abnormal rates by group and transformation, a row a cell; cells without rows are absent."""
    p = A.predictions(spark, d).withColumn("rate", (F.col("observed") == "abnormal").cast("double"))
    return p.groupBy("source_id", "transformation").agg(r6(F.avg("rate")).alias("rate"))


@query("WITH " + O.REG + ", " + O.HITS + " SELECT video_id, coalesce(nullif(list_position(['trusted_reference','avi_conversion','mov_conversion','resize_480p','resize_720p','blur','frame_deletion','frame_insertion','frame_replacement'], t2), 0)-1, 99)::INT AS place, least(300.0::DOUBLE, greatest(30.0::DOUBLE, coalesce(width,0)*height/5000.0::DOUBLE)) AS point_size FROM cl")
def transformation_order(spark, d):
    pixels = F.coalesce("width", F.lit(0)) * F.col("height")
    return _registry(spark, d).select("video_id", S.transformation_order(F.col("t2")).alias("place"), reports.point_size(pixels).alias("point_size"))


@query("WITH " + O.LOG + " SELECT run_id, count(*)::BIGINT AS rows FROM lg WHERE run_id='O' GROUP BY 1")
def current_run_strict(spark, d):
    """The exact-match reading of the current run: blank ids are left out."""
    return _log(spark, d).filter("run_id = 'O'").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
