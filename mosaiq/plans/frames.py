"""Queries of the pixel operators over small frames made from the vectors of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.operators import compare, pixels, segments
from mosaiq.plans.catalog import query, r6
from mosaiq.sources import adapters as A

_KEYS = ["video_id", "segment_id"]
_PX = """fr AS (SELECT label AS video_id, rn//9 AS segment_id, rn%9 AS frame_index, list_transform(embedding, lambda v: greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v::DOUBLE+1)/2))) AS img FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS rn FROM embeddings)),
 px AS (SELECT video_id, segment_id, frame_index, unnest(img) AS x, (generate_subscripts(img,1)-1)//8 AS i, (generate_subscripts(img,1)-1)%8 AS j FROM fr)"""
_GRAD = """, w(di,dj,wx,wy,wl) AS (VALUES (-1,-1,-1,-1,2),(-1,0,0,-2,0),(-1,1,1,-1,2),(0,-1,-2,0,0),(0,0,0,0,-8),(0,1,2,0,0),(1,-1,-1,1,2),(1,0,0,2,0),(1,1,1,1,2)),
 nb AS (SELECT p.*, wx, wy, wl, CASE WHEN p.i+di>7 THEN 14-p.i-di ELSE abs(p.i+di) END AS ni, CASE WHEN p.j+dj>7 THEN 14-p.j-dj ELSE abs(p.j+dj) END AS nj FROM px p, w),
 gr AS (SELECT nb.video_id, nb.segment_id, nb.frame_index, nb.i, nb.j, any_value(nb.x) AS x, sum(wx*q.x) AS gx, sum(wy*q.x) AS gy, sum(wl*q.x) AS lap FROM nb JOIN px q ON q.video_id=nb.video_id AND q.segment_id=nb.segment_id AND q.frame_index=nb.frame_index AND q.i=ni AND q.j=nj GROUP BY ALL)"""
_NAMES = [f"{s}_{f}" for s in ("mean", "std", "max") for f in segments.PAIR_FEATURES]
_STATS = {"mean": "avg", "std": "stddev_pop", "max": "max"}
_PAIR_SQL = "WITH " + _PX + _GRAD + """, dp AS (SELECT a.video_id, a.segment_id, a.frame_index AS pair_index, abs(b.x-a.x) AS d, abs(sqrt(b.gx*b.gx+b.gy*b.gy)-sqrt(a.gx*a.gx+a.gy*a.gy)) AS e FROM gr a JOIN gr b ON b.video_id=a.video_id AND b.segment_id=a.segment_id AND b.frame_index=a.frame_index+1 AND b.i=a.i AND b.j=a.j),
 pf AS (SELECT video_id, segment_id, pair_index, avg(d) AS mad, stddev_pop(d) AS absdiff_std, sqrt(avg(d*d)) AS rmse, avg((d>20/255.0::DOUBLE)::INT) AS changed_ratio, quantile_cont(d,0.9) AS p90, avg((e>20/255.0::DOUBLE)::INT) AS edge_change FROM dp GROUP BY 1,2,3) """


@query(_PAIR_SQL + "SELECT video_id, segment_id, " + ", ".join(f"round({_STATS[n.split('_')[0]]}({n.split('_', 1)[1]}),9) AS {n}" for n in _NAMES) + " FROM pf GROUP BY 1,2")
def pixel_temporal_vector(spark, d):
    """The 18 temporal values of each segment, from its frames' pixels."""
    pairs = pixels.frame_pairs(A.pixel_frames(spark, d), _KEYS, size=0, kernel=0)
    return segments.temporal_vector(pairs, _KEYS).select(*_KEYS, *(F.round(n, 9).alias(n) for n in _NAMES))


_DCT = """, dk AS (SELECT k, y, cos(pi()*(2*y+1)*k/(2*{n}))*sqrt(2.0::DOUBLE/{n})/(CASE WHEN k=0 THEN sqrt(2.0::DOUBLE) ELSE 1 END) AS c FROM range(0,8) a(k), range(0,{n}) b(y))"""


@query("WITH " + _PX + _GRAD + _DCT.format(n=8) + """, tk AS (SELECT video_id, segment_id, frame_index, a.k AS k, b.k AS l, sum(a.c*b.c*x) AS t FROM px JOIN dk a ON a.y=px.i JOIN dk b ON b.y=px.j GROUP BY ALL),
 en AS (SELECT video_id, segment_id, frame_index, sum(t*t) AS total, sum(t*t) FILTER (k<2 AND l<2) AS low FROM tk GROUP BY 1,2,3), sg AS (SELECT video_id, segment_id, frame_index, var_pop(lap) AS vl, avg(gx*gx+gy*gy) AS tg FROM gr GROUP BY 1,2,3)
 SELECT video_id, segment_id, frame_index::INT AS frame_index, round(vl,6) AS variance_laplacian, round(tg,6) AS tenengrad_sharpness, round((total-low)/total,6) AS high_frequency_dct_energy_ratio FROM sg JOIN en USING (video_id, segment_id, frame_index)""")
def pixel_sharpness(spark, d):
    """Laplacian, gradient and high-frequency measures of each frame; edges and local contrast have brute-force tests."""
    found = pixels.frame_sharpness(A.pixel_frames(spark, d), [*_KEYS, "frame_index"], size=0, lowest=2)
    return found.select(*_KEYS, "frame_index", *(r6(c).alias(c) for c in ("variance_laplacian", "tenengrad_sharpness", "high_frequency_dct_energy_ratio")))


_HASH = "WITH " + _PX + _DCT.format(n=32) + """, pl AS (SELECT y, least(greatest((y+0.5::DOUBLE)*8/32-0.5, 0), 7) AS place FROM range(0,32) t(y)), li AS (SELECT y, place, least(floor(place)::INT, 6) AS low FROM pl),
 lw AS (SELECT y, low AS i, 1-(place-low) AS c FROM li UNION ALL SELECT y, low+1, place-low FROM li), ak AS (SELECT k, i, sum(dk.c*lw.c) AS c FROM dk JOIN lw USING (y) GROUP BY 1,2),
 tk AS (SELECT video_id, segment_id, frame_index, a.k*8+b.k AS n, CASE WHEN a.k=0 AND b.k=0 THEN 0 ELSE sum(a.c*b.c*x) END AS t FROM px JOIN ak a ON a.i=px.i JOIN ak b ON b.i=px.j GROUP BY video_id, segment_id, frame_index, a.k, b.k),
 bt AS (SELECT video_id, segment_id, frame_index, n, t > avg(t) OVER (PARTITION BY video_id, segment_id, frame_index) AS bit FROM tk)"""


@query(_HASH + " SELECT video_id, segment_id, frame_index::INT AS frame_index, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY n) AS bits FROM bt GROUP BY 1,2,3")
def pixel_hashes(spark, d):
    """The 64 bits of each frame's hash."""
    found = pixels.frame_hashes(A.pixel_frames(spark, d), [*_KEYS, "frame_index"])
    return found.select(*_KEYS, "frame_index", F.lpad(F.bin("hash64"), 64, "0").alias("bits"))


@query(_HASH + """, pd AS (SELECT a.video_id//2 AS g, a.segment_id, a.frame_index, sum((a.bit<>b.bit)::INT)/64.0::DOUBLE AS dist FROM bt a JOIN bt b ON b.video_id=a.video_id+1 AND b.segment_id=a.segment_id AND b.frame_index=a.frame_index AND b.n=a.n WHERE a.video_id%2=0 GROUP BY 1,2,3),
 sm AS (SELECT g, segment_id, avg(dist) AS score FROM pd GROUP BY 1,2), st AS (SELECT g, bool_or(c=1) AS structural FROM (SELECT video_id//2 AS g, segment_id, count(DISTINCT video_id) AS c FROM fr GROUP BY 1,2) GROUP BY 1)
 SELECT st.g, round(max(score),6) AS video_score, structural, CASE WHEN max(score)>0.45 OR structural THEN 'abnormal' ELSE 'normal' END AS observed FROM st JOIN sm USING (g) GROUP BY st.g, structural""")
def pixel_hash_decisions(spark, d):
    """Recordings judged by the hashes of their frames: pairs, segment means and the decision."""
    frames = pixels.frame_hashes(A.pixel_frames(spark, d), [*_KEYS, "frame_index"]).withColumn("offset_s", F.lit(0.0)).withColumn("g", F.floor(F.col("video_id") / 2))
    sides = [frames.filter(f"video_id % 2 = {k}") for k in (0, 1)]
    scores = compare.hash_segments(compare.hash_pairs(*sides, ["g", "segment_id", "frame_index"]), ["g"])
    found = compare.hash_video_decision(scores, compare.hash_structure(*sides, ["g"]), ["g"], F.lit(0.45))
    return found.select("g", r6("video_score").alias("video_score"), "structural", "observed")
