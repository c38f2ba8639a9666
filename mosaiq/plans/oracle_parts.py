"""DuckDB SQL of the logical tables and of the shared steps, for the oracle queries."""

SV = """sv AS (SELECT 'SRC_'||label AS source_id, 'SRC_'||label||'_V'||(rn%9) AS video_id, (rn%9)::INT AS video_no,
 ['trusted_reference','avi_conversion','mov_conversion','resize_480p','resize_720p','blur','frame_deletion','frame_insertion','frame_replacement'][(rn%9)::INT+1] AS transformation,
 (rn//9)::INT AS segment_id, CASE WHEN rn%9<=4 THEN 'normal' ELSE 'abnormal' END AS expected,
 ['.mp4:source_res','.avi:source_res','.mov:source_res','.mp4:480p','.mp4:720p','.mp4:source_res','.mp4:480p','.mp4:720p','.mkv:unknown_res'][(rn%9)::INT+1] AS profile, embedding
 FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS rn FROM embeddings))"""
LV = SV + """, lv AS (SELECT source_id, video_id, video_no, transformation, segment_id, expected, profile, unnest(embedding) AS v, generate_subscripts(embedding,1)::INT AS pos FROM sv)"""
FIT = LV + """, fit AS (SELECT pos, quantile_cont(v::DOUBLE,0.25) q1, quantile_cont(v::DOUBLE,0.5) med, quantile_cont(v::DOUBLE,0.75) q3, count(*) n FROM lv WHERE video_no<=4 GROUP BY pos),
 m AS (SELECT *, greatest(q3-q1,1e-8) safe FROM fit),
 nx AS (SELECT lv.*, least(5.0::DOUBLE, greatest(-5.0::DOUBLE, (v::DOUBLE-med)/safe))::FLOAT x, ((q1-med)/safe)::FLOAT t1, ((q3-med)/safe)::FLOAT t3 FROM lv JOIN m USING (pos))"""
CODE_OF = """CASE WHEN pos<=40 THEN (x>=0::FLOAT)::INT ELSE xor(b, b>>1) END"""
BINS = """CASE WHEN x>=t3 THEN 3 WHEN x>=0::FLOAT THEN 2 WHEN x>=t1 THEN 1 ELSE 0 END"""
CODE = FIT + f""", bn AS (SELECT *, {BINS} AS b FROM nx), code AS (SELECT *, {CODE_OF} AS c FROM bn)"""
DIST_SELECT = """SELECT {k} q.source_id, q.video_id, q.video_no, q.transformation, q.expected, q.profile, q.segment_id,
 sum(CASE WHEN q.pos<=40 THEN bit_count(xor(q.c,r.c)) ELSE 0 END)/40.0::DOUBLE AS dr,
 sum(CASE WHEN q.pos>40 AND q.pos<=52 THEN bit_count(xor(q.c,r.c)) ELSE 0 END)/24.0::DOUBLE AS dt,
 sum(CASE WHEN q.pos>52 THEN bit_count(xor(q.c,r.c)) ELSE 0 END)/24.0::DOUBLE AS ds,
 sum(bit_count(xor(q.c,r.c)))::BIGINT AS hybrid_raw,
 sum(CASE WHEN q.pos>52 THEN greatest(greatest(r.v::DOUBLE,0)-greatest(q.v::DOUBLE,0),0)/greatest(greatest(r.v::DOUBLE,0),1e-8) ELSE 0 END)/12 AS blur
 FROM code q JOIN code r ON r.source_id=q.source_id AND r.video_no=0 AND r.segment_id=q.segment_id AND r.pos=q.pos {j} GROUP BY ALL"""
DIST = CODE + ", d AS (" + DIST_SELECT.format(k="", j="") + "), dd AS (SELECT *, 0.5*dr+0.5*dt AS bal FROM d)"
STRUCT = """, st AS (SELECT source_id, video_id, sum((o IS NULL)::INT)::BIGINT AS missing_segments, sum((r IS NULL)::INT)::BIGINT AS extra_segments FROM
 (SELECT coalesce(a.source_id,b.source_id) source_id, coalesce(a.video_id,b.video_id) video_id, a.segment_id r, b.segment_id o FROM
 (SELECT DISTINCT v.source_id, v.video_id, s.segment_id FROM sv v JOIN sv s ON s.source_id=v.source_id AND s.video_no=0) a
 FULL JOIN (SELECT DISTINCT source_id, video_id, segment_id FROM sv) b ON a.source_id=b.source_id AND a.video_id=b.video_id AND a.segment_id=b.segment_id) GROUP BY 1,2)"""
FRAMES = """fr AS (SELECT user_id AS video_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS segment_id, (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)-1)::INT AS frame_index,
 epoch_us(ts)/1e6 AS ts_s, value, event_type <> 'error' AS success, ('0x'||substr(sha256(event_id::VARCHAR),1,15))::BIGINT AS hash64 FROM events)"""
PAIRS = FRAMES + """, nx AS (SELECT *, lead(frame_index) OVER w nf, lead(ts_s) OVER w nt, lead(value) OVER w nv, lead(success) OVER w ns FROM fr WINDOW w AS (PARTITION BY video_id, segment_id ORDER BY frame_index)),
 pr AS (SELECT video_id, segment_id, frame_index AS pair_index, success AND ns AS ok, CASE WHEN success AND ns THEN abs(nv-value) END AS change, CASE WHEN success AND ns THEN (ts_s+nt)/2 END AS middle_s FROM nx WHERE nf IS NOT NULL)"""
TURNS = """tn AS (SELECT conv_id, turn AS segment_id, turn*5000000+(length(text)%3)*1000 AS start_us FROM conversations),
 al AS (SELECT coalesce(r.conv_id, q.conv_id-1) AS conv_id, coalesce(r.segment_id,q.segment_id) AS segment_id, r.start_us AS ref_start, q.start_us AS query_start,
 CASE WHEN q.conv_id IS NULL THEN 'missing_in_query' WHEN r.conv_id IS NULL THEN 'extra_in_query' WHEN abs(r.start_us-q.start_us)<=1000 THEN 'matched' ELSE 'timestamp_mismatch' END AS state
 FROM (SELECT * FROM tn WHERE conv_id%2=0) r FULL JOIN (SELECT * FROM tn WHERE conv_id%2=1) q ON q.conv_id=r.conv_id+1 AND q.segment_id=r.segment_id)"""
PRED = """pd AS (SELECT source AS source_id, doc_id AS video_id, lang AS transformation, CASE WHEN toxic=1 THEN 'abnormal' ELSE 'normal' END AS expected, CASE WHEN quality=0 THEN 'abnormal' ELSE 'normal' END AS observed FROM labels JOIN documents USING (doc_id))"""


def counts(by: str, source: str = "pd") -> str:
    cell = lambda e, o, n: f"count(*) FILTER (expected='{e}' AND observed='{o}') AS {n}"
    cells = ", ".join((cell("abnormal", "abnormal", "tp"), cell("normal", "normal", "tn"), cell("normal", "abnormal", "fp"), cell("abnormal", "normal", "fn")))
    return f"SELECT {by + ', ' if by else ''}{cells} FROM {source}" + (f" GROUP BY {by}" if by else "")


def metrics(source: str, keys: str, zero: bool = False) -> str:
    z = (lambda e: f"coalesce({e},0)") if zero else (lambda e: e)
    k = keys + ", " if keys else ""
    return f"""SELECT {k}tp,tn,fp,fn, accuracy, precision, recall, {z('2*precision*recall/nullif(precision+recall,0)')} AS f1, specificity, {z('(recall+specificity)/2')} AS balanced_accuracy, far, frr FROM
 (SELECT {k}tp,tn,fp,fn, {z('(tp+tn)/nullif((tp+tn+fp+fn)::DOUBLE,0)')} AS accuracy, {z('tp/nullif((tp+fp)::DOUBLE,0)')} AS precision, {z('tp/nullif((tp+fn)::DOUBLE,0)')} AS recall, {z('tn/nullif((tn+fp)::DOUBLE,0)')} AS specificity, {z('fn/nullif((tp+fn)::DOUBLE,0)')} AS far, {z('fp/nullif((tn+fp)::DOUBLE,0)')} AS frr FROM {source})"""


METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "far", "frr")


def long_metrics(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {m} AS value FROM {source}" for m in METRIC_NAMES)


REG = """rg AS (SELECT 'SRC_'||upper(source) AS source_id, doc_id AS video_id, ['original.mp4','take_avi.avi','take.mov','clip_480p.mp4','clip_720.mp4','blurred.mp4','frame_del_x.mp4','insert-1.mp4','swap.mp4','blur_480.mp4','other.mkv'][(doc_id%11)::INT+1] AS filename,
 sha256(text) AS sha256, strlen(text)::BIGINT AS size, CASE WHEN doc_id%7<>0 THEN (320+(doc_id%13)*100)::INT END AS width, (240+(doc_id%5)*150)::INT AS height, ['30/1','30000/1001','25/1','invalid','0/0','24'][(doc_id%6)::INT+1] AS fps_text FROM documents)"""
EXT = "CASE WHEN contains(filename,'.') THEN '.'||regexp_extract(filename,'\\.([^.]+)$',1) ELSE '' END"
STEM = "regexp_replace(filename,'\\.[^.]*$','')"
HITS = f"""rl AS (SELECT *, {STEM} AS stem, {EXT} AS ext FROM rg), hs AS (SELECT *, list_filter([
 CASE WHEN regexp_matches(filename,'blur') THEN 'blur' END,
 CASE WHEN regexp_matches(filename,'delete|deletion|frame_del|(^|[_-])del($|[_.-])') OR stem IN ('del','fdel') THEN 'frame_deletion' END,
 CASE WHEN regexp_matches(filename,'insert|nsert') THEN 'frame_insertion' END,
 CASE WHEN regexp_matches(filename,'replace|swap') THEN 'frame_replacement' END,
 CASE WHEN contains(stem,'480') THEN 'resize_480p' END, CASE WHEN contains(stem,'720') THEN 'resize_720p' END,
 CASE WHEN ext='.avi' OR contains(stem,'avi') THEN 'avi_conversion' END, CASE WHEN ext='.mov' OR contains(stem,'mov') THEN 'mov_conversion' END], lambda x: x IS NOT NULL) AS h FROM rl),
 cl AS (SELECT *, CASE WHEN len(h)=1 THEN h[1] WHEN len(h)>1 THEN 'ambiguous' ELSE 'unsupported_video' END AS t1,
 CASE WHEN filename='original.mp4' THEN 'trusted_reference' WHEN contains(filename,'blur') THEN 'blur' WHEN regexp_matches(filename,'delete|deletion') THEN 'frame_deletion' WHEN regexp_matches(filename,'replace') THEN 'frame_replacement' WHEN regexp_matches(filename,'nsert') THEN 'frame_insertion'
 WHEN ext='.avi' OR contains(stem,'avi') THEN 'avi_conversion' WHEN ext='.mov' OR contains(stem,'mov') THEN 'mov_conversion' WHEN contains(stem,'480') THEN 'resize_480p' WHEN contains(stem,'720') THEN 'resize_720p' ELSE 'unclassified' END AS t2 FROM hs)"""
LOG = """lg AS (SELECT CASE WHEN o_orderstatus='F' THEN '' ELSE o_orderstatus END AS run_id, l_linestatus AS source_id, o_orderpriority AS video_id, l_returnflag AS stage, CASE WHEN l_discount>0.05 THEN 'failed' ELSE 'completed' END AS status, l_tax<0.02 AS cache_reused,
 CASE WHEN l_linenumber=7 THEN 'bad' ELSE l_quantity::INT::VARCHAR END AS duration_text, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""
THR = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, max({v}) + greatest({m}*{mad}, {r})))"
