"""The views of ``views.py`` as SQL, for the independent check of query results."""

from __future__ import annotations

B = 1_704_067_200_000
_DET = "(((l_partkey*100000 + l_suppkey)*10 + l_linenumber)*100 + CAST(l_quantity AS BIGINT))"
_LINE = f"concat('cam_', l_orderkey % 4) AS camera_id, l_orderkey // 4 + 1 AS frame_number, {B} + l_orderkey*200 AS t"

VIEWS: dict[str, tuple[list[str], str]] = {
    "cameras": ([], "SELECT concat('cam_', i) AS camera_id, 0.5::DOUBLE AS ex1, 0.0::DOUBLE AS ey1, 0.75::DOUBLE AS ex2, 0.6::DOUBLE AS ey2 FROM range(4) r(i)"),
    "zone_points": ([], """SELECT * FROM (VALUES
        (0,'A',1,0.0::DOUBLE,0.2::DOUBLE,4),(0,'A',2,0.4,0.2,4),(0,'A',3,0.4,1.0,4),(0,'A',4,0.0,1.0,4),
        (1,'B',1,0.7,0.3,4),(1,'B',2,1.0,0.3,4),(1,'B',3,1.0,1.0,4),(1,'B',4,0.7,1.0,4),
        (2,'C',1,0.2,0.1,3),(2,'C',2,0.8,0.5,3),(2,'C',3,0.2,1.0,3)) z(zone_ord,name,i,x,y,n)"""),
    "zone_edges": (["zone_points"], """SELECT p.zone_ord, p.name, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy
        FROM zone_points p JOIN zone_points q ON p.zone_ord = q.zone_ord AND q.i = CASE WHEN p.i = 1 THEN p.n ELSE p.i - 1 END"""),
    "edges": ([], """SELECT 2*i AS edge_ord, concat('cam_', i) AS from_camera, concat('cam_', (i+1)%4) AS to_camera,
            [0.7::DOUBLE,0.0,1.0,1.0] AS exit_zone, [0.0::DOUBLE,0.0,0.3,1.0] AS entry_zone, i + 2.0::DOUBLE AS max_handover_sec FROM range(4) r(i)
        UNION ALL SELECT 2*i+1, concat('cam_', (i+1)%4), concat('cam_', i), [0.0::DOUBLE,0.0,0.3,1.0], [0.7::DOUBLE,0.0,1.0,1.0], i + 2.0::DOUBLE FROM range(4) r(i)"""),
    "overlap_edges": ([], """SELECT 2*s_suppkey AS edge_ord, concat('cam_', s_nationkey) AS from_camera, concat('cam_', (s_nationkey*7+3)%25) AS to_camera,
            (s_suppkey%5)/10.0::DOUBLE AS exit_x1, 1.0::DOUBLE AS exit_x2, 0.0::DOUBLE AS entry_x1, (s_suppkey%7)/10.0::DOUBLE AS entry_x2,
            CASE WHEN s_suppkey%4 <> 0 THEN CAST(s_suppkey%10 AS DOUBLE) ELSE 3.0::DOUBLE END AS max_handover_sec FROM supplier
        UNION ALL SELECT 2*s_suppkey+1, concat('cam_', (s_nationkey*7+3)%25), concat('cam_', s_nationkey), 0.0::DOUBLE, (s_suppkey%7)/10.0::DOUBLE,
            (s_suppkey%5)/10.0::DOUBLE, 1.0::DOUBLE, CASE WHEN s_suppkey%4 <> 0 THEN CAST(s_suppkey%10 AS DOUBLE) ELSE 3.0::DOUBLE END FROM supplier"""),
    "zone_dim": ([], """SELECT CAST(s_suppkey AS BIGINT) AS zone_ord, concat('zone_', s_suppkey) AS name, concat('cam_', s_nationkey + d) AS camera_id, (s_suppkey%5)/10.0::DOUBLE AS px,
        CASE WHEN s_suppkey%4 <> 0 THEN CAST(s_suppkey%9 AS DOUBLE) ELSE 5.0::DOUBLE END AS max_handover_sec FROM supplier, range(2) r(d)"""),
    "frames": ([], f"""SELECT concat('cam_', event_id % 4) AS camera_id, event_id // 4 + 1 AS frame_number, {B} + event_id*200 AS t,
        1280 AS frame_w, 720 AS frame_h, value/10000.0::DOUBLE AS motion_ratio, event_type = 'purchase' AS active FROM events"""),
    "detections": ([], f"""SELECT *, x1 + 60 + 2*q AS x2, y1 + 120 + 6*q AS y2 FROM (SELECT {_LINE}, {_DET} AS det_id,
        CAST((l_partkey*37) % 1080 AS DOUBLE) AS x1, CAST((l_suppkey*53) % 300 AS DOUBLE) AS y1, l_quantity AS q,
        0.3::DOUBLE + 6*l_discount AS confidence, CASE WHEN l_linenumber % 7 = 0 THEN 1 ELSE 0 END AS class_id,
        1280 AS frame_w, 720 AS frame_h FROM lineitem)"""),
    "persons_seen": (["detections"], "SELECT * FROM detections WHERE class_id = 0 AND confidence >= 0.5::DOUBLE"),
    "kept": (["persons_seen", "cameras"], """SELECT d.* FROM persons_seen d WHERE NOT EXISTS (SELECT 1 FROM cameras c WHERE c.camera_id = d.camera_id
        AND (d.x1+d.x2)/2.0::DOUBLE/1280 BETWEEN c.ex1 AND c.ex2 AND (d.y1+d.y2)/2.0::DOUBLE/720 BETWEEN c.ey1 AND c.ey2)"""),
    "pairs": (["persons_seen"], """SELECT * FROM (SELECT camera_id, frame_number, id_a, id_b, inter / (aa + ab - inter) AS iou FROM (
        SELECT a.camera_id, a.frame_number, a.det_id AS id_a, b.det_id AS id_b, (a.x2-a.x1)*(a.y2-a.y1) AS aa, (b.x2-b.x1)*(b.y2-b.y1) AS ab,
        greatest(0.0::DOUBLE, least(a.x2,b.x2)-greatest(a.x1,b.x1)) * greatest(0.0::DOUBLE, least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS inter
        FROM persons_seen a JOIN persons_seen b ON a.camera_id = b.camera_id AND a.frame_number = b.frame_number AND a.det_id < b.det_id)) WHERE iou > 0.15::DOUBLE"""),
    "observations": ([], f"SELECT DISTINCT {_LINE}, l_suppkey % 20 AS track_id, (l_orderkey // 4) % 5 = 0 AS has_motion FROM lineitem"),
    "faces": ([], f"""SELECT *, x1 + side AS x2, y1 + side + ln AS y2 FROM (SELECT {_LINE}, l_suppkey % 5 AS track_id, {_DET} AS face_id,
        CAST(l_partkey % 900 AS DOUBLE) + l_linenumber*10 AS x1, CAST(l_suppkey % 200 AS DOUBLE) + l_partkey % 240 AS y1, 10 + l_quantity*3 AS side, l_linenumber AS ln,
        0.5::DOUBLE + l_tax*5 AS confidence, CAST(l_partkey % 900 AS DOUBLE) AS person_x1, CAST(l_suppkey % 200 AS DOUBLE) AS person_y1,
        CAST(l_partkey % 900 AS DOUBLE) + 150.5::DOUBLE AS person_x2, CAST(l_suppkey % 200 AS DOUBLE) + 400 AS person_y2 FROM lineitem)"""),
    "crops": ([], f"""SELECT {_LINE}, l_partkey AS track_id, {_DET} AS crop_id, CAST(20 + 3*l_quantity AS INT) AS width, CAST(60 + l_partkey % 300 AS INT) AS height,
        CAST(l_suppkey % 60 AS DOUBLE) AS mean_saturation, l_extendedprice % 800 AS laplacian_var FROM lineitem"""),
    "graded": (["crops"], """SELECT *, CASE WHEN size_ok AND colour_ok THEN raw_quality ELSE 0.0 END AS quality FROM (
        SELECT *, height >= 100 AND width >= 30 AS size_ok, mean_saturation >= 15.0 AS colour_ok,
        0.4::DOUBLE*least(1.0::DOUBLE, height*width/32768.0::DOUBLE)
        + 0.3::DOUBLE*(1.0::DOUBLE - least(1.0::DOUBLE, abs(height/(width+1e-6::DOUBLE) - 2.0::DOUBLE)/2.0::DOUBLE))
        + 0.3::DOUBLE*least(1.0::DOUBLE, laplacian_var/500.0::DOUBLE) AS raw_quality FROM crops)"""),
    "persons": ([], "SELECT DISTINCT CAST(label AS BIGINT) AS person_id, concat('person_', label) AS name, label <> 9 AS is_active FROM embeddings"),
    "vecs": ([], "SELECT vec_id, CAST(label AS BIGINT) AS person_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"),
    "n_vec": ([], "SELECT count(*) AS n FROM embeddings"),
    "probes": (["vecs", "n_vec"], """SELECT a.vec_id AS query_id, a.vec_id % 7 = 3 AS gated, CASE WHEN a.vec_id % 2 = 0
        THEN list_transform(list_zip(a.v, b.v), lambda z: 0.9::DOUBLE*z[1] + 0.43589::DOUBLE*z[2])
        ELSE list_transform(list_zip(a.v, b.v, c.v), lambda z: 0.57::DOUBLE*z[1] + 0.57::DOUBLE*z[2] + 0.59::DOUBLE*z[3]) END AS v
        FROM vecs a, n_vec, vecs b, vecs c WHERE b.vec_id = (a.vec_id*7+3) % n AND c.vec_id = (a.vec_id*11+5) % n"""),
    "spans": (["vecs", "n_vec"], f"""SELECT o_orderkey AS track_id, concat('cam_', o_orderkey % 4) AS camera_id, concat('zone_', o_orderkey % 3) AS zone,
        concat('site_', o_orderkey % 5) AS site_id, {B} + o_orderkey*2000 AS t_in, {B} + o_orderkey*2000 + (o_custkey % 20)*1000 AS t_out,
        0.3::DOUBLE + (o_orderkey % 8)/10.0::DOUBLE AS quality, o_orderkey % 3 <> 1 AS alone,
        CASE WHEN o_orderkey % 4 <> 0 THEN v END AS exit_vec, CASE WHEN o_orderkey % 3 <> 0 THEN v END AS entry_vec
        FROM orders, n_vec, vecs WHERE vec_id = o_custkey % n"""),
    "face_checks": ([], f"""SELECT user_id AS track_id, event_id AS obs_id, {B} + event_id*200 AS t, event_id // 4 + 1 AS frame_number,
        CASE WHEN event_type <> 'error' THEN (event_id // 3) % 3 END AS candidate, value/600.0::DOUBLE AS score FROM events"""),
    "event_log": ([], """SELECT event_id, ts, epoch_us(ts) // 1000 AS t, concat('cam_', user_id % 4) AS camera_id, event_type, CAST(user_id AS VARCHAR) AS track_id,
        user_id % 10 AS person_id, value/600.0::DOUBLE AS confidence, props AS extra_data FROM events"""),
    "stored_tracks": ([], f"""SELECT concat('global_', o_orderkey) AS track_id, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 12 END AS person_id,
        {B} + o_orderkey*2000 AS t_first, {B} + o_orderkey*2000 + (o_custkey % 20)*1000 AS t_last, concat('cam_', o_custkey % 4) AS last_camera_id,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'lost' ELSE 'archived' END AS status,
        CASE o_orderstatus WHEN 'O' THEN 'tracked' WHEN 'F' THEN 'lost' ELSE 'removed' END AS state FROM orders"""),
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` preceded by the views it names and those they need."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in views:
        need(name)
    ctes = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        recursive = recursive or body.upper().startswith("RECURSIVE ")
        body = body[10:] if body.upper().startswith("RECURSIVE ") else body
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' if ctes else ''}{body}"
    return f"WITH {ctes} {body}" if ctes else body
