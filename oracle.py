"""DuckDB statements for the queries of the catalogue.

They work on unnested vertices: ``lead()`` over the vertex order gives the segments, plain sums
and joins the rest.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------- derived tables

BASE = """
item AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_quantity AS qty,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos
  FROM lineitem),
node AS (
  SELECT ok * 64 + pos AS id,
         CASE WHEN qty = 13 THEN NULL
              ELSE (15900000 + (ok % 100) * 4000 + (pk % 17) * 200) / 1e6 END AS x,
         CASE WHEN qty = 13 THEN NULL
              ELSE (45800000 + (ok // 100) * 4000 + (sk % 13) * 200) / 1e6 END AS y
  FROM item),
cnt AS (SELECT l_orderkey AS ok, count(*) AS n FROM lineitem GROUP BY 1),
way AS (
  SELECT o_orderkey AS id, n,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'secondary'
      WHEN '3-MEDIUM' THEN 'tertiary' WHEN '4-NOT SPECIFIED' THEN 'residential' END AS highway,
    CASE WHEN o_custkey % 5 <> 0 THEN 'Road ' || o_custkey END AS name,
    CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS lit,
    CASE o_orderkey % 4 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'paved' END
      AS surface,
    CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '2;3' END
      AS lanes,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'D' || o_custkey END AS ref,
    CASE WHEN n IS NULL THEN 0 WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 1 THEN n + 1
         ELSE n END AS n_refs
  FROM orders LEFT JOIN cnt ON ok = o_orderkey),
ref AS (
  SELECT ok AS way_id, pos, ok * 64 + pos AS node_id FROM item JOIN way ON way.id = ok
  UNION ALL
  SELECT id, n, CASE WHEN id % 10 = 0 THEN id * 64 ELSE (id - 1) * 64 END
  FROM way WHERE n IS NOT NULL AND (id % 10 = 0 OR id % 7 = 1)),
vert AS (
  SELECT way_id, pos, x, y FROM ref JOIN node ON node.id = ref.node_id WHERE x IS NOT NULL),
seg AS (
  SELECT way_id, pos, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM vert WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
shape AS (
  SELECT way_id AS id, count(*) AS n_points,
    coalesce(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 0) AS len,
    min(x1) AS xmin, min(y1) AS ymin, max(x1) AS xmax, max(y1) AS ymax,
    avg(x1) AS vx, avg(y1) AS vy,
    sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * (x1 + x2) / 2) AS mx,
    sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * (y1 + y2) / 2) AS my,
    arg_min(x1, pos) AS sx, arg_min(y1, pos) AS sy, arg_max(x1, pos) AS ex, arg_max(y1, pos) AS ey
  FROM seg GROUP BY way_id HAVING count(*) >= 2),
osm AS (SELECT * FROM shape JOIN way USING (id)),
member AS (
  SELECT c_custkey AS id, o_orderkey AS ref,
         CASE WHEN o_orderkey % 3 = 0 THEN 'node' ELSE 'way' END AS ref_type
  FROM customer JOIN orders ON o_custkey = c_custkey),
run AS (
  SELECT event_type AS query, value AS execution_time, user_id,
    row_number() OVER (PARTITION BY event_type ORDER BY ts NULLS FIRST, event_id) - 1 AS run FROM events)
"""

# Segments of roads (closed up for one-vertex leftovers), for exact distances.
NEAR = """
line AS (
  SELECT id, x1, y1, x2, y2 FROM seg JOIN osm ON way_id = id WHERE x2 IS NOT NULL),
"""


def _pair_distance(candidates: str) -> str:
    """CTEs giving ``pair_distance(i, j, distance)`` for the id pairs of ``candidates``."""

    def to_segment(p: str, a: str, b: str) -> str:
        return f"""
          least(greatest(CASE WHEN {a}len = 0 THEN 0 ELSE
            (({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / {a}len END, 0), 1)"""

    def squared(p: str, a: str, b: str) -> str:
        t = to_segment(p, a, b)
        return (
            f"power({p}x - {a}x - {t} * ({b}x - {a}x), 2)"
            f" + power({p}y - {a}y - {t} * ({b}y - {a}y), 2)"
        )

    def side(o: str, a: str, b: str) -> str:
        return f"sign(({a}x - {o}x) * ({b}y - {o}y) - ({a}y - {o}y) * ({b}x - {o}x))"

    return f"""{NEAR}
    cand AS ({candidates}),
    sp AS (
      SELECT cand.i, cand.j, s.x1 AS px, s.y1 AS py, s.x2 AS qx, s.y2 AS qy,
             t.x1 AS rx, t.y1 AS ry, t.x2 AS sx, t.y2 AS sy,
             power(s.x2 - s.x1, 2) + power(s.y2 - s.y1, 2) AS plen,
             power(t.x2 - t.x1, 2) + power(t.y2 - t.y1, 2) AS rlen
      FROM cand JOIN line s ON s.id = cand.i JOIN line t ON t.id = cand.j),
    pair_distance AS (
      SELECT i, j, sqrt(min(CASE WHEN
          greatest(px, qx) >= least(rx, sx) AND greatest(rx, sx) >= least(px, qx)
          AND greatest(py, qy) >= least(ry, sy) AND greatest(ry, sy) >= least(py, qy)
          AND {side("r", "s", "p")} * {side("r", "s", "q")} <= 0
          AND {side("p", "q", "r")} * {side("p", "q", "s")} <= 0
        THEN 0 ELSE least({squared("p", "r", "s")}, {squared("q", "r", "s")},
                          {squared("r", "p", "q")}, {squared("s", "p", "q")}) END)) AS distance
      FROM sp GROUP BY i, j)"""


def _near_boxes(a: str, b: str, d: float, also: str) -> str:
    return f"""SELECT a.id AS i, b.id AS j FROM ({a}) a JOIN ({b}) b
      ON a.xmin <= b.xmax + {d} AND b.xmin <= a.xmax + {d}
      AND a.ymin <= b.ymax + {d} AND b.ymin <= a.ymax + {d} AND {also}"""


NAMED = "SELECT * FROM osm WHERE name IS NOT NULL"
NEARBY = f"""WITH {BASE}, {_pair_distance(_near_boxes(NAMED, NAMED, 0.01, "a.id < b.id"))}
  SELECT i AS road1_id, a.name AS road1_name, j AS road2_id, b.name AS road2_name,
         round(distance, 9) AS distance
  FROM pair_distance JOIN osm a ON a.id = i JOIN osm b ON b.id = j WHERE distance < 0.01"""
CLOSE = f"""WITH {BASE}, {_pair_distance(_near_boxes(
    "SELECT * FROM osm WHERE lit = 'yes'", "SELECT * FROM osm WHERE lit = 'no'", 0.002, "true"))}
  SELECT i AS a_id, j AS b_id, round(distance, 9) AS distance
  FROM pair_distance WHERE distance < 0.002"""

# A window, as its four sides, against the segments of each road.
WINDOW = """
win AS (SELECT 15.94 AS wx0, 45.81 AS wy0, 15.95 AS wx1, 45.83 AS wy1),
-- Liang-Barsky: the part of the segment inside each half plane, as a range of its parameter
clip AS (
  SELECT way_id, greatest(0,
      CASE WHEN x2 > x1 THEN (wx0 - x1) / (x2 - x1) WHEN x2 < x1 THEN (wx1 - x1) / (x2 - x1)
           WHEN x1 BETWEEN wx0 AND wx1 THEN 0 ELSE 2 END,
      CASE WHEN y2 > y1 THEN (wy0 - y1) / (y2 - y1) WHEN y2 < y1 THEN (wy1 - y1) / (y2 - y1)
           WHEN y1 BETWEEN wy0 AND wy1 THEN 0 ELSE 2 END) AS t0,
    least(1,
      CASE WHEN x2 > x1 THEN (wx1 - x1) / (x2 - x1) WHEN x2 < x1 THEN (wx0 - x1) / (x2 - x1)
           ELSE 1 END,
      CASE WHEN y2 > y1 THEN (wy1 - y1) / (y2 - y1) WHEN y2 < y1 THEN (wy0 - y1) / (y2 - y1)
           ELSE 1 END) AS t1
  FROM seg, win WHERE x2 IS NOT NULL),
inside AS (SELECT DISTINCT way_id AS id FROM clip WHERE t0 <= t1)
"""

# Area of the union of capsules, by vertical slabs and the middle of each slab.
BUFFER = """
pick AS (
  SELECT id, name, len FROM osm WHERE highway IN ('primary', 'secondary', 'tertiary')
  ORDER BY id LIMIT 50),
cap AS (
  SELECT DISTINCT id, x1, y1, x2, y2, atan2(y2 - y1, x2 - x1) AS along,
         dense_rank() OVER (PARTITION BY id ORDER BY x1, y1, x2, y2) AS c
  FROM seg JOIN pick ON way_id = id WHERE x2 IS NOT NULL),
corner AS (
  SELECT id, c, k,
    CASE WHEN k < 17 THEN x2 ELSE x1 END + 0.001 * cos(along + CASE WHEN k < 17
      THEN (k - 8) * pi() / 16 ELSE (k - 17 + 8) * pi() / 16 END) AS x,
    CASE WHEN k < 17 THEN y2 ELSE y1 END + 0.001 * sin(along + CASE WHEN k < 17
      THEN (k - 8) * pi() / 16 ELSE (k - 17 + 8) * pi() / 16 END) AS y
  FROM cap, range(34) r(k)),
edge AS (
  SELECT a.id, a.c, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM corner a JOIN corner b ON a.id = b.id AND a.c = b.c AND b.k = (a.k + 1) % 34),
crossing AS (
  SELECT id, x1 + t * (x2 - x1) AS x FROM (
    SELECT e.id, e.x1, e.x2,
      (e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1) AS den,
      ((f.x1 - e.x1) * (f.y2 - f.y1) - (f.y1 - e.y1) * (f.x2 - f.x1))
        / nullif((e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1), 0) AS t,
      ((f.x1 - e.x1) * (e.y2 - e.y1) - (f.y1 - e.y1) * (e.x2 - e.x1))
        / nullif((e.x2 - e.x1) * (f.y2 - f.y1) - (e.y2 - e.y1) * (f.x2 - f.x1), 0) AS u
    FROM edge e JOIN edge f ON e.id = f.id AND e.c < f.c)
  WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
cut AS (SELECT id, x FROM corner UNION SELECT id, x FROM crossing),
slab AS (
  SELECT id, x AS xa, lead(x) OVER (PARTITION BY id ORDER BY x) AS xb FROM cut),
span AS (
  SELECT s.id, xa, xb, c,
    min(y1 + (y2 - y1) * ((xa + xb) / 2 - x1) / (x2 - x1)) AS lo,
    max(y1 + (y2 - y1) * ((xa + xb) / 2 - x1) / (x2 - x1)) AS hi
  FROM slab s JOIN edge e ON e.id = s.id AND least(x1, x2) <= xa AND greatest(x1, x2) >= xb
  WHERE xb > xa GROUP BY ALL),
reach AS (
  SELECT *, max(hi) OVER (PARTITION BY id, xa ORDER BY lo, hi
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM span),
area AS (
  SELECT id, sum((xb - xa) * greatest(hi - greatest(lo, coalesce(before, lo)), 0)) AS area
  FROM reach GROUP BY id),
hull AS (
  SELECT id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
  FROM corner GROUP BY id)
"""


def _osm(select: str) -> str:
    return f"WITH {BASE} {select}"


def oracle_sql() -> dict[str, str]:
    named = "FROM osm WHERE name IS NOT NULL"
    cx = "CASE WHEN len > 0 THEN mx / len ELSE vx END"
    cy = "CASE WHEN len > 0 THEN my / len ELSE vy END"
    box_only = (
        "round(xmin, 9) AS xmin, round(ymin, 9) AS ymin,"
        " round(xmax, 9) AS xmax, round(ymax, 9) AS ymax"
    )
    members = """SELECT m.id, m.ref, m.ref_type, 'route' AS relation_type, round(len, 9) AS length
      FROM member m JOIN osm ON osm.id = m.ref"""
    summary = """SELECT query, count(*) AS runs, avg(execution_time) AS avg_time,
        min(execution_time) AS min_time, max(execution_time) AS max_time FROM run GROUP BY 1"""
    way_columns = "id, name, lanes, n_points, round(len, 9) AS length FROM osm"
    lit = "SELECT id, name AS road_name, lit AS lighting FROM osm WHERE lit = 'yes'"
    statements = {
        "q01_count_roads": _osm("SELECT count(*) AS total_roads FROM osm"),
        "q02_road_length": _osm(
            """SELECT count(*) AS road_count, round(sum(len), 9) AS total_length,
              round(avg(len), 9) AS avg_length, round(max(len), 9) AS max_length FROM osm"""
        ),
        "q03_roads_by_highway_type": _osm(
            """SELECT highway AS highway_type, count(*) AS road_count,
              round(sum(len), 9) AS total_length FROM osm WHERE highway IS NOT NULL
              GROUP BY 1 ORDER BY 2 DESC, 1"""
        ),
        "q04_lit_roads": _osm(
            """SELECT id, name AS road_name, highway AS highway_type, lit AS lighting,
              round(len, 9) AS length FROM osm WHERE lit = 'yes'"""
        ),
        "q05_roads_by_surface": _osm(
            """SELECT surface AS surface_type, count(*) AS road_count,
              round(sum(len), 9) AS total_length, round(avg(len), 9) AS avg_length
              FROM osm WHERE surface IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1"""
        ),
        "q06_envelope_bbox": _osm(
            f"SELECT id, name AS road_name, round(len, 9) AS length, {box_only} {named} "
            "ORDER BY id LIMIT 100"
        ),
        "q07_major_roads": _osm(
            """SELECT id, name AS road_name, highway AS highway_type, ref AS road_ref,
              round(len, 9) AS length FROM osm
              WHERE highway IN ('primary', 'secondary', 'tertiary') ORDER BY len DESC, id"""
        ),
        "q08_road_centroids": _osm(
            f"""SELECT id, name AS road_name, round(len, 9) AS length,
              round({cx}, 9) AS cx, round({cy}, 9) AS cy {named} ORDER BY id LIMIT 100"""
        ),
        "q09_named_roads_with_lanes": _osm(
            f"""SELECT id, name AS road_name, highway AS highway_type, lanes AS num_lanes,
              round(len, 9) AS length {named} AND lanes IS NOT NULL
              ORDER BY try_cast(lanes AS INT) DESC NULLS LAST, id"""
        ),
        "q10_road_statistics": _osm(
            """SELECT highway AS highway_type, count(*) AS segment_count,
              round(sum(len), 9) AS total_length, round(avg(len), 9) AS avg_length,
              round(min(len), 9) AS min_length, round(max(len), 9) AS max_length,
              count(*) FILTER (lit = 'yes') AS lit_count,
              count(*) FILTER (surface = 'asphalt') AS asphalt_count
              FROM osm WHERE highway IS NOT NULL GROUP BY 1 ORDER BY 3 DESC, 1"""
        ),
        "q11_buffer_analysis": f"""WITH {BASE}, {BUFFER}
          SELECT id, name AS road_name, round(len, 9) AS original_length,
            round(area, 9) AS buffer_area, {box_only}
          FROM pick JOIN area USING (id) JOIN hull USING (id)""",
        "q12_spatial_filter": f"""WITH {BASE}, {WINDOW}
          SELECT id, name AS road_name, highway AS highway_type, round(len, 9) AS length
          FROM osm JOIN inside USING (id)""",
        "q13_start_end_points": _osm(
            """SELECT id, name AS road_name, round(len, 9) AS length, round(sx, 9) AS sx,
              round(sy, 9) AS sy, round(ex, 9) AS ex, round(ey, 9) AS ey
              FROM osm ORDER BY id LIMIT 100"""
        ),
        "q14_road_complexity": _osm(
            """SELECT id, name AS road_name, highway AS highway_type, n_points AS num_points,
              round(len, 9) AS length, round(len / n_points, 9) AS avg_segment_length
              FROM osm WHERE n_points > 10 ORDER BY n_points DESC, id LIMIT 100"""
        ),
        "q15_self_join_nearby": f"{NEARBY} ORDER BY road1_id, road2_id LIMIT 100",
        "osm_points": _osm("SELECT id, x, y FROM node WHERE x IS NOT NULL"),
        "osm_points_strict": _osm("SELECT id, x, y FROM node WHERE x IS NOT NULL"),
        "osm_drop_counts": _osm(
            """SELECT (SELECT count(*) FROM osm) AS ways,
              (SELECT count(*) FROM node WHERE x IS NULL) AS nodes_without_location,
              (SELECT count(*) FROM way WHERE n IS NULL) AS ways_without_refs,
              (SELECT count(*) FROM (SELECT way_id FROM vert GROUP BY 1 HAVING count(*) = 1))
                AS ways_with_one_vertex"""
        ),
        "osm_points_dropped": _osm("SELECT id FROM node WHERE x IS NULL"),
        "osm_ways": _osm(
            """SELECT id, highway, name, lit, surface, lanes, ref, n_points,
              round(len, 9) AS length FROM osm"""
        ),
        "osm_ways_complete": _osm(
            """SELECT id AS osm_id, n_points, round(len, 9) AS length FROM osm
              WHERE n_points = n_refs"""
        ),
        "osm_ways_dropped": _osm(
            "SELECT id, n_refs FROM way WHERE id NOT IN (SELECT id FROM shape)"
        ),
        "osm_way_vertices": _osm("SELECT way_id, pos, x, y FROM vert"),
        "osm_relation_members_way": _osm(f"{members} WHERE ref_type = 'way'"),
        "osm_relation_members_any": _osm(members),
        "wkb_types": _osm(
            """SELECT id,
              ['POINT', 'LINESTRING', 'POLYGON', 'MULTIPOINT', 'MULTILINESTRING', 'MULTIPOLYGON'][id % 6 + 1] AS type,
              [21, 9 + 16 * n_points, 29 + 16 * n_points, 9 + 21 * n_points, 27 + 32 * n_points,
               67 + 32 * n_points][id % 6 + 1]::bigint AS n_bytes,
              true AS same, true AS same_extended,
              round(CASE id % 6 WHEN 1 THEN len WHEN 4 THEN 2 * len ELSE 0 END, 9) AS length FROM osm"""
        ),
        "osm_pbf_roundtrip": _osm(f"{members} WHERE ref_type = 'way'"),
        "export_ways": _osm("SELECT id AS osm_id, name, round(len, 9) AS length FROM osm"),
        "way_wkt": _osm(
            """SELECT way_id AS id, 'LINESTRING (' || string_agg(
                regexp_replace(x::VARCHAR, '\\.0$', '') || ' ' ||
                regexp_replace(y::VARCHAR, '\\.0$', ''), ', ' ORDER BY pos) || ')' AS wkt
              FROM vert GROUP BY way_id HAVING count(*) >= 2"""
        ),
        "point_wkt": _osm(
            """SELECT id, 'POINT (' || regexp_replace(x::VARCHAR, '\\.0$', '') || ' ' ||
                regexp_replace(y::VARCHAR, '\\.0$', '') || ')' AS wkt
              FROM node WHERE x IS NOT NULL"""
        ),
        "wkt_roundtrip": _osm("SELECT id, true AS same, round(len, 9) AS length FROM osm"),
        "wkb_roundtrip": _osm("SELECT id, true AS same, 9 + 16 * n_points AS n_bytes FROM osm"),
        "make_line": _osm(
            """SELECT id, round(sqrt(power(xmax - xmin, 2) + power(ymax - ymin, 2)), 9)
              AS diagonal FROM osm"""
        ),
        "polygon_area": _osm(
            """SELECT id, CASE WHEN xmin = xmax AND ymin = ymax THEN 'POINT'
                WHEN xmin = xmax OR ymin = ymax THEN 'LINESTRING' ELSE 'POLYGON' END AS box_type,
              round((xmax - xmin) * (ymax - ymin), 12) AS box_area, 0.0::DOUBLE AS line_area,
              round((xmin + xmax) / 2, 12) AS cx, round((ymin + ymax) / 2, 12) AS cy FROM osm"""
        ),
        "road_buffers": _osm(
            """SELECT id, round(2 * 0.001 * len + 16 * sin(pi() / 16) * 0.001 * 0.001, 12)
              AS buffer_area FROM osm WHERE n_points = 2"""
        ),
        "point_line_distance": _osm(
            """, p AS (
              SELECT way_id AS id, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy,
                15.9 + (way_id % 100) * 0.004 - x1 AS wx, 45.8 - y1 AS wy
              FROM seg JOIN osm ON id = way_id WHERE x2 IS NOT NULL),
            q AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE
              greatest(0, least(1, (wx * dx + wy * dy) / (dx * dx + dy * dy))) END AS t FROM p)
            SELECT id, round(min(sqrt(power(wx - t * dx, 2) + power(wy - t * dy, 2))), 9)
              AS distance FROM q GROUP BY id"""
        ),
        "intersects_window_pairs": _osm(
            """, s AS (
              SELECT way_id, x1 - ox AS x1, y1 - oy AS y1, x2 - x1 AS dx, y2 - y1 AS dy FROM (
                SELECT *, 15.9 + (way_id % 100) * 0.004 AS ox, 45.8 + (way_id // 100) * 0.004 AS oy
                FROM seg JOIN osm ON id = way_id WHERE x2 IS NOT NULL)),
            tri AS (SELECT * FROM (VALUES
              (0.0000513171, 0.0000377393, 0.0020533719, 0.0010417153),
              (0.0020533719, 0.0010417153, 0.0010291733, 0.0030435927),
              (0.0010291733, 0.0030435927, 0.0000513171, 0.0000377393)) v(px, py, qx, qy)),
            -- left of every side: f(t) = f0 + t * df >= 0
            half AS (
              SELECT way_id, x1, y1, dx, dy,
                (qx - px) * (y1 - py) - (qy - py) * (x1 - px) AS f0,
                (qx - px) * dy - (qy - py) * dx AS df
              FROM s, (SELECT px::DOUBLE AS px, py::DOUBLE AS py, qx::DOUBLE AS qx,
                              qy::DOUBLE AS qy FROM tri)),
            part AS (
              SELECT way_id,
                max(CASE WHEN df > 0 THEN -f0 / df WHEN df = 0 AND f0 < 0 THEN 2 ELSE 0 END) AS t0,
                min(CASE WHEN df < 0 THEN -f0 / df ELSE 1 END) AS t1
              FROM half GROUP BY way_id, x1, y1, dx, dy)
            SELECT way_id AS id, bool_or(greatest(t0, 0) <= least(t1, 1)) AS intersects
            FROM part GROUP BY way_id"""
        ),
        "distance_join_all": NEARBY,
        "distance_join_close": CLOSE,
        "range_filter_bbox": f"""WITH {BASE}, {WINDOW}
          SELECT id, {box_only} FROM osm JOIN inside USING (id)""",
        "track_points": """
          SELECT (45800000 + (event_id % 777) * 100) / 1e6 AS lat,
            (15900000 + (event_id % 1000) * 100) / 1e6 AS lon, 'user ' || user_id AS track,
            CASE WHEN event_id % 11 <> 0 THEN ts END AS time, lon AS x, lat AS y FROM events""",
        "gpx_roundtrip": """
          SELECT (45800000 + (event_id % 777) * 100) / 1e6 AS lat,
            (15900000 + (event_id % 1000) * 100) / 1e6 AS lon, 'user ' || user_id AS track,
            CASE WHEN event_id % 11 <> 0 THEN ts END AS time FROM events""",
        "osm_xml_roundtrip": _osm(f"SELECT {way_columns}"),
        "track_name_fallback": """
          SELECT event_id, CASE WHEN user_id % 7 = 0 OR user_id % 5 = 0
            THEN 'day.' || (event_id % 9) || ' log' ELSE 'user ' || user_id END AS track
          FROM events""",
        "file_stem": """
          SELECT page_id, regexp_extract(string_split(url, '/')[-1], '^\\.*[^.]*') AS stem
          FROM pages""",
        "parquet_roundtrip": _osm(
            f"""SELECT id, highway AS tag_highway, lit AS tag_lit, {box_only}, n_points,
              round(len, 9) AS length FROM osm"""
        ),
        "parquet_geo_roundtrip": _osm(
            """SELECT id, round(len, 9) AS length, 'WKB' AS encoding, 'LineString' AS types,
              true AS inside_file_box FROM osm"""
        ),
        "parquet_points": _osm("SELECT id, x, y FROM node WHERE x IS NOT NULL"),
        "json_result_all": _osm(
            "SELECT id, name AS road_name, round(len, 9) AS length, false AS has_geometry FROM osm"
        ),
        "json_result_no_geometry": _osm(
            f"SELECT id, name AS road_name, round(len, 9) AS length {named} ORDER BY id LIMIT 100"
        ),
        "run_timing": _osm(
            f"""SELECT query, run, round(execution_time, 9) AS execution_time,
              round(avg_time, 9) AS avg_time, round(min_time, 9) AS min_time,
              round(max_time, 9) AS max_time
              FROM run JOIN ({summary}) s USING (query)"""
        ),
        "run_summary": _osm(
            f"""SELECT query, runs, round(avg_time, 9) AS avg_time,
              round(min_time, 9) AS min_time, round(max_time, 9) AS max_time FROM ({summary})"""
        ),
        "timing_json": _osm(
            f"""SELECT query, run, round(execution_time, 9) AS execution_time,
              round(avg_time, 9) AS avg_time, round(min_time, 9) AS min_time,
              round(max_time, 9) AS max_time
              FROM run JOIN ({summary}) s USING (query)"""
        ),
        "run_mean_sorted": _osm(
            "SELECT query, round(avg(execution_time), 9) AS avg_time FROM run GROUP BY 1"
        ),
        "run_box_stats": _osm(
            """, q AS (SELECT query, quantile_cont(execution_time, 0.25) AS q1,
                quantile_cont(execution_time, 0.5) AS median,
                quantile_cont(execution_time, 0.75) AS q3 FROM run GROUP BY 1)
            SELECT query, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
              round(min(execution_time) FILTER (execution_time >= q1 - 1.5 * (q3 - q1)), 9)
                AS whisker_low,
              round(max(execution_time) FILTER (execution_time <= q3 + 1.5 * (q3 - q1)), 9)
                AS whisker_high,
              count(*) FILTER (execution_time < q1 - 1.5 * (q3 - q1)
                OR execution_time > q3 + 1.5 * (q3 - q1)) AS outliers
            FROM run JOIN q USING (query) GROUP BY query, q1, median, q3"""
        ),
        "run_points": _osm(
            "SELECT query, run + 1 AS run, execution_time FROM run"
        ),
        "frame_diff": _osm(
            f""", before AS ({lit}), after AS (
              SELECT id, road_name, CASE WHEN id % 50 = 0 THEN 'no' ELSE lighting END AS lighting
              FROM before)
            SELECT *, 'a' AS only_in FROM (SELECT * FROM before EXCEPT ALL SELECT * FROM after)
            UNION ALL
            SELECT *, 'b' AS only_in FROM (SELECT * FROM after EXCEPT ALL SELECT * FROM before)"""
        ),
        "result_fingerprint": _osm(
            "SELECT count(*) AS n_rows, true AS same FROM osm WHERE lit = 'yes'"
        ),
        "run_agreement": _osm(
            """SELECT query, count(*) AS runs, count(DISTINCT user_id % 3) = 1 AS agree
              FROM run GROUP BY 1"""
        ),
        "parameter_sweep": _osm(
            """SELECT least, count(*) AS roads, round(sum(len), 9) AS total_length
              FROM osm JOIN (VALUES (0.001::DOUBLE), (0.002::DOUBLE), (0.005::DOUBLE),
                (0.01::DOUBLE)) v(least) ON len >= least GROUP BY 1"""
        ),
        "sql_sweep": _osm(
            """SELECT count(*) AS roads, highway FROM osm
              WHERE highway IN ('primary', 'secondary', 'tertiary') GROUP BY 2"""
        ),
    }
    # The SQL texts of the road queries answer the same questions.
    return statements | {f"sql_{name}": text for name, text in statements.items() if re.match(r"q\d", name)}
