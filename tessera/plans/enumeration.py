"""SQL that enumerates the corners of small frontiers (some dozens of units): an independent way to the results of
tessera.operators.frontier, for two inputs and one output or three indicators. The texts are ANSI SQL, so another engine can run them.
Their theta joins grow with the fourth power of the units; the engine itself doesn't run them.
"""

from __future__ import annotations

#: Two inputs and one output for each nation, as doubles; money is summed as decimals, so the order of rows doesn't matter.
UNITS = """raw AS (
  SELECT c.dmu_id, c.x1, c.x2, o.y FROM (
    SELECT c_nationkey AS dmu_id, CAST(count(*) AS DOUBLE) AS x1,
      CAST(sum(CAST(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS DECIMAL(18, 2))) AS DOUBLE) AS x2
    FROM customer GROUP BY c_nationkey) c
  JOIN (SELECT c_nationkey AS dmu_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS y
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) o ON c.dmu_id = o.dmu_id),
tops AS (SELECT max(x1) AS m1, max(x2) AS m2, max(y) AS my FROM raw),
u AS (SELECT dmu_id, x1 / m1 AS x1, x2 / m2 AS x2, y / my AS y FROM raw CROSS JOIN tops WHERE y > 0)"""

#: Three indicators for each nation.
INDICATORS = """raw AS (
  SELECT c.dmu_id, c.y1, o.y2, o.y3 FROM (
    SELECT c_nationkey AS dmu_id, CAST(count(*) AS DOUBLE) AS y1 FROM customer GROUP BY c_nationkey) c
  JOIN (SELECT c_nationkey AS dmu_id, CAST(count(*) AS DOUBLE) AS y2, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS y3
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) o ON c.dmu_id = o.dmu_id)"""

#: Facets v1 * x1 + v2 * x2 + t >= y of the frontier: through three units, two, or the highest one.
FACETS = """tri AS (
  SELECT a.x1 AS ax, a.x2 AS az, a.y AS ay, b.x1 - a.x1 AS bx, b.x2 - a.x2 AS bz, b.y - a.y AS dy, c.x1 - a.x1 AS cx, c.x2 - a.x2 AS cz, c.y - a.y AS ey
  FROM u a JOIN u b ON a.dmu_id < b.dmu_id JOIN u c ON b.dmu_id < c.dmu_id),
cand AS (
  SELECT v1, v2, ay - v1 * ax - v2 * az AS t FROM (
    SELECT ax, az, ay, (dy * cz - ey * bz) / nullif(bx * cz - cx * bz, 0) AS v1, (bx * ey - cx * dy) / nullif(bx * cz - cx * bz, 0) AS v2
    FROM tri WHERE abs(bx * cz - cx * bz) > 1e-12) q
  UNION ALL SELECT v1, CAST(0 AS DOUBLE), ay - v1 * ax FROM (SELECT a.x1 AS ax, a.y AS ay, (b.y - a.y) / nullif(b.x1 - a.x1, 0) AS v1
    FROM u a JOIN u b ON a.dmu_id < b.dmu_id WHERE abs(b.x1 - a.x1) > 1e-12) q
  UNION ALL SELECT CAST(0 AS DOUBLE), v2, ay - v2 * az FROM (SELECT a.x2 AS az, a.y AS ay, (b.y - a.y) / nullif(b.x2 - a.x2, 0) AS v2
    FROM u a JOIN u b ON a.dmu_id < b.dmu_id WHERE abs(b.x2 - a.x2) > 1e-12) q
  UNION ALL SELECT CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), max(y) FROM u),
facets AS (
  SELECT v1, v2, t FROM cand CROSS JOIN u WHERE v1 >= -1e-9 AND v2 >= -1e-9
  GROUP BY v1, v2, t HAVING min(v1 * x1 + v2 * x2 + t - y) >= -1e-9),
dual AS (SELECT o.dmu_id, (f.v1 * o.x1 + f.v2 * o.x2 + f.t) / o.y AS phi, f.t / o.y AS vstar FROM facets f CROSS JOIN u o)"""

#: Each facet once, with the output's price 1.
FACET_TABLE = f"""WITH {UNITS}, {FACETS}
SELECT DISTINCT round(v1, 6) + 0.0 AS v_x1, round(v2, 6) + 0.0 AS v_x2, round(t, 6) + 0.0 AS vstar FROM facets"""

SCORE = f"""WITH {UNITS}, {FACETS},
best AS (SELECT dmu_id, greatest(1.0, min(phi)) AS phi FROM dual GROUP BY dmu_id)
SELECT b.dmu_id, round(b.phi, 6) AS phi, round(1 / b.phi, 6) AS eff, round(b.phi * r.y, 4) AS y_target, 1 / b.phi >= 1 - 1e-9 AS efficient
FROM best b JOIN raw r ON b.dmu_id = r.dmu_id"""

#: The frontier of each region: the facets above with every join within a region.
SCORE_BY = f"""WITH {UNITS.split("tops AS")[0].rstrip().rstrip(",")},
named AS (SELECT r_name AS grp, raw.* FROM raw JOIN nation ON dmu_id = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tops AS (SELECT grp AS g, max(x1) AS m1, max(x2) AS m2, max(y) AS my FROM named GROUP BY grp),
u AS (SELECT grp, dmu_id, x1 / m1 AS x1, x2 / m2 AS x2, y / my AS y FROM named JOIN tops ON grp = g WHERE y > 0),
tri AS (
  SELECT a.grp, a.x1 AS ax, a.x2 AS az, a.y AS ay, b.x1 - a.x1 AS bx, b.x2 - a.x2 AS bz, b.y - a.y AS dy, c.x1 - a.x1 AS cx, c.x2 - a.x2 AS cz, c.y - a.y AS ey
  FROM u a JOIN u b ON a.grp = b.grp AND a.dmu_id < b.dmu_id JOIN u c ON b.grp = c.grp AND b.dmu_id < c.dmu_id),
cand AS (
  SELECT grp, v1, v2, ay - v1 * ax - v2 * az AS t FROM (
    SELECT grp, ax, az, ay, (dy * cz - ey * bz) / nullif(bx * cz - cx * bz, 0) AS v1, (bx * ey - cx * dy) / nullif(bx * cz - cx * bz, 0) AS v2
    FROM tri WHERE abs(bx * cz - cx * bz) > 1e-12) q
  UNION ALL SELECT grp, v1, CAST(0 AS DOUBLE), ay - v1 * ax FROM (SELECT a.grp, a.x1 AS ax, a.y AS ay, (b.y - a.y) / nullif(b.x1 - a.x1, 0) AS v1
    FROM u a JOIN u b ON a.grp = b.grp AND a.dmu_id < b.dmu_id WHERE abs(b.x1 - a.x1) > 1e-12) q
  UNION ALL SELECT grp, CAST(0 AS DOUBLE), v2, ay - v2 * az FROM (SELECT a.grp, a.x2 AS az, a.y AS ay, (b.y - a.y) / nullif(b.x2 - a.x2, 0) AS v2
    FROM u a JOIN u b ON a.grp = b.grp AND a.dmu_id < b.dmu_id WHERE abs(b.x2 - a.x2) > 1e-12) q
  UNION ALL SELECT grp, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), max(y) FROM u GROUP BY grp),
facets AS (
  SELECT cand.grp, v1, v2, t FROM cand JOIN u ON cand.grp = u.grp WHERE v1 >= -1e-9 AND v2 >= -1e-9
  GROUP BY cand.grp, v1, v2, t HAVING min(v1 * x1 + v2 * x2 + t - y) >= -1e-9)
SELECT o.grp AS region, o.dmu_id, round(greatest(1.0, min((f.v1 * o.x1 + f.v2 * o.x2 + f.t) / o.y)), 6) AS phi FROM facets f JOIN u o ON f.grp = o.grp GROUP BY o.grp, o.dmu_id"""

#: Ways to reach a unit's inputs by mixing up to three units, with the output of each.
PRIMAL = """solo AS (
  SELECT o.dmu_id, o.y AS yo, a.y AS reach, a.dmu_id AS a, a.dmu_id AS b, a.dmu_id AS c, CAST(1 AS DOUBLE) AS wa, CAST(0 AS DOUBLE) AS wb, CAST(0 AS DOUBLE) AS wc
  FROM u o JOIN u a ON a.x1 <= o.x1 + 1e-9 AND a.x2 <= o.x2 + 1e-9),
mix AS (
  SELECT o.dmu_id, o.y AS yo, o.x1 AS ox, o.x2 AS oz, a.dmu_id AS a, b.dmu_id AS b, a.x1 AS ax, a.x2 AS az, a.y AS ay, b.x1 AS bx, b.x2 AS bz, b.y AS bo, k.k,
    CASE WHEN k.k = 1 THEN o.x1 - b.x1 ELSE o.x2 - b.x2 END AS up, CASE WHEN k.k = 1 THEN a.x1 - b.x1 ELSE a.x2 - b.x2 END AS down
  FROM u o CROSS JOIN u a JOIN u b ON a.dmu_id < b.dmu_id CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) k),
duo AS (
  SELECT dmu_id, yo, w * ay + (1 - w) * bo AS reach, a, b, b AS c, w AS wa, 1 - w AS wb, CAST(0 AS DOUBLE) AS wc
  FROM (SELECT *, up / nullif(down, 0) AS w FROM mix WHERE abs(down) > 1e-12) q
  WHERE w >= -1e-9 AND w <= 1 + 1e-9 AND w * ax + (1 - w) * bx <= ox + 1e-9 AND w * az + (1 - w) * bz <= oz + 1e-9),
trio AS (
  SELECT dmu_id, yo, wa * ay + wb * bo + (1 - wa - wb) * cy AS reach, a, b, c, wa, wb, 1 - wa - wb AS wc FROM (
    SELECT *, ((ox - cx) * (bz - cz) - (oz - cz) * (bx - cx)) / nullif(det, 0) AS wa, ((ax - cx) * (oz - cz) - (az - cz) * (ox - cx)) / nullif(det, 0) AS wb FROM (
      SELECT o.dmu_id, o.y AS yo, o.x1 AS ox, o.x2 AS oz, a.dmu_id AS a, b.dmu_id AS b, c.dmu_id AS c, a.x1 AS ax, a.x2 AS az, a.y AS ay, b.x1 AS bx, b.x2 AS bz, b.y AS bo, c.x1 AS cx, c.x2 AS cz, c.y AS cy,
        (a.x1 - c.x1) * (b.x2 - c.x2) - (a.x2 - c.x2) * (b.x1 - c.x1) AS det
      FROM u o CROSS JOIN u a JOIN u b ON a.dmu_id < b.dmu_id JOIN u c ON b.dmu_id < c.dmu_id) p
    WHERE abs(det) > 1e-12) q
  WHERE wa >= -1e-9 AND wb >= -1e-9 AND wa + wb <= 1 + 1e-9),
ways AS (SELECT * FROM solo UNION ALL SELECT * FROM duo UNION ALL SELECT * FROM trio),
top AS (SELECT dmu_id, max(reach) AS reach FROM ways GROUP BY dmu_id)"""

PEERS = f"""WITH {UNITS}, {PRIMAL},
tied AS (SELECT w.* FROM ways w JOIN top t ON w.dmu_id = t.dmu_id WHERE w.reach >= t.reach - 1e-9)
SELECT DISTINCT dmu_id, peer_id FROM (
  SELECT dmu_id, a AS peer_id FROM tied WHERE wa > 1e-7 UNION ALL SELECT dmu_id, b FROM tied WHERE wb > 1e-7 UNION ALL SELECT dmu_id, c FROM tied WHERE wc > 1e-7) p"""

#: vstar is the constant of the facet with u * y = 1 (data divided by their maxima), taken with a plus sign: below 0 is
#: increasing, above 0 decreasing returns. A lower end without bound is null, and such a unit is never called decreasing.
SCALE = f"""WITH {UNITS}, {FACETS},
best AS (SELECT dmu_id, min(phi) AS phi FROM dual GROUP BY dmu_id),
ends AS (SELECT d.dmu_id, min(vstar) AS lo, max(vstar) AS hi FROM dual d JOIN best b ON d.dmu_id = b.dmu_id WHERE d.phi <= b.phi + 1e-9 GROUP BY d.dmu_id),
spans AS (
  SELECT o.dmu_id,
    greatest(0.0, CASE WHEN a.x1 < b.x1 THEN (o.x1 - b.x1) / (a.x1 - b.x1) ELSE 0.0 END, CASE WHEN a.x2 < b.x2 THEN (o.x2 - b.x2) / (a.x2 - b.x2) ELSE 0.0 END) AS lo,
    least(1.0, CASE WHEN a.x1 > b.x1 THEN (o.x1 - b.x1) / (a.x1 - b.x1) WHEN a.x1 = b.x1 AND a.x1 >= o.x1 THEN -1.0 ELSE 1.0 END,
      CASE WHEN a.x2 > b.x2 THEN (o.x2 - b.x2) / (a.x2 - b.x2) WHEN a.x2 = b.x2 AND a.x2 >= o.x2 THEN -1.0 ELSE 1.0 END) AS hi
  FROM u o CROSS JOIN u a JOIN u b ON a.dmu_id <= b.dmu_id),
roomy AS (SELECT DISTINCT dmu_id FROM spans WHERE lo < hi - 1e-9)
SELECT e.dmu_id, CASE WHEN r.dmu_id IS NULL THEN NULL ELSE round(e.lo, 4) + 0.0 END AS vstar_min, round(e.hi, 4) + 0.0 AS vstar_max,
  CASE WHEN e.hi < -1e-9 THEN 'IRS' WHEN r.dmu_id IS NOT NULL AND e.lo > 1e-9 THEN 'DRS' ELSE 'CRS' END AS rts
FROM ends e LEFT JOIN roomy r ON e.dmu_id = r.dmu_id"""


def corners(units: str, group: str, limits: tuple[tuple[float, float, float, float], ...] = ()) -> str:
    """Corners (w1, w2, w3) of the weights at which no unit of a group exceeds 1; `units` has grp, dmu_id and z1, z2, z3.

    limits: further planes (p, q, r, s) with p * w1 + q * w2 + r * w3 <= s.
    """
    more = "".join(f" UNION ALL SELECT grp, {-4 - k}, CAST({p} AS DOUBLE), CAST({q} AS DOUBLE), CAST({r} AS DOUBLE), CAST({s} AS DOUBLE) FROM {group}" for k, (p, q, r, s) in enumerate(limits))
    held = "".join(f" AND {p} * w1 + {q} * w2 + {r} * w3 <= {s} + 1e-9" for p, q, r, s in limits)
    return f"""planes AS (
  SELECT grp, dmu_id AS k, z1 AS p, z2 AS q, z3 AS r, CAST(1 AS DOUBLE) AS s FROM {units}
  UNION ALL SELECT grp, -1, 1.0, 0.0, 0.0, 0.0 FROM {group} UNION ALL SELECT grp, -2, 0.0, 1.0, 0.0, 0.0 FROM {group} UNION ALL SELECT grp, -3, 0.0, 0.0, 1.0, 0.0 FROM {group}{more}),
meets AS (
  SELECT a.grp, a.p AS ap, a.q AS aq, a.r AS ar, a.s AS sa, b.p AS bp, b.q AS bq, b.r AS br, b.s AS sb, c.p AS cp, c.q AS cq, c.r AS cr, c.s AS sc,
    a.p * (b.q * c.r - b.r * c.q) - a.q * (b.p * c.r - b.r * c.p) + a.r * (b.p * c.q - b.q * c.p) AS det
  FROM planes a JOIN planes b ON a.grp = b.grp AND a.k < b.k JOIN planes c ON b.grp = c.grp AND b.k < c.k),
points AS (
  SELECT grp, (sa * (bq * cr - br * cq) - aq * (sb * cr - br * sc) + ar * (sb * cq - bq * sc)) / nullif(det, 0) AS w1,
    (ap * (sb * cr - br * sc) - sa * (bp * cr - br * cp) + ar * (bp * sc - sb * cp)) / nullif(det, 0) AS w2,
    (ap * (bq * sc - sb * cq) - aq * (bp * sc - sb * cp) + sa * (bp * cq - bq * cp)) / nullif(det, 0) AS w3
  FROM meets WHERE abs(det) > 1e-12),
corners AS (
  SELECT p.grp, w1, w2, w3 FROM points p JOIN {units} x ON p.grp = x.grp WHERE w1 >= -1e-9 AND w2 >= -1e-9 AND w3 >= -1e-9{held}
  GROUP BY p.grp, w1, w2, w3 HAVING max(w1 * z1 + w2 * z2 + w3 * z3) <= 1 + 1e-9),
scored AS (SELECT x.grp, x.dmu_id, c.w1, c.w2, c.w3, c.w1 * z1 + c.w2 * z2 + c.w3 * z3 AS ci FROM {units} x JOIN corners c ON x.grp = c.grp)"""


_SCALED = f"""WITH {INDICATORS},
tops AS (SELECT max(y1) AS m1, max(y2) AS m2, max(y3) AS m3 FROM raw),
z AS (SELECT 0 AS grp, dmu_id, y1 / m1 AS z1, y2 / m2 AS z2, y3 / m3 AS z3 FROM raw CROSS JOIN tops),
groups AS (SELECT DISTINCT grp FROM z)"""

_ALL = f"""{_SCALED}, {corners("z", "groups")}"""

#: What BOUNDED and BOUNDED_WEIGHTS keep to: weights of 0.1 to 0.5 for y1, 0.15 at least for y2, and y2's from half to twice y3's.
LIMITS = ((-1.0, 0.0, 0.0, -0.1), (1.0, 0.0, 0.0, 0.5), (0.0, -1.0, 0.0, -0.15), (0.0, -1.0, 0.5, 0.0), (0.0, 1.0, -2.0, 0.0))
_LIMITED = f"""{_SCALED}, {corners("z", "groups", LIMITS)}"""
BOUNDED = f"""{_LIMITED} SELECT dmu_id, round(least(1.0, max(ci)), 6) AS ci FROM scored GROUP BY dmu_id"""

BOD = f"""{_ALL} SELECT dmu_id, round(least(1.0, max(ci)), 6) AS ci FROM scored GROUP BY dmu_id"""

#: Weights are for indicators divided by their maxima.
WEIGHTS = f"""{_ALL},
best AS (SELECT dmu_id, max(ci) AS ci FROM scored GROUP BY dmu_id),
tied AS (SELECT s.* FROM scored s JOIN best b ON s.dmu_id = b.dmu_id WHERE s.ci >= b.ci - 1e-9)
SELECT dmu_id, 'y1' AS indicator, round(min(w1), 6) + 0.0 AS w_min, round(max(w1), 6) + 0.0 AS w_max FROM tied GROUP BY dmu_id
UNION ALL SELECT dmu_id, 'y2', round(min(w2), 6) + 0.0, round(max(w2), 6) + 0.0 FROM tied GROUP BY dmu_id
UNION ALL SELECT dmu_id, 'y3', round(min(w3), 6) + 0.0, round(max(w3), 6) + 0.0 FROM tied GROUP BY dmu_id"""

BOD_BY = f"""WITH {INDICATORS},
named AS (SELECT r_name, raw.* FROM raw JOIN nation ON dmu_id = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tops AS (SELECT r_name AS t_name, max(y1) AS m1, max(y2) AS m2, max(y3) AS m3 FROM named GROUP BY r_name),
z AS (SELECT r_name AS grp, dmu_id, y1 / m1 AS z1, y2 / m2 AS z2, y3 / m3 AS z3 FROM named JOIN tops ON r_name = t_name),
groups AS (SELECT DISTINCT grp FROM z), {corners("z", "groups")}
SELECT grp AS region, dmu_id, round(least(1.0, max(ci)), 6) AS ci FROM scored GROUP BY grp, dmu_id"""

#: With one input less, facets have that input's price at 0.
SENSITIVITY = f"""WITH {UNITS}, {FACETS},
parts AS (
  SELECT o.dmu_id, 'none' AS dropped, min((f.v1 * o.x1 + f.v2 * o.x2 + f.t) / o.y) AS phi FROM facets f CROSS JOIN u o GROUP BY o.dmu_id
  UNION ALL SELECT o.dmu_id, 'x1', min((f.v2 * o.x2 + f.t) / o.y) FROM facets f CROSS JOIN u o WHERE f.v1 = 0 GROUP BY o.dmu_id
  UNION ALL SELECT o.dmu_id, 'x2', min((f.v1 * o.x1 + f.t) / o.y) FROM facets f CROSS JOIN u o WHERE f.v2 = 0 GROUP BY o.dmu_id)
SELECT p.dmu_id, p.dropped, round(1 / greatest(1.0, p.phi), 6) AS eff, round(1 / greatest(1.0, p.phi) - 1 / greatest(1.0, n.phi), 6) + 0.0 AS delta
FROM parts p JOIN parts n ON p.dmu_id = n.dmu_id AND n.dropped = 'none' WHERE p.dropped <> 'none'"""

BOUNDED_WEIGHTS = WEIGHTS.replace(_ALL, _LIMITED)
