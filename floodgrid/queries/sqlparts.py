"""Shared SQL pieces for the DuckDB side, composed with their dependencies."""

from __future__ import annotations

import re

CELL_AREA = "69.381334e0"

PARTS: dict[str, str] = {
    "h": "SELECT (max(o_orderkey)//100+1)*1e0 AS h, CAST(max(o_orderkey)//100+1 AS INT) AS hi FROM orders",
    "g": """SELECT o_orderkey AS id, CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
        2e-1*CAST(o_orderkey // 100 AS DOUBLE) + 5e-2*CAST(abs(o_orderkey % 100 - 50) AS DOUBLE) + o_totalprice/5e6 AS z FROM orders""",
    "galt": """SELECT o_orderkey AS id, CAST(o_orderkey // 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
        2e-1*CAST(o_orderkey // 100 AS DOUBLE) + 5e-2*CAST(abs(o_orderkey % 100 - 50) AS DOUBLE) + o_totalprice/4e6 AS z FROM orders""",
    "gn": """SELECT o_orderkey AS id, g.row, g.col,
        CASE WHEN o_orderstatus='P' AND o_orderpriority='1-URGENT' THEN -9999e0 ELSE z END AS z
        FROM orders JOIN g ON g.id=o_orderkey""",
    "steps": """SELECT * FROM (VALUES (1,-1,1),(2,0,1),(4,1,1),(8,1,0),(16,1,-1),(32,0,-1),(64,-1,-1),(128,-1,0)) s(code,dr,dc)""",
    "cand": """SELECT id, z, code, CASE WHEN dr<>0 AND dc<>0 THEN sqrt(2e0) ELSE 1e0 END AS run, id+dr*100+dc AS nid
        FROM g, steps WHERE col+dc BETWEEN 0 AND 99""",
    "drops": """SELECT c.id, c.code, c.nid, (c.z-b.z)/c.run AS slope FROM cand c JOIN g b ON b.id=c.nid WHERE c.z > b.z""",
    "best": """SELECT id, code, nid FROM drops QUALIFY row_number() OVER (PARTITION BY id ORDER BY slope DESC, code)=1""",
    "d8": """SELECT g.id, g.row, g.col, g.z, coalesce(b.code,0) AS pointer, b.nid AS nxt FROM g LEFT JOIN best b ON b.id=g.id""",
    "links": "SELECT id, nxt FROM d8 WHERE nxt IS NOT NULL",
    "paths": """SELECT id AS src, id AS cur FROM d8 UNION ALL SELECT p.src, l.nxt FROM paths p JOIN links l ON l.id=p.cur""",
    "acc": "SELECT cur AS id, count(*) AS acc FROM paths GROUP BY cur",
    "flow": "SELECT d8.*, acc.acc FROM d8 JOIN acc ON acc.id=d8.id",
    "chan": "SELECT id FROM flow WHERE acc>=100",
    "openlinks": "SELECT l.id, l.nxt FROM links l LEFT JOIN chan c ON c.id=l.id WHERE c.id IS NULL",
    "tpaths": """SELECT id AS src, id AS cur FROM d8 UNION ALL SELECT p.src, l.nxt FROM tpaths p JOIN openlinks l ON l.id=p.cur""",
    "tgt": "SELECT p.src AS id, p.cur AS target FROM tpaths p JOIN chan c ON c.id=p.cur",
    "hh": """SELECT f.id, f.row, f.col, f.z, t.target, f.z - c.z AS h, c.acc AS ariver,
        pow((c.acc + 1e0)*69.381334e0/1e6, 0.354429752e0) AS hr
        FROM flow f LEFT JOIN tgt t ON t.id=f.id LEFT JOIN flow c ON c.id=t.target""",
    "raw": """SELECT *, CASE WHEN h=0 THEN 1e-5 ELSE h END AS hadj,
        CASE WHEN h>=0 THEN ln(hr/(CASE WHEN h=0 THEN 1e-5 ELSE h END)) END AS gfi FROM hh""",
    "gfi": """SELECT raw.*, 2e0*((gfi-lo)/(hi-lo)-5e-1) AS norm, hr-hadj AS wd FROM raw,
        (SELECT min(gfi) AS lo, max(gfi) AS hi FROM raw) m""",
    "nverts": """SELECT n_nationkey AS k, n_name, n_regionkey AS rk, ring, seq,
        CAST(n_nationkey % 5 AS DOUBLE)*20e0 + dx AS x, (CAST(n_nationkey // 5 AS DOUBLE) + fy)*h/5e0 AS y
        FROM nation, h, (VALUES (0,0,1.3e0,7e-2),(0,1,21.1e0,11e-2),(0,2,18.7e0,105e-2),(0,3,-2.2e0,93e-2),(0,4,1.3e0,7e-2),
          (1,0,6.2e0,35e-2),(1,1,12.9e0,42e-2),(1,2,9.4e0,71e-2),(1,3,6.2e0,35e-2)) v(ring,seq,dx,fy)
        WHERE ring=0 OR n_nationkey % 6 = 2""",
    "ze": """SELECT a.k, a.n_name, a.rk, a.ring, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM nverts a JOIN nverts b ON a.k=b.k AND a.ring=b.ring AND b.seq=a.seq+1""",
    "grow": "SELECT DISTINCT row FROM g",
    "zx": """SELECT k, row, x1 + ((row+5e-1)-y1)*(x2-x1)/(y2-y1) AS u FROM ze JOIN grow
        ON row+5e-1 >= least(y1,y2) AND row+5e-1 < greatest(y1,y2)""",
    "zc": """SELECT zx.k, g.id FROM g JOIN zx ON zx.row=g.row AND zx.u <= g.col+5e-1 GROUP BY zx.k, g.id HAVING count(*)%2=1""",
    "zn": "SELECT zc.k, zc.id, n_name, n_regionkey AS rk, r_name FROM zc JOIN nation ON n_nationkey=zc.k JOIN region ON r_regionkey=n_regionkey",
    "basin": "SELECT DISTINCT zc.id FROM zc JOIN nation ON n_nationkey=zc.k WHERE n_regionkey <> 0",
    "rverts": """SELECT r_regionkey AS k, seq, CAST(r_regionkey AS DOUBLE)*20e0 + dx AS x, fy*h AS y
        FROM region, h, (VALUES (0,10.25e0,2e-2),(1,17.25e0,27e-2),(2,5.25e0,51e-2),(3,14.25e0,74e-2),(4,7.25e0,98e-2)) v(seq,dx,fy)""",
    "re": """SELECT a.k, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM rverts a JOIN rverts b ON a.k=b.k AND b.seq=a.seq+1""",
    "rstrip": """SELECT re.*, c.col, greatest(CAST(c.col AS DOUBLE), least(x1,x2)) AS ua, least(c.col+1e0, greatest(x1,x2)) AS ub
        FROM re JOIN (SELECT DISTINCT col FROM g) c ON c.col BETWEEN floor(least(x1,x2)) AND floor(greatest(x1,x2))""",
    "rspan": """SELECT k, col, y1+(ua-x1)/(x2-x1)*(y2-y1) AS va, y1+(ub-x1)/(x2-x1)*(y2-y1) AS vb FROM rstrip""",
    "rc": """SELECT DISTINCT g.id, g.row, g.col FROM rspan s JOIN g ON g.col=s.col AND g.row BETWEEN floor(least(va,vb)) AND floor(greatest(va,vb))""",
    "obs": """SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag='R' AND l_discount >= 8e-2""",
    "scen": """SELECT * FROM (VALUES ('M175','manual',1.75e0),('M250','manual',2.5e0),('P175','physical',1.75e0),('P250','physical',2.5e0)) s(scenario,mask,spread)""",
    "haz": """SELECT s.scenario, s.mask, s.spread, v.id, v.row, v.col, v.wd, greatest(v.wd,0e0) AS depth,
        CASE WHEN v.wd<=0 THEN 0e0 ELSE 1e0/(1e0+pow(v.wd/3e-1, -s.spread)) END AS hz
        FROM gfi v, scen s WHERE v.norm IS NOT NULL AND ((s.mask='manual' AND v.norm > -0.53e0) OR (s.mask='physical' AND v.gfi > 0))""",
    "hc": "SELECT *, CASE WHEN hz<=0.333e0 THEN 1 WHEN hz<=0.666e0 THEN 2 ELSE 3 END AS cls FROM haz",
    "sar0": """SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 1 THEN 'PRE' WHEN 2 THEN 'EVENT' ELSE 'POST' END AS role,
        max(l_extendedprice)/1e5 AS vv, max(l_quantity)/1e2 AS vh FROM lineitem GROUP BY 1,2""",
    "sar": """SELECT id, role, round(10e0*log10(vv),9) AS vv, round(10e0*log10(vh),9) AS vh FROM sar0 WHERE vv>0 AND vh>0""",
    "sarw": """SELECT id, max(vv) FILTER (role='PRE') AS pre_vv, max(vv) FILTER (role='EVENT') AS event_vv, max(vv) FILTER (role='POST') AS post_vv,
        max(vh) FILTER (role='PRE') AS pre_vh, max(vh) FILTER (role='EVENT') AS event_vh, max(vh) FILTER (role='POST') AS post_vh FROM sar GROUP BY id""",
    "pts": """SELECT vec_id AS point_id, 1e3*CAST(embedding[1] AS DOUBLE) AS x, 1e3*CAST(embedding[2] AS DOUBLE) AS y, label AS beam,
        CASE WHEN vec_id % 2 = 1 THEN 'POST' ELSE 'PRE' END AS date FROM embeddings""",
    "scenes": """SELECT event_id, ts, CAST(user_id % 6 AS INT) AS orbit, CASE WHEN event_id % 2 = 0 THEN 'ASC' ELSE 'DESC' END AS direction,
        event_type AS pol, value AS coverage,
        CASE WHEN ts IS NULL THEN 'UNKNOWN' WHEN ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-14 23:59:59' THEN 'PRE'
          WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND ts <= TIMESTAMP '2024-01-18 23:59:59' THEN 'EVENT'
          WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' AND ts <= TIMESTAMP '2024-01-28 23:59:59' THEN 'POST' ELSE 'OTHER' END AS period FROM events""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the CTEs it names in front, dependencies first."""
    parts = {**PARTS, **extra}
    order: list[str] = []

    def need(text: str, open_: tuple[str, ...] = ()) -> None:
        for w in _from_names(text):
            if w in parts and w not in open_ and w not in order:
                need(parts[w], (*open_, w))
                order.append(w)

    need(body)
    if not order:
        return body
    recursive = any(n in _from_names(parts[n]) for n in order)
    ctes = ",\n".join(
        f"{n} AS ({parts[n]})" if n in _from_names(parts[n]) else f"{n} AS MATERIALIZED ({parts[n]})"
        for n in order
    )
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def _from_names(text: str) -> list[str]:
    """Table names: words after FROM, JOIN or a comma, when no dot follows."""
    return re.findall(r"(?:\bFROM\s|\bJOIN\s|,)\s*([A-Za-z_]\w*)\b(?!\s*\.)", text, re.I)
