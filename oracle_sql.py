"""DuckDB oracle SQL for the registered queries.

Each stage of the Spark pipeline is restated here as plain SQL CTEs over
the driver's tables, written independently of the Spark code: the derived
export, the referral split + cleaning + Person-ID keep-first, the provider
roll-up, the preferred list, the enrichment joins and the scoring.
Doubles are rounded to 6 places in the final projections on both sides.
"""

from __future__ import annotations

DOCTOR = "'Referral - Doctor''s Office'"
NUM_RE = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


def _phone(d: str, v: str) -> str:
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN {v} = 0 THEN substr({d},1,3)||'-'||substr({d},4,3)||'-'||substr({d},7,4) "
            f"WHEN {v} = 1 THEN '1'||{d} WHEN {v} = 2 THEN ' '||{d}||' ' ELSE NULL END")


def _norm_date(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN {x} IS NULL OR {t} = '' THEN NULL "
            f"WHEN regexp_matches({t}, {NUM_RE}) THEN TIMESTAMP '1899-12-30 00:00:00' + "
            f"to_microseconds(CAST(round(CAST({t} AS DOUBLE) * 86400000000.0) AS BIGINT)) "
            f"ELSE TRY_CAST({t} AS TIMESTAMP) END")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _us(d: str) -> str:
    return f"'(' || substr({d},1,3) || ') ' || substr({d},4,3) || '-' || substr({d},7,4)"


def _clean_phone(x: str) -> str:
    d = _digits(x)
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN length({d}) = 10 THEN {_us(d)} "
            f"WHEN trim({x}) = '' THEN NULL ELSE trim({x}) END")


def _format_phone(x: str) -> str:
    d = _digits(x)
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN length({d}) = 10 THEN {_us(d)} "
            f"WHEN length({d}) = 11 AND {d} LIKE '1%' THEN {_us('substr(' + d + ',2,10)')} ELSE {x} END")


def _clean_address(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL "
            f"ELSE replace(replace(trim({x}), ', ,', ','), '  ', ' ') END")


def _clean_geo(x: str) -> str:
    v = f"TRY_CAST(replace({x}, '--', '-') AS DOUBLE)"
    return f"CASE WHEN {v} IS NULL OR isnan({v}) OR {v} < -180 OR {v} > 180 THEN NULL ELSE {v} END"


def _blank(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} IN ('', 'nan', 'None', 'NaN') THEN '' ELSE {x} END"


def _tidy(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, ',\\s*,', ',', 'g'), ',\\s*$', '', 'g')"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)")
    return f"(7917.6 * asin(CASE WHEN sqrt({a}) > 1.0 THEN 1.0 ELSE sqrt({a}) END))"


def _dir(prefix: str) -> str:
    k = "s_suppkey"
    lat = f"(2500 + ({k}*37) % 2400)"
    lon = f"(12400 - ({k}*53) % 5700)"
    return f"""
  SELECT {k} AS {prefix}key,
    'Supplier#' || lpad(CAST({k} AS VARCHAR), 9, '0') AS {prefix}name,
    '301' || lpad(CAST(({k}*7919) % 10000000 AS VARCHAR), 7, '0') AS {prefix}digits,
    CASE WHEN {k} % 13 = 0 THEN NULL ELSE CAST({k}*10+1 AS VARCHAR) || '  Main St, , City' || CAST({k} % 50 AS VARCHAR)
      || ', ' || CASE WHEN {k} % 2 = 0 THEN 'MD' ELSE 'VA' END || ' ' || lpad(CAST(({k}*31) % 100000 AS VARCHAR), 5, '0') END AS {prefix}address,
    CASE WHEN {k} % 41 = 0 THEN NULL ELSE CAST({lat} // 100 AS VARCHAR) || '.' || lpad(CAST({lat} % 100 AS VARCHAR), 2, '0') END AS {prefix}lat,
    CASE WHEN {k} % 41 = 0 THEN NULL ELSE '-' || CAST({lon} // 100 AS VARCHAR) || '.' || lpad(CAST({lon} % 100 AS VARCHAR), 2, '0') END AS {prefix}lon
  FROM supplier"""


# ---------------------------------------------------------------------------
# Stage CTEs
# ---------------------------------------------------------------------------
RAW = f"""
nsupp AS (SELECT count(*) AS n FROM supplier),
j AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, o.o_orderdate, o.o_orderpriority,
         o.o_custkey % (SELECT n FROM nsupp) AS kf,
         CASE WHEN l.l_linenumber <= 2 THEN (o.o_custkey * 7 + 3) % (SELECT n FROM nsupp) END AS ks,
         l.l_partkey % 4 AS v
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
wide AS (
  SELECT j.*, t.*, f.*, s.*, strftime(j.l_shipdate, '%Y-%m-%d') AS ship_text
  FROM j LEFT JOIN ({_dir('t_')}) t ON j.l_suppkey = t.t_key
         LEFT JOIN ({_dir('f_')}) f ON j.kf = f.f_key
         LEFT JOIN ({_dir('s_')}) s ON j.ks = s.s_key),
raw AS (
  SELECT {SEQ},
    CAST(l_orderkey AS VARCHAR) AS pid_text,
    CASE WHEN l_linenumber = 4 THEN NULL
         WHEN l_linenumber = 3 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)
         ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS intake_text,
    ship_text AS create_text,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN {DOCTOR} ELSE 'Self Referral' END AS p_source,
    CASE WHEN l_linenumber <> 6 THEN f_name END AS p_name,
    {_phone('f_digits', '(v + 1) % 4')} AS p_phone,
    f_address AS p_address, f_lat AS p_lat,
    CASE WHEN l_linenumber = 2 AND f_lon IS NOT NULL THEN '-' || f_lon ELSE f_lon END AS p_lon,
    ship_text AS p_verified,
    CASE WHEN s_key IS NOT NULL AND o_orderpriority <> '5-LOW' THEN {DOCTOR} END AS s_source,
    s_name AS s_name2, {_phone('s_digits', 'v')} AS s_phone, s_address AS s_address2, s_lat AS s_lat2, s_lon AS s_lon2,
    CASE WHEN s_key IS NOT NULL THEN ship_text END AS s_verified,
    'P' || CAST(s_key AS VARCHAR) AS s_pid,
    t_name AS o_name, {_phone('t_digits', 'v')} AS o_phone, t_address AS o_address, t_lat AS o_lat,
    CASE WHEN l_linenumber = 5 AND t_lon IS NOT NULL THEN '-' || t_lon ELSE t_lon END AS o_lon,
    CASE WHEN l_linenumber <> 5 THEN ship_text END AS o_verified
  FROM wide),
rawn AS (
  SELECT *, coalesce({_norm_date('intake_text')}, {_norm_date('create_text')}) AS intake FROM raw)"""


def _party(src, name, phone, addr, lat, lon, verified, pid, rtype, cfg, default_src, where):
    return f"""
  SELECT TRY_CAST(pid_text AS BIGINT) AS project_id, intake AS date_of_intake,
    coalesce({src}, {default_src}) AS referral_source, {name} AS full_name,
    {_clean_phone(phone)} AS work_phone, {_clean_address(addr)} AS work_address,
    {_clean_geo(lat)} AS latitude, {_clean_geo(lon)} AS longitude,
    {_norm_date(verified)} AS last_verified_date, {pid} AS person_id, '{rtype}' AS referral_type, {cfg} AS cfg, {SEQ}
  FROM rawn WHERE {where}"""


REFERRALS = RAW + f""",
prim AS ({_party('p_source', 'p_name', 'p_phone', 'p_address', 'p_lat', 'p_lon', 'p_verified', 'CAST(NULL AS VARCHAR)',
                 'inbound', 0, DOCTOR,
                 f"p_source = {DOCTOR} AND p_name IS NOT NULL AND p_address IS NOT NULL AND p_lat IS NOT NULL AND p_lon IS NOT NULL")}),
sec AS ({_party('s_source', 's_name2', 's_phone', 's_address2', 's_lat2', 's_lon2', 's_verified', 's_pid',
                'inbound', 1, DOCTOR,
                f"s_source = {DOCTOR} AND s_name2 IS NOT NULL AND s_address2 IS NOT NULL AND s_lat2 IS NOT NULL AND s_lon2 IS NOT NULL")}),
outb AS ({_party('CAST(NULL AS VARCHAR)', 'o_name', 'o_phone', 'o_address', 'o_lat', 'o_lon', 'o_verified', 'CAST(NULL AS VARCHAR)',
                 'outbound', 2, "'Outbound Referral'", "o_name IS NOT NULL AND o_lat IS NOT NULL AND o_lon IS NOT NULL")}),
sec_first AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY {SEQ}) AS rn FROM sec)
  WHERE rn = 1 OR NOT coalesce((SELECT bool_or(person_id IS NOT NULL) FROM sec), false)),
referrals AS (SELECT * FROM prim UNION ALL SELECT * FROM sec_first UNION ALL SELECT * FROM outb)"""


PROVIDERS = REFERRALS + f""",
outbound AS (SELECT * FROM referrals WHERE referral_type = 'outbound'),
providers AS (
  SELECT full_name, count(project_id) AS referral_count,
    {_blank(f"first(work_address ORDER BY date_of_intake NULLS LAST, {SEQ}) FILTER (WHERE work_address IS NOT NULL)")} AS work_address,
    {_blank(f"first(work_phone ORDER BY date_of_intake NULLS LAST, {SEQ}) FILTER (WHERE work_phone IS NOT NULL)")} AS work_phone,
    first(latitude ORDER BY date_of_intake NULLS LAST, {SEQ}) FILTER (WHERE latitude IS NOT NULL) AS latitude,
    first(longitude ORDER BY date_of_intake NULLS LAST, {SEQ}) FILTER (WHERE longitude IS NOT NULL) AS longitude,
    {_blank(f"first(referral_source ORDER BY date_of_intake NULLS LAST, {SEQ}) FILTER (WHERE referral_source IS NOT NULL)")} AS referral_source,
    max(last_verified_date) AS last_verified_date
  FROM outbound WHERE full_name IS NOT NULL GROUP BY full_name)"""


PREFERRED = f"""
spec AS (
  SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS specialty
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey),
pbase AS (SELECT s_suppkey, s_acctbal, specialty FROM supplier LEFT JOIN spec ON s_suppkey = spec.l_suppkey WHERE s_acctbal > 7500),
prows AS (SELECT *, 0 AS copy FROM pbase UNION ALL SELECT *, 1 AS copy FROM pbase WHERE s_acctbal > 9000),
pref_raw AS (
  SELECT copy, s_suppkey,
    'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS full_name,
    CASE WHEN s_suppkey % 41 = 0 THEN NULL ELSE (2500 + (s_suppkey*37) % 2400) / 100.0 END AS latitude,
    CASE WHEN s_suppkey % 41 = 0 THEN NULL ELSE -((12400 - (s_suppkey*53) % 5700) / 100.0) END AS longitude,
    specialty,
    CASE WHEN copy = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-07-27 00:00:00' END AS last_verified_date,
    'P' || CAST(s_suppkey AS VARCHAR) AS person_id
  FROM prows),
pref_dedup AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY copy, s_suppkey) AS rn FROM pref_raw)
  WHERE rn = 1),
preferred AS (SELECT * FROM pref_dedup WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"""


ENRICHED = PROVIDERS + "," + PREFERRED + f""",
inbound AS (SELECT * FROM referrals WHERE referral_type = 'inbound'),
in_counts AS (
  SELECT full_name, latitude, longitude, work_address, work_phone, count(*) AS inbound_referral_count
  FROM inbound
  WHERE full_name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND work_address IS NOT NULL AND work_phone IS NOT NULL
  GROUP BY ALL),
valid AS (
  SELECT * REPLACE (coalesce(latitude, 0.0) AS latitude, coalesce(longitude, 0.0) AS longitude) FROM providers
  WHERE coalesce(latitude, 0.0) <> 0 AND coalesce(longitude, 0.0) <> 0),
prov2 AS (
  SELECT *, {_tidy(f"coalesce(CASE WHEN trim(work_address) IN ('', 'nan', 'None', 'NaN') THEN NULL ELSE trim(work_address) END, '')")} AS full_address,
    {_format_phone('work_phone')} AS work_phone_number
  FROM valid),
with_in AS (
  SELECT p.*, coalesce(c.inbound_referral_count, 0) AS inbound_referral_count
  FROM prov2 p LEFT JOIN in_counts c ON p.full_name IS NOT DISTINCT FROM c.full_name),
pref_first AS (
  SELECT full_name, specialty FROM (
    SELECT full_name, specialty, row_number() OVER (PARTITION BY full_name ORDER BY copy, s_suppkey) AS rn FROM preferred)
  WHERE rn = 1),
enriched AS (
  SELECT coalesce(w.full_name, pf.full_name) AS full_name, w.work_address, w.work_phone, w.latitude, w.longitude,
    w.referral_source, w.last_verified_date, coalesce(w.referral_count, 0) AS referral_count, w.full_address,
    w.work_phone_number, coalesce(w.inbound_referral_count, 0) AS inbound_referral_count,
    pf.full_name IS NOT NULL AS preferred, pf.specialty AS specialty
  FROM with_in w FULL OUTER JOIN pref_first pf ON w.full_name IS NOT DISTINCT FROM pf.full_name)"""


def scored_sql(lat: float, lon: float, radius: float, min_ref: int, wd: float, wr: float, wi: float, wp: float,
               source: str = "enriched", k: int | None = None, specialties: list[str] | None = None) -> str:
    """Candidates → stats → score → best per name → rank, for one client location."""
    spec = ""
    if specialties:
        lst = ", ".join("'" + s.replace("'", "''") + "'" for s in specialties)
        spec = f" AND coalesce(len(list_intersect(list_transform(string_split(specialty, ','), lambda x: trim(x)), [{lst}])) > 0, false)"
    use_pref = wp > 0
    use_in = wi > 0
    dist_first = wd > wr
    order = ["score DESC NULLS LAST"]
    order += (["distance_miles DESC NULLS LAST", "referral_count DESC NULLS LAST"] if dist_first
              else ["referral_count DESC NULLS LAST", "distance_miles DESC NULLS LAST"])
    order += ["inbound_referral_count DESC NULLS LAST", "full_name ASC NULLS LAST"]
    ob = ", ".join(order)
    pref_flag = "CASE WHEN preferred THEN 1 ELSE 0 END"
    nd = "CASE WHEN st.max_d - st.min_d = 0 THEN 0.0 ELSE (st.max_d - distance_miles) / (st.max_d - st.min_d) END"
    nr = "CASE WHEN st.max_c - st.min_c = 0 THEN 0.0 ELSE (referral_count - st.min_c) / CAST(st.max_c - st.min_c AS DOUBLE) END"
    npf = f"CASE WHEN st.max_p - st.min_p = 0 THEN 0.0 ELSE ({pref_flag} - st.min_p) / CAST(st.max_p - st.min_p AS DOUBLE) END"
    ni = ("CASE WHEN inbound_referral_count IS NULL THEN NULL WHEN st.max_i - st.min_i = 0 THEN 0.0 "
          "ELSE (inbound_referral_count - st.min_i) / CAST(st.max_i - st.min_i AS DOUBLE) END")
    base = f"({wd} * norm_dist + {wr} * norm_rank)"
    score = base
    if use_pref:
        score = f"({score} + {wp} * norm_pref)"
    if use_in:
        score = f"CASE WHEN inbound_referral_count IS NOT NULL THEN ({base} + {wi} * norm_inbound) ELSE {score} END"
    limit = f" WHERE rank <= {k}" if k is not None else ""
    return f""",
cands AS (
  SELECT *, {haversine(repr(float(lat)), repr(float(lon)), 'latitude', 'longitude')} AS distance_miles
  FROM {source} WHERE referral_count >= {min_ref}{spec}),
cands2 AS (SELECT * FROM cands WHERE distance_miles <= {float(radius)} AND referral_count IS NOT NULL AND referral_count >= {min_ref}),
st AS (SELECT min(referral_count) min_c, max(referral_count) max_c, min(distance_miles) min_d, max(distance_miles) max_d,
              min({pref_flag}) min_p, max({pref_flag}) max_p, min(inbound_referral_count) min_i, max(inbound_referral_count) max_i
       FROM cands2),
normed AS (
  SELECT c.*, {nd} AS norm_dist, {nr} AS norm_rank, {npf} AS norm_pref, {ni if use_in else 'CAST(NULL AS DOUBLE)'} AS norm_inbound
  FROM cands2 c, st),
scored AS (SELECT *, {score} AS score FROM normed),
best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY {ob}) AS rn FROM scored) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY {ob}) AS rank FROM best)
SELECT full_name, round(distance_miles, 6) AS distance_miles, referral_count, inbound_referral_count, preferred,
  round(norm_dist, 6) AS norm_dist, round(norm_rank, 6) AS norm_rank, round(norm_inbound, 6) AS norm_inbound,
  round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM ranked{limit}"""


def with_(ctes: str) -> str:
    return "WITH " + ctes.strip().lstrip(",")


# ---------------------------------------------------------------------------
# More derived inputs
# ---------------------------------------------------------------------------
CLIENTS = """
clients AS (
  SELECT c_custkey AS client_id,
    CASE WHEN c_custkey % 53 = 0 THEN 89.95 WHEN c_custkey % 53 = 1 THEN -12.5
         ELSE (2500 + (c_custkey * 41) % 2400) / CAST(100.0 AS DOUBLE) END AS client_lat,
    CASE WHEN c_custkey % 53 = 0 THEN 10.0 WHEN c_custkey % 53 = 1 THEN 179.99
         ELSE -((12400 - (c_custkey * 59) % 5700) / CAST(100.0 AS DOUBLE)) END AS client_lon
  FROM customer)"""

UNIT_RE = r"'(?i)\b(Suite|Ste|Apt|Apartment|#)\s*\w*\b'"

CONTACTS = f"""
c1 AS (
  SELECT s_suppkey AS contact_key, 0 AS copy,
    'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS full_name,
    'P' || CAST(s_suppkey AS VARCHAR) AS person_id,
    CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(s_suppkey*10+1 AS VARCHAR) || ' Main St, City' || CAST(s_suppkey % 50 AS VARCHAR)
      || ', ' || CASE WHEN s_suppkey % 2 = 0 THEN 'MD' ELSE 'VA' END || ' ' || lpad(CAST((s_suppkey*31) % 100000 AS VARCHAR), 5, '0')
      || CASE s_suppkey % 4 WHEN 0 THEN ' Ste ' || CAST(s_suppkey % 50 AS VARCHAR) WHEN 1 THEN ' #' || CAST(s_suppkey % 9 AS VARCHAR)
              WHEN 2 THEN ' Apt ' || CAST(s_suppkey % 7 AS VARCHAR) ELSE '' END END AS address,
    CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 41 = 0 THEN NULL ELSE (2500 + (s_suppkey*37) % 2400) / CAST(100.0 AS DOUBLE) END AS latitude,
    CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 41 = 0 THEN NULL ELSE -((12400 - (s_suppkey*53) % 5700) / CAST(100.0 AS DOUBLE)) END AS longitude,
    {_phone("'301' || lpad(CAST((s_suppkey*7919) % 10000000 AS VARCHAR), 7, '0')", 's_suppkey % 4')} AS phone,
    CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE CAST(s_suppkey*10+1 AS VARCHAR) || ' Main St' END AS street,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'City' || CAST(s_suppkey % 50 AS VARCHAR) END AS city,
    CASE s_suppkey % 5 WHEN 0 THEN 'Maryland' WHEN 1 THEN 'ZZ' WHEN 2 THEN NULL ELSE 'VA' END AS state,
    CASE WHEN s_suppkey % 6 = 1 THEN 'ABCDE' WHEN s_suppkey % 6 = 2 THEN '20746-1234'
         ELSE lpad(CAST((s_suppkey*31) % 100000 AS VARCHAR), 5, '0') END AS zip
  FROM supplier),
contacts AS (
  SELECT * FROM c1 UNION ALL
  SELECT * REPLACE (1 AS copy, 'Contact#' || CAST(contact_key AS VARCHAR) AS full_name, 'Q' || CAST(contact_key AS VARCHAR) AS person_id)
  FROM c1 WHERE contact_key % 6 = 0),
ctiers AS (
  SELECT contact_key, address, 0 AS tier, address AS candidate FROM contacts WHERE address IS NOT NULL
  UNION ALL
  SELECT contact_key, address, 1, replace(replace(replace(address, '#', ''), 'Ste', 'Suite'), 'Apt', 'Apartment') FROM contacts
  WHERE address IS NOT NULL AND replace(replace(replace(address, '#', ''), 'Ste', 'Suite'), 'Apt', 'Apartment') <> address
  UNION ALL
  SELECT contact_key, address, 2, trim(regexp_replace(address, {UNIT_RE}, '', 'g')) FROM contacts
  WHERE address IS NOT NULL AND trim(regexp_replace(address, {UNIT_RE}, '', 'g')) <> address
    AND length(trim(regexp_replace(address, {UNIT_RE}, '', 'g'))) > 10),
gcache AS (
  SELECT md5(lower(trim(candidate))) AS addr_key,
    CASE WHEN tier = CASE contact_key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END
         THEN (2500 + (contact_key*37) % 2400) / CAST(100.0 AS DOUBLE) + 0.001 END AS latitude,
    CASE WHEN tier = CASE contact_key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END
         THEN -((12400 - (contact_key*53) % 5700) / CAST(100.0 AS DOUBLE)) - 0.001 END AS longitude,
    candidate AS address,
    coalesce(tier = CASE contact_key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END, false) AS found
  FROM ctiers
  WHERE copy_ok AND (tier = CASE contact_key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END
         OR (tier = 0 AND contact_key % 5 IN (1, 2, 3))))"""

# gcache is built only from the first copy of each contact
CONTACTS = CONTACTS.replace("FROM ctiers\n  WHERE copy_ok AND", "FROM (SELECT DISTINCT contact_key, tier, candidate FROM ctiers) ctiers\n  WHERE")

GEO_RESOLVED = CONTACTS + """,
todo AS (SELECT DISTINCT * FROM contacts WHERE address IS NOT NULL AND (latitude IS NULL OR longitude IS NULL)),
utiers AS (
  SELECT DISTINCT t.address, t.tier, t.candidate FROM ctiers t JOIN (SELECT DISTINCT address FROM todo) u ON t.address = u.address),
tj AS (SELECT u.*, g.latitude AS g_lat, g.longitude AS g_lon, g.found FROM utiers u LEFT JOIN gcache g ON md5(lower(trim(u.candidate))) = g.addr_key),
resolved AS (
  SELECT address,
    arg_min(g_lat, tier) FILTER (WHERE found AND g_lat IS NOT NULL AND g_lon IS NOT NULL) AS latitude,
    arg_min(g_lon, tier) FILTER (WHERE found AND g_lat IS NOT NULL AND g_lon IS NOT NULL) AS longitude,
    min(tier) FILTER (WHERE found AND g_lat IS NOT NULL AND g_lon IS NOT NULL) AS tier,
    CASE WHEN count(*) FILTER (WHERE found AND g_lat IS NOT NULL AND g_lon IS NOT NULL) > 0 THEN 'hit'
         WHEN bool_or(found IS NULL) THEN 'unresolved' ELSE 'negative' END AS status
  FROM tj GROUP BY address)"""


def tagged_scored_sql(tag: str, lat, lon, radius, min_ref, wd, wr, wi, wp, k=None, source="enriched",
                      label: str | None = None) -> str:
    """``scored_sql`` with CTE names suffixed by ``tag`` and a final SELECT named ``final_<tag>``."""
    body = scored_sql(lat, lon, radius, min_ref, wd, wr, wi, wp, source=source, k=k)
    for name in ("cands2", "cands", "normed", "scored", "ranked", "best", "st"):
        body = body.replace(f"{name} AS (", f"{name}_{tag} AS (")
        for pre in ("FROM ", "JOIN ", ", "):
            body = body.replace(f"{pre}{name})", f"{pre}{name}_{tag})").replace(f"{pre}{name} ", f"{pre}{name}_{tag} ") \
                       .replace(f"{pre}{name}\n", f"{pre}{name}_{tag}\n").replace(f"{pre}{name},", f"{pre}{name}_{tag},")
    body = body.replace("st.min_", f"st_{tag}.min_").replace("st.max_", f"st_{tag}.max_")
    head, sel = body.rsplit("\nSELECT ", 1)
    lab = (label or tag).replace("'", "''")
    return head + f",\nfinal_{tag} AS (SELECT '{lab}' AS scenario, " + sel + ")"


def batch_sql(radius, min_ref, wd, wr, wi, wp, k) -> str:
    order = ["score DESC NULLS LAST"]
    order += (["distance_miles DESC NULLS LAST", "referral_count DESC NULLS LAST"] if wd > wr
              else ["referral_count DESC NULLS LAST", "distance_miles DESC NULLS LAST"])
    order += ["inbound_referral_count DESC NULLS LAST", "full_name ASC NULLS LAST"]
    ob = ", ".join(order)
    base = f"({wd} * norm_dist + {wr} * norm_rank)"
    score = base
    if wp > 0:
        score = f"({score} + {wp} * norm_pref)"
    if wi > 0:
        score = f"CASE WHEN inbound_referral_count IS NOT NULL THEN ({base} + {wi} * norm_inbound) ELSE {score} END"
    ni = ("CASE WHEN st.max_i - st.min_i = 0 THEN 0.0 ELSE (inbound_referral_count - st.min_i) / CAST(st.max_i - st.min_i AS DOUBLE) END"
          if wi > 0 else "CAST(NULL AS DOUBLE)")
    return f""",
{CLIENTS.strip()},
pairs AS (
  SELECT c.client_id, c.client_lat, c.client_lon, e.*, {haversine('c.client_lat', 'c.client_lon', 'e.latitude', 'e.longitude')} AS distance_miles
  FROM clients c, enriched e
  WHERE e.referral_count >= {min_ref} AND e.latitude IS NOT NULL AND e.longitude IS NOT NULL),
bp AS (SELECT * FROM pairs WHERE distance_miles <= {float(radius)}),
st AS (SELECT client_id, min(referral_count) min_c, max(referral_count) max_c, min(distance_miles) min_d, max(distance_miles) max_d,
              min(CASE WHEN preferred THEN 1 ELSE 0 END) min_p, max(CASE WHEN preferred THEN 1 ELSE 0 END) max_p,
              min(inbound_referral_count) min_i, max(inbound_referral_count) max_i FROM bp GROUP BY client_id),
normed AS (
  SELECT b.*,
    CASE WHEN st.max_d - st.min_d = 0 THEN 0.0 ELSE (st.max_d - distance_miles) / (st.max_d - st.min_d) END AS norm_dist,
    CASE WHEN st.max_c - st.min_c = 0 THEN 0.0 ELSE (referral_count - st.min_c) / CAST(st.max_c - st.min_c AS DOUBLE) END AS norm_rank,
    CASE WHEN st.max_p - st.min_p = 0 THEN 0.0 ELSE ((CASE WHEN preferred THEN 1 ELSE 0 END) - st.min_p) / CAST(st.max_p - st.min_p AS DOUBLE) END AS norm_pref,
    {ni} AS norm_inbound
  FROM bp b JOIN st USING (client_id)),
scored AS (SELECT *, {score} AS score FROM normed),
best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY client_id, full_name ORDER BY {ob}) AS rn FROM scored) WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {ob}) AS rank FROM best)
SELECT client_id, full_name, round(distance_miles, 6) AS distance_miles, referral_count, inbound_referral_count, preferred,
  round(norm_dist, 6) AS norm_dist, round(norm_rank, 6) AS norm_rank, round(norm_inbound, 6) AS norm_inbound,
  round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= {k}"""
