"""Oracle SQL registry: one DuckDB statement per registered query."""

from __future__ import annotations

import oracle_sql as O
from provena.functions.score import SCENARIOS
from provena.plans import pipeline as P
from provena.plans import queries as Q
from provena.schema import STATE_CODES, TEST_STREETS

W0, W1 = Q.W0, Q.W1
_OUT_KEYS = "full_name, work_address, work_phone, latitude, longitude"
_IN_KEYS = "full_name, latitude, longitude, work_address, work_phone"
_REFCOLS = ["project_id", "date_of_intake", "referral_source", "full_name", "work_phone", "work_address", "latitude",
            "longitude", "last_verified_date", "person_id", "referral_type"]
_BLANK = "IN ('', 'nan', 'None', 'NaN')"


def _win(src: str, keys: str, name: str) -> str:
    nn = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return (f"SELECT {keys}, count(*) AS {name} FROM {src} WHERE date_of_intake BETWEEN TIMESTAMP '{W0}' "
            f"AND TIMESTAMP '{W1}' AND {nn} GROUP BY {keys}")


def _rec(k=None, w=P.WEIGHTS, specialties=None) -> str:
    return O.with_(O.ENRICHED + O.scored_sql(P.CLIENT_LAT, P.CLIENT_LON, P.RADIUS_MILES, P.MIN_REFERRALS,
                                             w.distance, w.referral, w.inbound, w.preferred,
                                             k=k, specialties=specialties))


def _null_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS n FROM referrals"
        for c in _REFCOLS)
    return (O.with_(O.REFERRALS) + "\nSELECT \"column\", null_count, CASE WHEN n > 0 THEN round((n - null_count) / n * 100, 2) "
            f"END AS non_null_pct FROM ({parts})")


def _integrity() -> str:
    def one(name, src, cols, req):
        missing = [c for c in req if c not in cols]
        nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
        geo = ("count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND "
               "(latitude < -90 OR latitude > 90 OR longitude < -180 OR longitude > 180))")
        return (f"SELECT '{name}' AS dataset, {str(not missing).lower()} AND count(*) > 0 AS valid, count(*) AS row_count, "
                f"{len(cols)} AS column_count, '{', '.join(missing)}' AS missing_required_columns, "
                f"count(*) - count(DISTINCT {{'v': full_name}}) AS duplicate_names, {geo} AS invalid_coordinates, "
                f"CASE WHEN count(*) > 0 THEN round(({nulls}) / (count(*) * {len(cols)}) * 100, 2) ELSE 0.0 END "
                f"AS missing_values_pct FROM {src}")
    prov = ["full_name", "work_address", "work_phone", "latitude", "longitude", "referral_source", "last_verified_date",
            "referral_count"]
    pref = ["full_name", "work_phone", "work_address", "latitude", "longitude", "specialty", "last_verified_date", "person_id"]
    body = " UNION ALL ".join([
        one("inbound", "(SELECT * FROM referrals WHERE referral_type = 'inbound')", _REFCOLS, ["full_name", "project_id"]),
        one("outbound", "(SELECT * FROM referrals WHERE referral_type = 'outbound')", _REFCOLS, ["full_name", "project_id"]),
        one("all_referrals", "referrals", _REFCOLS, ["full_name", "project_id"]),
        one("provider", "providers", prov, ["full_name", "referral_count"]),
        one("preferred_providers", "pref_list", pref, ["full_name", "project_id"]),
    ])
    return O.with_(O.PROVIDERS + "," + O.PREFERRED + ",\npref_list AS (" + _pref_select("pref_dedup",
                   "latitude IS NOT NULL AND longitude IS NOT NULL") + ")") + "\n" + body


def _pref_select(src: str, where: str) -> str:
    addr = ("CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(s_suppkey*10+1 AS VARCHAR) || '  Main St, , City' || "
            "CAST(s_suppkey % 50 AS VARCHAR) || ', ' || CASE WHEN s_suppkey % 2 = 0 THEN 'MD' ELSE 'VA' END || ' ' || "
            "lpad(CAST((s_suppkey*31) % 100000 AS VARCHAR), 5, '0') END")
    d = "('301' || lpad(CAST((s_suppkey*7919) % 10000000 AS VARCHAR), 7, '0'))"
    phone = f"substr({d},1,3)||'-'||substr({d},4,3)||'-'||substr({d},7,4)"
    return (f"SELECT full_name, {phone} AS work_phone, {addr} AS work_address, latitude, longitude, "
            f"specialty, last_verified_date, person_id FROM {src} WHERE {where}")


def _zip_re() -> str:
    return "'^[0-9]{5}(-[0-9]{4})?$'"


def _audit() -> str:
    strict = (f"list_filter([CASE WHEN street IS NULL OR trim(street) = '' THEN 'Street address is required' END, "
              f"CASE WHEN city IS NULL OR trim(city) = '' THEN 'City is required' END, "
              f"CASE WHEN state IS NULL OR trim(state) = '' THEN 'State is required' END, "
              f"CASE WHEN zip IS NULL OR trim(zip) = '' THEN 'ZIP code is required' END, "
              f"CASE WHEN zip IS NOT NULL AND zip <> '' AND NOT regexp_matches(trim(zip), {_zip_re()}) "
              f"THEN 'ZIP code must be in format 12345 or 12345-6789' END], lambda x: x IS NOT NULL)")
    digits = "regexp_replace(phone, '[^0-9]', '', 'g')"
    a = "trim(address)"
    return O.with_(O.CONTACTS) + f"""
SELECT person_id, 'address_parts' AS "check", len({strict}) = 0 AS ok,
  CASE WHEN len({strict}) = 0 THEN 'Valid address' ELSE array_to_string({strict}, '; ') END AS message
FROM contacts
UNION ALL
SELECT person_id, 'address', NOT (address IS NULL OR {a} = '') AND length({a}) >= 10 AND regexp_matches({a}, '[0-9]'),
  CASE WHEN address IS NULL OR {a} = '' THEN 'Address cannot be empty'
       WHEN length({a}) < 10 THEN 'Address appears too short. Please provide a complete address.'
       WHEN NOT regexp_matches({a}, '[0-9]') THEN 'Address should include a street number'
       WHEN NOT (regexp_matches({a}, '\\b[A-Z]{{2}}\\b') OR regexp_matches({a}, '[0-9]{{5}}(-[0-9]{{4}})?\\b'))
         THEN 'Consider adding state and ZIP code for better accuracy'
       ELSE '' END
FROM contacts
UNION ALL
SELECT person_id, 'coordinates',
  latitude IS NOT NULL AND longitude IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180,
  CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'Coordinates must be numeric'
       WHEN latitude < -90 OR latitude > 90 THEN 'Latitude must be between -90 and 90'
       WHEN longitude < -180 OR longitude > 180 THEN 'Longitude must be between -180 and 180'
       ELSE 'Valid coordinates' END
FROM contacts
UNION ALL
SELECT person_id, 'phone',
  phone IS NULL OR trim(phone) = '' OR length({digits}) = 10 OR (length({digits}) = 11 AND {digits} LIKE '1%'),
  CASE WHEN phone IS NULL OR trim(phone) = '' THEN 'Phone number is optional'
       WHEN length({digits}) = 10 THEN 'Valid phone number'
       WHEN length({digits}) = 11 AND {digits} LIKE '1%' THEN 'Valid phone number'
       ELSE 'Phone number must be 10 digits or 11 digits starting with 1' END
FROM contacts"""


def _advice() -> str:
    states = ", ".join(f"'{v}'" for v in STATE_CODES.values())
    tests = ", ".join(f"'{v}'" for v in TEST_STREETS)
    st = "upper(trim(state))"
    empty_state = "(state IS NULL OR trim(state) = '')"
    return O.with_(O.CONTACTS) + f"""
SELECT person_id, NOT (street IS NULL OR trim(street) = '') AS ok,
  CASE WHEN street IS NULL OR trim(street) = '' THEN 'Street address is required' ELSE '' END AS errors,
  array_to_string(list_filter([
    CASE WHEN city IS NULL OR trim(city) = '' THEN 'City is recommended for better geocoding accuracy' END,
    CASE WHEN {empty_state} THEN 'State is recommended for better geocoding accuracy' END,
    CASE WHEN NOT {empty_state} AND length({st}) = 2 AND {st} NOT IN ({states})
         THEN '''' || state || ''' may not be a valid US state abbreviation' END,
    CASE WHEN NOT {empty_state} AND length({st}) > 2
         THEN 'Consider using 2-letter state abbreviation (e.g., ''MD'' instead of ''Maryland'')' END,
    CASE WHEN NOT (zip IS NULL OR trim(zip) = '') AND NOT regexp_matches(trim(zip), '^[0-9]{{5}}$')
              AND NOT regexp_matches(trim(zip), '^[0-9]{{5}}-[0-9]{{4}}$')
         THEN 'ZIP code should be 5 digits (e.g., ''20746'') or ZIP+4 format (e.g., ''20746-1234'')' END,
    CASE WHEN NOT (street IS NULL OR trim(street) = '') AND lower(trim(street)) IN ({tests})
         THEN 'Address appears to be a test value - please enter a real address' END], lambda x: x IS NOT NULL), '; ')
    AS suggestions
FROM contacts"""


def _scenarios() -> str:
    parts = ",\n".join(
        O.tagged_scored_sql(f"s{i}", P.CLIENT_LAT, P.CLIENT_LON, P.RADIUS_MILES, P.MIN_REFERRALS,
                            w.distance, w.referral, w.inbound, w.preferred, k=10, label=n).strip().lstrip(",")
        for i, (n, w) in enumerate(SCENARIOS.items()))
    return O.with_(O.ENRICHED + ",\n" + parts) + "\n" + " UNION ALL ".join(
        f"SELECT * FROM final_s{i}" for i in range(len(SCENARIOS)))


def registry() -> dict[str, str]:
    refsel = ", ".join(_REFCOLS)
    geo_join = "FROM todo t LEFT JOIN resolved r ON t.address = r.address"
    return {
        "referrals_etl": O.with_(O.REFERRALS) + f"\nSELECT {refsel} FROM referrals",
        "preparation_summary": O.with_(O.REFERRALS) + """
SELECT count(*) FILTER (WHERE referral_type = 'inbound') AS inbound_rows,
       count(*) FILTER (WHERE referral_type = 'outbound') AS outbound_rows, count(*) AS all_rows FROM referrals""",
        "preparation_run": O.with_(O.REFERRALS + """,
kinds AS (SELECT 'inbound' AS kind UNION ALL SELECT 'outbound' UNION ALL SELECT 'all'),
of_kind AS (SELECT kind, r.* FROM kinds LEFT JOIN referrals r ON kind = 'all' OR kind = referral_type)""") + """
SELECT 'rows' AS section, kind AS name, count(referral_type) AS value FROM of_kind GROUP BY kind
""" + "".join(f"""UNION ALL SELECT 'issue', kind || ': {reason}', count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) {_BLANK})
FROM of_kind WHERE referral_type IS NOT NULL GROUP BY kind HAVING count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) {_BLANK}) > 0
""" for c, reason in Q.ISSUE_CHECKS),
        "sketch_report": O.with_(O.REFERRALS) + """
SELECT referral_type, count(*) AS referrals, min(date_of_intake) AS first_intake, max(date_of_intake) AS last_intake,
  count(DISTINCT coalesce(strftime(date_of_intake, '%Y-%m'), 'undated')) AS loads, true AS names_within_bound, true AS median_within_bound
FROM referrals GROUP BY referral_type""",
        "clustered_window": O.with_(O.REFERRALS) + f"""
SELECT referral_type, full_name, count(*) AS referrals FROM referrals
WHERE date_of_intake BETWEEN TIMESTAMP '{W0}' AND TIMESTAMP '{W1}'
  AND {O.haversine(repr(P.CLIENT_LAT), repr(P.CLIENT_LON), 'latitude', 'longitude')} <= {Q.CLUSTER_RADIUS}
GROUP BY ALL""",
        "overlay_all_referrals": O.with_(O.RAW) + f"""
SELECT pid_text AS project_id, 'outbound' AS referral_type, o_name AS full_name, o_phone AS work_phone, o_address AS work_address, o_lat AS latitude,
  o_lon AS longitude, {O._norm_date('o_verified')} AS last_verified_date, {O._norm_date('create_text')} AS referral_date, p_source AS referral_source,
  s_pid AS secondary_person_id, o_name AS referred_to FROM raw WHERE o_name IS NOT NULL
UNION ALL
SELECT pid_text, 'inbound', p_name, p_phone, p_address, p_lat, p_lon, {O._norm_date('p_verified')}, {O._norm_date('create_text')}, p_source, s_pid, o_name
FROM raw WHERE p_name IS NOT NULL""",
        "dataset_dispatch": O.with_(O.PROVIDERS + "," + O.PREFERRED + """,
sets AS (
  SELECT 'inbound_referrals' AS dataset, count(*) AS row_count, count(DISTINCT full_name) AS names FROM referrals WHERE referral_type = 'inbound'
  UNION ALL SELECT 'outbound_referrals', count(*), count(DISTINCT full_name) FROM outbound
  UNION ALL SELECT 'all_referrals', count(*), count(DISTINCT full_name) FROM referrals
  UNION ALL SELECT 'preferred_providers', count(*), count(DISTINCT full_name) FROM preferred
  UNION ALL SELECT 'provider_data', count(*), count(DISTINCT full_name) FROM providers)""") + """
SELECT dataset, way, row_count, names FROM sets, (SELECT unnest(['export', 'clean', 'fallback']) AS way)""",
        "source_validation": O.with_(O.CONTACTS + "," + O.PREFERRED + ",\npref_list AS (" + _pref_select("pref_dedup",
                                     "latitude IS NOT NULL AND longitude IS NOT NULL") + ")") + """
SELECT 'contacts' AS dataset, false AS valid, count(*) + 1 AS row_count, 12 AS column_count, '' AS missing_required_columns,
  count(*) - count(DISTINCT full_name) AS duplicate_names, CAST(0 AS BIGINT) AS invalid_coordinates,
  round((9 + """ + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '')" for c in (
            "contact_key", "copy", "full_name", "person_id", "address", "latitude", "longitude", "phone", "street", "city", "state", "zip")) + """)
        / ((count(*) + 1) * 12) * 100, 2) AS missing_values_pct, CAST(1 AS BIGINT) AS corrupt_rows, false AS error FROM contacts
UNION ALL
SELECT 'preferred_providers', false, count(*), 8, 'project_id', count(*) - count(DISTINCT full_name), CAST(0 AS BIGINT),
  CASE WHEN count(*) = 0 THEN 0.0 ELSE round((""" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in (
            "full_name", "work_phone", "work_address", "latitude", "longitude", "specialty", "last_verified_date", "person_id")) + """)
        / (count(*) * 8) * 100, 2) END, CAST(0 AS BIGINT), false FROM pref_list
UNION ALL
SELECT 'archive', false, CAST(0 AS BIGINT), 0, 'full_name', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0, CAST(0 AS BIGINT), true""",
        "providers_missing_geo": O.with_(O.PROVIDERS) + """
SELECT full_name, latitude, longitude, referral_count FROM providers
WHERE latitude IS NULL OR longitude IS NULL OR latitude = 0 OR longitude = 0""",
        "audit_summary": "SELECT \"check\", count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM ("
                         + _audit() + ") GROUP BY 1",
        "contact_phones": O.with_(O.CONTACTS + """,
stripped AS (SELECT person_id, regexp_replace(phone, '[-() ]', '', 'g') AS p FROM contacts)""") + f"""
SELECT person_id, CASE WHEN regexp_full_match(p, '[0-9]{{10}}') THEN {O._us('p')} ELSE p END AS phone FROM stripped""",
        "provider_rollup": O.with_(O.PROVIDERS) + """
SELECT full_name, work_address, work_phone, latitude, longitude, referral_source, last_verified_date, referral_count
FROM providers""",
        "enriched_providers": O.with_(O.ENRICHED) + "\nSELECT * FROM enriched",
        "inbound_counts": O.with_(O.ENRICHED) + """
SELECT full_name, latitude, longitude, work_address, work_phone, inbound_referral_count, work_address AS full_address
FROM in_counts""",
        "time_filtered_providers": O.with_(O.ENRICHED + f""",
w_out AS ({_win('outbound', _OUT_KEYS, 'cnt')}),
tf1 AS (SELECT e.* REPLACE (CASE WHEN (SELECT count(*) FROM w_out) > 0 THEN coalesce(w.cnt, 0) ELSE e.referral_count END
                            AS referral_count)
        FROM enriched e LEFT JOIN w_out w ON e.full_name IS NOT DISTINCT FROM w.full_name),
w_in AS ({_win('inbound', _IN_KEYS, 'cnt')}),
tf2 AS (SELECT t.* REPLACE (CASE WHEN (SELECT count(*) FROM w_in) > 0 THEN coalesce(w.cnt, 0)
                            ELSE t.inbound_referral_count END AS inbound_referral_count)
        FROM tf1 t LEFT JOIN w_in w ON t.full_name IS NOT DISTINCT FROM w.full_name)""") + """
SELECT full_name, referral_count, inbound_referral_count, preferred, latitude, longitude FROM tf2""",
        "time_based_counts": O.with_(O.PROVIDERS) + "\n" + _win("outbound", _OUT_KEYS, "referral_count"),
        "raw_inbound_counts": O.with_(O.RAW + """,
both_sides AS (SELECT p_name AS full_name, p_lat AS latitude, p_lon AS longitude FROM rawn
               UNION ALL SELECT s_name2, s_lat2, s_lon2 FROM rawn)""") + """
SELECT full_name, latitude, longitude, count(*) AS inbound_referral_count FROM both_sides
WHERE full_name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL""",
        "unique_specialties": O.with_(O.ENRICHED) + """
SELECT DISTINCT trim(s) AS specialty FROM (SELECT unnest(string_split(specialty, ',')) AS s FROM enriched
                                           WHERE specialty IS NOT NULL) WHERE trim(s) <> ''""",
        "preferred_list": O.with_(O.PREFERRED) + "\n" + _pref_select("pref_dedup", "latitude IS NOT NULL AND longitude IS NOT NULL"),
        "preferred_missing_geo": O.with_(O.PREFERRED) + "\n" + _pref_select("pref_dedup", "NOT (latitude IS NOT NULL AND longitude IS NOT NULL)"),
        "preferred_summary": O.with_(O.PREFERRED) + """
SELECT (SELECT count(*) FROM pref_raw) AS total_count,
  count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS cleaned_count,
  count(*) FILTER (WHERE NOT (latitude IS NOT NULL AND longitude IS NOT NULL)) AS missing_geo_count,
  count(DISTINCT full_name) AS distinct_names, count(DISTINCT full_name) > 100 AS too_many_preferred
FROM pref_dedup""",
        "recommend_top10": _rec(k=10),
        "recommend_ranked": _rec(),
        "recommend_preferred": _rec(k=25, w=P.PREF_WEIGHTS),
        "recommend_specialty": _rec(specialties=["ECONOMY", "SMALL"]),
        "best_provider": _rec(k=1),
        "batch_top5": O.with_(O.ENRICHED) + O.batch_sql(P.BATCH_RADIUS_MILES, P.MIN_REFERRALS, P.WEIGHTS.distance,
                                                       P.WEIGHTS.referral, P.WEIGHTS.inbound, P.WEIGHTS.preferred, 5),
        "radius_pairs": O.with_(O.ENRICHED + ",\n" + O.CLIENTS.strip()) + f"""
SELECT client_id, full_name, inbound_referral_count, round(d, 6) AS distance_miles FROM (
  SELECT c.client_id, e.full_name, e.inbound_referral_count,
         {O.haversine('c.client_lat', 'c.client_lon', 'e.latitude', 'e.longitude')} AS d
  FROM clients c, enriched e
  WHERE e.referral_count >= {P.MIN_REFERRALS} AND e.latitude IS NOT NULL AND e.longitude IS NOT NULL)
WHERE d <= {Q.PAIR_RADIUS}""",
        "scenario_comparison": _scenarios(),
        "data_quality": O.with_(O.ENRICHED) + f"""
SELECT count(*) AS total_records,
  count(*) FILTER (WHERE full_name IS NULL OR trim(full_name) {_BLANK}) AS missing_names,
  count(*) FILTER (WHERE work_address IS NULL OR trim(work_address) {_BLANK}) AS missing_addresses,
  count(*) FILTER (WHERE work_phone IS NULL OR trim(work_phone) {_BLANK}) AS missing_phones,
  count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL OR abs(latitude) > 90 OR abs(longitude) > 180) AS invalid_geocodes
FROM enriched""",
        "integrity_report": _integrity(),
        "provider_validation": O.with_(O.PROVIDERS + """,
a AS (SELECT CAST(count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS DOUBLE) AS mc,
             CAST(count(*) FILTER (WHERE referral_count IS NULL) AS DOUBLE) AS ic,
             CAST(count(*) FILTER (WHERE referral_count = 0) AS DOUBLE) AS zc,
             round(avg(referral_count), 1) AS av, CAST(max(referral_count) AS DOUBLE) AS mx,
             CAST(count(*) AS DOUBLE) AS n FROM providers)""") + """
SELECT 'issue' AS severity, 'missing_coordinates' AS metric, mc AS value FROM a UNION ALL
SELECT 'issue', 'invalid_referral_counts', ic FROM a UNION ALL SELECT 'info', 'zero_referral_providers', zc FROM a UNION ALL
SELECT 'info', 'avg_referrals', av FROM a UNION ALL SELECT 'info', 'max_referrals', mx FROM a UNION ALL
SELECT 'info', 'total_providers', n FROM a""",
        "us_bounds_audit": O.with_(O.ENRICHED) + """
SELECT count(*) AS providers, count(*) FILTER (WHERE coalesce(latitude, 0) < 20 OR coalesce(latitude, 0) > 70
  OR coalesce(longitude, 0) < -180 OR coalesce(longitude, 0) > -60) AS outside_us_bounds FROM enriched""",
        "issue_records": O.with_(O.REFERRALS) + "\n" + " UNION ALL ".join(
            f"SELECT project_id, full_name, referral_type, '{r}' AS issue FROM referrals "
            f"WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) {_BLANK}" for c, r in Q.ISSUE_CHECKS),
        "referral_type_distribution": O.with_(O.REFERRALS)
        + "\nSELECT referral_type, count(*) AS referrals FROM referrals GROUP BY referral_type",
        "coverage_stats": O.with_(O.REFERRALS) + f"""
SELECT count(DISTINCT full_name) AS unique_providers, min(date_of_intake) AS first_intake, max(date_of_intake) AS last_intake,
  count(*) FILTER (WHERE NOT (full_name IS NULL OR trim(full_name) {_BLANK})
                     AND NOT (work_address IS NULL OR trim(work_address) {_BLANK})
                     AND NOT (work_phone IS NULL OR trim(work_phone) {_BLANK})) AS complete_contact_rows,
  count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS geocoded_rows,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
                                    / count(*) * 100, 2) END AS geocoded_pct
FROM referrals""",
        "null_profile": _null_profile(),
        "freshness_breakdown": O.with_(O.ENRICHED + f""",
aged AS (SELECT CASE WHEN last_verified_date IS NULL THEN NULL
                     ELSE greatest(0, CAST(floor(date_diff('second', last_verified_date, TIMESTAMP '{Q.AS_OF}') / 86400)
                                           AS BIGINT)) END AS age FROM enriched)""") + """
SELECT CASE WHEN age IS NULL THEN 'Unknown' WHEN age <= 90 THEN 'Fresh' WHEN age <= 180 THEN 'Stale' ELSE 'Very Stale' END
       AS status, count(*) AS providers FROM aged GROUP BY 1""",
        "call_log_rollup": """
SELECT event_type AS function, count(*) AS calls, round(avg(value), 6) AS avg_s, round(max(value), 6) AS max_s,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*) * 100, 6) AS error_pct, max(ts) AS last_call,
  avg(value) > 10.0 AS slow
FROM events GROUP BY event_type""",
        "referral_statistics": O.with_(O.REFERRALS + """,
per AS (SELECT referral_type, full_name, count(*) AS n FROM referrals WHERE full_name IS NOT NULL GROUP BY ALL)""") + """
SELECT referral_type, sum(n) AS referrals, count(*) AS providers, max(n) AS max_per_provider,
       quantile_cont(n, 0.5) AS median_per_provider FROM per GROUP BY referral_type""",
        "output_schema_check": O.with_(O.REFERRALS) + "\n" + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", true AS present, count(*) FILTER (WHERE {c} IS NOT NULL AND "
            f"TRY_CAST(CAST({c} AS VARCHAR) AS {t}) IS NULL) AS bad_values FROM referrals"
            for c, t in [("full_name", "VARCHAR"), ("work_address", "VARCHAR"), ("work_phone", "VARCHAR"),
                         ("latitude", "DOUBLE"), ("longitude", "DOUBLE"), ("project_id", "BIGINT")])
        + " UNION ALL SELECT 'specialty', false, CAST(0 AS BIGINT)",
        "preferred_share": O.with_(O.ENRICHED) + """
SELECT count(*) FILTER (WHERE preferred) AS preferred_count, count(*) AS total_count,
  round(avg(CASE WHEN preferred THEN 1.0 ELSE 0.0 END) * 100, 1) AS preferred_pct,
  avg(CASE WHEN preferred THEN 1.0 ELSE 0.0 END) * 100 > 80.0 AS alarm FROM enriched""",
        "freshness_table": O.with_(O.ENRICHED + f""",
aged AS (SELECT full_name, last_verified_date AS d,
  CASE WHEN last_verified_date IS NULL THEN NULL
       ELSE greatest(0, CAST(floor(date_diff('second', last_verified_date, TIMESTAMP '{Q.AS_OF}') / 86400) AS BIGINT))
  END AS age_days FROM enriched),
st AS (SELECT *, CASE WHEN age_days IS NULL THEN 'Unknown' WHEN age_days <= 90 THEN 'Fresh' WHEN age_days <= 180 THEN 'Stale'
                      ELSE 'Very Stale' END AS status FROM aged)""") + """
SELECT full_name, age_days, status,
  CASE WHEN d IS NULL THEN 'Not Available'
       ELSE (CASE status WHEN 'Fresh' THEN '✅' WHEN 'Stale' THEN '⚠️' WHEN 'Very Stale' THEN '❌' ELSE '❓' END)
            || ' ' || strftime(d, '%Y-%m-%d') || ' (' || CAST(age_days AS VARCHAR) || ' days ago)' END AS display
FROM st""",
        "geocode_retry_join": O.with_(O.GEO_RESOLVED) + """
SELECT t.full_name, t.person_id, round(r.latitude, 6) AS latitude, round(r.longitude, 6) AS longitude
FROM todo t RIGHT JOIN (SELECT * FROM resolved WHERE status = 'hit' AND tier > 0) r ON t.address = r.address""",
        "bidirectional_providers": O.with_(O.REFERRALS) + """
SELECT full_name FROM referrals WHERE referral_type = 'inbound' AND full_name IS NOT NULL
INTERSECT SELECT full_name FROM referrals WHERE referral_type = 'outbound'""",
        "address_audit": _audit(),
        "address_advice": _advice(),
        "duplicate_addresses": O.with_(O.CONTACTS + """,
per AS (SELECT address, count(*) AS n FROM contacts WHERE address IS NOT NULL GROUP BY address HAVING count(*) > 1)""") + """
SELECT count(*) AS duplicate_addresses, coalesce(sum(n), 0) AS records, coalesce(sum(n - 1), 0) AS lookups_saved FROM per""",
        "needs_geocoding": O.with_(O.CONTACTS) + """
SELECT DISTINCT * FROM contacts WHERE address IS NOT NULL AND (latitude IS NULL OR longitude IS NULL)""",
        "geocode_resolved": O.with_(O.GEO_RESOLVED) + """
SELECT address, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, tier, status FROM resolved""",
        "geocode_enriched": O.with_(O.GEO_RESOLVED) + f"""
SELECT t.person_id, t.full_name, t.address, round(coalesce(t.latitude, r.latitude), 6) AS latitude,
  round(coalesce(t.longitude, r.longitude), 6) AS longitude, r.tier, r.status {geo_join}""",
        "stream_intake": O.with_(O.REFERRALS) + f"""
SELECT {refsel} FROM (SELECT * FROM prim UNION ALL SELECT * FROM sec UNION ALL SELECT * FROM outb)""",
        "stream_first_seen": O.with_(O.REFERRALS) + f"\nSELECT {refsel} FROM referrals",
        "stream_first_seen_bounded": O.with_(O.REFERRALS) + """,
passed AS (SELECT referral_type, person_id FROM (SELECT * FROM prim UNION ALL SELECT * FROM sec UNION ALL SELECT * FROM outb)
           WHERE person_id IS NULL
           UNION ALL SELECT DISTINCT referral_type, person_id FROM sec WHERE person_id IS NOT NULL)
SELECT referral_type, person_id IS NOT NULL AS has_id, count(*) AS row_count, count(DISTINCT person_id) AS ids
FROM passed GROUP BY ALL""",
        "stream_running_counts": O.with_(O.REFERRALS) + f"""
SELECT referral_type, {_OUT_KEYS}, coalesce(strftime(date_of_intake, '%Y-%m'), 'undated') AS month, count(*) AS referrals
FROM (SELECT * FROM prim UNION ALL SELECT * FROM sec UNION ALL SELECT * FROM outb)
WHERE full_name IS NOT NULL AND work_address IS NOT NULL AND work_phone IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
GROUP BY ALL""",
        "geocode_merged": O.with_(O.GEO_RESOLVED) + """
SELECT t.full_name, t.person_id, round(coalesce(t.latitude, r.latitude), 6) AS latitude, round(coalesce(t.longitude, r.longitude), 6) AS longitude
FROM todo t JOIN resolved r ON t.address = r.address WHERE r.status = 'hit' AND r.tier = 0
UNION
SELECT t.full_name, t.person_id, round(r.latitude, 6), round(r.longitude, 6)
FROM todo t RIGHT JOIN (SELECT * FROM resolved WHERE status = 'hit' AND tier > 0) r ON t.address = r.address""",
        "geocode_failures": O.with_(O.GEO_RESOLVED) + """
SELECT DISTINCT t.full_name, t.address FROM todo t JOIN resolved r ON t.address = r.address WHERE NOT coalesce(r.tier = 0, false)""",
        "geocode_work_list": O.with_(O.GEO_RESOLVED) + "\nSELECT address FROM resolved WHERE status = 'unresolved'",
        "geocode_cache_merged": O.with_(O.GEO_RESOLVED + """,
answers AS (
  SELECT md5(lower(trim(address))) AS addr_key, md5(lower(trim(address))) < '8' AS found, address,
         CASE status WHEN 'unresolved' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2023-12-01 00:00:00' END AS looked_up_at
  FROM resolved WHERE status <> 'hit'),
entries AS (
  SELECT addr_key, latitude, longitude, address, found, TIMESTAMP '2024-01-01 00:00:00' AS looked_up_at FROM gcache
  UNION ALL
  SELECT addr_key, CASE WHEN found THEN 40.0 + length(address) / 100.0 END, CASE WHEN found THEN -80.0 - length(address) / 100.0 END,
         address, found, looked_up_at FROM answers)""") + """
SELECT addr_key, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, address, found, looked_up_at
FROM (SELECT *, row_number() OVER (PARTITION BY addr_key ORDER BY looked_up_at DESC) AS rn FROM entries) WHERE rn = 1""",
        "reload_changed_files": f"""
SELECT CAST(l_orderkey % {Q.RELOAD_PARTS} AS INTEGER) AS part, CASE WHEN l_orderkey % {Q.RELOAD_PARTS} = {Q.RELOAD_PART} THEN 2 ELSE 1 END AS loaded_in,
  count(*) AS row_count, count(DISTINCT l_orderkey) AS projects
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT (l_orderkey % {Q.RELOAD_PARTS} = {Q.RELOAD_PART} AND l_linenumber = 1) GROUP BY ALL""",
        "geocode_report": O.with_(O.GEO_RESOLVED + f""",
e AS (SELECT coalesce(t.latitude, r.latitude) AS lat, coalesce(t.longitude, r.longitude) AS lon {geo_join})""") + """
SELECT count(*) AS total, count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS succeeded,
  count(*) FILTER (WHERE NOT (lat IS NOT NULL AND lon IS NOT NULL)) AS failed,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) / count(*) * 100, 1) END
  AS success_pct FROM e""",
    }
