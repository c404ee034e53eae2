"""Inputs shaped from the given tables by SQL that Spark and the checking engine both run.

They only bring the tables into the form of flows, hosts, users and logs; whole tables go in.
"""

from __future__ import annotations

from threatlake import constants as C


def _values(rows, columns) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    selects = []
    for i, row in enumerate(rows):
        cells = [literal(v) + (f" AS {c}" if i == 0 else "") for v, c in zip(row, columns)]
        selects.append("SELECT " + ", ".join(cells))
    return " UNION ALL ".join(selects)


def _numbered(rows):
    return [(i, *r) for i, r in enumerate(rows, 1)]


INPUTS = {
    # network flows with text fields as they come from files
    "fx_flow": """
SELECT event_id, ts AS event_time, user_id, value, event_type,
  CASE WHEN day(ts) <= 6 THEN 'Monday' WHEN day(ts) <= 12 THEN 'Tuesday' ELSE 'Friday' END AS source_day,
  CASE event_id % 8
    WHEN 0 THEN concat('192.168.10.', CAST(user_id % 256 AS STRING))
    WHEN 1 THEN concat('10.0.7.', CAST(user_id % 256 AS STRING))
    WHEN 2 THEN concat('172.16.0.', CAST(user_id % 256 AS STRING))
    WHEN 3 THEN concat('8.8.4.', CAST(user_id % 256 AS STRING))
    WHEN 4 THEN concat('100.64.1.', CAST(user_id % 256 AS STRING))
    WHEN 5 THEN concat('224.0.0.', CAST(user_id % 256 AS STRING))
    WHEN 6 THEN concat('10.0.0.', CAST(user_id + 200 AS STRING))
    ELSE CAST(NULL AS STRING) END AS src_ip,
  concat('203.0.114.', CAST(event_id % 97 AS STRING)) AS dest_ip,
  CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST((event_id * 37) % 70000 AS STRING) END AS src_port,
  CAST((event_id * 13) % 500 AS STRING) AS dest_port,
  CASE event_id % 3 WHEN 0 THEN '6' WHEN 1 THEN '17' ELSE '' END AS protocol_num,
  CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'purchase' THEN 'DoS Hulk' WHEN 'click' THEN 'BENIGN'
    WHEN 'view' THEN concat('Web Attack ', chr(150), ' XSS') ELSE CAST(NULL AS STRING) END AS label,
  CASE WHEN event_id % 50 = 0 THEN 'Infinity' WHEN event_id % 50 = 1 THEN 'NaN' ELSE CAST(value AS STRING) END AS rate_text,
  CASE WHEN event_id % 17 = 0 THEN CAST(NULL AS STRING)
    WHEN day(ts) <= 6 THEN concat(lpad(CAST(day(ts) AS STRING), 2, '0'), '/', lpad(CAST(month(ts) AS STRING), 2, '0'), '/',
      CAST(year(ts) AS STRING), ' ', lpad(CAST(CASE WHEN hour(ts) > 12 THEN hour(ts) - 12 ELSE hour(ts) END AS STRING), 2, '0'),
      ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0'))
    ELSE concat(CAST(day(ts) AS STRING), '/', CAST(month(ts) AS STRING), '/', CAST(year(ts) AS STRING), ' ',
      CAST(CASE WHEN hour(ts) > 12 THEN hour(ts) - 12 ELSE hour(ts) END AS STRING), ':',
      lpad(CAST(minute(ts) AS STRING), 2, '0')) END AS event_time_raw
FROM {events}""",
    # typed flows with label columns, one per lineitem row
    "fx_fact": """
SELECT event_id, event_time, year(event_time) * 10000 + month(event_time) * 100 + day(event_time) AS date_sk,
  hour(event_time) * 60 + minute(event_time) AS time_sk, src_asset_sk, dest_asset_sk, flow_duration, total_fwd_packets,
  total_bwd_packets, flow_bytes_per_sec, attack_label, score_a, score_b,
  CASE attack_label WHEN 'BENIGN' THEN 1 WHEN 'Unlabeled' THEN 2 WHEN 'DoS Hulk' THEN 3 WHEN 'DDoS' THEN 7
    WHEN 'FTP-Patator' THEN 8 WHEN 'PortScan' THEN 10 WHEN 'Web Attack - XSS' THEN 12 WHEN 'Bot' THEN 14
    WHEN 'Infiltration' THEN 15 ELSE 16 END AS attack_sk,
  CASE attack_label WHEN 'BENIGN' THEN 'Benign' WHEN 'Unlabeled' THEN 'Unlabeled' WHEN 'DoS Hulk' THEN 'DoS'
    WHEN 'DDoS' THEN 'DDoS' WHEN 'FTP-Patator' THEN 'Brute Force' WHEN 'PortScan' THEN 'Reconnaissance'
    WHEN 'Web Attack - XSS' THEN 'Web Attack' WHEN 'Bot' THEN 'Botnet' WHEN 'Infiltration' THEN 'Infiltration'
    ELSE 'Exploit' END AS attack_family_denorm,
  CASE attack_label WHEN 'BENIGN' THEN 0 WHEN 'Unlabeled' THEN CAST(NULL AS INT) ELSE 1 END AS is_attack,
  score_a AS priority_score,
  CASE WHEN unscored THEN CAST(NULL AS STRING) WHEN score_a >= 0.75 THEN 'critical' WHEN score_a >= 0.55 THEN 'high'
    WHEN score_a >= 0.35 THEN 'medium' WHEN score_a >= 0.15 THEN 'low' ELSE 'info' END AS priority_label,
  score_b AS anomaly_score, scored_at
FROM (
  SELECT l_orderkey * 10 + l_linenumber AS event_id, l_shipdate AS scored_at,
    l_shipdate + INTERVAL '1' MINUTE * (l_partkey * 7 % 1440) AS event_time,
    l_suppkey AS src_asset_sk, 10000000 + l_partkey AS dest_asset_sk,
    CAST(l_quantity AS BIGINT) * 1000 AS flow_duration, CAST(l_quantity AS BIGINT) AS total_fwd_packets,
    CAST(l_linenumber AS BIGINT) AS total_bwd_packets, l_extendedprice AS flow_bytes_per_sec,
    l_returnflag = 'N' AND l_linestatus = 'O' AS unscored,
    l_discount * 5 + l_quantity / 100 AS score_a, l_tax * 5 + l_quantity / 100 AS score_b,
    CASE WHEN l_discount < 0.065 THEN 'BENIGN' WHEN l_tax < 0.005 THEN 'Heartbleed' WHEN l_tax < 0.015 THEN 'DDoS'
      WHEN l_tax < 0.025 THEN 'DoS Hulk' WHEN l_tax < 0.035 THEN 'PortScan' WHEN l_tax < 0.045 THEN 'FTP-Patator'
      WHEN l_tax < 0.055 THEN 'Bot' WHEN l_tax < 0.065 THEN 'Web Attack - XSS' WHEN l_tax < 0.075 THEN 'Infiltration'
      ELSE 'Unlabeled' END AS attack_label
  FROM {lineitem}) AS flows""",
    # hosts: suppliers are external, parts internal
    "fx_asset": """
SELECT s_suppkey AS asset_sk, concat('45.', CAST(CAST(floor(s_suppkey / 65536) AS INT) AS STRING), '.',
    CAST(CAST(floor(s_suppkey / 256) AS INT) % 256 AS STRING), '.', CAST(s_suppkey % 256 AS STRING)) AS asset_identifier,
  'host' AS asset_type, 0 AS is_internal, CAST(NULL AS STRING) AS business_unit, CAST(NULL AS STRING) AS criticality,
  CASE WHEN s_acctbal < 0 THEN CAST(NULL AS STRING) ELSE concat('N', CAST(s_nationkey AS STRING)) END AS country_iso,
  CASE WHEN s_acctbal < 0 THEN CAST(NULL AS STRING) ELSE n_name END AS country_name,
  CASE WHEN s_acctbal < 2000 THEN CAST(NULL AS STRING) ELSE concat('City ', CAST(s_nationkey AS STRING)) END AS city,
  CASE WHEN s_acctbal < 0 THEN CAST(NULL AS DOUBLE) ELSE s_nationkey * 2.5e0 END AS latitude,
  CASE WHEN s_acctbal < 0 THEN CAST(NULL AS DOUBLE) ELSE s_nationkey * 5e-1 END AS longitude,
  concat('AS-', s_name) AS asn_org,
  CASE WHEN s_acctbal < 4000 THEN CAST(NULL AS INT) ELSE CAST(floor(s_acctbal / 100) AS INT) END AS abuse_confidence,
  CASE WHEN s_acctbal >= 5000 THEN 1 ELSE 0 END AS is_known_attacker
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL
SELECT 10000000 + p_partkey, concat('10.', CAST(CAST(floor(p_partkey / 65536) AS INT) AS STRING), '.',
    CAST(CAST(floor(p_partkey / 256) AS INT) % 256 AS STRING), '.', CAST(p_partkey % 256 AS STRING)),
  p_type, 1, p_brand, CASE WHEN p_size > 40 THEN 'high' ELSE 'normal' END,
  CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
  CAST(NULL AS STRING), CAST(NULL AS INT), 0
FROM {part}""",
    "fx_attack_type": _values(
        _numbered(C.ATTACK_TYPES), ("attack_sk", "attack_label", "attack_family", "severity", "mitre_technique_id", "mitre_tactic")),
    "fx_activity_type": _values(
        _numbered(C.ACTIVITY_TYPES), ("activity_sk", "activity_name", "activity_category", "risk_weight")),
    "fx_protocol": _values(_numbered(C.PROTOCOLS), ("protocol_sk", "protocol_num", "protocol_name")),
    "fx_port": _values(_numbered(C.PORTS), ("port_sk", "port_number", "service_name", "port_category")),
    # unified user activity
    "fx_activity": """
SELECT event_id AS event_id_src, ts AS event_time, user_id, concat('PC-', CAST(event_id % 40 AS STRING)) AS pc_id,
  CASE event_type WHEN 'click' THEN 'Logon' WHEN 'error' THEN 'Logoff' WHEN 'purchase' THEN 'USB_Connect'
    WHEN 'view' THEN 'File_Activity' ELSE 'Email' END AS activity_type,
  CASE WHEN event_type = 'view' THEN concat('F', CAST(event_id AS STRING),
    CASE event_id % 3 WHEN 0 THEN '.DOC' WHEN 1 THEN '.pdf' ELSE '' END) ELSE CAST(NULL AS STRING) END AS filename,
  CASE WHEN event_type = 'signup' THEN concat('a@dtaa.com', CASE event_id % 3 WHEN 0 THEN '; b@x.org'
    WHEN 1 THEN ';c@DTAA.com;d@dtaa.com;e@dtaa.com;f@dtaa.com;g@dtaa.com' ELSE '' END) ELSE CAST(NULL AS STRING) END AS email_to,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'd@dtaa.com;e@dtaa.com' ELSE '' END AS email_cc,
  CASE WHEN event_id % 5 = 0 THEN 'me@home.net' WHEN event_id % 5 = 1 THEN CAST(NULL AS STRING) ELSE 'me@DTAA.com' END AS email_from,
  CASE WHEN event_type = 'signup' THEN CAST(floor(value * 1000) AS BIGINT) END AS email_size,
  CASE WHEN event_type = 'signup' THEN CAST(event_id % 7 AS BIGINT) END AS email_attachments_count
FROM {events}""",
    # monthly directory snapshots with natural gaps and attribute changes
    "fx_snapshot": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date, o_custkey AS user_id,
  max(o_orderpriority) AS role, max(o_orderstatus) AS department
FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), o_custkey""",
    # insiders with a window inside the month of events
    "fx_insider": """
SELECT c_custkey AS user_id, 1 + c_nationkey % 3 AS scenario, CAST('2024-01-15 00:00:00' AS TIMESTAMP_NTZ) AS window_start,
  CAST('2024-01-20 12:00:00' AS TIMESTAMP_NTZ) AS window_end
FROM {customer} WHERE c_acctbal < 0 OR c_acctbal > 9000""",
    # users in one or two versions
    "fx_user": """
SELECT v.user_sk, v.user_id, c_name AS employee_name, concat(c_name, '@dtaa.com') AS email_address,
  concat('Role ', CAST(c_nationkey % 5 AS STRING)) AS role, 'BU' AS business_unit, 'FU' AS functional_unit,
  CASE WHEN c_nationkey % 10 = 9 THEN CAST(NULL AS STRING) ELSE c_mktsegment END AS department,
  concat('Team ', CAST(c_nationkey % 7 AS STRING)) AS team, 'Boss' AS supervisor_name,
  c_nationkey * 2 AS ocean_o, c_nationkey + 10 AS ocean_c, 50 - c_nationkey AS ocean_e, c_nationkey + 5 AS ocean_a,
  40 - c_nationkey AS ocean_n, v.valid_from, v.valid_to, v.is_current,
  CASE WHEN i.user_id IS NULL THEN 0 ELSE 1 END AS is_malicious, i.scenario AS malicious_scenario,
  i.window_start AS attack_window_start, i.window_end AS attack_window_end
FROM (
  SELECT c_custkey * 2 AS user_sk, c_custkey AS user_id, DATE '2023-01-01' AS valid_from,
    CASE WHEN c_acctbal > 5000 THEN DATE '2024-01-12' ELSE DATE '9999-12-31' END AS valid_to,
    CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END AS is_current FROM {customer}
  UNION ALL
  SELECT c_custkey * 2 + 1, c_custkey, DATE '2024-01-12', DATE '9999-12-31', 1 FROM {customer} WHERE c_acctbal > 5000) AS v
JOIN {customer} ON c_custkey = v.user_id
LEFT JOIN {fx_insider} AS i ON i.user_id = v.user_id""",
    "fx_pc": """
SELECT row_number() OVER (ORDER BY pc_id) AS asset_sk, pc_id AS asset_identifier
FROM (SELECT DISTINCT concat('PC-', CAST(event_id % 40 AS STRING)) AS pc_id FROM {events}) AS pcs""",
    # risk scores of users
    "fx_risk": """
SELECT user_sk, risk_score, CASE WHEN risk_score >= 0.5 THEN 'high' WHEN risk_score >= 0.315 THEN 'elevated'
    WHEN risk_score >= 0.1 THEN 'low' ELSE 'baseline' END AS risk_label, is_malicious AS is_malicious_truth, malicious_scenario
FROM (SELECT user_sk, (user_id * 13 % 97) / 97e0 * 5e-1 + is_malicious * 3e-1 AS risk_score, is_malicious, malicious_scenario
  FROM {fx_user}) AS scored""",
    # disjoint numeric address ranges with holes
    "fx_geo": """
SELECT CAST(n_nationkey AS BIGINT) * 160000000 AS ip_from, CAST(n_nationkey AS BIGINT) * 160000000 + 99999999 AS ip_to,
  concat('N', CAST(n_nationkey AS STRING)) AS country_iso, n_name AS country_name
FROM {nation}""",
    "fx_reputation": """
SELECT DISTINCT dest_ip AS ip, CAST(CAST(split_part(dest_ip, '.', 4) AS INT) AS INT) AS abuse_confidence
FROM {fx_flow} WHERE event_type = 'error'""",
}

# facts of the user activity, derived the same way on both sides
INPUTS["fx_user_fact"] = """
SELECT u.user_sk, p.asset_sk, t.activity_sk, t.activity_name, t.activity_category, a.event_id_src, a.event_time, a.filename,
  CASE WHEN hour(a.event_time) < 9 OR hour(a.event_time) >= 17 THEN 1 ELSE 0 END AS is_after_hours,
  CASE WHEN a.activity_type = 'Email' AND event_id_src % 3 = 0 THEN 1 WHEN a.activity_type = 'Email' THEN 0 END AS external_recipient_count,
  CASE WHEN day(a.event_time) % 7 IN (6, 0) THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN u.is_malicious = 1 AND a.event_time >= u.attack_window_start AND a.event_time <= u.attack_window_end
    THEN 1 ELSE 0 END AS in_attack_window, u.is_malicious AS is_malicious_user, t.risk_weight AS risk_score
FROM {fx_activity} AS a
JOIN {fx_user} AS u ON u.user_id = a.user_id AND a.event_time >= u.valid_from AND a.event_time < u.valid_to
JOIN {fx_pc} AS p ON p.asset_identifier = a.pc_id
JOIN {fx_activity_type} AS t ON t.activity_name = CASE a.activity_type WHEN 'USB_Connect' THEN 'Connect'
  WHEN 'Email' THEN 'Email Send' WHEN 'File_Activity' THEN 'File Access' ELSE a.activity_type END"""
