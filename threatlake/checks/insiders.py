"""Insider queries: history, activity fact, user days, baselines, peers, profiles, insider reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatlake.checks.flows import _pct
from threatlake.checks.registry import Data, query
from threatlake.functions import activity as A
from threatlake.operators import aggregates as G
from threatlake.operators import dimensions as D
from threatlake.operators import filters as FL
from threatlake.operators import insider as I
from threatlake.operators import joins as J
from threatlake.operators import ordering as O
from threatlake.plans import insider_job as IJ
from threatlake.plans import reports as R
from threatlake.plans import views as V
from threatlake.session import cut_lineage

DAYS_OF_BASELINE = 10

# ---- SQL of the shared steps ------------------------------------------------------------------------

HISTORY = """cal AS (SELECT snapshot_date AS sd, row_number() OVER (ORDER BY snapshot_date) AS i, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS nxt
    FROM (SELECT DISTINCT snapshot_date FROM fx_snapshot) s),
  seen AS (SELECT f.*, i, nxt FROM fx_snapshot f JOIN cal ON sd = snapshot_date),
  marked AS (SELECT *, CASE WHEN lag(i) OVER w IS NULL OR lag(i) OVER w <> i - 1 OR lag(role) OVER w IS DISTINCT FROM role
    OR lag(department) OVER w IS DISTINCT FROM department THEN 1 ELSE 0 END AS fresh FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY i)),
  grouped AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY i) AS v FROM marked),
  history AS (SELECT user_id, any_value(role) AS role, any_value(department) AS department, MIN(snapshot_date) AS valid_from,
    COALESCE(arg_max(COALESCE(nxt, DATE '9999-12-31'), i), DATE '9999-12-31') AS valid_to,
    CASE WHEN arg_max(COALESCE(nxt, DATE '9999-12-31'), i) = DATE '9999-12-31' THEN 1 ELSE 0 END AS is_current FROM grouped GROUP BY user_id, v)"""
USER_DAYS = """days AS (SELECT user_sk, event_time::DATE AS feature_date, dayofweek(event_time::DATE) AS day_of_week, COUNT(*) AS events_total,
    COUNT(*) FILTER (WHERE activity_name = 'Connect') AS usb_connects, COUNT(*) FILTER (WHERE activity_name = 'Email Send') AS emails_sent,
    COUNT(*) FILTER (WHERE activity_name = 'Email Send' AND external_recipient_count > 0) AS ext_emails,
    COUNT(*) FILTER (WHERE activity_name = 'File Access') AS file_accesses, COUNT(*) FILTER (WHERE activity_name = 'Logon') AS logons,
    SUM(is_after_hours)::BIGINT AS after_hours_events, SUM(is_weekend)::BIGINT AS weekend_events, COUNT(DISTINCT asset_sk) AS distinct_pcs,
    MAX(in_attack_window) AS in_attack_window FROM fx_user_fact GROUP BY 1, 2, 3)"""


def _r3(x):
    return f"round_even({x}, 3)::DOUBLE"


BASELINES = f"""firsts AS (SELECT user_sk, MIN(feature_date) AS baseline_from FROM days GROUP BY 1),
  baselines AS (SELECT d.user_sk, baseline_from, baseline_from + {DAYS_OF_BASELINE} AS baseline_to, COUNT(*) AS baseline_active_days,
    {_r3('SUM(usb_connects)::DOUBLE / COUNT(*)')} AS baseline_usb_per_day, {_r3('SUM(emails_sent)::DOUBLE / COUNT(*)')} AS baseline_emails_per_day,
    {_r3('SUM(ext_emails)::DOUBLE / COUNT(*)')} AS baseline_ext_emails_per_day, {_r3('SUM(file_accesses)::DOUBLE / COUNT(*)')} AS baseline_files_per_day,
    {_r3('SUM(logons)::DOUBLE / COUNT(*)')} AS baseline_logon_count, {_r3('SUM(after_hours_events)::DOUBLE / greatest(SUM(events_total), 1)')} AS baseline_after_hours_pct,
    {_r3('SUM(weekend_events)::DOUBLE / greatest(SUM(events_total), 1)')} AS baseline_weekend_pct, MAX(distinct_pcs) AS baseline_distinct_pcs, 0.0 AS baseline_avg_session_hours
    FROM days d JOIN firsts f ON d.user_sk = f.user_sk WHERE feature_date < baseline_from + {DAYS_OF_BASELINE} GROUP BY d.user_sk, baseline_from)"""


def _ratio(today, usual):
    return f"least({today} / COALESCE(NULLIF({usual}, 0), 0.1::DOUBLE), 50.0::DOUBLE)"


def _z(c):
    w = "OVER (PARTITION BY department, feature_date)"
    return (f"CASE WHEN department IS NULL THEN 0 ELSE COALESCE(({c} - AVG({c}) {w}) / CASE WHEN stddev_samp({c}) {w} = 0 THEN 1 "
            f"ELSE stddev_samp({c}) {w} END, 0) END")


FEATURES = f"""wide AS (SELECT d.*, department, is_malicious, malicious_scenario,
    usb_connects - COALESCE(baseline_usb_per_day, 0) AS a1, emails_sent - COALESCE(baseline_emails_per_day, 0) AS a2,
    ext_emails - COALESCE(baseline_ext_emails_per_day, 0) AS a3, file_accesses - COALESCE(baseline_files_per_day, 0) AS a4,
    {_ratio('usb_connects', 'baseline_usb_per_day')} AS r1, {_ratio('ext_emails', 'baseline_ext_emails_per_day')} AS r2,
    {_z('usb_connects')} AS z1, {_z('ext_emails')} AS z2, {_z('after_hours_events')} AS z3, after_hours_events::DOUBLE / greatest(events_total, 1) AS p
    FROM days d JOIN fx_user u ON u.user_sk = d.user_sk LEFT JOIN baselines b ON b.user_sk = d.user_sk),
  features AS (SELECT user_sk, feature_date, day_of_week, events_total, usb_connects, emails_sent, ext_emails, file_accesses, logons, after_hours_events,
    weekend_events, distinct_pcs, {_r3('a1')} AS usb_dev_personal, {_r3('a2')} AS emails_dev_personal, {_r3('a3')} AS ext_emails_dev_personal,
    {_r3('a4')} AS files_dev_personal, {_r3('r1')} AS usb_ratio_personal, {_r3('r2')} AS ext_emails_ratio_personal, {_r3('z1')} AS usb_zscore_peer,
    {_r3('z2')} AS ext_emails_zscore_peer, {_r3('z3')} AS after_hours_zscore_peer, {_r3('p')} AS after_hours_pct,
    (z1 > 2)::INT + (z2 > 2)::INT + (z3 > 2)::INT + (r1 > 3)::INT + (r2 > 3)::INT AS multi_signal_count, is_malicious AS is_malicious_user,
    in_attack_window, COALESCE(malicious_scenario, 0) AS malicious_scenario FROM wide)"""
LATEST = "latest AS (SELECT * FROM fx_user QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC) = 1)"


def _types(d: Data):
    return D.dim_activity_type(d.spark)


def _days(d: Data):
    return I.user_days(d.user_fact.drop("activity_name"), _types(d))


def _tables(d: Data):
    days = cut_lineage(_days(d))  # read by the baselines, the peers and the features
    baselines = I.personal_baselines(days, baseline_days=DAYS_OF_BASELINE)
    return days, baselines, I.user_day_features(days, d.user, baselines)


# ---- history ------------------------------------------------------------------------------------------

def _history(d: Data):
    return D.build_history(d.snapshot, "user_id", "snapshot_date", ["role", "department"])


@query(f"WITH {HISTORY} SELECT * FROM history")
def user_history(d: Data):
    return _history(d)


@query(f"""WITH {HISTORY} SELECT COUNT(*) AS total_rows, COUNT(DISTINCT user_id) AS distinct_users, SUM(is_current) AS currently_active, MIN(valid_from) AS earliest_from,
  MAX(CASE WHEN is_current = 0 THEN valid_to END) AS latest_to, CAST(round_even(AVG(CASE WHEN is_current = 0 THEN valid_to - valid_from END), 0) AS BIGINT) AS avg_period_days FROM history""")
def history_totals(d: Data):
    return I.history_totals(_history(d))


@query(f"""WITH {HISTORY}, act AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey AS user_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a.user_id, l_shipdate, h.valid_from, h.role, h.department
  FROM act a JOIN history h ON h.user_id = a.user_id AND l_shipdate >= valid_from AND l_shipdate < valid_to""")
def asof_version_join(d: Data):
    acts = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("o_custkey").alias("user_id"))
    out = J.asof_join(acts, _history(d), "user_id", "l_shipdate", "valid_from", "valid_to")
    return out.drop("valid_to", "is_current")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_price_from, tier FROM lineitem ASOF JOIN (SELECT o_orderkey AS k, o_orderdate AS p_price_from, o_orderpriority AS tier FROM orders) o
  ON l_orderkey = k AND l_shipdate >= p_price_from""")
def asof_join_plain(d: Data):
    right = d.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("p_price_from"), F.col("o_orderpriority").alias("tier"))
    out = J.asof_join(d.lineitem, right, "l_orderkey", "l_shipdate", "p_price_from")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_price_from", "tier")


@query(f"WITH {HISTORY} SELECT * FROM history WHERE is_current = 1 AND valid_from = (SELECT MAX(valid_from) FROM history)")
def of_latest_value(d: Data):
    history = _history(d)
    return FL.of_latest(history, "valid_from").filter(F.col("is_current") == 1)


@query("SELECT role, COUNT(*) AS n FROM fx_snapshot WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM fx_snapshot) GROUP BY 1 ORDER BY n DESC, role LIMIT 10")
def latest_snapshot_roles(d: Data):
    return O.value_counts(FL.of_latest(d.snapshot, "snapshot_date"), "role", 10, "n")


@query("SELECT snapshot_date, COUNT(*) AS active_employees FROM fx_snapshot GROUP BY 1")
def population_per_snapshot(d: Data):
    return G.distribution(d.snapshot, ["snapshot_date"], "active_employees")


@query("""SELECT u.user_sk, CASE WHEN i.user_id IS NULL THEN 0 ELSE 1 END AS is_malicious, scenario AS malicious_scenario, window_start AS attack_window_start,
  window_end AS attack_window_end FROM fx_user u LEFT JOIN fx_insider i ON i.user_id = u.user_id""")
def flagged_users(d: Data):
    plain = d.user.drop("is_malicious", "malicious_scenario", "attack_window_start", "attack_window_end")
    return D.flag_users(plain, d.insider).select(
        "user_sk", "is_malicious", "malicious_scenario", "attack_window_start", "attack_window_end")


@query("SELECT user_id FROM fx_insider WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def insiders_not_found(d: Data):
    known = d.orders.filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("user_id"))
    return FL.keys_missing(d.insider, known, ["user_id"])


@query("""SELECT COUNT(*) FILTER (WHERE is_malicious = 1) AS malicious_users, COUNT(*) FILTER (WHERE is_malicious = 0) AS legitimate_users,
  COUNT(*) FILTER (WHERE malicious_scenario = 1) AS scenario_1_users, COUNT(*) FILTER (WHERE malicious_scenario = 2) AS scenario_2_users,
  COUNT(*) FILTER (WHERE malicious_scenario = 3) AS scenario_3_users FROM fx_user""")
def insider_totals(d: Data):
    return I.insider_totals(d.user)


@query("SELECT scenario, MIN(window_start) AS earliest, MAX(window_end) AS latest, COUNT(*) AS events FROM fx_insider GROUP BY 1")
def insiders_per_scenario(d: Data):
    return d.insider.groupBy("scenario").agg(
        F.min("window_start").alias("earliest"), F.max("window_end").alias("latest"), F.count("*").alias("events"))


# ---- activity -----------------------------------------------------------------------------------------

@query("""SELECT event_id_src, CASE WHEN email_to IS NULL THEN 0 ELSE length(email_to) - length(replace(email_to, ';', '')) + 1 END
    + CASE WHEN email_cc = '' THEN 0 ELSE length(email_cc) - length(replace(email_cc, ';', '')) + 1 END AS recipients,
  CASE WHEN email_to ILIKE '%x.org%' THEN 1 ELSE 0 END AS to_external, CASE WHEN email_from LIKE '%home.net' THEN 1 ELSE 0 END AS from_external,
  CASE WHEN email_to IS NULL THEN 'No recipient' WHEN email_to LIKE '%@dtaa.com%' AND email_to NOT LIKE '%;%@%' THEN 'Internal only (single)'
    WHEN email_to LIKE '%@dtaa.com%' AND email_to LIKE '%;%' THEN 'Mixed internal/external' ELSE 'External only' END AS pattern,
  length(email_to) - length(replace(email_to, ';', '')) + 1 AS approx,
  NULLIF(lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)), '') AS extension,
  CASE activity_type WHEN 'USB_Connect' THEN 'Connect' WHEN 'Email' THEN 'Email Send' WHEN 'File_Activity' THEN 'File Access' ELSE activity_type END AS activity_name
  FROM fx_activity""")
def activity_expressions(d: Data):
    c = F.col
    return d.activity.select(
        "event_id_src", A.recipient_count(c("email_to"), c("email_cc")).alias("recipients"), A.to_external(c("email_to")).alias("to_external"),
        A.from_external(c("email_from")).alias("from_external"), A.destination_pattern(c("email_to")).alias("pattern"),
        A.approx_recipients(c("email_to")).alias("approx"), A.file_extension(c("filename")).alias("extension"),
        A.activity_name(c("activity_type")).alias("activity_name"))


@query("SELECT event_id_src, event_time, user_id, activity_type FROM fx_activity")
def unified_activity(d: Data):
    from threatlake.sources.readers import unify_activity

    kinds = ["Logon", "Logoff", "USB_Connect", "File_Activity", "Email"]
    parts = [d.activity.filter(F.col("activity_type") == k).select("event_id_src", "event_time", "user_id", "activity_type") for k in kinds]
    return unify_activity(parts, sort=True)


def _activity_fact(d: Data):
    mails = d.activity.withColumns({
        "email_recipients_count": A.recipient_count(F.col("email_to"), F.col("email_cc")),
        "email_to_external_domain": A.to_external(F.col("email_to"))})
    return I.activity_fact(mails, d.user, d.pc, _types(d))


@query("""SELECT event_id_src AS natural_event_id, user_sk, asset_sk, activity_sk, year(event_time) * 10000 + month(event_time) * 100 + day(event_time) AS date_sk,
  hour(event_time) * 60 + minute(event_time) AS time_sk, NULLIF(lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)), '') AS file_extension,
  is_after_hours, is_weekend, is_malicious_user, in_attack_window FROM fx_user_fact""")
def activity_fact(d: Data):
    return _activity_fact(d).select(
        "natural_event_id", "user_sk", "asset_sk", "activity_sk", "date_sk", "time_sk", "file_extension", "is_after_hours", "is_weekend",
        "is_malicious_user", "in_attack_window")


@query("""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT user_sk) AS distinct_users, SUM(is_malicious_user) AS malicious_user_events, SUM(in_attack_window) AS in_attack_window_events,
  SUM(is_after_hours) AS after_hours_events, MIN(event_time) AS earliest, MAX(event_time) AS latest, COUNT(DISTINCT activity_sk) AS activity_types_used FROM fx_user_fact""")
def activity_totals(d: Data):
    return I.activity_totals(_activity_fact(d))


CLASSED = """(SELECT a.*, i.user_id AS insider, scenario, CASE WHEN i.user_id IS NULL THEN 'Benign user' WHEN event_time BETWEEN window_start AND window_end
  THEN 'Malicious user (during attack window)' ELSE 'Malicious user (outside attack window)' END AS event_class FROM fx_activity a LEFT JOIN fx_insider i ON i.user_id = a.user_id)"""


@query(f"SELECT event_class, COUNT(*) AS events FROM {CLASSED} c GROUP BY 1")
def event_class_counts(d: Data):
    return G.event_class_counts(d.activity, d.insider, "user_id", "event_time")


@query(f"""SELECT CASE WHEN insider IS NULL THEN 'Benign' ELSE 'Malicious' END AS user_class, COUNT(DISTINCT user_id) AS unique_users, COUNT(*) AS events,
  round(COUNT(*) / COUNT(DISTINCT user_id), 0) AS avg_events_per_user FROM {CLASSED} c GROUP BY 1""")
def volume_by_user_class(d: Data):
    return G.volume_by_user_class(d.activity, d.insider, "user_id", "event_time")


@query(f"""SELECT hour, attack_window_events, benign_events, a AS attack_pct, b AS benign_pct, round(a / COALESCE(NULLIF(b, 0), 0.01::DOUBLE), 2) AS signal FROM (
  SELECT *, {_pct('attack_window_events', 'SUM(attack_window_events) OVER ()')} AS a, {_pct('benign_events', 'SUM(benign_events) OVER ()')} AS b FROM (
  SELECT hour(event_time) AS hour, COUNT(*) FILTER (WHERE event_class LIKE '%(during attack window)') AS attack_window_events,
  COUNT(*) FILTER (WHERE insider IS NULL) AS benign_events FROM {CLASSED} c GROUP BY 1) h) s""")
def hour_signal(d: Data):
    return G.hour_signal(d.activity, d.insider, "user_id", "event_time")


def _mails(d: Data):
    return d.activity.filter(F.col("activity_type") == "Email").select(
        "user_id", "event_time", F.col("email_attachments_count").alias("attachment_count"), F.col("email_size").alias("size_bytes"),
        F.col("email_to").alias("recipients"))


DURING = f"FROM {CLASSED} c WHERE activity_type = 'Email' AND scenario = 3 AND event_class LIKE '%(during attack window)'"


@query(f"""SELECT user_id, COUNT(*) AS emails_during_attack, round(AVG(email_attachments_count), 2) AS avg_attachments, MAX(email_attachments_count) AS max_attachments,
  round(MAX(email_size) / 1024.0::DOUBLE, 0) AS max_size_kb {DURING} GROUP BY 1""")
def window_mail_stats(d: Data):
    return G.window_mail_stats(_mails(d), d.insider, "user_id", "event_time", 3)


@query(f"""SELECT user_id, event_time, email_attachments_count AS attachment_count, round(email_size / 1024.0::DOUBLE, 0) AS size_kb,
  length(email_to) - length(replace(email_to, ';', '')) + 1 AS approx_recipient_count {DURING} AND length(email_to) - length(replace(email_to, ';', '')) >= 5
  ORDER BY approx_recipient_count DESC, event_time, user_id LIMIT 15""")
def mass_mails(d: Data):
    return G.mass_mails(_mails(d), d.insider, "user_id", "event_time", 3, 5, 15)


@query("SELECT email_attachments_count AS attachment_count, COUNT(*) AS emails FROM fx_activity WHERE activity_type = 'Email' GROUP BY 1")
def attachment_distribution(d: Data):
    return G.distribution(_mails(d), ["attachment_count"], "emails")


# ---- user days, baselines, features --------------------------------------------------------------------

@query(f"WITH {USER_DAYS} SELECT * FROM days")
def user_days(d: Data):
    return _days(d)


@query(f"WITH {USER_DAYS}, {BASELINES} SELECT * FROM baselines")
def personal_baselines(d: Data):
    return _tables(d)[1]


@query(f"WITH {USER_DAYS}, {BASELINES}, {FEATURES} SELECT * FROM features")
def user_day_features(d: Data):
    return _tables(d)[2]


@query(f"""WITH {USER_DAYS} SELECT d.user_sk, feature_date, round({_z('usb_connects')}, 6) AS usb_zscore_peer, round({_z('after_hours_events')}, 6) AS after_hours_zscore_peer
  FROM days d JOIN fx_user u ON u.user_sk = d.user_sk""")
def peer_z_scores(d: Data):
    wide = _days(d).join(d.user.select("user_sk", "department"), "user_sk")
    metrics = {k: v for k, v in I.PEER_METRICS.items() if k != "ext_emails"}
    return I.peer_scores(wide, metrics=metrics).select("user_sk", "feature_date", *[F.round(z, 6).alias(z) for z in metrics.values()])


@query(f"""WITH {USER_DAYS}, {BASELINES} SELECT d.user_sk, feature_date, events_total FROM days d JOIN baselines b ON b.user_sk = d.user_sk WHERE feature_date >= baseline_to""")
def days_after_baseline(d: Data):
    days, baselines, _ = _tables(d)
    return FL.after_baseline(days, baselines).select("user_sk", "feature_date", "events_total")


PROFILE_MAX = ("max_usb_ratio usb_ratio_personal", "max_usb_z usb_zscore_peer", "max_ext_email_z ext_emails_zscore_peer", "max_after_hours_z after_hours_zscore_peer",
               "max_signals_in_day multi_signal_count", "max_usb_in_day usb_connects", "max_ext_emails_in_day ext_emails", "max_files_in_day file_accesses")
PROFILE_AVG = ("avg_usb_ratio usb_ratio_personal", "avg_usb_z usb_zscore_peer", "avg_ext_email_z ext_emails_zscore_peer", "avg_after_hours_pct after_hours_pct",
               "avg_usb_dev usb_dev_personal", "avg_signals_per_day multi_signal_count")
PROFILES = "profiles AS (SELECT f.user_sk, " + ", ".join(f"MAX({p.split()[1]}) AS {p.split()[0]}" for p in PROFILE_MAX) + ", " + ", ".join(
    f"round(AVG({p.split()[1]}), 9) AS {p.split()[0]}" for p in PROFILE_AVG) + """, COUNT(*) FILTER (WHERE multi_signal_count >= 2) AS days_with_multi_signal,
  COUNT(*) FILTER (WHERE usb_zscore_peer > 2) AS days_high_usb_z, COUNT(*) FILTER (WHERE ext_emails_zscore_peer > 2) AS days_high_ext_email_z, COUNT(*) AS total_days_observed,
  SUM(usb_connects) AS lifetime_usb_total, SUM(ext_emails) AS lifetime_ext_emails_total, MAX(is_malicious_user) AS is_malicious, MAX(malicious_scenario) AS malicious_scenario
  FROM features f JOIN baselines b ON b.user_sk = f.user_sk WHERE feature_date >= baseline_to GROUP BY 1)"""


@query(f"WITH {USER_DAYS}, {BASELINES}, {FEATURES}, {PROFILES} SELECT * FROM profiles")
def user_profiles(d: Data):
    _, baselines, features = _tables(d)
    profiles = I.user_profiles(features, baselines)
    return profiles.withColumns({p.split()[0]: F.round(p.split()[0], 9) for p in PROFILE_AVG})


def _group(style_day, rest, malicious="is_malicious"):
    whens = " ".join(f"WHEN malicious_scenario = {n} AND in_attack_window = 1 THEN '{style_day.format(n)}'" for n in (1, 2, 3))
    return f"CASE WHEN {malicious} = 0 THEN 'Legitimate' {whens} ELSE '{rest}' END AS user_day_group"


def _mean(x, places=2):
    return f"round(AVG({x})::DECIMAL(20,9), {places})::DOUBLE"


@query(f"""WITH {USER_DAYS}, {BASELINES} SELECT {_group('Scen {} (attack day)', 'Malicious (non-attack day)')}, COUNT(*) AS user_days, {_mean('usb_connects')} AS avg_usb,
  {_mean('usb_connects - baseline_usb_per_day')} AS usb_deviation, {_mean('ext_emails')} AS avg_ext_emails, {_mean('ext_emails - baseline_ext_emails_per_day')} AS ext_email_deviation,
  {_mean('after_hours_events::DOUBLE / NULLIF(events_total, 0) - baseline_after_hours_pct', 3)} AS after_hours_deviation
  FROM days d JOIN fx_user u ON u.user_sk = d.user_sk JOIN baselines b ON b.user_sk = d.user_sk WHERE feature_date >= baseline_to GROUP BY 1""")
def baseline_separability(d: Data):
    days, baselines, _ = _tables(d)
    return I.baseline_separability(days, d.user, baselines)


@query(f"""WITH {USER_DAYS}, {BASELINES}, {FEATURES} SELECT {_group('Scen {} attack day', 'Malicious non-attack', 'is_malicious_user')}, COUNT(*) AS days,
  {_mean('usb_dev_personal')} AS usb_dev, {_mean('usb_ratio_personal')} AS usb_ratio, {_mean('usb_zscore_peer')} AS usb_z_peer, {_mean('ext_emails_zscore_peer')} AS ext_email_z_peer,
  {_mean('multi_signal_count')} AS avg_signals_triggered FROM features GROUP BY 1""")
def feature_separability(d: Data):
    return I.feature_separability(_tables(d)[2])


# ---- reports --------------------------------------------------------------------------------------------

@query("""SELECT user_id, employee_name, role, department, team, ocean_o, ocean_c, ocean_e, ocean_a, ocean_n, u.is_malicious, u.malicious_scenario, COUNT(f.event_id_src) AS total_events,
  SUM(f.is_after_hours) AS after_hours_events, COUNT(*) FILTER (WHERE activity_category = 'device') AS usb_events, COUNT(*) FILTER (WHERE activity_category = 'email') AS email_events,
  COUNT(*) FILTER (WHERE activity_category = 'file') AS file_events, round(AVG(f.risk_score), 6) AS avg_risk_score, MAX(f.risk_score) AS max_risk_score
  FROM fx_user u LEFT JOIN fx_user_fact f ON f.user_sk = u.user_sk WHERE u.is_current = 1 GROUP BY ALL""")
def user_risk_view(d: Data):
    fact = d.user_fact.drop("activity_category")
    return V.user_risk_scoring(d.user, fact, _types(d)).withColumn("avg_risk_score", F.round("avg_risk_score", 6))


@query(f"""SELECT r.*, f.*, {_pct('flagged_correctly', 'greatest(malicious_truth, 1)', 1)} AS recall, {_pct('flagged_correctly', 'greatest(flagged_users, 1)', 1)} AS precision FROM
  (SELECT COUNT(*) AS total_users, SUM(is_malicious_truth) AS malicious_truth, COUNT(*) FILTER (WHERE risk_label IN ('high', 'elevated')) AS flagged_users,
  COUNT(*) FILTER (WHERE risk_label IN ('high', 'elevated') AND is_malicious_truth = 1) AS flagged_correctly FROM fx_risk) r,
  (SELECT COUNT(*) AS total_events, SUM(in_attack_window) AS attack_window_events, SUM(is_after_hours) AS after_hours_events, COUNT(DISTINCT user_sk) AS distinct_users FROM fx_user_fact) f""")
def insider_kpis(d: Data):
    return R.insider_kpis(d.risk, d.user_fact)


BOARD = f"""WITH {LATEST} SELECT l.user_id, employee_name, role, department, team, supervisor_name, is_current AS employment_active,
  round(risk_score::DECIMAL(20,9), 4)::DOUBLE AS risk_score, risk_label, is_malicious_truth, l.malicious_scenario, attack_window_start, attack_window_end
  FROM fx_risk r JOIN latest l ON l.user_sk = r.user_sk"""


@query(BOARD)
def risk_leaderboard(d: Data):
    return R.risk_leaderboard(d.risk, d.user)


@query(BOARD + " WHERE r.risk_score >= 0.3 AND risk_label IN ('high', 'elevated') AND COALESCE(l.malicious_scenario, 0) IN (1, 2)")
def risk_leaderboard_filtered(d: Data):
    return R.risk_leaderboard(d.risk, d.user, 0.3, ["high", "elevated"], [1, 2])


@query(f"""WITH {LATEST} SELECT COALESCE(l.malicious_scenario, 0) AS scenario, COUNT(*) AS users, COUNT(*) FILTER (WHERE risk_label IN ('high', 'elevated')) AS flagged,
  round(AVG(risk_score), 6) AS avg_risk_score, MAX(risk_score) AS max_risk_score, MIN(risk_score) AS min_risk_score,
  {_pct("COUNT(*) FILTER (WHERE risk_label IN ('high', 'elevated'))", 'COUNT(*)', 1)} AS catch_rate_pct FROM fx_risk r JOIN latest l ON l.user_sk = r.user_sk GROUP BY 1""")
def scenario_summary(d: Data):
    return R.scenario_summary(d.risk, d.user).withColumn("avg_risk_score", F.round("avg_risk_score", 6))


@query(f"""WITH {USER_DAYS}, {BASELINES}, {FEATURES}, {LATEST} SELECT l.user_sk, feature_date, events_total, usb_connects, emails_sent, ext_emails, file_accesses, logons, after_hours_events, weekend_events,
  usb_zscore_peer, usb_ratio_personal, multi_signal_count, in_attack_window, baseline_usb_per_day, baseline_ext_emails_per_day, baseline_after_hours_pct, attack_window_start,
  attack_window_end, is_malicious, l.malicious_scenario FROM latest l JOIN features f ON f.user_sk = l.user_sk LEFT JOIN baselines b ON b.user_sk = l.user_sk""")
def activity_timeline(d: Data):
    _, baselines, features = _tables(d)
    return R.activity_timeline(d.user, features, baselines)


@query(f"WITH {LATEST} SELECT user_id, employee_name, role, department, is_current FROM latest")
def user_options(d: Data):
    return R.user_options(d.user)


@query(f"""WITH {USER_DAYS}, {BASELINES}, {LATEST} SELECT l.user_id, l.user_sk, valid_from, risk_score, risk_label, baseline_usb_per_day, baseline_weekend_pct, baseline_active_days, baseline_to
  FROM latest l LEFT JOIN fx_risk r ON r.user_sk = l.user_sk LEFT JOIN baselines b ON b.user_sk = l.user_sk""")
def user_profile_card(d: Data):
    _, baselines, _ = _tables(d)
    return R.user_profile(d.user, d.risk, baselines).select(
        "user_id", "user_sk", "valid_from", "risk_score", "risk_label", "baseline_usb_per_day", "baseline_weekend_pct", "baseline_active_days", "baseline_to")


@query(f"""WITH {USER_DAYS}, {BASELINES}, {FEATURES}, {LATEST}, per_user AS (SELECT l.user_sk, COALESCE(l.malicious_scenario, 0) AS scenario, AVG(usb_connects) AS a, AVG(ext_emails) AS b,
    AVG(file_accesses) AS c, AVG(after_hours_pct) AS e, MAX(usb_zscore_peer) AS z, MAX(usb_ratio_personal) AS r, MAX(multi_signal_count) AS s FROM latest l JOIN features f ON f.user_sk = l.user_sk
    JOIN baselines b ON b.user_sk = l.user_sk WHERE feature_date >= baseline_to GROUP BY ALL)
  SELECT scenario, COUNT(*) AS users, round(AVG(a), 6) AS avg_daily_usb, round(AVG(b), 6) AS avg_daily_ext_emails, round(AVG(c), 6) AS avg_daily_files,
  round(AVG(e), 6) AS avg_after_hours_pct, round(AVG(z), 6) AS avg_peak_usb_z, round(AVG(r), 6) AS avg_peak_usb_ratio, round(AVG(s), 6) AS avg_peak_signals FROM per_user GROUP BY 1""")
def scenario_profile(d: Data):
    _, baselines, features = _tables(d)
    out = R.scenario_profile(d.user, features, baselines)
    return out.select("scenario", "users", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(f"""WITH {LATEST} SELECT l.user_id, employee_name, role, department, l.malicious_scenario, attack_window_start, attack_window_end,
  attack_window_end::DATE - attack_window_start::DATE AS window_days, is_current AS employment_active, round(risk_score::DECIMAL(20,9), 4)::DOUBLE AS risk_score, risk_label,
  CASE WHEN risk_label IN ('high', 'elevated') THEN 1 ELSE 0 END AS caught FROM latest l JOIN fx_risk r ON r.user_sk = l.user_sk WHERE is_malicious = 1""")
def insiders_detail(d: Data):
    return R.insiders_detail(d.user, d.risk)


@query(f"""WITH {LATEST} SELECT hour(event_time) AS hour_24, dayofweek(event_time) AS day_of_week, activity_category, COUNT(*) AS events FROM fx_user_fact f
  JOIN latest l ON l.user_sk = f.user_sk GROUP BY ALL""")
def user_hours(d: Data):
    return R.user_hours(d.user, d.user_fact.drop("activity_category"), _types(d))


@query("""SELECT COUNT(*) AS users_scored, COUNT(*) FILTER (WHERE f) AS flagged, COUNT(*) FILTER (WHERE f AND t) AS caught, COUNT(*) FILTER (WHERE f AND NOT t) AS false_alarms,
  COUNT(*) FILTER (WHERE t) AS malicious, """ + f"{_pct('COUNT(*) FILTER (WHERE f AND t)', 'COUNT(*) FILTER (WHERE t)', 1)} AS recall_pct, "
  f"{_pct('COUNT(*) FILTER (WHERE f AND t)', 'greatest(COUNT(*) FILTER (WHERE f), 1)', 1)} AS precision_pct" + """
  FROM (SELECT risk_score >= 0.315 AS f, is_malicious_truth = 1 AS t FROM fx_risk) r""")
def scoring_summary(d: Data):
    return IJ.scoring_summary(d.risk)
