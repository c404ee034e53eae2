"""Names, maps and thresholds that results depend on."""

from __future__ import annotations

from datetime import date

# ---- fixed values: label patterns tested in this order, first match wins -------------------
FAMILY_PATTERNS = (
    ("BENIGN", "Benign"),
    ("DDoS", "DDoS"),
    ("DoS", "DoS"),
    ("Patator", "Brute Force"),
    ("PortScan", "Reconnaissance"),
    ("Web Attack", "Web Attack"),
    ("Bot", "Botnet"),
    ("Infiltration", "Infiltration"),
    ("Heartbleed", "Exploit"),
)

# ---- fixed values: severity by family, weight by severity, fusion weights, label thresholds -
FAMILY_SEVERITY = {
    "Benign": "info",
    "Botnet": "high",
    "Brute Force": "medium",
    "DDoS": "critical",
    "DoS": "high",
    "Exploit": "critical",
    "Infiltration": "critical",
    "Reconnaissance": "low",
    "Web Attack": "medium",
    "Unlabeled": "info",
}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2, "info": 0.0}
FUSION_WEIGHTS = {"supervised": 0.65, "anomaly": 0.15, "severity": 0.20}
PRIORITY_THRESHOLDS = ((0.75, "critical"), (0.55, "high"), (0.35, "medium"), (0.15, "low"), (0.0, "info"))
RISK_THRESHOLDS = ((0.50, "high"), (0.315, "elevated"), (0.10, "low"))
ALERT_LABELS = ("critical", "high")
FLAGGED_RISK = ("high", "elevated")

# ---- fixed values: dimension rows ------------------------------------------------------------
ATTACK_TYPES = (
    ("BENIGN", "Benign", "info", None, None),
    ("Unlabeled", "Unlabeled", "info", None, None),
    ("DoS Hulk", "DoS", "high", "T1499.002", "Impact"),
    ("DoS GoldenEye", "DoS", "high", "T1499.002", "Impact"),
    ("DoS slowloris", "DoS", "high", "T1499.001", "Impact"),
    ("DoS Slowhttptest", "DoS", "high", "T1499.001", "Impact"),
    ("DDoS", "DDoS", "critical", "T1498", "Impact"),
    ("FTP-Patator", "Brute Force", "medium", "T1110.001", "Credential Access"),
    ("SSH-Patator", "Brute Force", "medium", "T1110.001", "Credential Access"),
    ("PortScan", "Reconnaissance", "low", "T1046", "Discovery"),
    ("Web Attack - Brute Force", "Web Attack", "medium", "T1110", "Credential Access"),
    ("Web Attack - XSS", "Web Attack", "medium", "T1059.007", "Execution"),
    ("Web Attack - Sql Injection", "Web Attack", "high", "T1190", "Initial Access"),
    ("Bot", "Botnet", "high", "T1071", "Command and Control"),
    ("Infiltration", "Infiltration", "critical", "T1133", "Initial Access"),
    ("Heartbleed", "Exploit", "critical", "T1190", "Initial Access"),
)
ACTIVITY_TYPES = (
    ("Logon", "authentication", 1.0),
    ("Logoff", "authentication", 1.0),
    ("Connect", "device", 3.0),
    ("Disconnect", "device", 1.5),
    ("File Access", "file", 1.5),
    ("Email Send", "email", 1.5),
    ("HTTP Visit", "web", 1.0),
)
ACTIVITY_NAMES = {
    "Logon": "Logon",
    "Logoff": "Logoff",
    "USB_Connect": "Connect",
    "USB_Disconnect": "Disconnect",
    "Email": "Email Send",
    "File_Activity": "File Access",
}
DEVICE_ACTIONS = {"Connect": "USB_Connect", "Disconnect": "USB_Disconnect"}
PROTOCOLS = (
    (0, "HOPOPT"),
    (1, "ICMP"),
    (2, "IGMP"),
    (6, "TCP"),
    (17, "UDP"),
    (41, "IPv6"),
    (47, "GRE"),
    (50, "ESP"),
    (51, "AH"),
    (58, "ICMPv6"),
    (89, "OSPF"),
    (132, "SCTP"),
)
PORTS = (
    (80, "HTTP", "web"),
    (443, "HTTPS", "web"),
    (8080, "HTTP-Alt", "web"),
    (8443, "HTTPS-Alt", "web"),
    (8088, "HTTP-Alt2", "web"),
    (25, "SMTP", "mail"),
    (110, "POP3", "mail"),
    (143, "IMAP", "mail"),
    (465, "SMTPS", "mail"),
    (587, "SMTP-Submit", "mail"),
    (993, "IMAPS", "mail"),
    (995, "POP3S", "mail"),
    (22, "SSH", "remote_access"),
    (23, "Telnet", "remote_access"),
    (3389, "RDP", "remote_access"),
    (5900, "VNC", "remote_access"),
    (20, "FTP-Data", "file_transfer"),
    (21, "FTP-Control", "file_transfer"),
    (69, "TFTP", "file_transfer"),
    (115, "SFTP", "file_transfer"),
    (445, "SMB", "file_transfer"),
    (139, "NetBIOS-SSN", "file_transfer"),
    (53, "DNS", "network_service"),
    (67, "DHCP-Server", "network_service"),
    (68, "DHCP-Client", "network_service"),
    (123, "NTP", "network_service"),
    (161, "SNMP", "network_service"),
    (162, "SNMP-Trap", "network_service"),
    (1433, "MSSQL", "database"),
    (1521, "Oracle", "database"),
    (3306, "MySQL", "database"),
    (5432, "PostgreSQL", "database"),
    (6379, "Redis", "database"),
    (27017, "MongoDB", "database"),
    (444, "SNPP", "web"),
    (49163, "Ephemeral", "ephemeral"),
    (981, "Unassigned", "unknown"),
    (7496, "Unassigned", "unknown"),
    (6689, "Unassigned", "unknown"),
    (9944, "Unassigned", "unknown"),
)
CALENDAR_START, CALENDAR_END = date(2010, 1, 1), date(2017, 12, 31)
DAY_PARTS = ((5, "late_night"), (8, "early_morning"), (12, "morning"), (17, "afternoon"), (20, "evening"), (24, "night"))
OPEN_END = date(9999, 12, 31)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")

# ---- fixed values: flow column names, source -> warehouse --------------------------------------
FLOW_COLUMNS = {
    "Flow ID": "flow_id",
    "Source IP": "src_ip",
    "Destination IP": "dest_ip",
    "Source Port": "src_port",
    "Destination Port": "dest_port",
    "event_time": "event_time",
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_bwd_packets",
    "Total Length of Fwd Packets": "total_length_fwd",
    "Total Length of Bwd Packets": "total_length_bwd",
    "Flow Bytes/s": "flow_bytes_per_sec",
    "Flow Packets/s": "flow_packets_per_sec",
    "Fwd Packet Length Max": "fwd_pkt_len_max",
    "Fwd Packet Length Min": "fwd_pkt_len_min",
    "Fwd Packet Length Mean": "fwd_pkt_len_mean",
    "Fwd Packet Length Std": "fwd_pkt_len_std",
    "Bwd Packet Length Max": "bwd_pkt_len_max",
    "Bwd Packet Length Min": "bwd_pkt_len_min",
    "Bwd Packet Length Mean": "bwd_pkt_len_mean",
    "Bwd Packet Length Std": "bwd_pkt_len_std",
    "Min Packet Length": "pkt_len_min",
    "Max Packet Length": "pkt_len_max",
    "Packet Length Mean": "pkt_len_mean",
    "Packet Length Std": "pkt_len_std",
    "Packet Length Variance": "pkt_len_variance",
    "Flow IAT Mean": "flow_iat_mean",
    "Flow IAT Std": "flow_iat_std",
    "Flow IAT Max": "flow_iat_max",
    "Flow IAT Min": "flow_iat_min",
    "Fwd IAT Total": "fwd_iat_total",
    "Fwd IAT Mean": "fwd_iat_mean",
    "Fwd IAT Std": "fwd_iat_std",
    "Fwd IAT Max": "fwd_iat_max",
    "Fwd IAT Min": "fwd_iat_min",
    "Bwd IAT Total": "bwd_iat_total",
    "Bwd IAT Mean": "bwd_iat_mean",
    "Bwd IAT Std": "bwd_iat_std",
    "Bwd IAT Max": "bwd_iat_max",
    "Bwd IAT Min": "bwd_iat_min",
    "Fwd PSH Flags": "fwd_psh_flags",
    "Bwd PSH Flags": "bwd_psh_flags",
    "Fwd URG Flags": "fwd_urg_flags",
    "Bwd URG Flags": "bwd_urg_flags",
    "FIN Flag Count": "fin_flag_count",
    "SYN Flag Count": "syn_flag_count",
    "RST Flag Count": "rst_flag_count",
    "PSH Flag Count": "psh_flag_count",
    "ACK Flag Count": "ack_flag_count",
    "URG Flag Count": "urg_flag_count",
    "CWE Flag Count": "cwe_flag_count",
    "ECE Flag Count": "ece_flag_count",
    "Fwd Header Length": "fwd_header_length",
    "Bwd Header Length": "bwd_header_length",
    "Fwd Packets/s": "fwd_pkts_per_sec",
    "Bwd Packets/s": "bwd_pkts_per_sec",
    "Down/Up Ratio": "down_up_ratio",
    "Average Packet Size": "avg_pkt_size",
    "Avg Fwd Segment Size": "avg_fwd_seg_size",
    "Avg Bwd Segment Size": "avg_bwd_seg_size",
    "Fwd Avg Bytes/Bulk": "fwd_avg_bytes_bulk",
    "Fwd Avg Packets/Bulk": "fwd_avg_pkts_bulk",
    "Fwd Avg Bulk Rate": "fwd_avg_bulk_rate",
    "Bwd Avg Bytes/Bulk": "bwd_avg_bytes_bulk",
    "Bwd Avg Packets/Bulk": "bwd_avg_pkts_bulk",
    "Bwd Avg Bulk Rate": "bwd_avg_bulk_rate",
    "Subflow Fwd Packets": "subflow_fwd_pkts",
    "Subflow Fwd Bytes": "subflow_fwd_bytes",
    "Subflow Bwd Packets": "subflow_bwd_pkts",
    "Subflow Bwd Bytes": "subflow_bwd_bytes",
    "Init_Win_bytes_forward": "init_win_bytes_fwd",
    "Init_Win_bytes_backward": "init_win_bytes_bwd",
    "act_data_pkt_fwd": "act_data_pkt_fwd",
    "min_seg_size_forward": "min_seg_size_fwd",
    "Active Mean": "active_mean",
    "Active Std": "active_std",
    "Active Max": "active_max",
    "Active Min": "active_min",
    "Idle Mean": "idle_mean",
    "Idle Std": "idle_std",
    "Idle Max": "idle_max",
    "Idle Min": "idle_min",
    "label_clean": "attack_label",
    "attack_family": "attack_family_denorm",
    "is_attack": "is_attack",
    "Protocol": "protocol_num",
}
REQUIRED_FLOW_COLUMNS = (
    "Flow ID", "Source IP", "Destination IP", "Source Port", "Destination Port", "Protocol",
    "event_time", "source_day", "label_clean", "attack_family", "is_attack",
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Flow Bytes/s", "Flow Packets/s",
)
MIN_FLOW_COLUMNS = 80
MIN_FLOW_ROWS = 3_000_000

# ---- fixed values: model features, by group ----------------------------------------------------
FEATURE_GROUPS = {
    "volumetric": (
        "flow_duration", "total_fwd_packets", "total_bwd_packets", "total_length_fwd", "total_length_bwd",
        "flow_bytes_per_sec", "flow_packets_per_sec", "fwd_pkts_per_sec", "bwd_pkts_per_sec", "down_up_ratio",
    ),
    "packet_length": (
        "fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
        "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean", "bwd_pkt_len_std",
        "pkt_len_min", "pkt_len_max", "pkt_len_mean", "pkt_len_std", "pkt_len_variance",
        "avg_pkt_size", "avg_fwd_seg_size", "avg_bwd_seg_size",
    ),
    "iat": (
        "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min",
        "fwd_iat_total", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
        "bwd_iat_total", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_iat_min",
    ),
    "flags": (
        "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags",
        "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
        "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count",
    ),
    "headers": ("fwd_header_length", "bwd_header_length"),
    "bulk": (
        "fwd_avg_bytes_bulk", "fwd_avg_pkts_bulk", "fwd_avg_bulk_rate",
        "bwd_avg_bytes_bulk", "bwd_avg_pkts_bulk", "bwd_avg_bulk_rate",
    ),
    "subflow": ("subflow_fwd_pkts", "subflow_fwd_bytes", "subflow_bwd_pkts", "subflow_bwd_bytes"),
    "window": ("init_win_bytes_fwd", "init_win_bytes_bwd", "act_data_pkt_fwd", "min_seg_size_fwd"),
    "timing": (
        "active_mean", "active_std", "active_max", "active_min",
        "idle_mean", "idle_std", "idle_max", "idle_min",
    ),
}
FLOW_FEATURES = tuple(name for group in FEATURE_GROUPS.values() for name in group)
CATEGORICAL_FEATURES = ("protocol_sk", "src_port_sk", "dest_port_sk")
USER_DAY_FEATURES = (
    "events_total", "usb_connects", "emails_sent", "ext_emails", "file_accesses", "logons",
    "after_hours_events", "weekend_events", "distinct_pcs",
    "usb_dev_personal", "emails_dev_personal", "ext_emails_dev_personal", "files_dev_personal",
    "usb_ratio_personal", "ext_emails_ratio_personal",
    "usb_zscore_peer", "ext_emails_zscore_peer", "after_hours_zscore_peer",
    "after_hours_pct", "multi_signal_count", "day_of_week",
)
USER_FEATURES = (
    "max_usb_ratio", "max_usb_z", "max_ext_email_z", "max_after_hours_z",
    "max_signals_in_day", "max_usb_in_day", "max_ext_emails_in_day", "max_files_in_day",
    "avg_usb_ratio", "avg_usb_z", "avg_ext_email_z", "avg_after_hours_pct",
    "avg_usb_dev", "avg_signals_per_day",
    "days_with_multi_signal", "days_high_usb_z", "days_high_ext_email_z",
    "lifetime_usb_total", "lifetime_ext_emails_total",
)
# the doubles among the measures; every other measure is a whole number
DOUBLE_MEASURES = frozenset(
    name for name in FLOW_FEATURES if name.endswith(("_mean", "_std", "_variance", "_per_sec", "_pkt_size", "_seg_size"))
)
FACT_KEYS = (
    "source_system", "date_sk", "time_sk", "src_asset_sk", "dest_asset_sk",
    "src_port_sk", "dest_port_sk", "protocol_sk", "attack_sk", "event_time", "flow_id",
)
FACT_MEASURES = tuple(name for name in FLOW_COLUMNS.values() if name in set(FLOW_FEATURES))
#: Empty after a load; scoring fills them by event_id.
SCORE_COLUMNS = {"priority_score": "double", "priority_label": "string", "anomaly_score": "double", "model_version": "string", "scored_at": "timestamp"}
FACT_COLUMNS = ("event_id", *FACT_KEYS, *FACT_MEASURES, "is_attack", "attack_family_denorm", *SCORE_COLUMNS)
ACTIVITY_COLUMNS = (
    "event_id_src", "event_time", "user_id", "pc_id", "activity_type", "filename", "email_size",
    "email_recipients_count", "email_attachments_count", "email_to_external_domain", "email_from_external_address",
)
DIRECTORY_ATTRIBUTES = {
    "employee_name": "employee_name",
    "email": "email_address",
    "role": "role",
    "business_unit": "business_unit",
    "functional_unit": "functional_unit",
    "department": "department",
    "team": "team",
    "supervisor": "supervisor_name",
}
CORPORATE_DOMAIN = "@dtaa.com"
