"""Class names, severity weights, feature names and default rules."""

# Class index to attack name.
ATTACK_NAMES = [
    "BENIGN",
    "Bot",
    "DDoS",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowhttptest",
    "DoS Slowloris",
    "FTP-Patator",
    "Heartbleed",
    "Infiltration",
    "PortScan",
    "SSH-Patator",
    "Web Attack – Brute Force",
    "Web Attack – SQL Injection",
    "Web Attack – XSS",
]

# Severity weight per attack name.
SEVERITY_WEIGHTS = {
    "BENIGN": 0.0,
    "Bot": 85.0,
    "DDoS": 90.0,
    "DoS GoldenEye": 80.0,
    "DoS Hulk": 80.0,
    "DoS Slowhttptest": 75.0,
    "DoS Slowloris": 75.0,
    "FTP-Patator": 70.0,
    "Heartbleed": 100.0,
    "Infiltration": 95.0,
    "PortScan": 50.0,
    "SSH-Patator": 90.0,
    "Web Attack – Brute Force": 65.0,
    "Web Attack – SQL Injection": 95.0,
    "Web Attack – XSS": 75.0,
}
DEFAULT_SEVERITY = 75.0

# The model-ready flow vector, in order.
FLOW_FEATURES = [
    "Destination Port",
    "Total Length of Fwd Packets",
    "Fwd Packet Length Max",
    "Bwd Packet Length Max",
    "Flow Bytes/s",
    "Flow IAT Std",
    "Fwd IAT Min",
    "Fwd Header Length",
    "Bwd Header Length",
    "Bwd Packets/s",
    "FIN Flag Count",
    "PSH Flag Count",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Idle Std",
]

# Indicator lists used when no indicator file exists.
DEFAULT_WHITELIST = ["127.0.0.1", "::1", "192.168.1.1"]
DEFAULT_BLACKLIST = ["198.51.100.14", "203.0.113.55", "185.220.101.5"]
DEFAULT_MALICIOUS = [
    ("185.220.101.5", "Tor Exit Node", 95, "2026-01-10"),
    ("198.51.100.14", "Botnet C2", 90, "2026-02-14"),
    ("203.0.113.55", "DDoS Attacker", 85, "2026-03-01"),
]

# Defaults of a live alert event.
ALERT_DEFAULTS = {
    "attack_type": "BENIGN",
    "confidence": 0.99,
    "risk_score": 0.0,
    "risk_level": "Low",
    "prediction_time_ms": 0.035,
    "src_ip": "192.168.1.100",
    "dst_ip": "10.0.0.1",
    "protocol": "TCP",
    "dst_port": 80,
}
