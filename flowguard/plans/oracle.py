"""The views of `flowguard.sources.views` as SQL common table expressions."""

from __future__ import annotations

MIX = ("(((l_orderkey % 2147483647) * 48271 + (l_partkey % 2147483647) * 69621 + (l_suppkey % 2147483647) * 39373"
       " + (l_linenumber % 2147483647)::BIGINT * 16807) % 2147483647)")

ATTACK_CASE = ("CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'PortScan' WHEN 'error' THEN 'DoS Hulk'"
               " WHEN 'purchase' THEN 'Bot' ELSE 'SSH-Patator' END")

# Severity of the five attack types that occur in the alert view.
WEIGHT_CASE = "CASE attack_type WHEN 'PortScan' THEN 50.0 WHEN 'DoS Hulk' THEN 80.0 WHEN 'Bot' THEN 85.0 ELSE 90.0 END::DOUBLE"

VIEWS = {
    "flows": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate,
               l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
               l_linenumber::DOUBLE AS linenumber, l_suppkey::DOUBLE AS supp, l_linestatus AS status, l_returnflag AS label,
               {MIX} AS m
        FROM lineitem""",
    "dirty": """
        SELECT l_orderkey, l_partkey,
               CASE WHEN m % 17 = 0 THEN NULL ELSE quantity END AS quantity,
               CASE WHEN m % 101 = 0 THEN 'inf'::DOUBLE WHEN m % 103 = 0 THEN '-inf'::DOUBLE ELSE price END AS price,
               CASE WHEN m % 29 = 0 THEN 'n/a' WHEN m % 31 = 0 THEN NULL ELSE ' ' || linenumber::INT || ' ' END AS linetext,
               discount,
               CASE WHEN m % 13 = 0 THEN 'nan'::DOUBLE ELSE tax END AS tax,
               1.0::DOUBLE AS one, quantity AS quantity_full, quantity AS quantity_copy, price * 2.0 + 1.0 AS price_linear,
               NULL::DOUBLE AS empty, ' ' || label || ' ' AS label
        FROM flows, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR m % 19 = 0""",
    "repaired": """
        SELECT l_orderkey, l_partkey, quantity,
               CASE WHEN isfinite(price) THEN price END AS price,
               TRY_CAST(trim(linetext) AS DOUBLE) AS linetext, discount,
               CASE WHEN isfinite(tax) THEN tax END AS tax,
               one, quantity_full, quantity_copy, price_linear, empty, trim(label) AS label
        FROM dirty""",
    "alerts": f"""
        SELECT *, CASE WHEN risk_score < 25 THEN 'Low' WHEN risk_score < 50 THEN 'Medium' WHEN risk_score < 75 THEN 'High'
                  ELSE 'Critical' END AS risk_level
        FROM (SELECT *, greatest(0.0, least(100.0, CASE WHEN attack_type = 'BENIGN'
                        THEN round_even((1.0::DOUBLE - confidence) * 20.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE
                        ELSE round_even(({WEIGHT_CASE}) * (0.5::DOUBLE + 0.5::DOUBLE * confidence) * 100.0::DOUBLE, 0) / 100.0::DOUBLE END)) AS risk_score
              FROM (SELECT event_id, 'ALT-' || event_id AS id, ts AS timestamp, {ATTACK_CASE} AS attack_type,
                           1.0::DOUBLE - (event_id % 500) / 1000.0::DOUBLE AS confidence,
                           (CASE user_id % 5 WHEN 0 THEN '185.220.101.' WHEN 1 THEN '10.0.0.' WHEN 2 THEN '192.168.1.'
                            WHEN 3 THEN '172.20.0.' ELSE '203.0.113.' END) || (user_id % 250) AS src_ip,
                           '10.0.1.' || (event_id % 50) AS dst_ip,
                           CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
                           json_extract_string(props, '$.k')::INT AS dst_port, value / 100.0::DOUBLE AS prediction_time_ms
                    FROM events))""",
    "packets": """
        SELECT event_id AS seq, ts,
               CASE WHEN event_id % 3 <> 0 THEN client ELSE server END AS src_ip,
               CASE WHEN event_id % 3 <> 0 THEN 40000 + user_id % 1000 ELSE 443 END AS src_port,
               CASE WHEN event_id % 3 <> 0 THEN server ELSE client END AS dst_ip,
               CASE WHEN event_id % 3 <> 0 THEN 443 ELSE 40000 + user_id % 1000 END AS dst_port,
               CASE user_id % 7 WHEN 6 THEN 'ARP' WHEN 5 THEN 'ICMP' WHEN 4 THEN 'UDP' ELSE 'TCP' END AS protocol,
               40 + k AS length, CASE event_type WHEN 'error' THEN 'FA' WHEN 'click' THEN 'PA' ELSE 'A' END AS flags,
               1000 + k AS window_size, CASE WHEN event_id % 2 = 0 THEN 20 ELSE 32 END AS header_len
        FROM (SELECT *, '192.168.1.' || (user_id % 250) AS client, '10.0.0.' || (user_id % 4) AS server,
                     json_extract_string(props, '$.k')::INT AS k FROM events)""",
    "scored": """
        SELECT *, round(CASE WHEN pred = 0 THEN top WHEN (pred + 1) % 3 = 0 THEN rest * share ELSE rest * (1.0::DOUBLE - share) END, 6) AS p0,
                  round(CASE WHEN pred = 1 THEN top WHEN (pred + 1) % 3 = 1 THEN rest * share ELSE rest * (1.0::DOUBLE - share) END, 6) AS p1,
                  round(CASE WHEN pred = 2 THEN top WHEN (pred + 1) % 3 = 2 THEN rest * share ELSE rest * (1.0::DOUBLE - share) END, 6) AS p2
        FROM (SELECT *, 1.0::DOUBLE - top AS rest FROM (
              SELECT *, CASE WHEN m % 10 < 7 THEN y ELSE ((y + 1 + m % 2) % 3)::INT END AS pred,
                     0.5::DOUBLE + (m % 400) / 1000.0::DOUBLE AS top, (m % 7 + 1) / 8.0::DOUBLE AS share
              FROM (SELECT *, CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM flows)))""",
    "ioc": """
        SELECT (CASE s_suppkey % 3 WHEN 0 THEN '185.220.101.' WHEN 1 THEN '203.0.113.' ELSE '10.0.0.' END) || (s_suppkey % 250) AS ip,
               CASE s_suppkey % 4 WHEN 0 THEN 'whitelist' WHEN 1 THEN 'blacklist' ELSE 'malicious_ip' END AS list_type,
               CASE WHEN s_suppkey % 4 >= 2 AND s_suppkey % 8 <> 2 THEN n_name END AS category,
               CASE WHEN s_suppkey % 4 >= 2 AND s_suppkey % 8 <> 3 THEN (s_suppkey % 100)::INT END AS threat_score,
               '2026-01-01' AS first_seen, s_suppkey AS seq
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "audit": """
        SELECT 'AUD-' || event_id AS id, ts AS timestamp, upper(event_type) AS event_type, 'user' || (user_id % 20) AS username,
               '10.1.0.' || (user_id % 250) AS ip_address, 'execute' AS action,
               CASE WHEN event_id % 10 = 0 THEN 'denied' WHEN event_id % 10 < 3 THEN 'failure' ELSE 'success' END AS status,
               props AS details
        FROM events""",
}

NEEDS = {"dirty": ["flows"], "repaired": ["flows", "dirty"], "scored": ["flows"]}


def with_views(names: str, body: str) -> str:
    """Prefix a query with the views it names, in dependency order."""
    wanted: list[str] = []
    for name in names.split():
        for part in [*NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views} {body}"
