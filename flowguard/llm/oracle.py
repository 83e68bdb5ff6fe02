"""The same results in DuckDB SQL."""

from __future__ import annotations

from flowguard.llm.urls import DOUBLE_SUFFIXES

SHARDS = """
WITH nibble AS (
    SELECT list(list_reduce([n, 0, 1, 2, 3], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS t
    FROM range(16) r(n)),
coded AS (SELECT *, hex(encode(text)) AS x FROM documents),
crcs AS (
    SELECT doc_id, source, octet_length(encode(text)) AS bytes,
           xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(x) // 2),
               lambda i: [instr('123456789ABCDEF', x[2 * i + 2])::BIGINT, instr('123456789ABCDEF', x[2 * i + 1])::BIGINT]))),
               lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295::BIGINT) AS text_crc32
    FROM coded, nibble),
ranked AS (
    SELECT *, md5('shards:' || coalesce(doc_id::VARCHAR, '')) AS o,
           row_number() OVER (PARTITION BY source ORDER BY md5('shards:' || coalesce(doc_id::VARCHAR, ''))) AS r,
           count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
    FROM crcs),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, o) - 1 AS place FROM ranked)
SELECT doc_id, (coalesce(bytes, 0) + 8)::BIGINT AS size, text_crc32, 'rows' AS law, (place * 24 // total)::INTEGER AS shard,
       (place - ((place * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

URLS = """
WITH rests AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest
    FROM pages),
parsed AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path
    FROM rests),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
    SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS place
    FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
judged AS (
    SELECT p.*, f.rule, f.verdict, string_split(p.host, '.') AS labels FROM parsed p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1),
hosts AS (
    SELECT host, CASE WHEN double THEN labels[-2] || '.' || labels[-1] ELSE labels[-1] END AS suffix,
           CASE WHEN len(labels) < 2 OR (double AND len(labels) = 2) THEN host WHEN double THEN labels[-3] || '.' || labels[-2] || '.' || labels[-1]
                ELSE labels[-2] || '.' || labels[-1] END AS domain,
           count(verdict)::DOUBLE AS n, count(*) FILTER (verdict = 'block')::DOUBLE AS k
    FROM (SELECT *, len(labels) >= 2 AND labels[-2] || '.' || labels[-1] IN (SUFFIXES) AS double FROM judged) GROUP BY ALL),
overall AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS prior FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(prior) AS prior FROM hosts, overall GROUP BY suffix),
s1 AS (SELECT sum(n * (k / n - prior) * (k / n - prior)) AS scatter, sum(prior * (1 - prior)) AS binomial, sum(n * prior * (1 - prior)) AS spread
       FROM suffixes WHERE n > 0),
c1 AS (SELECT least(greatest(coalesce(CASE WHEN spread - binomial > 1e-9 THEN CASE WHEN (scatter - binomial) / (spread - binomial) > 1e-3
              THEN (spread - binomial) / (scatter - binomial) - 1 ELSE 1000 END END, 10), 1), 1000) AS strength FROM s1),
suffix_mean AS (SELECT suffix, (strength * prior + k) / (strength + n) AS mean FROM suffixes, c1),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS prior FROM hosts JOIN suffix_mean USING (suffix) GROUP BY ALL),
s2 AS (SELECT sum(n * (k / n - prior) * (k / n - prior)) AS scatter, sum(prior * (1 - prior)) AS binomial, sum(n * prior * (1 - prior)) AS spread
       FROM domains WHERE n > 0),
c2 AS (SELECT least(greatest(coalesce(CASE WHEN spread - binomial > 1e-9 THEN CASE WHEN (scatter - binomial) / (spread - binomial) > 1e-3
              THEN (spread - binomial) / (scatter - binomial) - 1 ELSE 1000 END END, 10), 1), 1000) AS strength FROM s2),
domain_mean AS (SELECT domain, (strength * prior + k) / (strength + n) AS mean FROM domains, c2),
priors AS (SELECT host, n, k, mean AS prior FROM hosts JOIN domain_mean USING (domain)),
s3 AS (SELECT sum(n * (k / n - prior) * (k / n - prior)) AS scatter, sum(prior * (1 - prior)) AS binomial, sum(n * prior * (1 - prior)) AS spread
       FROM priors WHERE n > 0),
c3 AS (SELECT least(greatest(coalesce(CASE WHEN spread - binomial > 1e-9 THEN CASE WHEN (scatter - binomial) / (spread - binomial) > 1e-3
              THEN (spread - binomial) / (scatter - binomial) - 1 ELSE 1000 END END, 10), 1), 1000) AS strength FROM s3),
posterior AS (SELECT host, (strength * prior + k) / (strength + n) AS mean, strength + n AS weight FROM priors, c3)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN posterior USING (host)
"""

URLS = URLS.replace("SUFFIXES", ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES))

DECONTAMINATE = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""



def _vectors(rounds: int) -> str:
    """Plain Lloyd rounds, one block of tables per round."""
    steps = ["""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row FROM kept),
parts AS (SELECT row, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS w FROM numbered, range(4) r(p)),
book0 AS (SELECT p, row - 1 AS entry, w FROM parts WHERE row <= 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
    SELECT row, x.p, any_value(x.w) AS w, min({{'d': list_inner_product(x.w, x.w) + list_inner_product(b.w, b.w) - 2 * list_inner_product(x.w, b.w), 'e': entry}}) AS m
    FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY row, x.p)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS w
    FROM (SELECT p, m.e AS e, i, sum(w[i]) AS s, count(*) AS n FROM near{k}, range(1, len(w) + 1) r(i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.entry, coalesce(c.w, b.w) AS w FROM book{k} b LEFT JOIN mean{k} c ON b.p = c.p AND b.entry = c.e)""")
    steps.append(f"""
listed AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT), ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{rounds}),
coded AS (
    SELECT row, string_agg(printf('%02x', m.e::INTEGER), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY row)
SELECT vec_id, code, error, label, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN numbered USING (row), listed""")
    return ",".join(steps[:-1]) + "," + steps[-1]


WARC = """
WITH coded AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(encode(coalesce(html, ''))) AS x FROM pages),
told AS (SELECT *, array_to_string(flatten(list_transform(range(8), lambda i: list_transform(range(4),
             lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::INTEGER, 1)))), '') AS digest
         FROM coded),
ranked AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM told WINDOW w AS (PARTITION BY body ORDER BY page_id, url))
SELECT page_id, octet_length(encode(body)) AS payload_bytes, digest AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to
FROM ranked
"""

#: More than any conversation costs.
FAR = 10**15


def _conversations() -> str:
    """The cheapest edits by a pass over the rows of a conversation with one best (cost, audit) per place."""
    def then(place: int, cost: str, letter: str) -> str:
        return f"{{'c': acc.s{place}.c + {cost}, 'a': acc.s{place}.a || '{letter}'}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def kept(place: int, initial: str) -> str:
        return f"{{'c': acc.s{place}.c + CASE WHEN x.f = 3 THEN 3 WHEN x.f > 0 THEN {FAR} ELSE 0 END + CASE WHEN x.i = '{initial}' THEN 0 ELSE {FAR} END, 'a': acc.s{place}.a || 'K'}}"

    def told(place: int) -> str:
        return then(place, f"3 + CASE WHEN x.f = 3 THEN 3 WHEN x.f > 0 THEN {FAR} ELSE 0 END", "R")
    inserted = ["acc.s0", "acc.s1", least("acc.s2", then(0, "3", "I"), then(1, "3", "I"), then(3, "3", "I")), least("acc.s3", then(2, "3", "I"))]
    read = [then(0, "4", "D"), least(then(1, "4", "D"), kept(0, "s")), least(then(2, "4", "D"), *[w for p in (0, 1, 3) for w in (kept(p, "u"), told(p))]),
            least(then(3, "4", "D"), kept(2, "a"), told(2))]
    none = f"{{'c': {FAR}::BIGINT, 'a': ''}}"

    def element(op: str, initial: str, fault: str, places: list[str]) -> str:
        return "{" + f"'op': {op}, 'i': {initial}, 'f': {fault}, " + ", ".join(f"'s{k}': {v}" for k, v in enumerate(places)) + "}"
    insert = element("'I'", "''", "0", [none] * 4)
    row = element("'R'", "i", "fault", [none] * 4)
    start = element("''", "''", "0", ["{'c': 0::BIGINT, 'a': ''}", none, none, none])
    step = f"CASE WHEN x.op = 'I' THEN {element(chr(39) * 2, chr(39) * 2, '0', inserted)} ELSE {element(chr(39) * 2, chr(39) * 2, '0', read)} END"
    return f"""
WITH nibble AS (
    SELECT list(list_reduce([n, 0, 1, 2, 3], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS t
    FROM range(16) r(n)),
keyed AS (
    SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
dealt AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(x) // 2),
               lambda i: [instr('123456789ABCDEF', x[2 * i + 2])::BIGINT, instr('123456789ABCDEF', x[2 * i + 1])::BIGINT]))),
               lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295::BIGINT) % 20 AS deal
    FROM keyed, nibble),
damaged AS (
    SELECT key, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
           CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM dealt, (SELECT unnest([1, 2]) AS copy) WHERE deal <> 0 AND (copy = 1 OR deal = 3)),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS r, left(role, 1) AS i,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
faulty AS (
    SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY r) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
           lag(i) OVER (PARTITION BY key ORDER BY r) || i NOT IN ('su', 'ua', 'au') AS wrong FROM numbered),
counted AS (
    SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (r > 1 AND wrong) AS illegal,
           list_concat([{insert}, {insert}], flatten(list([{row}, {insert}, {insert}] ORDER BY r))) AS steps
    FROM faulty GROUP BY key),
reached AS (SELECT *, list_reduce(list_prepend({start}, steps), lambda acc, x: {step}) AS e FROM counted),
best AS (SELECT *, list_min([e.s0, e.s3]) AS b FROM reached),
edits AS (SELECT key, unnest(string_split(b.a, '')) AS letter, generate_subscripts(string_split(b.a, ''), 1) AS k FROM best WHERE b.a <> ''),
placed AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER w AS r, count(*) FILTER (letter <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY key ORDER BY k)),
said AS (
    SELECT p.key, p.o, p.letter, n.role, n.i, CASE WHEN p.letter = 'I' THEN '' ELSE n.text END AS text, first(p.letter = 'K' AND n.i = 's') OVER (PARTITION BY p.key ORDER BY p.o) AS led
    FROM placed p LEFT JOIN numbered n ON p.key = n.key AND p.r = n.r WHERE p.letter <> 'D'),
repaired AS (
    SELECT key, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS digest
    FROM said GROUP BY key),
named AS (SELECT DISTINCT conv_id, key FROM keyed)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM named LEFT JOIN best USING (key) LEFT JOIN repaired USING (key)
"""


SQL = {"op4_decontaminate": DECONTAMINATE, "op2_shards": SHARDS, "op5_urls": URLS, "op11_codes": _vectors(4), "op12_conversations": _conversations(), "op13_warc": WARC}
