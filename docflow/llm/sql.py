"""DuckDB SQL for those queries that it can express."""

QUALITY = r"""
    WITH base AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
    tokens AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1)))::BIGINT AS i FROM tokens WHERE len(w) >= 8),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM places),
    repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM windows) WHERE k > 1),
    gaps AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS d FROM repeated),
    covered AS (SELECT doc_id, sum(least(d, 8))::BIGINT AS n_repeat_words FROM gaps GROUP BY 1),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
    stats AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM tokens LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AND 100 * n_dup_lines > 30 * n_words AS soft_failed FROM stats),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY 1),
    moments AS (SELECT sum(f) AS f, sum(n) AS n, count(*) AS k, var_pop(f / n) AS v, avg(1 / n) AS inv, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS m FROM hosts),
    prior AS (SELECT m, least(greatest(CASE WHEN v - m * (1 - m) * inv > 0 THEN m * (1 - m) / (v - m * (1 - m) * inv) - 1 ELSE n / k END, 1.0), greatest(n / k, 1.0)) AS weight FROM moments),
    rates AS (SELECT host, (f + m * weight) / (n + m * weight + (1 - m) * weight) AS host_rate FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT soft_failed AND NOT host_rate > 0.5 AS kept, round(host_rate, 6) AS host_rate
    FROM judged JOIN rates ON judged.host IS NOT DISTINCT FROM rates.host"""

MIXING = r"""
    WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(size)::DOUBLE * 3 AS cap FROM sizes GROUP BY source),
    sums AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
        FROM per WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    levels AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS l FROM sums),
    level AS (SELECT max(l) AS level FROM levels WHERE cap >= l * weight),
    targets AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM per, level),
    rates AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
        FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rates"""

SUBSTRINGS = r"""
    WITH tokens AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1)))::BIGINT AS i FROM tokens WHERE len(w) >= 13),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM places),
    shared AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS least FROM windows) WHERE least < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM shared),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest, count(*) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM tokens LEFT JOIN kept USING (doc_id)"""

JACCARD = r"""
    WITH RECURSIVE tokens AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2)))::BIGINT AS i FROM tokens WHERE len(w) > 0),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    reach AS (SELECT doc_id, doc_id AS r FROM tokens UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
    SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM tokens t LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

WARC = r"""
    WITH rows AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
    typed AS (SELECT *, least IS NOT NULL AND (page_id IS NULL OR page_id > least) AS again FROM rows)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
        list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31))::INT, 1)), 'string_agg', '') AS payload_digest,
        CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM typed"""

#: CRC-32 of features, a byte a step by a table of 256 that its rule makes.
RESAMPLING = r"""
    WITH octets AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc_of FROM range(256) r(b)),
    spelled AS (SELECT doc_id, true AS ours, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL SELECT NULL, false, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    features AS (SELECT ours, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM spelled),
    kinds AS (SELECT f, list_transform(range(1, length(hex(f)), 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT f FROM features)),
    hashed AS (SELECT f, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc_of[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM kinds, octets),
    counts AS (SELECT bucket, count(*) FILTER (WHERE ours) AS s, count(*) FILTER (WHERE NOT ours) AS t FROM features JOIN hashed USING (f) GROUP BY 1),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts)::DOUBLE + 10000))))::BIGINT AS gain FROM counts),
    sums AS (SELECT r, count(*) AS k, sum(gain)::BIGINT AS total FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE ours GROUP BY 1),
    weighed AS (SELECT doc_id, len(w) AS n, coalesce(k, 0) AS n_features, CASE WHEN k > 0 THEN (total - ((total % k) + k) % k) // k ELSE 0 END AS weight, (('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296 AS u FROM spelled LEFT JOIN sums USING (r) WHERE ours),
    scored AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM weighed),
    ranked AS (SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id) AS place, 25 * count(*) FILTER (WHERE n >= 20) OVER () // 100 AS most FROM scored)
    SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= most THEN place END::BIGINT AS rank FROM ranked"""

ORACLES: dict[str, str] = {
    "op1_jaccard_join": JACCARD,
    "op5_quality_rules": QUALITY,
    "op6_mixing": MIXING,
    "op9_substring_dedup": SUBSTRINGS,
    "op11_warc": WARC,
    "op12_importance_resampling": RESAMPLING,
}
