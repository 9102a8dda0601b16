"""SQL that says the same as the operators, written independently of their methods."""

from __future__ import annotations

from slatewise.llm import licenses

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f"""


# Kinds, patterns in the dialect of the SQL engine, least lengths and the group that they hold for.
SECRETS = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("private_key", r"-----BEGIN [A-Z0-9 ]+-----([\r\n]+[A-Za-z-]+:\x20[A-Za-z0-9,\x20/.-]+)*(([\r\n\x20\t]|\\[nr])+[A-Za-z0-9+/=]{16,})*(([\r\n\x20\t]|\\[nr])*([A-Za-z0-9+/=]+([\r\n\x20\t]|\\[nr])+)?-----END [A-Z0-9 ]+-----)?", 20, 0),
    ("code_host", r"gh[opsur]_[A-Za-z0-9]+", 40, 0),
    ("code_host_fine", r"github_pat_[A-Za-z0-9_]+", 80, 0),
    ("code_host_lab", r"gl(pat|dt|rt|cbt|ptt)-[A-Za-z0-9_-]+", 25, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 16, 0),
    ("chat_hook", r"hooks\.slack\.com/services/[A-Za-z0-9]+/[A-Za-z0-9]+/[A-Za-z0-9]+", 60, 0),
    ("chat_hook_other", r"discord(app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+", 80, 0),
    ("chat_bot", r"[0-9]+:AA[A-Za-z0-9_-]+", 44, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0),
    ("maps_key", r"AIza[A-Za-z0-9_-]+", 39, 0),
    ("oauth_secret", r"GOCSPX-[A-Za-z0-9_-]+", 30, 0),
    ("oauth_access", r"ya29\.[A-Za-z0-9_-]+", 40, 0),
    ("session_access", r"ASIA[A-Z0-9]+", 20, 0),
    ("storage_key", r"AccountKey=[A-Za-z0-9+/]+==", 90, 0),
    ("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24, 0),
    ("payment_point", r"sq0(atp|csp|idp)-[A-Za-z0-9_-]+", 29, 0),
    ("mail_grid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60, 0),
    ("mail_gun", r"key-[0-9a-f]+", 36, 0),
    ("mail_list", r"[0-9a-f]+-us[0-9]+", 36, 0),
    ("phone_key", r"SK[0-9a-f]+", 34, 0),
    ("package_js", r"npm_[A-Za-z0-9]+", 40, 0),
    ("package_py", r"pypi-AgE[A-Za-z0-9_-]+", 60, 0),
    ("package_rb", r"rubygems_[0-9a-f]+", 57, 0),
    ("shop", r"shp(at|ca|pa|ss)_[A-Fa-f0-9]+", 38, 0),
    ("cloud_ocean", r"do[opr]_v1_[a-f0-9]+", 71, 0),
    ("vault", r"hv[bs]\.[A-Za-z0-9_-]+", 28, 0),
    ("lakehouse", r"dapi[0-9a-f]+", 36, 0),
    ("models", r"hf_[A-Za-z]+", 37, 0),
    ("issues", r"lin_api_[A-Za-z0-9]+", 48, 0),
    ("requests", r"PMAK-[0-9a-f]+-[0-9a-f]+", 60, 0),
    ("file_key", r"AGE-SECRET-KEY-1[0-9A-Z]+", 74, 0),
    ("dashboards", r"glsa_[A-Za-z0-9]+_[A-Fa-f0-9]+", 46, 0),
    ("monitoring", r"NRAK-[A-Z0-9]+", 32, 0),
    ("stack", r"pul-[0-9a-f]+", 44, 0),
)


def secrets_sql() -> str:
    """Matches and the stretches between them give the places of the matches."""
    kinds = []
    for order, (kind, pattern, least, group) in enumerate(SECRETS):
        kept = f"length(regexp_extract(m[i], $re${pattern}$re$, {group})) >= {least}"
        kinds.append(
            f"SELECT r, {order} AS o, '{kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n "
            f"FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, $re${pattern}$re$) AS m, string_split_regex(t, $re${pattern}$re$) AS g FROM d)) WHERE {kept}"
        )
    base = "'assign', 'access', 'hex'"
    told = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in ("assign", "access", "hex"))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(kinds)}),
j AS (SELECT r, {counts}, string_agg({told}, ',' ORDER BY a, o) FILTER (kind IN ({base})) AS b, string_agg({told}, ',' ORDER BY a, o) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)"""


def licenses_sql() -> str:
    rows = []
    for number, t in enumerate(licenses.TEMPLATES):
        words = t.text.split()
        rows += [f"({number}, '{t.label}', {t.base}, {len(words) <= licenses.PHRASE_WORDS}, {len(words) - 1}, {i}, '{a} {b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return f"""WITH t(template, label, base, phrase, grams, tpos, gram) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
z AS (SELECT r, unnest(list_zip(range(len(w) - 1), w[1:len(w) - 1], w[2:len(w)])) AS x FROM d WHERE len(w) > 1),
g AS (SELECT r, x[1] AS pos, x[2] || ' ' || x[3] AS gram FROM z),
v AS (SELECT r, template, label, base, phrase, grams, pos - tpos AS diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high, list(tpos) AS places FROM g JOIN t USING (gram) GROUP BY ALL),
whole AS (SELECT r, label, base, low AS first_word, 1.0 AS cover FROM v WHERE phrase AND votes = grams),
b AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {licenses.SLACK}, true) AS begins FROM v WHERE NOT phrase AND votes >= {licenses.LEAST_VOTES}),
n AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp FROM b),
merged AS (SELECT r, label, base, min(low) AS first_word, len(list_distinct(flatten(list(places)))) / grams AS cover, max(high) + 1 - min(low) AS span, grams FROM n GROUP BY r, template, label, base, grams, grp),
s AS (SELECT * FROM whole UNION ALL SELECT r, label, base, first_word, cover FROM merged WHERE cover >= {licenses.COVER} AND span <= 2 * grams),
j AS (SELECT r, count(*) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN j USING (r)"""

def rules_sql() -> str:
    """The base counts, both histograms as rows, and their Jensen-Shannon distances to the sums of each language."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    patterns = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "stop": "[.,;:!?]", "quote": """['"()-]""", "control": r"[\x00-\x08\x0E-\x1F\x7F]", "beyond": r"[^\x00-\x7F]"}
    patterns["symbol"] = r"[#$%&*+/<=>@\[\\\]^_`{|}~]"
    histogram = " UNION ALL ".join(f"SELECT r, 'c' AS part, '{name}' AS k, length(t) - length(regexp_replace(t, $re${p}$re$, '', 'g')) AS n FROM w" for name, p in patterns.items())
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(lang) AS lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
z AS (SELECT r, unnest(list_zip(range(len(w) - 2), w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)])) AS x FROM w WHERE len(w) > 2),
g AS (SELECT r, x[1] AS i, count(*) OVER (PARTITION BY r, x[2], x[3], x[4]) AS n FROM z),
m AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY r),
b AS MATERIALIZED (SELECT r, doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN m USING (r)),
u AS MATERIALIZED (SELECT r, trim(translate(unnest(w), '{upper}', '{lower}'), $tr$.,;:!?'"()-$tr$) AS word FROM w),
t AS (SELECT lang, sum(n_words) AS total FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 2000),
o AS (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(word)) AS place FROM u JOIN b USING (r) WHERE NOT base_failed AND word <> '' AND lang IS NOT NULL GROUP BY lang, word),
top AS MATERIALIZED (SELECT lang, word, n FROM o JOIN t USING (lang) WHERE place <= 30),
h AS MATERIALIZED (SELECT r, lang, part, k, n FROM ({histogram}) JOIN b USING (r) WHERE n > 0 UNION ALL SELECT r, b.lang, 'w', coalesce(top.word, ''), count(*) FROM u JOIN b USING (r) LEFT JOIN top ON top.lang = b.lang AND top.word = u.word GROUP BY ALL),
e AS (SELECT h.lang, part, k, sum(n) AS n FROM h JOIN b USING (r) JOIN t ON t.lang = h.lang WHERE NOT base_failed GROUP BY ALL),
q AS MATERIALIZED (SELECT lang, part, k, n / sum(n) OVER (PARTITION BY lang, part) AS q FROM e),
p AS (SELECT r, lang, part, k, n / sum(n) OVER (PARTITION BY r, part) AS p FROM h),
s AS (SELECT r, p.part, sqrt(greatest(0, (sum(p * log2(2 * p / (p + coalesce(q, 0)))) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) + 1 - sum(coalesce(q, 0))) / 2)) AS dist
  FROM p JOIN t ON t.lang = p.lang LEFT JOIN q ON q.lang = p.lang AND q.part = p.part AND q.k = p.k GROUP BY ALL),
x AS (SELECT lang, sqrt((log2(2 / (1 + max(q) FILTER (k = ''))) + sum(CASE WHEN k <> '' THEN q ELSE q * log2(2 * q / (1 + q)) END)) / 2) AS none FROM q WHERE part = 'w' GROUP BY lang),
f AS (SELECT r, max(dist) FILTER (part = 'c') AS c, max(dist) FILTER (part = 'w') AS v FROM s GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= 200 AND c > 0.3, false) AND NOT coalesce(n_words >= 100 AND v > 0.85 * none, false) AS kept
FROM b LEFT JOIN f USING (r) LEFT JOIN x USING (lang)"""


NEIGHBOURS = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM f q JOIN f c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
s AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT * FROM s WHERE rank <= 5"""


def vector_codes_sql(parts: int = 8, size: int = 16, rounds: int = 6) -> str:
    """The rounds written out one by one; every assignment looks at every entry."""
    steps = []
    for number in range(rounds + 1):
        steps.append(
            f"""a{number} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
  SELECT r, part, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{number} USING (part)) GROUP BY r, part)"""
        )
        if number < rounds:
            steps.append(
                f"""m{number} AS (SELECT part, entry, list(mean ORDER BY place) AS c FROM (SELECT part, best.entry AS entry, place, CAST(sum(y) AS BIGINT) AS s, count(*) AS n, (s - ((s % n) + n) % n) // n AS mean
  FROM (SELECT r, part, unnest(x) AS y, unnest(range(len(x))) AS place FROM p) JOIN a{number} USING (r, part) GROUP BY part, best.entry, place) GROUP BY part, entry),
c{number + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, o.c) AS c FROM c{number} o LEFT JOIN m{number} m USING (part, entry))"""
            )
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x FROM k, range({parts}) AS t(part)),
c0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {size}),
{", ".join(steps)},
f AS (SELECT r, string_agg(lpad(lower(to_hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), b"""
