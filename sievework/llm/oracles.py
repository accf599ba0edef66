"""DuckDB SQL of the corpus queries that SQL can express, written from their definitions."""

from __future__ import annotations

from sievework.llm import chat_format, license_scan, quality_rules, secrets

WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f"""


def sharding(shards: list[str], slots: int) -> str:
    """The table filled slot by slot, turn by turn, from the definition; then one lookup a row."""
    import hashlib

    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)

    def order(shard: str):
        at, step = number(f"start:{shard}"), number(f"step:{shard}") % (slots - 1) + 1
        return ((at + k * step) % slots for k in range(slots))

    orders = [order(s) for s in shards]
    owner: dict[int, str] = {}
    while len(owner) < slots:
        for shard, order in zip(shards, orders, strict=True):
            if (slot := next((x for x in order if x not in owner), None)) is not None:
                owner[slot] = shard
    values = ", ".join(f"({k}, '{v}')" for k, v in sorted(owner.items()))
    return f"""WITH t(slot, shard) AS (VALUES {values}),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT d.doc_id, CAST(d.slot AS BIGINT) AS slot, t.shard FROM d JOIN t ON d.slot = t.slot"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_spans() -> str:
    """Places of matches from the lengths of matches and of what stands between them."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2), ("AKIA[A-Z0-9]+", 0), ("[0-9a-f]+", 0), (secrets.VENDOR, 0)]
    found = "\nUNION ALL ".join(
        f"SELECT uid, {rank} AS rank, string_split_regex(t, {_quoted(p)}) AS g, regexp_extract_all(t, {_quoted(p)}, 0) AS f, regexp_extract_all(t, {_quoted(p)}, {group}) AS v FROM d WHERE regexp_matches(t, {_quoted(p)})" for rank,
        (p, group) in enumerate(patterns)
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    span = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
m AS ({found}),
s AS (SELECT uid, rank, g, f, v, unnest(range(1, len(f) + 1)) AS i FROM m),
p AS (SELECT uid, rank, v[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start, length(f[i]) AS n FROM s),
c AS (SELECT uid, CASE WHEN rank = 0 AND length(value) < 12 THEN 4 ELSE rank END AS rank, value, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM p
WHERE CASE rank WHEN 0 THEN length(value) >= 8 WHEN 1 THEN length(value) >= 18 WHEN 2 THEN length(value) >= 16 ELSE true END),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM c JOIN d USING (uid) GROUP BY value),
j AS (SELECT c.*, {kinds}[rank + 1] AS kind, rank < 3 AS base, owners, repos, NOT (owners >= {secrets.COPIED_OWNERS} OR (owners > 1 AND repos >= {secrets.COPIED_REPOS})) AS live FROM c JOIN o USING (value))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
sha256(coalesce(string_agg({span}, ',' ORDER BY start, rank) FILTER (WHERE base), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY start, rank, stop) FILTER (WHERE base OR live), '') AS spans,
count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied, coalesce(max(owners) FILTER (WHERE base OR live), 0) AS most_owners, coalesce(max(repos) FILTER (WHERE base OR live), 0) AS most_repos
FROM d LEFT JOIN j USING (uid) GROUP BY d.uid, d.doc_id"""


def chats() -> str:
    """Turns in order; a turn's share of the formatted text from its escaped length and from whether it begins a block."""
    escaped = lambda c: f"regexp_replace({c}, {_quoted(chat_format.ESCAPED)}, {_quoted(chr(92) + '1' + 2 * chr(92) + chr(92) + '2' + chr(92) + '3')}, 'g')"
    block = len(chat_format.BEGIN + chat_format.HEAD + chat_format.BODY + chat_format.END)
    said = "'</s>[INST] ok [/INST]'"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})),
e AS (SELECT *, {escaped('role')} AS er, {escaped('text')} AS et FROM r),
w AS (SELECT *, row_number() OVER o AS rn, lag(role) OVER o AS before FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, er, et))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(et) + CASE WHEN before IS DISTINCT FROM role THEN {block} + length(er) ELSE {len(chat_format.NEXT)} END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id"""


def license_phrases() -> str:
    """Places where a phrase's words stand consecutively, from the lists of words."""
    places = " UNION ALL ".join(
        f"SELECT uid, i, '{label}' AS label FROM i WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase,
        label in license_scan.PHRASES.items()
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT uid, w, unnest(range(1, len(w) + 1)) AS i FROM d), p AS ({places})
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(p.i) AS n_base, min(p.i) - 1 AS first_word, max(p.i) - 1 AS last_word, coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label), '') AS base_labels
FROM d LEFT JOIN p USING (uid) GROUP BY d.uid, d.doc_id"""


def rules() -> str:
    """Measures from lists of words, windows and lines; hosts from their sums."""
    q = quality_rules
    lines = "list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    return f"""WITH t AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS t FROM documents),
d AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, {lines} AS l FROM t),
i AS (SELECT uid, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM d),
x AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, w[i:i + {q.WINDOW - 1}]) AS times FROM i),
y AS (SELECT uid, least({q.WINDOW}, coalesce(lead(i) OVER (PARTITION BY uid ORDER BY i) - i, {q.WINDOW})) AS c FROM x WHERE times > 1),
z AS (SELECT uid, sum(c) AS c FROM y GROUP BY uid),
m AS (SELECT d.uid, doc_id, coalesce('=' || source, '') AS h, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(z.c, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN z USING (uid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 5 * n_symbols > n_words OR 3 * n_dup_lines > n_lines OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed FROM f),
hosts AS (SELECT h, count(*)::DOUBLE AS n, count(*) FILTER (WHERE failed)::DOUBLE AS bad FROM g GROUP BY h),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS p, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM hosts),
v AS (SELECT p, CASE WHEN n - nn / n - (k - 1) > 0 THEN (bb - n * p * p - (k - 1) * p * (1 - p)) / (n - nn / n - (k - 1)) ELSE 0 END AS spread FROM s),
a AS (SELECT p, least({q.PRIOR[1]}, greatest({q.PRIOR[0]}, CASE WHEN spread > 0 THEN p * (1 - p) / spread - 1 ELSE {q.PRIOR[1]} END)) AS weight FROM v),
b AS (SELECT h, n, p, weight, (bad + weight * p) / (n + weight) AS rate FROM hosts, a),
j AS (SELECT h, rate, p > 0 AND rate - {q.SURE_Z} * sqrt(rate * (1 - rate) / (n + weight + 1)) > least({q.TIMES} * p, {q.MOST_RATE}) AS suspect FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (failed AND suspect) AS kept, round_even(rate, 6) AS host_rate, suspect AS host_suspect FROM g JOIN j USING (h)"""
