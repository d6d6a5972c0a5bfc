"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from telemill.llm import licenses
from telemill.llm.queries import URL_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({_LOWER.format(f'coalesce({text}, {chr(39)}{chr(39)})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination_sql(length: int = 10) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
wins AS (SELECT item_id, least(len(w), {length}) AS size, unnest(list_transform(range(1, len(w) - least(len(w), {length}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {length}) - 1], ' '))) AS k FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wins),
dw AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS pos, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS k FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.r, dw.pos, dw.size, wins.item_id FROM dw JOIN wins ON dw.k = wins.k AND dw.size = wins.size),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS p FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""


def url_filters_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
parts AS (SELECT r, page_id, {_LOWER.format("regexp_extract(coalesce(x, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.r = fits.r AND k = 1"""


def _canonical(url: str) -> str:
    rest = rf"regexp_replace(regexp_replace({url}, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\.', '')"
    path = rf"regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    fields = rf"list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?]*\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')))"
    return f"{host} || {path} || CASE WHEN len({fields}) > 0 THEN '?' || array_to_string({fields}, '&') ELSE '' END"


def warc_sql() -> str:
    return rf"""
WITH p AS (SELECT row_number() OVER () AS n, page_id, {_canonical("url")} AS url_key, 1700000000 + page_id * 60 AS s,
    1700000000 + page_id * 60 + 3600 + (page_id * 7919) % 2592000 AS v, '"' || md5(html)[1:16] || '"' AS tag, sha1(html) AS digest, strlen(html)::VARCHAR AS size FROM pages),
near AS (SELECT a.n, max({{'s': b.s, 'id': 'r' || b.page_id, 'tag': b.tag, 'digest': b.digest, 'size': b.size}}) AS got FROM p a JOIN p b ON a.url_key = b.url_key AND b.s < a.v GROUP BY a.n),
x AS (SELECT p.*, got, CASE WHEN got IS NULL THEN 'missing' WHEN got.tag = p.tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM p LEFT JOIN near USING (n))
SELECT 'v' || page_id AS record_id, url_key, outcome, got.id AS response_id, got.digest AS response_digest, v AS ts_s, got.s AS response_s,
  CASE WHEN outcome = 'resolved' THEN 'W/' || tag END AS etag, CASE WHEN outcome = 'resolved' THEN strftime(make_timestamp(got.s * 1000000), '%Y-%m-%d %H:%M:%S') END AS last_modified,
  CASE WHEN outcome = 'resolved' THEN got.size END AS content_length, CASE WHEN outcome = 'resolved' THEN 'max-age=600' END AS cache_control,
  CASE WHEN outcome = 'resolved' THEN strftime(make_timestamp(v * 1000000), '%Y-%m-%d %H:%M:%S') END AS date_header FROM x"""


def licenses_sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in licenses.SENTENCES)
    step = "x"
    hits = []
    for license_, run in licenses.RULES:
        text = "".join(f"|{i}|" for i in run)
        hits.append((license_, text, step))
        step = f"replace({step}, '{text}', '/')"
    found = ", ".join(f"CASE WHEN contains({before}, '{text}') THEN '{name}' END" for name, text, before in hits)
    ends = r"[.!?;:]+(?:\s+|$)|[\r\n]+"
    return rf"""
WITH known(i, s) AS (VALUES {known}),
m AS (SELECT map(list(s), list(i)) AS m FROM known),
d AS (SELECT doc_id, list_filter(list_transform(list_transform(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{ends}'), lambda q: trim(regexp_replace(q, '[^a-z0-9]+', ' ', 'g'))), lambda q: m[q]), lambda q: q IS NOT NULL) AS ids FROM documents, m),
e AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '||') || '|' ELSE '' END AS x FROM d),
f AS (SELECT doc_id, ids, list_filter([{found}], lambda q: q IS NOT NULL) AS names, list_filter(regexp_split_to_array({step}, '[|/]+'), lambda q: q <> '') AS rest FROM e)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_filter(names, lambda q, k: list_position(names, q) = k), ',') AS licenses, array_to_string(rest, ',') AS unmatched FROM f"""


def repeats_sql(length: int = 200) -> str:
    """Texts as hex digits, two a byte; strings of ``length`` bytes are told apart by their MD5."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * length})) AS k FROM (SELECT r, x, unnest(range(len(x) // 2 - {length - 1})) AS i FROM d WHERE len(x) >= {2 * length})),
m AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
s AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {length}, true) AS new FROM m),
g AS (SELECT r, i, sum(new::INTEGER) OVER (PARTITION BY r ORDER BY i) AS n FROM s),
spans AS (SELECT r, n, min(i) AS low, max(i) + {length} AS high FROM g GROUP BY r, n),
pieces AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM spans),
cut AS (SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(x), 2 * max(high) + 1) AS kept FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    distance = "list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - c.q[i]) * (p.q[i] - c.q[i])))::BIGINT"
    step = lambda books: f"SELECT r, p.part, min({{'d': {distance}, 'e': entry}}) AS best FROM p JOIN {books} c ON p.part = c.part GROUP BY r, p.part"
    ctes = []
    for k in range(rounds):
        ctes.append(f"a{k} AS MATERIALIZED ({step(f'c{k}')})")
        ctes.append(f"""u{k} AS MATERIALIZED (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p.part, best.e AS e, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM a{k} JOIN p USING (r, part)) GROUP BY ALL)""")
        ctes.append(f"""m{k} AS MATERIALIZED (SELECT part, e AS entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM u{k} GROUP BY part, e)""")
        ctes.append(f"""c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m USING (part, entry))""")
    chain = ",\n".join(ctes)
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, list_transform(v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}], lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM e, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, q FROM p WHERE r <= {entries}),
{chain},
last AS MATERIALIZED ({step(f'c{rounds}')}),
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(range(len(q))) AS i, unnest(q) AS x FROM c{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN e USING (r), books"""


def source_audit_sql(least: int = 10, top: int = 10) -> str:
    p = lambda n, total: f"1 + (1000000000 * ({n} + 2)::HUGEINT) // ({total} + 2 * terms)"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS x FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM n GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS terms, sum(n_lang)::BIGINT AS lang_total FROM kept GROUP BY lang) USING (lang)),
t AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS c, {p("coalesce(n.n, 0)", "total")} AS p, {p("n_lang", "lang_total")} AS q FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")})::BIGINT AS value FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ({f("p", "q")})::BIGINT AS value FROM t WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}"""


ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination_sql(),
    "op5_url_filters": url_filters_sql(),
    "op8_warc_revisits": warc_sql(),
    "op10_licenses": licenses_sql(),
    "op11_repeats": repeats_sql(),
    "op12_vector_codes": vector_codes_sql(),
    "op13_source_audit": source_audit_sql(),
}
