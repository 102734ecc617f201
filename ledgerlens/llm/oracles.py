"""DuckDB SQL of the operators that SQL can express (4 and 6).

Written from the operators' definitions: one window over each whole leaf for
the mixture, one inequality join for the revisits.
"""

from __future__ import annotations

from . import captures, mixing, revisits


def _case(column: str, weights: dict[str, float], default: float) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {float(v)!r}" for k, v in weights.items())
    return f"CAST(CASE {whens} ELSE {float(default)!r} END AS DOUBLE)" if whens else f"CAST({float(default)!r} AS DOUBLE)"


def mixing_sql(share: float, epochs: int) -> str:
    number = "TRY_CAST(regexp_extract(source, '^src([0-9]{1,9})$', 1) AS BIGINT)"
    domain = " ".join(f"WHEN {number} BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in mixing.DOMAINS)
    ctes = [
        f"""d AS (SELECT doc_id, lang, source, CASE {domain} ELSE 'other' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)""",
        "leaves AS (SELECT domain, lang, source, CAST(SUM(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
    ]
    given = f"CAST({float(share)!r} AS DOUBLE) * (SELECT SUM(tokens) FROM leaves)"
    for k, level in enumerate(mixing.LEVELS):
        path = mixing.LEVELS[:k + 1]
        up = mixing.LEVELS[:k]
        group = "PARTITION BY " + ", ".join(f"c.{c}" for c in up) if up else ""
        same = " AND ".join(f"c.{c} IS NOT DISTINCT FROM p.{c}" for c in up)
        cols = ", ".join(f"c.{c}" for c in path)
        weight = _case(f"c.{level}", mixing.WEIGHTS[level], mixing.DEFAULT_WEIGHT[level])
        ctes += [
            f"c{k} AS (SELECT {', '.join(path)}, CAST(SUM(tokens) * {epochs} AS DOUBLE) AS capacity FROM leaves GROUP BY ALL)",
            f"w{k} AS (SELECT {cols}, c.capacity, {weight} AS weight, {'p.alloc' if k else given} AS given FROM c{k} c"
            + (f" JOIN n{k - 1} p ON {same})" if k else ")"),
            f"""r{k} AS (SELECT c.*, (c.given - COALESCE(SUM(c.capacity) OVER ({group} ORDER BY c.capacity / c.weight, c.{level}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(c.weight) OVER ({group} ORDER BY c.capacity / c.weight, c.{level}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM w{k} c)""",
            f"n{k} AS (SELECT {cols}, greatest(0, least(c.capacity, c.weight * MAX(c.reach) OVER ({group}))) AS alloc FROM r{k} c)",
        ]
    last = len(mixing.LEVELS) - 1
    leaf = " AND ".join(f"d.{c} IS NOT DISTINCT FROM l.{c}" for c in mixing.LEVELS)
    ctes += [
        f"""l AS (SELECT l.*, CAST(floor(n.alloc + 1e-6) AS BIGINT) AS alloc FROM leaves l JOIN n{last} n ON
  {' AND '.join(f'l.{c} IS NOT DISTINCT FROM n.{c}' for c in mixing.LEVELS)})""",
        "q AS (SELECT *, alloc // tokens AS whole, alloc % tokens AS rest FROM l WHERE tokens > 0)",
        f"""e AS (SELECT d.doc_id, d.domain, d.lang, d.source, d.tokens, l.whole, l.rest, unnest(range(0, l.whole + 1)) AS epoch
  FROM d JOIN q l ON {leaf} WHERE d.tokens > 0)""",
        f"""o AS (SELECT *, SUM(tokens) OVER (PARTITION BY domain, lang, source, epoch
    ORDER BY md5('{mixing.SEED}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) - tokens AS before FROM e)""",
    ]
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, tokens,
  CAST(CASE WHEN epoch < whole THEN tokens ELSE least(tokens, rest - before) END AS BIGINT) AS take
FROM o WHERE epoch < whole OR before < rest"""


def revisits_sql() -> str:
    rest = "regexp_replace(regexp_replace(trim(target_uri), '#.*$', ''), '^(?i:https?)://', '')"
    return f"""WITH rec({', '.join(captures.COLUMNS)}) AS ({captures.RECORDS_SQL}),
a AS (SELECT *, {rest} AS rest FROM rec),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''),
    ':(80|443)$', ''), '^www\\.', '') AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:{revisits.VISIT_FIELDS})(=|$)'))) AS kept FROM a),
c AS (SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM b),
v AS (SELECT * FROM c WHERE warc_type = 'revisit' AND profile LIKE '%{revisits.PROFILE}'),
f AS (SELECT * FROM c WHERE warc_type = 'response' AND status = 200),
m AS (SELECT v.record_id, arg_max(f.record_id, CAST(f.second AS HUGEINT) * 1000000000000 + f.record_id) AS response_id
  FROM v JOIN f ON f.url = v.url AND f.second < v.second GROUP BY v.record_id),
j AS (SELECT v.record_id, v.url, v.second, m.response_id, f.payload,
    CASE WHEN m.response_id IS NULL THEN 'no_response'
      WHEN v.etag IS NOT NULL AND f.etag IS NOT NULL THEN
        CASE WHEN regexp_replace(v.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
      WHEN v.modified IS NULL OR f.modified IS NULL THEN 'unverified'
      WHEN v.modified = f.modified THEN 'resolved' ELSE 'changed' END AS outcome,
    'cache-control: ' || v.cache || chr(10) || 'content-length: ' || f.length || chr(10) || 'etag: ' || coalesce(v.etag, f.etag)
      || chr(10) || 'last-modified: ' || coalesce(v.modified, f.modified) AS headers
  FROM v LEFT JOIN m USING (record_id) LEFT JOIN f ON f.record_id = m.response_id)
SELECT record_id, url, second, response_id, outcome, CASE WHEN outcome = 'resolved' THEN headers END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(payload) END AS payload_md5,
  CASE WHEN outcome = 'resolved' THEN CAST(length(payload) AS BIGINT) END AS payload_chars
FROM j"""


def lexical_sql() -> str:
    """Every document scored for every item, from the formula alone."""
    return r"""
with terms as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), sizes as (
  select row, doc_id, words, len(words)::bigint as n from terms where len(words) > 0
), totals as (
  select count(*)::bigint as docs, sum(n)::bigint as length from sizes
), counts as (
  select row, doc_id, n, word, count(*)::bigint as tf from (select row, doc_id, n, unnest(words) as word from sizes) group by all
), weights as (
  select word, cast(floor(1000 * ln((2.0::double * any_value(t.docs) + 2) / (2.0::double * count(*) + 1))) as bigint) as w
  from counts, totals t group by word
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as word
  from benchmark
), scores as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * t.docs) // t.length))))::bigint as score
  from wanted join counts using (word) join weights using (word), totals t group by item_id, row, doc_id
), ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as place
  from scores where score > 0
)
select item_id, place::int as rank, doc_id, score from ranked where place <= 10
"""


def fim_sql() -> str:
    """Cuts by list slices of all units."""
    return """
with units as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u
  from documents
), draws as (
  select *, len(u)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from units
), forms as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from draws
), parts as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m,
         coalesce(array_to_string(u[b + 1:n], ''), '') as s
  from forms
)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars,
       case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parts
"""
