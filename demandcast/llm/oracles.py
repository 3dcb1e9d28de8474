"""DuckDB SQL for the operators that SQL can express.

The texts state the definitions plainly: greedy patterns without look-around,
whole texts as keys instead of hashes, distinct counts instead of distributed
reductions.
"""

from __future__ import annotations

from demandcast.llm import decontaminate, mixing, privacy

_MARKS = {"name": "chr(1)", "unit": "chr(2)", "number": "chr(3)", "end": "chr(4)"}


def decontamination_sql() -> str:
    units = "|".join(decontaminate.UNITS)

    def kept(kind: str, group: str) -> str:
        return f"' ' || {_MARKS[kind]} || '{group}' || {_MARKS['end']} || ' '"

    any_mark = f"{_MARKS['name']} || {_MARKS['unit']} || {_MARKS['number']}"
    token = f"'[\\p{{L}}\\p{{M}}]+|[' || {any_mark} || '][^' || chr(4) || ']*' || chr(4)"
    is_slot = f"instr({any_mark}, substr(x, 1, 1)) > 0"

    def windows(name: str, key: str, source: str) -> str:
        return f"""{name}_m1 AS (
  SELECT {key}, regexp_replace(translate(coalesce(text, ''), {any_mark} || chr(4), '    '),
    '([\\p{{Ll}}\\p{{Nd}},;:] )(\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)*)',
    '\\1' || {kept('name', chr(92) + '2')}, 'g') AS t FROM {source}),
{name}_m2 AS (
  SELECT {key}, regexp_replace(t, '(\\p{{Nd}})( ?)((?i:{units}))([^\\p{{L}}\\p{{M}}\\p{{Nd}}]|$)',
    '\\1' || {kept('unit', chr(92) + '3')} || '\\4', 'g') AS t FROM {name}_m1),
{name}_m3 AS (
  SELECT {key}, regexp_replace(regexp_replace(t, '[%$€£¥]', {kept('unit', chr(92) + '0')}, 'g'),
    '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*', {kept('number', chr(92) + '0')}, 'g') AS t FROM {name}_m2),
{name}_t AS (
  SELECT {key}, regexp_extract_all(lower(t), {token}) AS w FROM {name}_m3),
{name}_w AS (
  SELECT {key}, pos, list_slice(w, pos, pos + {decontaminate.WINDOW - 1}) AS w
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) AS pos
        FROM {name}_t WHERE len(w) > 0)),
{name} AS (
  SELECT {key}, pos, [CASE WHEN {is_slot} THEN substr(x, 1, 1) ELSE x END FOR x IN w] AS tmpl,
         [x FOR x IN w IF {is_slot}] AS slots, len([x FOR x IN w IF NOT ({is_slot})]) AS literals
  FROM {name}_w)"""

    return f"""WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT text AS key, text FROM texts),
{windows('d', 'key', 'keyed')},
{windows('b', 'item_id', 'benchmark')},
sizes AS (SELECT item_id, count(DISTINCT tmpl) AS n FROM b GROUP BY item_id),
cand AS (
  SELECT d.key, b.item_id FROM d JOIN b ON d.tmpl = b.tmpl JOIN sizes s ON s.item_id = b.item_id
  GROUP BY d.key, b.item_id, s.n HAVING count(DISTINCT d.tmpl) >= {decontaminate.SHARE}::DOUBLE * s.n),
pairs AS (
  SELECT d.key, b.item_id, d.tmpl, d.slots AS dv, b.slots AS iv, d.pos - b.pos AS shift
  FROM d JOIN cand c ON c.key = d.key JOIN b ON b.item_id = c.item_id AND b.tmpl = d.tmpl
  WHERE b.literals >= {decontaminate.LITERALS} OR b.slots = d.slots),
vals AS (
  SELECT DISTINCT key, item_id, shift, unnest(iv) AS i, unnest(dv) AS v FROM pairs),
clash AS (
  SELECT key, item_id, shift FROM vals GROUP BY 1, 2, 3
  HAVING count(*) > count(DISTINCT i) OR count(*) > count(DISTINCT v)),
held AS (
  SELECT p.key, p.item_id, count(DISTINCT p.tmpl) AS hits
  FROM pairs p ANTI JOIN clash c ON p.key = c.key AND p.item_id = c.item_id AND p.shift = c.shift
  GROUP BY 1, 2)
SELECT x.doc_id, h.item_id, CAST(h.hits AS DOUBLE) / s.n AS coverage
FROM held h JOIN sizes s ON s.item_id = h.item_id JOIN documents x ON x.text = h.key
WHERE h.hits >= {decontaminate.SHARE}::DOUBLE * s.n"""


#: The base patterns as the contract writes them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _located(text: str, pattern: str) -> str:
    """A list of {s, e, v} structs: where a pattern matches (code points)."""
    m, gaps = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    before = f"coalesce(list_sum([length(y) FOR y IN list_slice({gaps}, 1, j)]), 0) " \
             f"+ coalesce(list_sum([length(y) FOR y IN list_slice({m}, 1, j - 1)]), 0)"
    return f"[{{'s': CAST({before} AS BIGINT), 'e': CAST({before} + length({m}[j]) AS BIGINT), " \
           f"'v': {m}[j]}} FOR j IN range(1, len({m}) + 1)]"


def personal_data_sql() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, len({digits}) - i, 1) AS INTEGER)"
    luhn = (f"list_sum([CASE WHEN i % 2 = 0 THEN {digit} ELSE {digit} * 2 - CASE WHEN {digit} > 4 "
            f"THEN 9 ELSE 0 END END FOR i IN range(0, len({digits}))]) % 10 = 0")
    valid = {
        "email": "true",
        "ip": "list_max([CAST(p AS HUGEINT) FOR p IN string_split(v, '.')]) <= 255",
        "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"len({digits}) BETWEEN 10 AND 15"}
    found = "\n  UNION ALL\n".join(
        f"  SELECT text, {rank} AS rank, '{kind}' AS kind, unnest({_located('text', PLAIN[kind])}) AS m "
        "FROM texts" for rank, kind in enumerate(privacy.BASE))
    check = " ".join(f"WHEN '{k}' THEN {c}" for k, c in valid.items())
    term = privacy.TERM
    counts = ", ".join(f"CAST(count_if(kind = '{k}') AS BIGINT) AS n_{k}" for k in privacy.BASE)
    span = "kind || ':' || s || ':' || e"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
texts AS (SELECT text, count(*) AS copies FROM docs GROUP BY text),
raw AS (
{found}),
flat AS (SELECT text, rank, kind, m.s AS s, m.e AS e, m.v AS v FROM raw),
base AS MATERIALIZED (
  SELECT *, kind || ':' || lower(v) AS entity FROM flat
  WHERE CASE kind {check} END),
holds AS MATERIALIZED (SELECT DISTINCT text, entity FROM base),
entities AS MATERIALIZED (
  SELECT entity, sum(copies) AS n_e FROM holds JOIN texts USING (text)
  GROUP BY 1 HAVING count(*) >= {privacy.SUPPORT}),
shared AS MATERIALIZED (SELECT DISTINCT text FROM holds JOIN entities USING (entity)),
words AS MATERIALIZED (
  SELECT text, unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM shared),
together AS (
  SELECT term, entity, sum(copies) AS n_te
  FROM holds JOIN entities USING (entity) JOIN words USING (text) JOIN texts USING (text)
  GROUP BY 1, 2 HAVING count(*) >= {privacy.SUPPORT}),
terms AS (
  SELECT term, count(*) AS n_t
  FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM docs)
  GROUP BY 1),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs),
telling AS MATERIALIZED (
  SELECT term, entity FROM together JOIN entities USING (entity) JOIN terms USING (term), total
  WHERE n_e < n AND log2(n_te * n / (n_t * n_e)) / log2(n / n_e) >= {privacy.GENERALISE}::DOUBLE),
given AS MATERIALIZED (
  SELECT DISTINCT text, term FROM telling JOIN holds USING (entity) JOIN words USING (text, term)),
places AS (
  SELECT text, lower(m.v) AS term, m.s AS s, m.e AS e
  FROM (SELECT text, unnest({_located('text', term)}) AS m FROM (SELECT DISTINCT text FROM given))),
marks AS (
  SELECT text, {len(privacy.BASE)} AS rank, 'term' AS kind, s, e
  FROM places JOIN given USING (text, term)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.text = places.text AND b.s < places.e AND places.s < b.e)),
spans AS (SELECT text, rank, kind, s, e FROM base UNION ALL SELECT * FROM marks),
per_text AS (
  SELECT text, {counts},
         coalesce(string_agg({span}, ',' ORDER BY s, rank) FILTER (kind <> 'term'), '') AS base_text,
         string_agg({span}, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY text)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in privacy.BASE)},
       sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per_text p ON d.text = p.text"""


def mixing_sql() -> str:
    def by_rank(values) -> str:
        return f"[{', '.join(f'{v}::DOUBLE' for v in values)}][(r - 1) % {len(values)} + 1]"

    share = "o / target"
    at = (f"CASE WHEN abs(slope) < 1e-9 THEN {share} ELSE (sqrt((1 - slope) * (1 - slope) "
          f"+ 4 * slope * ({share})) - (1 - slope)) / (2 * slope) END")
    return f"""WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 1, 15)
              AS BIGINT) AS k
  FROM documents),
line AS (
  SELECT *, sum(size) OVER (PARTITION BY g ORDER BY k % {mixing.CELLS}, k, doc_id, size
                            ROWS UNBOUNDED PRECEDING) - size AS place FROM d),
src AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY g) AS r
        FROM d GROUP BY g),
weighed AS (
  SELECT g, source_size, {by_rank(mixing.WEIGHTS)} AS w, {by_rank(mixing.SLOPES)} AS slope,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM src),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, g ROWS BETWEEN UNBOUNDED PRECEDING
                                             AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (SELECT g, source_size, slope, least(cap, max(level) OVER () * w) AS target FROM levels),
copies AS (
  SELECT *, [p * source_size + place FOR p IN [0, 1]
             IF size > 0 AND p * source_size + place + size / 2.0::DOUBLE <= target] AS offsets
  FROM line JOIN targets USING (g))
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(len(offsets) * size AS BIGINT) AS taken,
       round(list_min([{at} FOR o IN offsets]), 6) + 0.0::DOUBLE AS first_position
FROM copies"""


def filter_audit_sql() -> str:
    """Ranks texts by doc_id within the whole text; walks every order with bit masks."""
    return """
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
masked AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM worded),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masked LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)),
orders AS (
  SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits,
         a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit,
         coalesce(CAST(list_sum(bits[1:i - 1]) AS INTEGER), 0) AS before
  FROM orders, range(1, 6) AS r(i)),
sums AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
         coalesce(sum(n) FILTER (WHERE mask & (bit | before) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM sums"""


ORACLE_SQL = {
    "op11_filter_audit": filter_audit_sql(),
    "op7_mixing": mixing_sql(),
    "op4_pii": personal_data_sql(),
    "op5_decontamination": decontamination_sql(),
}
