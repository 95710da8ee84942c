"""DuckDB statements of the input tables (oracle side only).

These restate ``glossa.sources.fixtures`` in SQL over the driver's base tables;
the Spark builders share no code with them.  ``chr(92)`` is a backslash.
"""

ITEMS = r"""
select p_partkey as pid,
 'Box ' || cast(p_partkey as varchar) || ' holds ' || cast(p_size as varchar) || ' items. How many are left?' as question,
 case p_partkey % 4
  when 0 then 'Half of ' || cast(p_size as varchar) || ' go.' || chr(10) || '#### ' || cast(p_partkey % 5 as varchar)
  when 1 then 'First 9 then ' || cast(p_partkey % 5 as varchar)
  when 2 then 'Sum it.' || chr(10) || '#### ' || cast(p_partkey % 5 as varchar) || ',0'
  else 'Sum.' || chr(10) || '#### about ' || cast(p_partkey % 5 as varchar) || ' kr' end as answer,
 case when p_partkey % 13 = 0 then null when p_partkey % 11 = 0 then '  '
  else 'Kasse ' || cast(p_partkey as varchar) || ' rummer ' || cast(p_size as varchar) || '. Hvor mange er tilbage?' end as da_question,
 case when p_partkey % 17 = 0 then null when p_partkey % 19 = 0 then 'ingen tal'
  else 'Vi tager halvdelen.' || chr(10) || '#### ' || cast(p_partkey % 5 as varchar) end as da_answer
from part
"""

COMPLETIONS = r"""
select l_partkey as pid, 'm' || cast(l_suppkey % 2 as varchar) as model,
 case when l_returnflag = 'R' then case when l_orderkey % 13 = 0 then 'da_en' else 'da' end else 'en' end as mode,
 cast(row_number() over (partition by l_partkey, l_suppkey % 2, case when l_returnflag = 'R' then case when l_orderkey % 13 = 0 then 'da_en' else 'da' end else 'en' end
  order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_linestatus, l_returnflag) - 1 as bigint) as sample_idx,
 case when l_linenumber = 1 and l_orderkey % 11 = 0 then chr(92) || 'boxed{' || cast(trunc(l_quantity)::bigint % 5 as varchar) || '.12345678}'
  else case l_linenumber
  when 3 then d.text || chr(10) || 'Answer ' || cast(trunc(l_quantity)::bigint % 5 as varchar)
  when 2 then d.text || chr(10) || chr(92) || 'boxed{' || cast(trunc(l_quantity)::bigint % 5 as varchar) || ',0}' || chr(10)
  when 4 then chr(92) || 'boxed{ ' || cast(trunc(l_quantity)::bigint % 5 as varchar) || ' kr}'
  when 5 then d.text || ' ' || chr(92) || 'boxed{x} ' || chr(92) || 'boxed{' || cast(trunc(l_quantity)::bigint % 5 as varchar) || '}'
  else d.text || chr(10) || chr(92) || 'boxed{' || cast(trunc(l_quantity)::bigint % 5 as varchar) || '}' end end as text
from lineitem join documents d on d.doc_id = l_orderkey % (select count(*) from documents)
"""

TRANSLATION_ATTEMPTS = r"""
select p.p_partkey as id, cast(a.k as integer) as attempt,
 case when (p.p_partkey + a.k) % 7 = 0 then null
  when p.p_partkey % 23 = 0 then 'Danish Question: 12 + 4?' || chr(10) || 'Danish Answer: 16'
  when (p.p_partkey + a.k) % 5 = 0 then d.text || chr(10) || 'Danish Answer:' || chr(10) || d.text
  when (p.p_partkey + a.k) % 5 = 1 then d.text || chr(10) || d.text
  when (p.p_partkey + a.k) % 5 = 2 then 'Danish Question:' || chr(10) || d.text || chr(10) || 'Danish Answer:' || chr(10)
  else 'Danish Question:' || chr(10) || d.text || chr(10) || chr(10) || 'Danish Answer:' || chr(10) || d.text end as content,
 case when (p.p_partkey + a.k) % 7 = 0 then 'timeout' end as error
from part p, (select unnest([0, 1, 2]) as k) a
join documents d on d.doc_id = (p.p_partkey * 3 + a.k) % (select count(*) from documents)
"""

REVIEW_ATTEMPTS = r"""
select p.p_partkey as id, cast(a.k as integer) as attempt,
 case when (p.p_partkey + a.k) % 3 = 0 then null
  when p.p_partkey % 8 = 1 then 'not json'
  when p.p_partkey % 8 = 2 then '```json' || chr(10) || '{"en_ok": true, "issues": [], "severity": "none", "verdict": "ok"}' || chr(10) || '```'
  when p.p_partkey % 8 = 3 then 'Here: {"en_ok": false, "issues": [{"target": "EN", "type": "sum", "brief": "b"}], "severity": "minor", "verdict": "ISSUE"} end'
  when p.p_partkey % 8 = 4 then '{"en_ok": true, "verdict": null}'
  when p.p_partkey % 8 = 5 then '{"da_ok": true}'
  when p.p_partkey % 8 = 6 then '{"en_ok": true, "verdict": "OK"'
  when p.p_partkey % 40 = 7 then '{"en_ok": false, "verdict": "ISSUE", "en_ok": true, "verdict": "OK"}'
  when p.p_partkey % 40 = 15 then '{"en_ok": true, "math_ok_en": NaN, "name_mismatch": -Infinity, "verdict": "NaN or \"OK\""}'
  when p.p_partkey % 40 = 23 then '{"en_ok": true} {"verdict": "OK"}'
  when p.p_partkey % 40 = 31 then '{"en_ok": "yes, \\ \"q\"", "issues": [{"brief": "a \\", "n": [NaN, null]}], "issues": null, "comment": 3, "severity": "{}"}'
  else '{"en_ok": true, "da_ok": true, "verdict": "OK"}' end as content,
 case when (p.p_partkey + a.k) % 3 = 0 then 'ERROR: timeout ' || cast(a.k as varchar) end as error
from part p, (select unnest([0, 1, 2]) as k) a
where p.p_partkey % 29 <> 0
"""

VIEWS = {
    "items": ITEMS,
    "completions": COMPLETIONS,
    "translation_attempts": TRANSLATION_ATTEMPTS,
    "review_attempts": REVIEW_ATTEMPTS,
}


def with_views(body: str, *names: str) -> str:
    """Prefix a statement with the fixture views it reads, as CTEs."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in names)
    return f"with {ctes}\n{body}"
