"""DuckDB statements of operators 11 to 13."""

from __future__ import annotations

#: The CRC-32 of single bytes, bit by bit; the number is the reversed polynomial of that checksum.
_CRC_TABLE = """
crc_step as (select i, i::bigint as c, 0 as k from range(256) t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_step where k < 8),
crc_table as (select i, c from crc_step where k = 8)"""


def _crc(of: str) -> str:
    """CTEs crc_of(s, h): the unsigned CRC-32 of the UTF-8 bytes of each string of CTE ``of``(s)."""
    return f"""
crc_run as (select s, hex(encode(s)) as x, 4294967295::bigint as c, 0 as p from {of}
  union all select r.s, r.x, xor(t.c, r.c >> 8), r.p + 1 from crc_run r join crc_table t
    on t.i = (xor(r.c, ('0x' || r.x[2 * r.p + 1:2 * r.p + 2])::bigint) & 255) where r.p < length(r.x) / 2),
crc_of as (select s, xor(c, 4294967295) as h from crc_run where p = length(x) / 2)"""


NEAR_VECTORS = """
with recursive rows_ as (select distinct vec_id, embedding::double[] as e from embeddings),
good as (select vec_id, e from rows_ where vec_id is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
near as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from good union select r.a, n.b from reach r join near n on n.a = r.b),
least_ as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from near group by a)
select r.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.component_id, r.vec_id) as component_id,
  coalesce(l.component_id, r.vec_id) is not distinct from r.vec_id as kept
from rows_ r left join degree d on d.a = r.vec_id left join least_ l on l.a = r.vec_id"""

SPELLING = rf"""
with recursive {_CRC_TABLE.strip()},
run as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as r from documents),
keyed as (select d || ':' || r as s, any_value(r) as r, count(*) as m from run group by 1),
{_crc('keyed').strip()},
cut as (select m, case when h % 31 = 0 then left(r, (h % length(r))::bigint) || substr(r, (h % length(r) + 2)::bigint) else r end as word
  from keyed join crc_of using (s)),
words as (select word, sum(m)::bigint as n from cut where length(word) >= 7 group by word having sum(m) >= 2),
masks as (select word, k, left(word, k) || chr(0) || substr(word, k + 2) as masked, left(word, k) || substr(word, k + 2) as shorter
  from (select word, unnest(range(length(word))) as k from words)),
pairs as (select a.word as a, b.word as b from masks a join masks b on a.masked = b.masked and a.word <> b.word
  union select m.word, w.word from masks m join words w on w.word = m.shorter
  union select w.word, m.word from masks m join words w on w.word = m.shorter),
near as (select p.a as word, count(*) as n_near, first(p.b order by w.n desc, encode(p.b)) as best, max(w.n) as best_n
  from pairs p join words w on w.word = p.b group by p.a),
forms as (select w.word, w.n, coalesce(x.n_near, 0) as n_near, case when x.best_n >= 10 * w.n then x.best end as form,
  case when x.best_n >= 10 * w.n then x.best_n end as form_n from words w left join near x using (word)),
follow as (select word, word as root, 0 as k from forms
  union all select f.word, u.form, f.k + 1 from follow f join forms u on u.word = f.root where u.form is not null)
select o.word, o.form, r.root, o.n, o.n_near, o.form_n from forms o
join (select word, arg_max(root, k) as root from follow group by word) r using (word)"""

PREFIX_TRIE = rf"""
with recursive {_CRC_TABLE.strip()},
ids as (select distinct conv_id, conv_id::varchar as s from conversations where conv_id is not null),
{_crc('ids').strip()},
own as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, encode(coalesce(role, '')), encode(coalesce(text, ''))) as seq
  from conversations where conv_id is not null group by conv_id),
built as (select i.conv_id, list_concat(coalesce(b.seq[1:(c.h % 6)::bigint], []), o.seq[(c.h % 6 + 1)::bigint:]) as seq
  from ids i join crc_of c using (s) join own o on o.conv_id = i.conv_id left join own b on b.conv_id = i.conv_id - i.conv_id % 100),
steps as (select conv_id, len(seq) as full_len, unnest(range(len(seq) + 1)) as depth, seq from built),
member as (select conv_id, full_len, depth, seq[1:depth] as path from steps),
node as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where full_len = depth), '')) as ends_sha256 from member group by path, depth),
kids as (select path[1:depth - 1] as path, count(*) as n_children from node where depth > 0 group by 1),
facts as (select n.*, coalesce(k.n_children, 0) as n_children, case when n.depth = 0 then 0 else (n.n_convs - 1) * length(n.path[depth].t) end as saved
  from node n left join kids k on k.path = n.path),
below as (select y.conv_id, unnest(range(y.depth + 1)) as up, y.path, y.saved, (y.n_children = 0)::int as leaf from facts y),
sums as (select path[1:up] as path, sum(saved)::bigint as saved_tokens, sum(leaf)::bigint as n_leaves from below group by 1)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
from facts f join sums s on s.path = f.path left join node p on f.depth > 0 and p.depth = f.depth - 1 and p.path = f.path[1:f.depth - 1]"""
