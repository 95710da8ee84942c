"""Oracle statements: for each registered query, the same result in DuckDB SQL.

Written independently of the Spark operators; shares only the fixture views.
Regexes are RE2 (DuckDB): ``'g'`` makes ``regexp_replace`` global.
"""

from __future__ import annotations

from .fixtures_sql import with_views

N = r"-?\d+(?:[.,]\d+)?"

ORACLE: dict[str, str] = {}


def gold_num(col: str) -> str:
    """First number after '####' else the last number; comma -> point; double."""
    return (f"try_cast(replace(coalesce(nullif(regexp_extract(regexp_extract({col}, '####\\s*([^\\n\\r]+)', 1), "
            f"'{N}', 0), ''), list_extract(regexp_extract_all({col}, '({N})', 1), -1)), ',', '.') as double)")


def boxed_num(col: str) -> str:
    return (f"try_cast(replace(nullif(regexp_extract(regexp_extract({col}, '\\\\boxed\\s*\\{{\\s*([^\\}}]+)\\s*\\}}', 1), "
            f"'{N}', 0), ''), ',', '.') as double)")


def boxed_flag(col: str) -> str:
    return f"regexp_matches(coalesce({col}, ''), '\\\\boxed\\s*\\{{')"


ORACLE["c1_gold_number"] = with_views(
    f"select pid, {gold_num('answer')} as gold_en, {gold_num('da_answer')} as gold_da from items",
    "items")

ORACLE["c3_boxed_number"] = with_views(
    f"select pid, model, mode, sample_idx, {boxed_num('text')} as pred from completions",
    "completions")

ORACLE["c4_boxed_flag"] = with_views(
    f"select pid, model, mode, sample_idx, {boxed_flag('text')} as boxed from completions",
    "completions")

ORACLE["f1_attach_gold"] = with_views(
    f"""select c.pid, c.model, c.mode, c.sample_idx,
          case when c.mode = 'en' then {gold_num('i.answer')} else {gold_num('i.da_answer')} end as gold
        from completions c join items i on i.pid = c.pid""",
    "items", "completions")

ORACLE["g1_accuracy_boxed"] = with_views(
    f"""select model, mode,
          round(sum(case when p is not null and g is not null and abs(p - g) < 1e-3 then 1.0::double else 0.0::double end) / (select count(*) from items), 6) as accuracy,
          round(sum(case when b then 1.0::double else 0.0::double end) / (select count(*) from items), 6) as boxed_rate
        from (select c.model, c.mode, {boxed_num('c.text')} as p, {boxed_flag('c.text')} as b,
                case when c.mode = 'en' then {gold_num('i.answer')} else {gold_num('i.da_answer')} end as g
              from completions c join items i on i.pid = c.pid where c.sample_idx = 0)
        group by model, mode""",
    "items", "completions")


# ---- shared SQL expressions ---------------------------------------------------

def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def gold_txt(col: str) -> str:
    num = (f"replace(coalesce(nullif(regexp_extract(regexp_extract({col}, '####\\s*([^\\n\\r]+)', 1), "
           f"'{N}', 0), ''), list_extract(regexp_extract_all({col}, '({N})', 1), -1)), ',', '.')")
    return f"(case when {col} is null then '' else coalesce({num}, {strip(col)}) end)"


def boxed_ans(col: str) -> str:
    s = strip(f"coalesce({col}, '')")
    body = strip(f"regexp_replace({s}, '####\\s*[^\\n\\r]+', '', 'g')")
    line = f"(chr(92) || 'boxed{{' || {gold_txt(s)} || '}}')"
    return f"(case when {body} = '' then {line} else {body} || chr(10) || {line} end)"


def clean_eval(x: str) -> str:
    s = f"coalesce({x}, '')"
    s = f"regexp_replace({s}, '(?s)\\\\boxed\\s*\\{{.*?\\}}', ' ', 'g')"
    s = f"regexp_replace({s}, '\\\\[a-zA-Z]+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\d+', ' ', 'g')"
    s = f"regexp_replace({s}, '[^A-Za-zÆØÅæøå\\s]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"lower({strip(s)})"


def clean_reward(x: str) -> str:
    s = f"coalesce({x}, '')"
    s = f"regexp_replace({s}, '(?s)```.*?```', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)\\$.*?\\$|\\\\\\[.*?\\\\\\]|\\\\\\(.*?\\\\\\)', ' ', 'g')"
    s = f"regexp_replace({s}, '\\\\[a-zA-Z]+(?:\\{{.*?\\}})?', ' ', 'g')"
    return strip(s)


def drop_final(x: str) -> str:
    return (f"regexp_replace(coalesce({x}, ''), "
            f"'(?:^|\\r\\n|\\n|\\r)[^\\S\\n]*\\\\boxed\\{{[^\\n]*\\}}[^\\S\\n]*\\n?\\z', '')")


def gram_text(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^A-Za-zÆØÅæøå]+', ' ', 'g')"


def grams_of(src: str, keycols: str, text: str) -> str:
    """Select (keycols, gram) of all overlapping 3-grams of gram_text(text)."""
    return (f"select {keycols}, unnest(list_transform(range(1, len(_c) - 1), "
            f"lambda i: _c[i] || _c[i + 1] || _c[i + 2])) as gram "
            f"from (select {keycols}, string_split({gram_text(text)}, '') as _c from {src})")


def profile_ctes(langs, p="pf") -> str:
    """CTE list ending in ``{p}(gram, lang, logp)``: add-one smoothed trigram model."""
    ll = ", ".join(f"'{x}'" for x in sorted(langs))
    return f"""{p}_docs as (select lang, {clean_eval('text')} as t from documents where lang in ({ll})),
{p}_grams as ({grams_of(f'{p}_docs', 'lang', 't')}),
{p}_counts as materialized (select lang, gram, count(*) as c from {p}_grams group by lang, gram),
{p}_vocab as (select distinct gram from {p}_counts),
{p}_totals as (select lang, sum(c) as total from {p}_counts group by lang),
{p} as materialized (select g.gram, g.lang,
   ln((coalesce(pc.c, 0) + 1.0) / (coalesce(t.total, 0) + (select count(*) from {p}_vocab))) as logp
  from (select gram, unnest([{ll}]) as lang from {p}_vocab) g
  left join {p}_counts pc on pc.gram = g.gram and pc.lang = g.lang
  left join {p}_totals t on t.lang = g.lang)"""


def score_ctes(src: str, langs, out: str, p="pf") -> str:
    """CTEs ending in ``{out}(k, s_<lang>...)``: summed logp of known grams of
    ``src(k, t)``; 0 when a text has none."""
    langs = sorted(langs)
    sums = ", ".join(f"sum(case when p.lang = '{x}' then p.logp end) as s_{x}" for x in langs)
    co = ", ".join(f"coalesce(ss.s_{x}, 0.0) as s_{x}" for x in langs)
    # texts are numbered, so that a gram's row carries a number and not a text
    return f"""{out}_n as materialized (select row_number() over () as no, k, t from {src}),
{out}_g as ({grams_of(f'{out}_n', 'no', 't')}),
{out}_s as materialized (select g.no, {sums} from {out}_g g join {p} p on p.gram = g.gram group by g.no),
{out} as (select st.k, {co} from {out}_n st left join {out}_s ss on ss.no = st.no)"""


def conf2(s: str, t: str, o: str):
    """Softmax confidences of two languages from table alias s (sorted-language sum)."""
    a, b = sorted([t, o])
    m = f"greatest({s}.s_{a}, {s}.s_{b})"
    z = f"(exp({s}.s_{a} - {m}) + exp({s}.s_{b} - {m}))"
    return f"exp({s}.s_{t} - {m}) / {z}", f"exp({s}.s_{o} - {m}) / {z}"


T, O = "de", "en"
CT, CO = conf2("sc", T, O)


def signal(len_expr: str, score_expr: str) -> tuple[str, str]:
    score = f"(case when {len_expr} < 15 then 0.0 else {score_expr} end)"
    label = (f"(case when {len_expr} < 15 then 'unclear' when {score} >= 0.3 then 'target' "
             f"when {score} <= -0.3 then 'other' else 'mixed' end)")
    return score, label


def scored_ctes(target_modes=("da",)) -> str:
    """CTEs ending in ``scored``: F2 over the fixture tables."""
    tm = ", ".join(f"'{m}'" for m in target_modes)
    score, label = signal("length(b.ct)", f"(coalesce(sc_ct, 0.0) - coalesce(sc_co, 0.0))")
    return f"""{profile_ctes((T, O))},
sbase as (select c.pid, c.model, c.mode, c.sample_idx, coalesce(c.text, '') as text,
   case when c.mode = 'en' then {gold_num('i.answer')} else {gold_num('i.da_answer')} end as gold
   from completions c join items i on i.pid = c.pid),
sclean as (select *, {clean_eval(drop_final('text'))} as ct from sbase),
stx as (select distinct ct as k, ct as t from sclean where mode in ({tm}) and length(ct) >= 15),
{score_ctes('stx', (T, O), 'sconf')},
sconf2 as (select sc.k, {CT} as sc_ct, {CO} as sc_co from sconf sc),
sparsed as (select b.pid, b.model, b.mode, b.sample_idx, b.gold, {boxed_flag('b.text')} as boxed,
   {boxed_num('b.text')} as pred,
   case when b.mode in ({tm}) then {label} end as lang_label,
   case when b.mode in ({tm}) then {score} end as lang_score
   from sclean b left join sconf2 on sconf2.k = b.ct),
scored as (select *, (pred is not null and gold is not null and abs(pred - gold) < 1e-3) as correct
   from sparsed)"""


def q(body: str, *views: str, ctes: str = "") -> str:
    sql = with_views("", *views).rstrip()
    if ctes:
        sql = (sql + ",\n" + ctes) if views else ("with " + ctes)
    return sql + "\n" + body


ORACLE["c2_gold_text"] = with_views(
    f"select pid, {gold_txt('answer')} as gold_text_en, {gold_txt('da_answer')} as gold_text_da from items",
    "items")

ORACLE["c5_boxed_answer"] = with_views(
    f"select pid, {boxed_ans('answer')} as boxed_answer_en, {boxed_ans('da_answer')} as boxed_answer_da "
    f"from items", "items")

ORACLE["c6_boxed_answer_en"] = with_views(
    f"""select pid,
      case when answer is null or len(string_split(answer, '####')) > 2 then null
           when len(string_split(answer, '####')) = 2 then
             {strip("string_split(answer, '####')[1]")} || chr(10) || chr(92) || 'boxed{{' ||
             {strip("string_split(answer, '####')[2]")} || '}}'
           else {strip('answer')} || chr(10) || chr(92) || 'boxed{{}}' end as response,
      (answer is null or len(string_split(answer, '####')) > 2) as rejected
    from items""", "items")

ORACLE["c7_clean_eval"] = with_views(
    f"select pid, model, mode, sample_idx, {clean_eval('text')} as cleaned from completions",
    "completions")

ORACLE["c8_clean_reward"] = with_views(
    f"select pid, model, mode, sample_idx, {clean_reward('text')} as cleaned from completions",
    "completions")

ORACLE["c9_drop_final_boxed"] = with_views(
    f"select pid, model, mode, sample_idx, {drop_final('text')} as content from completions",
    "completions")

ORACLE["c10_vote_key"] = with_views(
    f"select pid, model, mode, sample_idx, round({boxed_num('text')}, 6) as vote_key from completions",
    "completions")

ORACLE["e1_fit_profile"] = q("select lang, gram, round(logp, 6) as logp from pf",
                             ctes=profile_ctes((T, O)))

_E2CT, _E2CO = conf2("sc", T, O)
ORACLE["e2_language_confidence"] = q(
    f"select sc.k as doc_id, round({_E2CT}, 6) as conf_target, round({_E2CO}, 6) as conf_other "
    f"from dconf sc",
    ctes=f"""{profile_ctes((T, O))},
dsrc as (select doc_id as k, {clean_eval('text')} as t from documents),
{score_ctes('dsrc', (T, O), 'dconf')}""")

_DL = ("de", "en", "es", "fr")
_best = "greatest(" + ", ".join(f"s.s_{x}" for x in _DL) + ")"


def _detected(langs, best):
    """The only language with the best score; null when none is known (all 0) or two tie."""
    ties = " + ".join(f"(s.s_{x} = {best})::int" for x in langs)
    name = "coalesce(" + ", ".join(f"case when s.s_{x} = {best} then '{x}' end" for x in langs) + ")"
    return f"(case when {best} < 0 and {ties} = 1 then {name} end)"


_det = _detected(_DL, _best)
ORACLE["e3_detect_language"] = q(
    f"""select s.k as doc_id, {_det} as detected,
        (regexp_replace(coalesce(d.text, ''), '\\s', '', 'g') <> '' and coalesce({_det} = '{T}', false)) as is_target
        from det s join documents d on d.doc_id = s.k""",
    ctes=f"""{profile_ctes(_DL)},
dsrc as (select doc_id as k, {clean_eval('text')} as t from documents),
{score_ctes('dsrc', _DL, 'det')}""")

_e4score, _e4label = signal("length(e.ct)", f"coalesce(sc_ct - sc_co, 0.0)")
ORACLE["e4_language_signal"] = q(
    f"""select e.pid, e.model, e.mode, e.sample_idx, length(e.ct) as cleaned_len,
        {_e4label} as lang_label, round({_e4score}, 6) as lang_score
        from ec e left join econf2 on econf2.k = e.ct""",
    "completions",
    ctes=f"""{profile_ctes((T, O))},
ec as (select pid, model, mode, sample_idx, {clean_eval(drop_final('text'))} as ct from completions),
etx as (select distinct ct as k, ct as t from ec where length(ct) >= 15),
{score_ctes('etx', (T, O), 'econf')},
econf2 as (select sc.k, {CT} as sc_ct, {CO} as sc_co from econf sc)""")


def reward_ctes(src_rows: str) -> str:
    """CTEs ending in ``rconf2(k, sc_ct, sc_co)`` and ``rc`` rows with ``rt``."""
    return f"""rc as (select *, {clean_reward(drop_final('text'))} as rt from {src_rows}),
rtx as (select distinct rt as k, rt as t from rc where length(rt) >= 15),
{score_ctes('rtx', (T, O), 'rconf')},
rconf2 as (select sc.k, {CT} as sc_ct, {CO} as sc_co from rconf sc)"""


_lr = "(case when length(r.rt) < 15 then 0.0 else 1.0 * (r2.sc_ct - r2.sc_co) end)"
ORACLE["e5_language_reward"] = q(
    f"""select r.pid, r.model, r.mode, r.sample_idx, round({_lr}, 6) as language_reward
        from rc r left join rconf2 r2 on r2.k = r.rt""",
    "completions", ctes=f"{profile_ctes((T, O))},\n{reward_ctes('completions')}")

ORACLE["f2_score_completions"] = q(
    "select pid, model, mode, sample_idx, gold, boxed, pred, correct, lang_label, "
    "round(lang_score, 6) as lang_score from scored",
    "items", "completions", ctes=scored_ctes())

_RL = f"""rl as (select c.*, chr(92) || 'boxed{{' ||
   {gold_txt("case when c.mode = 'en' then i.answer else i.da_answer end")} || '}}' as solution
   from completions c join items i on i.pid = c.pid where c.mode in ('en', 'da'))"""
_acc = (f"(case when {boxed_num('text')} is not null and {boxed_num('solution')} is not null and "
        f"abs({boxed_num('text')} - {boxed_num('solution')}) < 1e-3 then 1.0::double else 0.0::double end)")
ORACLE["f3_accuracy_reward"] = q(
    f"select pid, model, mode, sample_idx, {_acc} as accuracy_reward from rl",
    "items", "completions", ctes=_RL)

ORACLE["f4_total_reward"] = q(
    f"""select r.pid, r.model, r.mode, r.sample_idx, r.acc as accuracy_reward,
        round({_lr}, 6) as language_reward, round(1.0 * r.acc + 0.2 * {_lr}, 6) as total_reward
        from rc r left join rconf2 r2 on r2.k = r.rt""",
    "items", "completions",
    ctes=f"{_RL},\nrla as (select *, {_acc} as acc from rl),\n{profile_ctes((T, O))},\n{reward_ctes('rla')}")

_EM = """select model, mode,
  sum(case when correct then 1.0::double else 0.0::double end) / (select count(*) from items) as accuracy,
  sum(case when boxed then 1.0::double else 0.0::double end) / (select count(*) from items) as boxed_rate,
  case when mode in ('da', 'da_en') then sum(case when lang_label = 'target' then 1.0::double else 0.0::double end) / (select count(*) from items) end as target_rate,
  case when mode in ('da', 'da_en') then sum(case when lang_label = 'other' then 1.0::double else 0.0::double end) / (select count(*) from items) end as other_rate,
  case when mode in ('da', 'da_en') then sum(case when lang_label = 'mixed' then 1.0::double else 0.0::double end) / (select count(*) from items) end as mixed_rate,
  case when mode in ('da', 'da_en') then sum(case when lang_label = 'unclear' then 1.0::double else 0.0::double end) / (select count(*) from items) end as unclear_rate,
  case when mode in ('da', 'da_en') then sum(case when correct and boxed and lang_label = 'target' then 1.0::double else 0.0::double end) / (select count(*) from items) end as strict_accuracy,
  case when mode in ('da', 'da_en') then sum(case when correct and lang_label <> 'target' then 1.0::double else 0.0::double end) / (select count(*) from items) end as correct_but_not_target_rate,
  case when mode in ('da', 'da_en') then sum(coalesce(lang_score, 0.0::double)) / (select count(*) from items) end as avg_target_minus_other
 from scored where sample_idx = 0 group by model, mode"""

ORACLE["g2_language_rates"] = q(
    "select model, mode, round(target_rate, 6) as target_rate, round(other_rate, 6) as other_rate, "
    "round(mixed_rate, 6) as mixed_rate, round(unclear_rate, 6) as unclear_rate from em",
    "items", "completions", ctes=scored_ctes(("da", "da_en")) + f",\nem as ({_EM})")

ORACLE["g3_strict_accuracy"] = q(
    "select model, mode, round(strict_accuracy, 6) as strict_accuracy, "
    "round(correct_but_not_target_rate, 6) as correct_but_not_target_rate from em",
    "items", "completions", ctes=scored_ctes(("da", "da_en")) + f",\nem as ({_EM})")

ORACLE["g4_mean_contrast"] = q(
    "select model, mode, round(avg_target_minus_other, 6) as avg_target_minus_other from em",
    "items", "completions", ctes=scored_ctes(("da", "da_en")) + f",\nem as ({_EM})")

_st = strip("coalesce(text, '')")
_words = f"(case when {_st} = '' then 0 else len(regexp_split_to_array({_st}, '\\s+')) end)"
ORACLE["g5_length_summary"] = with_views(
    f"""select model, mode, round(avg(w), 6) as avg_words, cast(max(w) as bigint) as max_words,
        round(quantile_cont(w, 0.5), 6) as p50_words
        from (select model, mode, {_words} as w from completions) group by model, mode""",
    "completions")

_SC10 = scored_ctes() + """,
sc10 as (select * from scored where sample_idx < 10),
grid as (select m.model, m.mode, n.n from (select distinct model, mode from sc10) m,
   (select unnest(range(1, 11)) as n) n),
tot as (select count(*) as total from items)"""

_FH = """fh as (select pid, model, mode,
   min(case when correct then sample_idx end) as f_acc,
   min(case when boxed then sample_idx end) as f_box,
   min(case when correct and boxed and lang_label = 'target' then sample_idx end) as f_strict,
   min(case when correct and lang_label <> 'target' then sample_idx end) as f_cnt,
   min(case when correct and lang_label = 'target' then sample_idx end) as f_ct,
   min(case when correct and lang_label = 'other' then sample_idx end) as f_co
  from sc10 group by pid, model, mode),
bon as (select g.model, g.mode, g.n,
   sum(case when fh.f_acc < g.n then 1 else 0 end) / max(t.total) as oracle_accuracy,
   sum(case when fh.f_box < g.n then 1 else 0 end) / max(t.total) as oracle_boxed_rate,
   case when g.mode = 'da' then sum(case when fh.f_strict < g.n then 1 else 0 end) / max(t.total) end as oracle_strict_accuracy,
   case when g.mode = 'da' then sum(case when fh.f_cnt < g.n then 1 else 0 end) / max(t.total) end as oracle_correct_but_not_target_rate,
   case when g.mode = 'da' then sum(case when fh.f_acc < g.n then 1 else 0 end) / max(t.total) end as oracle_any_correct_rate,
   case when g.mode = 'da' then sum(case when fh.f_ct < g.n then 1 else 0 end) / max(t.total) end as oracle_any_correct_target_rate,
   case when g.mode = 'da' then sum(case when fh.f_co < g.n then 1 else 0 end) / max(t.total) end as oracle_any_correct_other_rate
  from grid g cross join tot t left join fh on fh.model = g.model and fh.mode = g.mode
  group by g.model, g.mode, g.n)"""

ORACLE["g6_best_of_n"] = q(
    "select model, mode, n, round(oracle_accuracy, 6) as oracle_accuracy, "
    "round(oracle_boxed_rate, 6) as oracle_boxed_rate from bon",
    "items", "completions", ctes=_SC10 + ",\n" + _FH)

ORACLE["g7_best_of_n_target"] = q(
    "select model, mode, n, round(oracle_strict_accuracy, 6) as oracle_strict_accuracy, "
    "round(oracle_correct_but_not_target_rate, 6) as oracle_correct_but_not_target_rate, "
    "round(oracle_any_correct_rate, 6) as oracle_any_correct_rate, "
    "round(oracle_any_correct_target_rate, 6) as oracle_any_correct_target_rate, "
    "round(oracle_any_correct_other_rate, 6) as oracle_any_correct_other_rate from bon",
    "items", "completions", ctes=_SC10 + ",\n" + _FH)

_WIN = """vv as (select pid, model, mode, sample_idx, round(pred, 6) as vkey, pred, correct, boxed, lang_label,
   lang_score, unnest(range(sample_idx + 1, 11)) as n from sc10 where pred is not null),
gr as (select pid, model, mode, n, vkey, count(*) as votes, avg(sample_idx) as avg_idx,
   min(sample_idx) as first_idx, arg_min(pred, sample_idx) as pred, arg_min(correct, sample_idx) as correct, arg_min(boxed, sample_idx) as boxed,
   arg_min(lang_label, sample_idx) as lang_label, arg_min(lang_score, sample_idx) as lang_score
   from vv group by pid, model, mode, n, vkey),
win as (select * from (select *, row_number() over (partition by pid, model, mode, n
   order by votes desc, avg_idx, first_idx) as rn from gr) where rn = 1),
maj as (select g.model, g.mode, g.n,
   sum(case when w.correct then 1 else 0 end) / max(t.total) as accuracy,
   sum(case when w.boxed then 1 else 0 end) / max(t.total) as boxed_rate,
   count(w.pid) / max(t.total) as parsed_rate,
   case when g.mode = 'da' then sum(case when w.correct and w.boxed and w.lang_label = 'target' then 1 else 0 end) / max(t.total) end as strict_accuracy,
   case when g.mode = 'da' then sum(case when w.correct and w.lang_label <> 'target' then 1 else 0 end) / max(t.total) end as correct_but_not_target_rate,
   case when g.mode = 'da' then sum(case when w.lang_label = 'target' then 1 else 0 end) / max(t.total) end as selected_target_rate,
   case when g.mode = 'da' then sum(case when w.lang_label = 'other' then 1 else 0 end) / max(t.total) end as selected_other_rate,
   case when g.mode = 'da' then sum(case when w.lang_label = 'mixed' then 1 else 0 end) / max(t.total) end as selected_mixed_rate,
   case when g.mode = 'da' then sum(case when w.lang_label = 'unclear' then 1 else 0 end) / max(t.total) end as selected_unclear_rate,
   case when g.mode = 'da' then coalesce(sum(w.lang_score) / nullif(count(w.pid), 0), 0.0) end as selected_avg_target_minus_other
  from grid g cross join tot t left join win w on w.model = g.model and w.mode = g.mode and w.n = g.n
  group by g.model, g.mode, g.n)"""

ORACLE["g8_majority_winner"] = q(
    "select pid, model, mode, n, pred, votes, first_idx as winner_idx, correct, boxed, "
    "lang_label, round(lang_score, 6) as lang_score from win",
    "items", "completions", ctes=_SC10 + ",\n" + _WIN)

ORACLE["g9_majority_metrics"] = q(
    "select model, mode, n, " + ", ".join(f"round({k}, 6) as {k}" for k in [
        "accuracy", "boxed_rate", "parsed_rate", "strict_accuracy", "correct_but_not_target_rate",
        "selected_target_rate", "selected_other_rate", "selected_mixed_rate",
        "selected_unclear_rate"]) + " from maj",
    "items", "completions", ctes=_SC10 + ",\n" + _WIN)

ORACLE["g10_majority_contrast"] = q(
    "select model, mode, n, round(selected_avg_target_minus_other, 6) as selected_avg_target_minus_other "
    "from maj", "items", "completions", ctes=_SC10 + ",\n" + _WIN)

_MIX = """mgrid as (select m.model, m.mode, n.n from (select distinct model, mode from sc10 where mode = 'da') m,
   (select unnest(range(1, 11)) as n) n),
mix as (select g.model, g.mode, g.n,
   sum(case when s.lang_label = 'target' then 1 else 0 end) / (max(t.total) * g.n) as sample_target_rate,
   sum(case when s.lang_label = 'other' then 1 else 0 end) / (max(t.total) * g.n) as sample_other_rate,
   sum(case when s.lang_label = 'mixed' then 1 else 0 end) / (max(t.total) * g.n) as sample_mixed_rate,
   sum(case when s.lang_label = 'unclear' then 1 else 0 end) / (max(t.total) * g.n) as sample_unclear_rate,
   coalesce(sum(s.lang_score), 0) / (max(t.total) * g.n) as sample_avg_target_minus_other
  from mgrid g cross join tot t left join sc10 s on s.model = g.model and s.mode = g.mode and s.sample_idx < g.n
  group by g.model, g.mode, g.n)"""

ORACLE["g11_sample_language_mix"] = q(
    "select model, mode, n, " + ", ".join(f"round({k}, 6) as {k}" for k in [
        "sample_target_rate", "sample_other_rate", "sample_mixed_rate", "sample_unclear_rate",
        "sample_avg_target_minus_other"]) + " from mix",
    "items", "completions", ctes=_SC10 + ",\n" + _MIX)

_EVAL_COLS = ([f"da_{k}" for k in ["accuracy", "boxed_rate", "target_rate", "other_rate", "mixed_rate",
                                    "unclear_rate", "strict_accuracy", "correct_but_not_target_rate",
                                    "avg_target_minus_other"]] + ["en_accuracy", "en_boxed_rate"])
ORACLE["g12_pivot_metrics"] = q(
    "select model, " + ", ".join(
        f"round(max(case when mode = '{c[:2]}' then {c[3:]} end), 6) as {c}" for c in _EVAL_COLS)
    + " from em group by model",
    "items", "completions", ctes=scored_ctes(("da", "da_en")) + f",\nem as ({_EM})")

_SERIES = [
    ("target_best_vs_majority", "Oracle best-of-n", "bon", "oracle_accuracy"),
    ("target_best_vs_majority", "Majority@n", "maj", "accuracy"),
    ("target_best_vs_majority", "Strict Danish majority@n", "maj", "strict_accuracy"),
    ("target_best_detail", "Strict Danish accuracy", "bon", "oracle_strict_accuracy"),
    ("target_best_detail", "Any correct Danish", "bon", "oracle_any_correct_target_rate"),
    ("target_best_detail", "Any correct English", "bon", "oracle_any_correct_other_rate"),
    ("target_best_language_mix", "Sample Danish rate", "mix", "sample_target_rate"),
    ("target_best_language_mix", "Sample English rate", "mix", "sample_other_rate"),
    ("target_best_language_mix", "Sample unclear rate", "mix", "sample_unclear_rate"),
    ("target_majority_language", "Selected Danish rate", "maj", "selected_target_rate"),
    ("target_majority_language", "Selected English rate", "maj", "selected_other_rate"),
    ("target_majority_language", "Selected unclear rate", "maj", "selected_unclear_rate"),
]
_safe = "regexp_replace(regexp_replace(model, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_parts = [
    "select model, 'best_of_accuracy' as figure, case mode when 'en' then 'English' when 'da' then 'Danish' "
    "else mode end as series, n, 100.0 * oracle_accuracy as percent from bon where mode in ('en', 'da')",
    "select model, 'majority_accuracy' as figure, case mode when 'en' then 'English' when 'da' then 'Danish' "
    "else mode end as series, n, 100.0 * accuracy as percent from maj where mode in ('en', 'da')",
] + [f"select model, '{f}' as figure, '{s}' as series, n, 100.0 * {m} as percent from {t} where mode = 'da'"
     for f, s, t, m in _SERIES]
ORACLE["g13_scaling_series"] = q(
    f"select model, {_safe} as safe_model, figure, series, n, round(percent, 6) as percent from ("
    + " union all ".join(_parts) + ")",
    "items", "completions", ctes=_SC10 + ",\n" + _FH + ",\n" + _WIN + ",\n" + _MIX)


# ---- D: datasets (prompt texts are fixed data shared with the operators;
# the substitution below is SQL's own replace) ----------------------------------
from glossa.operators import prompts as _P  # noqa: E402


def lit(s):
    return "NULL::varchar" if s is None else "'" + s.replace("'", "''") + "'"


def fill_sql(tmpl_sql: str, q: str) -> str:
    return (f"replace(replace(replace(replace(replace({tmpl_sql}, '{{question}}', coalesce({q}, '')), "
            f"'{{da_question}}', coalesce(i.da_question, '')), '{{en_question}}', coalesce(i.question, '')), "
            f"'{{answer}}', coalesce(i.answer, '')), '{{da_answer}}', coalesce(i.da_answer, ''))")


_TV = ", ".join(f"({lit(f)}, {lit(m)}, {str(r).lower()}, {lit(s)}, {lit(u)})"
                for (f, m, r), (s, u) in _P.TEMPLATES.items())
_QMODE = "case when t.mode = 'en' then i.question else i.da_question end"
ORACLE["d1_render_prompts"] = q(
    f"select i.pid, t.family, t.mode, t.reasoning, t.system, {fill_sql('t.tmpl', _QMODE)} as user "
    f"from items i, tpl t", "items",
    ctes=f"tpl(family, mode, reasoning, system, tmpl) as (values {_TV})")

_EV = [(m,) + _P.TEMPLATES[("eval", m, True)] for m in ("en", "da", "da_en")]
ORACLE["d2_to_messages"] = q(
    " union all ".join(
        f"select i.pid, '{m}' as mode, 0::bigint as msg_idx, 'system' as role, {lit(s)} as content from items i "
        f"union all select i.pid, '{m}', 1::bigint, 'user', "
        f"{fill_sql(lit(u), 'i.question' if m == 'en' else 'i.da_question')} from items i"
        for m, s, u in _EV), "items")

ORACLE["d3_render_chats"] = """select conv_id,
  string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn) as chat_train,
  string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn)
    || '<|im_start|>assistant' || chr(10) as chat_prompt
 from conversations group by conv_id"""

ORACLE["d4_expand_paired"] = with_views(
    f"""select pid, md5(cast(pid as varchar) || ':42') as order_key, 0::bigint as pos, 'da' as lang,
          da_question as q, {boxed_ans('da_answer')} as a from items
        union all
        select pid, md5(cast(pid as varchar) || ':42'), 1::bigint, 'en', question, {boxed_ans('answer')} from items""",
    "items")


def _nb(x):
    return f"({x} is not null and {strip(x)} <> '')"


ORACLE["d5_expand_unpaired"] = with_views(
    f"""select pid, lang, q, a, lang_order_key, md5(cast(pid as varchar) || ':' || lang || ':165') as order_key from (
        select pid, 'da' as lang, {strip('da_question')} as q, {boxed_ans(strip('da_answer'))} as a,
          md5(cast(pid as varchar) || ':1041') as lang_order_key
        from items where {_nb('da_question')} and {_nb('da_answer')}
        union all
        select pid, 'en', {strip('question')}, {boxed_ans(strip('answer'))}, md5(cast(pid as varchar) || ':42')
        from items where {_nb('question')} and {_nb('answer')})""", "items")

ORACLE["d6_expand_single"] = with_views(
    f"select pid, md5(cast(pid as varchar) || ':42') as order_key, da_question as q, "
    f"{boxed_ans('da_answer')} as a from items", "items")

ORACLE["d7_rl_set"] = with_views(
    " union all ".join(
        f"select i.pid, '{m}' as mode, {fill_sql(lit(_P.TEMPLATES[('rl', m, True)][1]), 'i.da_question')} as prompt, "
        f"chr(92) || 'boxed{{' || {gold_txt('i.da_answer')} || '}}' as solution from items i"
        for m in ("da", "da_en")), "items")

_C6 = (f"case when len(string_split(i.answer, '####')) = 2 then "
       f"{strip(chr(39).join(['string_split(i.answer, ', '####', ')[1]']))} || chr(10) || chr(92) || 'boxed{{' || "
       f"{strip(chr(39).join(['string_split(i.answer, ', '####', ')[2]']))} || '}}' "
       f"else {strip('i.answer')} || chr(10) || chr(92) || 'boxed{{}}' end")
ORACLE["d8_messages_en"] = with_views(
    f"""select * from (
        select i.pid, 0::bigint as msg_idx, 'user' as role, {fill_sql(lit(_P.EN_ONLY), 'i.question')} as content
        from items i where i.answer is not null and len(string_split(i.answer, '####')) <= 2
        union all
        select i.pid, 1::bigint, 'assistant', {_C6}
        from items i where i.answer is not null and len(string_split(i.answer, '####')) <= 2)""", "items")

ORACLE["d9_review_requests"] = with_views(
    f"select i.pid, {lit(_P.REVIEW_SYSTEM)} as system, {fill_sql(lit(_P.REVIEW_USER), 'i.question')} as user "
    f"from items i", "items")

ORACLE["d10_translation_requests"] = with_views(
    f"select i.pid as id, {fill_sql(lit(_P.TRANSLATE_USER), 'i.question')} as prompt from items i", "items")

_D11 = " union all ".join(
    f"select i.pid, '{m}' as mode, {lit(s)} as system, "
    f"{fill_sql(lit(u), 'i.question' if m == 'en' else 'i.da_question')} as user, "
    f"{gold_num('i.answer' if m == 'en' else 'i.da_answer')} as gold from items i"
    for m, s, u in _EV)
ORACLE["d11_prepare_modes"] = with_views(_D11, "items")

# ---- B: splits ----------------------------------------------------------------
ORACLE["b1_split_by_position"] = with_views(
    """select pid, position, case when position < 7473 then 'train' else 'test' end as part
       from (select pid, row_number() over (order by pid) - 1 as position from items)""", "items")
ORACLE["b1_split_inside"] = ORACLE["b1_split_by_position"].replace("7473", "150")
ORACLE["b2_head_subset"] = with_views(
    "select pid from (select pid from items order by pid limit 7473) order by pid limit 2000", "items")
ORACLE["b3_sample_k"] = with_views(
    "select pid, md5(cast(pid as varchar) || ':42') as order_key from items "
    "order by md5(cast(pid as varchar) || ':42'), pid limit 1000", "items")
ORACLE["b4_seeded_order"] = with_views(
    "select pid, md5(cast(pid as varchar) || ':42') as order_key from items", "items")

# ---- H: replies -----------------------------------------------------------------
_QL, _AL = "'Danish Question:'", "'Danish Answer:'"
_T = strip("coalesce(content, '')")
_H1 = f"""h1t as (select id, attempt, error, content, {_T} as t from translation_attempts),
h1s as (select *, split_part(t, {_QL}, 2) as seg,
   case when t = '' then []::varchar[] else string_split_regex(t, '\\r\\n|\\r|\\n') end as lines from h1t),
h1 as (select id, attempt, error, content,
   case when strpos(t, {_QL}) > 0 and strpos(t, {_AL}) > 0 then
          case when strpos(seg, {_AL}) > 0 then {strip(f"split_part(seg, {_AL}, 1)")} else '' end
        when strpos(t, {_AL}) > 0 then {strip(f"split_part(t, {_AL}, 1)")}
        else {strip("array_to_string(lines[1:len(lines) // 2], chr(10))")} end as da_q,
   case when strpos(t, {_QL}) > 0 and strpos(t, {_AL}) > 0 then
          case when strpos(seg, {_AL}) > 0 then {strip(f"substr(seg, strpos(seg, {_AL}) + 14)")} else '' end
        when strpos(t, {_AL}) > 0 then {strip(f"split_part(t, {_AL}, 2)")}
        else {strip("array_to_string(lines[len(lines) // 2 + 1:len(lines)], chr(10))")} end as da_a
   from h1s)"""

ORACLE["h1_parse_sections"] = q("select id, attempt, da_q, da_a from h1", "translation_attempts", ctes=_H1)

_DLS = ("de", "en", "es", "fr")
_dbest = "greatest(" + ", ".join(f"s.s_{x}" for x in _DLS) + ")"
_ddet = _detected(_DLS, _dbest)
_H2 = _H1 + f""",
{profile_ctes(_DLS)},
h2p as (select id, attempt, 'q' as part, da_q as raw from h1 where error is null
        union all select id, attempt, 'a', da_a from h1 where error is null),
h2c as (select *, {clean_eval('raw')} as ct from h2p),
h2u as (select distinct ct as k, ct as t from h2c),
{score_ctes('h2u', _DLS, 'h2s')},
h2d as (select s.k, {_ddet} as detected from h2s s),
h2v as (select c.id, c.attempt, min(case when regexp_replace(coalesce(c.raw, ''), '\\s', '', 'g') <> ''
          and d.detected = 'de' then 1 else 0 end) as ok
        from h2c c join h2d d on d.k = c.ct group by c.id, c.attempt),
h2 as (select h.id, h.attempt, h.content, (h.da_q <> '' and h.da_a <> '' and coalesce(v.ok, 0) = 1) as accepted,
          h.da_q, h.da_a
        from h1 h join h2v v on v.id = h.id and v.attempt = h.attempt where h.error is null)"""

ORACLE["h2_accept_translations"] = q("select id, attempt, accepted from h2",
                                     "translation_attempts", ctes=_H2)

_H3 = _H2 + """,
h3f as (select * from (select id, da_q, da_a, row_number() over (partition by id order by attempt) as rn
        from h2 where accepted and attempt < 3 and content is not null) where rn = 1),
h3 as (select i.pid as id, i.question, i.answer, coalesce(f.da_q, '') as da_question,
        coalesce(f.da_a, '') as da_answer from items i left join h3f f on f.id = i.pid)"""

ORACLE["h3_first_accepted"] = q("select * from h3", "items", "translation_attempts", ctes=_H3)
ORACLE["h4_pending_items"] = q("select i.pid as id from items i where i.pid not in "
                               "(select id from h3 where da_question <> '')",
                               "items", "translation_attempts", ctes=_H3)

ORACLE["h3_translation_log"] = ORACLE["h3_first_accepted"]
ORACLE["h4_pending_after_a_run"] = q("select pid as id from items where pid % 3 <> 0", "items")

_S0 = strip("coalesce(content, '')")
_FL = ["en_ok", "da_ok", "math_ok_en", "math_ok_da", "crosslang_ok"]


def _jflag(k):
    return f"(case when t_{k} <> 'NULL' then v_{k} end)"


def _jstr(k, default):
    # json_extract_string of the value itself: a string's content, other values as they are
    return f"case when t_{k} is null then '{default}' when t_{k} = 'NULL' then null else json_extract_string(v_{k}, '$') end"


_KEYS = _FL + ["name_mismatch", "issues", "severity", "comment", "verdict"]
# the last of repeated keys: json_each lists them in their order
_FIELDS = ("fields as (select r.id, r.attempt, " + ", ".join(
    f"arg_max(e.value::varchar, e.id) filter (where e.key = '{k}') as v_{k}, arg_max(e.type, e.id) filter (where e.key = '{k}') as t_{k}" for k in _KEYS)
    + " from r4 r, json_each(r.js) e group by r.id, r.attempt)")


_H5 = f"""r0 as (select id, attempt, content, error, {_S0} as s0 from review_attempts),
r1 as (select *, case when starts_with(s0, '```') then
          regexp_replace(regexp_replace(s0, '^```[a-zA-Z0-9]*\\s*', ''), '\\s*```$', '') else s0 end as s1 from r0),
r2 as (select *, case when regexp_matches(s1, '(?s)\\{{.*\\}}') then regexp_extract(s1, '(?s)(\\{{.*\\}})', 1)
          else s1 end as s2 from r1),
r3 as (select *, (error is null and content is not null and coalesce(case when json_valid(s2) then json_type(s2) = 'OBJECT' end, false)) as parsed
       from r2),
r4 as (select *, case when parsed then s2 else '{{}}' end as js from r3),
{_FIELDS},
r5 as (select r4.*, fields.* exclude (id, attempt) from r4 left join fields using (id, attempt)),
h5 as (select id, attempt, parsed,
  {", ".join(f"case when parsed then {_jflag(k)} end as {k}" for k in _FL)},
  case when parsed then (case when t_name_mismatch is null then 'false' else {_jflag('name_mismatch')} end) end as name_mismatch,
  case when parsed then (case when t_issues is null then '[]' when t_issues = 'NULL' then 'null' else v_issues end) end as issues,
  case when parsed then {_jstr('severity', '')} end as severity,
  case when parsed then {_jstr('comment', '')} end as comment,
  case when parsed then {_jstr('verdict', 'ISSUE')} end as verdict,
  coalesce(error, {_S0}) as last_msg
 from r5)"""

ORACLE["h5_parse_reviews"] = q(
    "select id, attempt, parsed, " + ", ".join(_FL) + ", name_mismatch, issues, severity, comment, verdict from h5",
    "review_attempts", ctes=_H5)

_H6 = _H5 + f""",
h5w as (select * from h5 where attempt < 3),
h6ok as (select * from (select *, row_number() over (partition by id order by attempt) as rn
         from h5w where parsed) where rn = 1),
h6last as (select * from (select id, last_msg, row_number() over (partition by id order by attempt desc) as rn
           from h5w) where rn = 1),
h6 as (select i.pid as id, {", ".join(f"o.{k}" for k in _FL)}, o.name_mismatch, o.severity,
   case when o.id is not null then o.issues else '[]' end as issues,
   case when o.id is not null then o.comment else 'Model error: ' || coalesce(left(l.last_msg, 150), '') end as comment,
   case when o.id is not null then o.verdict else 'ISSUE' end as verdict
  from items i left join h6last l on l.id = i.pid left join h6ok o on o.id = i.pid)"""

ORACLE["h6_first_parseable"] = q("select * from h6", "items", "review_attempts", ctes=_H6)
ORACLE["h7_is_issue"] = q("select id, verdict, upper(coalesce(verdict, '')) <> 'OK' as is_issue from h6",
                          "items", "review_attempts", ctes=_H6)
ORACLE["h8_issue_report"] = q(
    "select i.pid, i.question, i.answer, i.da_question, i.da_answer, "
    + ", ".join(f"h.{k} as qa_{k}" for k in _FL + ["name_mismatch", "issues", "severity", "comment", "verdict"])
    + " from items i join h6 h on h.id = i.pid where upper(coalesce(h.verdict, '')) <> 'OK'",
    "items", "review_attempts", ctes=_H6)


# ---- A and S: round trips and incremental end states ------------------------------
ORACLE["a1_read_items_csv"] = with_views("select * from items", "items")
ORACLE["a2_read_source_tsv"] = with_views("select pid as id, question, answer from items", "items")
ORACLE["a3_write_issue_csv"] = ORACLE["h8_issue_report"]
ORACLE["a4_write_metrics"] = ORACLE["g12_pivot_metrics"]
ORACLE["s1_stream_score"] = ORACLE["f2_score_completions"]
ORACLE["s2_stream_metrics"] = q(
    """select model, mode, count(*) as rows, sum(case when correct then 1 else 0 end)::bigint as correct,
         sum(case when boxed then 1 else 0 end)::bigint as boxed,
         sum(case when lang_label = 'target' then 1 else 0 end)::bigint as target,
         sum(case when lang_label = 'other' then 1 else 0 end)::bigint as other,
         sum(case when lang_label = 'mixed' then 1 else 0 end)::bigint as mixed,
         sum(case when lang_label = 'unclear' then 1 else 0 end)::bigint as unclear,
         round(sum(coalesce(lang_score, 0.0)), 6) as score_sum
       from scored group by model, mode""",
    "items", "completions", ctes=scored_ctes())

# ---- S3: the results of G6, G7, G9-G11, and of G8, while completions arrive ----
_S3_MAJ = ["accuracy", "boxed_rate", "parsed_rate", "strict_accuracy", "correct_but_not_target_rate", "selected_target_rate", "selected_other_rate",
           "selected_mixed_rate", "selected_unclear_rate", "selected_avg_target_minus_other"]
_S3_BEST = ["oracle_accuracy", "oracle_boxed_rate", "oracle_strict_accuracy", "oracle_correct_but_not_target_rate", "oracle_any_correct_rate",
            "oracle_any_correct_target_rate", "oracle_any_correct_other_rate"]
_S3_MIX = ["sample_target_rate", "sample_other_rate", "sample_mixed_rate", "sample_unclear_rate", "sample_avg_target_minus_other"]
ORACLE["s3_running_scaling"] = q(
    "select model, mode, n, " + ", ".join(f"round({k}, 6) as {k}" for k in _S3_BEST + _S3_MAJ + _S3_MIX)
    + " from bon join maj using (model, mode, n) left join mix using (model, mode, n)",
    "items", "completions", ctes=_SC10 + ",\n" + _FH + ",\n" + _WIN + ",\n" + _MIX)
ORACLE["s4_running_winners"] = ORACLE["g8_majority_winner"]
