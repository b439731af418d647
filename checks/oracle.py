"""Independent SQL for every registered query that SQL can express.

Each entry is assembled from named common table expressions; only the ones a
query needs are emitted, in order of definition.
"""

from __future__ import annotations

from checks.parameters import LEXICON, OTHER_WEIGHTS, ROLE_HEAD, SETTINGS

D = len(LEXICON.domains)
NAMES = LEXICON.names


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::varchar[]"


def dbl(x: float) -> str:
    return f"{x!r}::double"


def tidy(expr: str, digits: int = 6) -> str:
    f = f"1e{digits}"
    return f"(round_even(({expr}) * {f}, 0) / {f})"


def has_any(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {q(w)})" for w in words) + ")" if words else "false"


def has_word(col: str, word: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({col}, {q(f'(^|{edge}){word}({edge}|$)')})"


def terms_in(col: str) -> str:
    """List of the lexicon terms that occur between non-alphanumerics."""
    return "list_filter([" + ", ".join(
        f"case when regexp_matches({col}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') then {q(t)} end"
        for t in LEXICON.all_terms) + "], lambda x: x is not null)"


def exact(x: str, digits: int) -> str:
    """Correctly rounded units of 10^-digits of a non-negative double."""
    s = f"{float(10 ** digits)!r}::double"
    down, wide = f"floor(({x}) * {s})", f"(({x}) * 134217729.0::double)"
    high = f"({wide} - ({wide} - ({x})))"
    side = (f"(({high} * (2.0::double * {s}) - ({down} * 2.0::double + 1.0::double)) "
            f"+ (({x}) - {high}) * (2.0::double * {s}))")
    return (f"(cast({down} as bigint) + case when {side} > 0 or ({side} = 0 and {down} % 2 = 1) "
            "then 1 else 0 end)")


def one_decimal(x: str) -> str:
    u = exact(x, 1)
    return f"(cast({u} // 10 as varchar) || '.' || cast({u} % 10 as varchar))"


def rounded3(x: str) -> str:
    return (f"(case when {x} < 0 then -{exact(f'(-({x}))', 3)} else {exact(x, 3)} end"
            f" / 1000.0::double)")


PIECES: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def piece(name: str, sql: str, *needs: str) -> None:
    PIECES[name], NEEDS[name] = sql, needs


def query(final: str, *needs: str) -> str:
    wanted: set[str] = set()

    def visit(n: str) -> None:
        if n not in wanted:
            wanted.add(n)
            for m in NEEDS[n]:
                visit(m)
    for n in needs:
        visit(n)
    parts = [f"{n} as materialized (\n{sql}\n)" for n, sql in PIECES.items() if n in wanted]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + final


# --- parameters as tables ------------------------------------------------------
_rows = [(i, d.name, d.label, kind, j, p) for i, d in enumerate(LEXICON.domains)
         for kind, words in (("term", d.terms), ("title", d.titles)) for j, p in enumerate(words)]
piece("lex", "select * from (values " + ", ".join(
    f"({i}, {q(n)}, {q(lab)}, {q(k)}, {j}, {q(p)})" for i, n, lab, k, j, p in _rows)
    + ") t(di, domain, label, kind, pi, phrase)")
piece("dom", "select distinct di, domain, label from lex", "lex")

# --- tables as candidates ---------------------------------------------------------
piece("sig", """select user_id, avg(case when event_type = 'click' then 1.0 else 0.0 end) as click_rate,
 avg(case when event_type = 'purchase' then 1.0 else 0.0 end) as buy_rate,
 max(case when event_type = 'signup' and value > 100 then 1 else 0 end) = 1 as opened
 from events group by user_id""")
piece("people", """select c_custkey as row_id, printf('CAND_%07d', c_custkey) as candidate_id,
 p_name as title, lower(p_type) as industry, c_mktsegment as company,
 (c_custkey % 160)::double / 10.0::double as yoe, lower(n_name) as location, lower(r_name) as country,
 c_custkey % 3 = 0 as relocate, coalesce(opened, false) as open_to_work,
 c_custkey % 2 = 0 as email_ok, c_custkey % 4 = 0 as phone_ok,
 case when c_custkey % 11 > 0 then click_rate * 2.0::double end as response_rate,
 case when c_custkey % 13 > 0 then buy_rate end as interview_rate,
 case when c_custkey % 17 > 0 then (c_custkey % 121)::double end as notice_days,
 case when c_custkey % 7 > 0 then (c_custkey % 101)::double end as completeness,
 case when c_custkey % 5 > 0 then (c_custkey % 100)::double else -1.0::double end as github,
 c_custkey % (select max(user_id) + 1 from events) as user_id
 from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
 left join part on p_partkey = c_custkey
 left join sig on sig.user_id = c_custkey % (select max(user_id) + 1 from events)""", "sig")
piece("prose", "select doc_id as row_id, lower(text) as prose from documents")
piece("roles", """select o_custkey as row_id, o_orderkey as role_no, min(p_name) as title,
 'supplier ' || cast(min(l_suppkey) as varchar) as company, lower(min(p_type)) as industry,
 (1 + o_orderkey % 60)::double as months, min(o_orderstatus) = 'O' as is_current,
 year(min(o_orderdate)) as y0,
 case when min(o_orderstatus) <> 'O' then year(min(o_orderdate)) + o_orderkey % 4 end as y1,
 max(o_orderdate) as ordered
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
 group by o_custkey, o_orderkey""")
_kind = f"""case when {has_any('lower(company)', SETTINGS.consulting_companies)}
 or {has_any('lower(industry)', SETTINGS.consulting_industries)} then 'consulting'
 when {has_any('lower(industry)', SETTINGS.product_industries)} then 'product'
 when {has_any('lower(industry)', SETTINGS.nontech_industries)} then 'nontech' else 'other' end"""
piece("rolefacts", f"""select row_id, count(*) as n_roles,
 count(*) filter (where kind = 'consulting') as n_consulting,
 count(*) filter (where kind = 'product') as n_product,
 count(*) filter (where kind = 'nontech') as n_nontech,
 count(*) filter (where not is_current) as n_completed,
 coalesce(sum(months) filter (where not is_current), 0) as completed_months,
 sum(months) as total_months, strftime(max(ordered), '%Y-%m-%d') as last_active
 from (select *, {_kind} as kind from roles) group by row_id""", "roles")
piece("past", """select r.row_id, l.di, count(distinct r.role_no) as hits
 from roles r join (select * from lex where kind = 'title') l on contains(lower(r.title), l.phrase)
 where not r.is_current group by r.row_id, l.di""", "roles", "lex")
piece("offend", """select row_id,
 min_by({'t': title, 'm': months}, role_no) filter (where yoe > 0 and months > yoe * 12 + 12) as lng,
 min_by({'t': title, 'm': months, 's': (y1 - y0) * 12}, role_no)
   filter (where months > (y1 - y0) * 12 + 30) as dis
 from roles join (select row_id, yoe from people) using (row_id) group by row_id""",
      "roles", "people")
piece("skl", """select o_custkey as row_id, count(*) filter (where lower(p_name) in
   (select unnest(keywords) from spec)) as skill_hits,
 count(*) filter (where l_returnflag in ('A', 'N') and l_quantity::bigint % 5 = 0) as mastery_zero
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
 group by o_custkey""", "spec")
piece("assess", """select user_id, avg(score) filter (where rel) as rel_mean, avg(score) as all_mean
 from (select user_id, event_type in (select unnest(keywords) from spec) as rel,
   least(100.0, avg(value)) as score from events where event_type <> 'error'
   group by user_id, event_type) group by user_id""", "spec")

# --- role texts -----------------------------------------------------------------------
piece("jobs", r"""select p_partkey as jd_id, 'Role: ' || p_name || chr(10) ||
 case p_partkey % 5 when 0 then (p_size % 9) || '-' || (p_size % 9 + 4) || ' years'
  when 1 then 'minimum ' || p_size || ' years' when 2 then p_size || '+ years'
  when 3 then p_size || ' years' else 'any tenure' end || '. In ' ||
 case p_partkey % 3 when 0 then 'asia' when 1 then 'europe' else 'nowhere' end ||
 case when p_partkey % 4 = 0 then ' nation_1, nation_13' else '' end || '.' ||
 ' Skills for this: ' || p_brand || ' from that ' || lower(p_type) || ' hot ' ||
 split_part(p_name, ' ', 2) || chr(10) || 'We do NOT want: ' || lower(p_type) || ' work; ' ||
 case when p_partkey % 2 = 0 then 'or gizmo' else 'or gear' end || '.' as text from part""")
piece("jobrole", f"select -1 as jd_id, {q(ROLE_HEAD)} || (select text from benchmark "
                 "where item_id = 0) as text")
# both kinds of text go through the same parsing steps
piece("jd", "select jd_id::bigint as jd_id, text, lower(text) as t from jobs "
            "union all select jd_id::bigint, text, lower(text) from jobrole", "jobs", "jobrole")


def parsing(src: str, pre: str) -> None:
    """Parsing steps over ``src(jd_id, text, t)``; CTE names get ``pre``."""
    piece(pre + "title", f"""select jd_id, left(case when m <> '' then trim(m) else line end, 120) as title
 from (select jd_id, line, regexp_extract(line,
   '(?i)(?:job\\s*description|role|position|title)\\s*[:\\-]\\s*(.+)', 1) as m
  from (select jd_id, trim(split_part(ltrim(text, chr(10) || ' '), chr(10), 1)) as line
   from {src}))""", src)
    piece(pre + "band", f"""select jd_id, case when a <> '' then a::double when f <> '' then f::double
  when b <> '' then greatest(0.0, b::double - 2) else 0.0 end as exp_min,
 case when a <> '' then z::double when f <> '' then f::double + 6
  when b <> '' then b::double + 3 else 50.0 end as exp_max,
 case when a <> '' then (a::double + z::double) / 2 when f <> '' then f::double + 1
  when b <> '' then b::double else 0.0 end as exp_ideal
 from (select jd_id, regexp_extract(t, r1, 1) as a, regexp_extract(t, r1, 2) as z,
  case when regexp_extract(t, r2, 1) <> '' then regexp_extract(t, r2, 1)
   else regexp_extract(t, r3, 1) end as f, regexp_extract(t, '([0-9]{{1,2}})\\s*year', 1) as b
 from (select *, '([0-9]{{1,2}})\\s*(?:-|–|—|to)\\s*([0-9]{{1,2}})\\s*\\+?\\s*year' as r1,
  '(?:minimum|at least|min|over|more than)\\s*([0-9]{{1,2}})\\s*\\+?\\s*year' as r2,
  '([0-9]{{1,2}})\\s*\\+\\s*year' as r3 from {src}))""", src)

    def words(names) -> str:
        hits = [f"case when {has_word('t', n)} then {q(n)} end" for n in sorted(names)]
        return "list_filter([" + ", ".join(hits) + "], lambda x: x is not null)"
    piece(pre + "place", f"select jd_id, {words(SETTINGS.cities)} as cities, "
                         f"{words(SETTINGS.countries)} as countries from {src}", src)
    piece(pre + "clause", f"""select jd_id, pos, clause, max(case when
  {has_any('clause', SETTINGS.exclusion_markers)} then 1 else 0 end)
  over (partition by jd_id order by pos rows between 15 preceding and current row) = 1 as neg
 from (select jd_id, unnest(cl) as clause, generate_subscripts(cl, 1) as pos
  from (select jd_id, string_split_regex(t, '[.\\n;]') as cl from {src}))""", src)
    vocab = ", ".join(f"case when {has_word('clause', s)} then {{'vi': {i}, 'sp': {q(s)}}} end"
                      for i, s in enumerate(SETTINGS.specialties))
    piece(pre + "excl", f"""select jd_id, list(e.sp order by p, e.vi) as excluded from (
 select jd_id, e, min(pos) as p from (select jd_id, pos,
  unnest(list_filter([{vocab}], lambda x: x is not null)) as e from {pre}clause where neg)
 group by jd_id, e) group by jd_id""", pre + "clause")
    piece(pre + "raw", f"""select s.jd_id, d.di, d.domain, d.label,
 4.0::double * max(case when l.kind = 'title' and contains(lower(ti.title), l.phrase) then 1 else 0 end)
 + least(2.5::double, 0.4::double * count(case when l.kind = 'term' and list_contains(s.seen, l.phrase) then 1 end)) as raw
 from (select *, {terms_in('t')} as seen from {src}) s join {pre}title ti using (jd_id) cross join lex l join dom d on d.di = l.di
 group by all""", src, pre + "title", "lex", "dom")
    piece(pre + "vec", f"""select jd_id, di, domain, label,
 case when n <= 1e-9 then 0.0 else raw / n end as v,
 row_number() over (partition by jd_id order by case when n <= 1e-9 then 0.0 else raw / n end desc, di) as r
 from (select *, sqrt(sum(raw * raw) over (partition by jd_id)) as n from {pre}raw)""", pre + "raw")
    piece(pre + "target", f"""select jd_id, coalesce(list(domain order by r) filter (where r <= 3 and v >= 0.15),
  list(domain order by r) filter (where r = 1)) as target,
 coalesce(list(label order by r) filter (where r <= 3 and v >= 0.15),
  list(label order by r) filter (where r = 1)) as labels
 from {pre}vec group by jd_id""", pre + "vec")
    piece(pre + "kw", f"""select jd_id, list(phrase order by o) as kws from (
 select *, row_number() over (partition by jd_id order by o) as rn from (
 select s.jd_id, l.phrase, min(v.r * 1000 + case when l.kind = 'term' then 0 else 500 end + l.pi) as o
 from {src} s join {pre}vec v on v.jd_id = s.jd_id and v.r <= 3 and v.v >= 0.12
 join lex l on l.di = v.di and contains(s.t, l.phrase) and length(l.phrase) > 2
 group by s.jd_id, l.phrase)) where rn <= 40 group by jd_id""", src, pre + "vec", "lex")
    piece(pre + "spec", f"""select s.jd_id, s.text, title, exp_min, exp_max, exp_ideal, cities, countries,
 coalesce(excluded, []) as excluded, target, labels,
 list_filter(coalesce(kws, []), lambda k: not list_contains(coalesce(excluded, []), k)) as keywords
 from {src} s join {pre}title using (jd_id) join {pre}band using (jd_id)
 join {pre}place using (jd_id) join {pre}target using (jd_id)
 left join {pre}excl using (jd_id) left join {pre}kw using (jd_id)""",
          src, pre + "title", pre + "band", pre + "place", pre + "target", pre + "excl", pre + "kw")


piece("jdall", "select jd_id, text, lower(text) as t from jobs", "jobs")
piece("jdone", "select jd_id, text, lower(text) as t from jobrole", "jobrole")
parsing("jdall", "j_")
parsing("jdone", "o_")
piece("spec", "select * from o_spec", "o_spec")
del PIECES["jd"], NEEDS["jd"]
# people and children that look at the spec are defined above it: move them last
for _late in ("skl", "assess"):
    PIECES[_late] = PIECES.pop(_late)

# --- domain vectors of people -------------------------------------------------------------
piece("terms", f"""select row_id, l.di, l.phrase from (select row_id, unnest({terms_in('prose')}) as phrase
 from prose) p join (select * from lex where kind = 'term') l using (phrase)""", "prose", "lex")
piece("rawvec", """select p.row_id, d.di, d.domain, d.label,
 4.0::double * max(case when l.kind = 'title' and contains(lower(coalesce(p.title, '')), l.phrase) then 1 else 0 end)
 + coalesce(max(pa.hits), 0) + least(2.5::double, 0.4::double * coalesce(max(te.n), 0)) as raw
 from people p cross join dom d join lex l on l.di = d.di
 left join past pa on pa.row_id = p.row_id and pa.di = d.di
 left join (select row_id, di, count(*) as n from terms group by all) te
  on te.row_id = p.row_id and te.di = d.di
 group by all""", "people", "dom", "lex", "past", "terms")
piece("vec", """select row_id, di, domain, label, case when n <= 1e-9 then 0.0 else raw / n end as v,
 row_number() over (partition by row_id order by case when n <= 1e-9 then 0.0 else raw / n end desc, di) as r
 from (select *, sqrt(sum(raw * raw) over (partition by row_id)) as n from rawvec)""", "rawvec")
piece("fit", """select row_id, least(1.0, greatest(0.0, sum(a.v * b.v))) as role_fit
 from vec a join o_vec b on a.di = b.di group by row_id""", "vec", "o_vec")

# --- TF-IDF -----------------------------------------------------------------------------------
_stop = ", ".join(q(w) for w in SETTINGS.stop_words)


def tfidf(docs: str, pre: str, *needs: str, cap: str = "limit 40000") -> None:
    """``docs(k, txt)``; key -1 is the role text."""
    piece(pre + "docs", f"{docs} union all select -1, text from jobrole", "jobrole", *needs)
    piece(pre + "tok", f"""select k, pos, w from (select k, unnest(ws) as w, generate_subscripts(ws, 1) as pos
  from (select k, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]{{2,}}') as ws from {pre}docs))
 where w not in ({_stop})""", pre + "docs")
    piece(pre + "tf", f"""select k, term, count(*) as tf from (select k, w as term from {pre}tok
 union all select k, w || ' ' || nx from (select k, w, lead(w) over (partition by k order by pos) as nx
  from {pre}tok) where nx is not null) group by k, term""", pre + "tok")
    piece(pre + "voc", f"""select term, ln((1.0::double + n) / (1.0::double + df)) + 1.0 as idf from (
 select term, count(*) as df, sum(tf) as cf from {pre}tf group by term having count(*) >= 2
 order by cf desc, term asc {cap}), (select count(*) as n from {pre}docs)""",
          pre + "tf", pre + "docs")
    piece(pre + "w", f"""select k, term, (1.0 + ln(tf::double)) * idf as w
 from {pre}tf join {pre}voc using (term)""", pre + "tf", pre + "voc")
    piece(pre + "sim", f"""select d.k, coalesce(dot / (nd * nq), 0.0) as tfidf
 from (select distinct k from {pre}docs where k <> -1) d left join (
 select a.k, sum(a.w * b.w) as dot from {pre}w a join {pre}w b on b.k = -1 and a.term = b.term
 where a.k <> -1 group by a.k) x using (k)
 left join (select k, sqrt(sum(w * w)) as nd from {pre}w group by k) using (k),
 (select sqrt(sum(w * w)) as nq from {pre}w where k = -1)""", pre + "w", pre + "docs")
    piece(pre + "scaled", f"""select k, tfidf, case when hi <= 1e-9 then 0.0
 else least(1.0, greatest(0.0, tfidf / hi)) end as scaled
 from {pre}sim, (select case when count(*) >= 50 then quantile_cont(tfidf, 0.99)
  else max(tfidf) end as hi from {pre}sim)""", pre + "sim")


tfidf("select doc_id as k, text as txt from documents", "d_")
tfidf("select doc_id as k, text as txt from documents", "u_", cap="")
tfidf("select row_id as k, coalesce(prose, '') as txt from people left join prose using (row_id)",
      "p_", "people", "prose")
tfidf("select row_id as k, prose as txt from nprose", "n_", "nprose")
piece("dense", """select printf('CAND_%07d', vec_id) as candidate_id,
 dot / ((sqrt(na) + 1e-9) * (sqrt(nb) + 1e-9)) as dense from (select vec_id,
 sum(a::double * b::double) as dot, sum(a::double * a::double) as na, sum(b::double * b::double) as nb
 from (select vec_id, unnest(embedding) as a, unnest((select embedding from embeddings where vec_id = 0)) as b
  from embeddings) group by vec_id)""")

# --- components over a facts relation ---------------------------------------------------------
_months = ("((2001 - try_cast(left(last_active, 4) as int)) * 12 "
           "+ (9 - try_cast(substr(last_active, 6, 2) as int)))")
RECENCY = (f"case when {_months} is null then 0.5 when {_months} <= 1 then 1.0 "
           f"when {_months} <= 3 then 0.85 when {_months} <= 6 then 0.6 "
           f"when {_months} <= 12 then 0.3 else 0.12 end")
_TERMS = (
    (0.30, "response_rate", "least(1.0, response_rate / 0.6)"),
    (0.25, "1", RECENCY),
    (0.12, "1", "case when open_to_work then 1.0 else 0.55 end"),
    (0.10, "interview_rate", "least(1.0, interview_rate)"),
    (0.10, "notice_days", "case when notice_days <= 30 then 1.0 when notice_days <= 60 then 0.8 "
                          "when notice_days <= 90 then 0.6 else 0.4 end"),
    (0.07, "completeness", "least(1.0, completeness / 90.0)"),
    (0.06, "1", "((email_ok::int + phone_ok::int) / 2.0)"),
)
AVAILABILITY = ("(0.55::double + 0.57::double * ((" + " + ".join(
    f"case when {p} is null then 0 else {dbl(w)} * ({v}) end" for w, p, v in _TERMS) + ") / ("
    + " + ".join(f"case when {p} is null then 0 else {dbl(w)} end" for w, p, _ in _TERMS) + ")))")
EXPERIENCE = """case when (select exp_min <= 0 and exp_max >= 50 from spec) then 0.7
 when coalesce(yoe, 0) between (select exp_min from spec) and (select exp_max from spec) then greatest(0.82,
  1.0 - 0.18::double * abs(coalesce(yoe, 0) - (select exp_ideal from spec))
   / (select greatest(1.0, (exp_max - exp_min) / 2.0) from spec))
 else greatest(0.08, 0.80 - 0.13::double * case when coalesce(yoe, 0) < (select exp_min from spec)
  then (select exp_min from spec) - coalesce(yoe, 0) else yoe - (select exp_max from spec) end) end"""
LOCATION = """case when exists (select 1 from spec, unnest(cities) u(x) where contains(location, x)) then 1.0
 when exists (select 1 from spec, unnest(countries) u(x) where contains(country, x))
  then case when relocate then 0.78 else 0.68 end
 when relocate then 0.35 else 0.15 end"""
HOP = """case when n_completed >= 3 and completed_months / n_completed < 16 then 0.85
 when n_completed >= 4 and completed_months / n_completed < 20 then 0.92 else 1.0 end"""
_share = ("(0.45 + 0.55::double * (n_product / n_roles) - 0.30::double * (n_consulting / n_roles) "
          "- 0.45::double * (n_nontech / n_roles))")
_c1 = f"case when n_consulting = n_roles and n_roles >= 2 then least(0.18, {_share}) else {_share} end"
COMPANY = f"""case when n_roles = 0 then case when {has_any('industry', SETTINGS.product_industries)}
  then 0.5 else 0.3 end
 else least(1.0, greatest(0.0, case when n_nontech / n_roles >= 0.8 and n_product = 0
  then least(0.20, {_c1}) else {_c1} end)) end"""
VERIFIED = """least(1.08, greatest(0.95, 1.0
 + 0.05::double * case when avg_assessment is null then 0.0 else least(1.0, greatest(-0.5, (avg_assessment - 55.0) / 35.0)) end
 + 0.03::double * case when github >= 0 then least(1.0, greatest(-0.3, (github - 35.0) / 45.0)) else 0.0 end))"""
STUFFER = """case when skill_hits >= 4 and role_fit < 0.45 then 1.0 - 0.45::double
 * (least(1.0, skill_hits / 8.0) * (0.45 - role_fit) / 0.45) else 1.0 end"""
NEGATIVE = """case when len(list_filter((select excluded from spec),
  lambda x: contains(lower(coalesce(title, '')), x))) > 0
 then case when evidence >= 0.9 then 0.80 else 0.60 end else 1.0 end"""


def _mo(x: str) -> str:
    return f"cast(cast({x} as bigint) as varchar)"


REASONS = f"""list_filter([
 case when lng is not null then 'role ''' || lng.t || ''' lasts ' || {_mo('lng.m')}
  || 'mo but total experience is only ' || {one_decimal('yoe')} || 'y' end,
 case when yoe > 0 and total_months > yoe * 24 and n_roles >= 2 then 'career roles sum to '
  || {_mo('total_months')} || 'mo vs ' || {_mo('round_even(yoe * 12.0, 0)')}
  || 'mo of stated experience (impossible overlap)' end,
 case when mastery_zero >= 5 then mastery_zero || ' skills marked expert/advanced with 0 months used'
  when mastery_zero >= 3 then mastery_zero || ' expert/advanced skills with 0 months used' end,
 case when dis is not null then 'role ''' || dis.t || ''' claims ' || {_mo('dis.m')} || 'mo over a '
  || {_mo('dis.s')} || 'mo date span' end], lambda x: x is not null)"""

piece("base", """select p.*, f.* exclude (row_id, n_roles, n_consulting, n_product, n_nontech,
  n_completed, completed_months, total_months),
 coalesce(n_roles, 0) as n_roles, coalesce(n_consulting, 0) as n_consulting,
 coalesce(n_product, 0) as n_product, coalesce(n_nontech, 0) as n_nontech,
 coalesce(n_completed, 0) as n_completed, coalesce(completed_months, 0) as completed_months,
 coalesce(total_months, 0) as total_months, coalesce(skill_hits, 0) as skill_hits,
 coalesce(mastery_zero, 0) as mastery_zero, lng, dis,
 coalesce(rel_mean, all_mean) as avg_assessment
 from people p left join rolefacts f on f.row_id = p.row_id left join skl s on s.row_id = p.row_id
 left join offend o on o.row_id = p.row_id left join assess a on a.user_id = p.user_id""",
      "people", "rolefacts", "skl", "offend", "assess")
piece("evid", """select p.row_id, len(found) as n_found, found[1:6] as found,
 case when n = 0 then 0.5 else least(1.0, len(found) / least(10.0, greatest(5.0, n * 0.4))) end as evidence
 from (select row_id, (select len(keywords) from spec) as n,
  list_filter((select keywords from spec), lambda k: contains(coalesce(prose, ''), k)) as found
  from people left join prose using (row_id)) p""", "people", "prose", "spec")


def scored_pieces(pre: str, base: str, fit: str, evid: str, sims: str, dense: str | None) -> None:
    piece(pre + "local", f"""select *, {STUFFER} as stuffer, {NEGATIVE} as negative, {EXPERIENCE} as experience,
 {COMPANY} as company_type, {LOCATION} as location_score, {AVAILABILITY} as behavioral,
 {VERIFIED} as verified, {HOP} as hop, greatest(0.6, 1.0 - 0.2::double * len(reasons)) as soft
 from (select b.*, role_fit, evidence, found, {REASONS} as reasons,
  lng is not null or dis is not null or mastery_zero >= 5
   or (yoe > 0 and total_months > yoe * 24 and n_roles >= 2) as hard
  from {base} b join {fit} using (row_id) join {evid} using (row_id))""", base, fit, evid, "spec")
    blend = ("coalesce(0.5 * scaled + 0.5 * dense, scaled)" if dense else "scaled")
    extra = f"left join {dense} using (candidate_id)" if dense else ""
    piece(pre + "sem", f"""select l.*, {blend} as semantic from {pre}local l
 join {sims} s on s.k = l.row_id {extra}""", pre + "local", sims, *([dense] if dense else []))


_ORDER = ("role_fit", "semantic", "evidence", "experience", "company_type", "location_score")


def final(weights: dict[str, float], src: str) -> str:
    names = dict(zip(_ORDER, ("role_fit", "semantic", "evidence", "experience",
                              "company_type", "location")))
    base = " + ".join(f"{dbl(weights[names[n]])} * {n}" for n in _ORDER)
    return (f"select *, base * behavioral * verified * stuffer * negative * hop * soft "
            f"* case when hard then 0.02::double else 1.0 end as final "
            f"from (select *, {base} as base from {src})")


def ranked(pre: str, weights: dict[str, float], src: str, *needs: str) -> None:
    piece(pre + "final", final(weights, src), src, *needs)
    piece(pre + "ranked", f"""select *, row_number() over (order by score desc, candidate_id) as rank
 from (select *, round_even(final / (select case when max(final) = 0 then 1.0 else max(final) end
  from {pre}final) * 10000, 0) / 10000 as score from {pre}final)""", pre + "final")


scored_pieces("s_", "base", "fit", "evid", "p_scaled", "dense")
ranked("s_", SETTINGS.weights, "s_sem")
_sum = sum(OTHER_WEIGHTS.values())
ranked("r_", {k: v / _sum for k, v in OTHER_WEIGHTS.items()}, "s_sem")

# --- sentences ---------------------------------------------------------------------------------
HOME = SETTINGS.home_country
ROLE_PHRASE = (f"coalesce(nullif(title, ''), 'professional') || ' with ' || case when yoe is null "
               f"then 'unknown tenure' else {one_decimal('yoe')} || ' yrs' end")
PLACE_PHRASE = (f"case when contains(lower(country), {q(HOME)}) then location else "
                f"location || ' (outside {HOME}' || case when relocate then "
                f"', open to relocate)' else ')' end end")


def sentences(pre: str) -> None:
    piece(pre + "said", f"""select *, case when len(concerns) > 0
  then ' Concerns: ' || array_to_string(concerns[1:3], '; ') || '.'
  when rank <= 25 and response_rate >= 0.5 then ' Responsive on the platform (response rate '
   || {_mo('round_even(response_rate * 100, 0)')} || '%).'
  when rank <= 25 then ' Solid overall fit on role, experience and location.' else '' end as closing
 from (select *, {ROLE_PHRASE} as rp, {PLACE_PHRASE} as lp,
  case when role_fit >= 0.6 then 'strong' when role_fit >= 0.35 then 'partial/adjacent' else 'limited' end
   || ' match to the ' || (select labels[1] from spec) || ' role' as match,
  list_filter([case when len(found) > 0 then 'profile mentions ' || array_to_string(found[1:3], ', ') end,
   case when avg_assessment >= 75 then 'verified assessment avg '
    || {_mo('round_even(avg_assessment, 0)')} || '/100' end,
   case when company_type >= 0.7 then 'product-company background' end], lambda x: x is not null) as extras,
  list_filter([case when response_rate < 0.25 then 'low recruiter response rate ('
    || {_mo('round_even(response_rate * 100, 0)')} || '%)' end,
   case when notice_days >= 90 then 'long notice period (' || {_mo('notice_days')} || 'd)' end,
   case when behavioral < 0.8 then 'weak recent platform activity' end,
   case when company_type <= 0.25 and role_fit >= 0.5 then 'services-heavy background' end,
   case when len(reasons) > 0 then 'profile has internal inconsistencies' end], lambda x: x is not null) as concerns
  from {pre}ranked)""", pre + "ranked", "spec")
    piece(pre + "told", f"""select *, case when role_fit < 0.35 and stuffer < 0.85 then rp || '; ' || match
  || ' — skills list carries relevant keywords but the actual role and history do not back them up; based in '
  || lp || '.' else rp || '; ' || match || case when len(extras) > 0 then '; '
  || array_to_string(extras[1:2], '; ') else '' end || '; based in ' || lp || '.' end || closing as reasoning
 from {pre}said""", pre + "said")


sentences("s_")
piece("domtext", """select row_id, coalesce(string_agg(label, ', ' order by r), '—') as domain from vec
 where r <= 2 and v >= 0.2 group by row_id""", "vec")
_R3 = ("role_fit", "semantic", "evidence", "experience", "company_type", "location_score",
       "behavioral", "verified", "stuffer", "negative")
piece("audited", f"""select rank, candidate_id, score, title, yoe, location, country, company, industry,
 coalesce(domain, '—') as domain, {', '.join(f'{rounded3(n)} as {n}' for n in _R3)},
 hard as honeypot, reasoning from s_told left join domtext using (row_id)""", "s_told", "domtext")
FLAG = ("case when honeypot then 'honeypot' when stuffer < 0.9 then 'stuffer' "
        "when negative < 1.0 then 'excluded specialty' else 'clean' end")

# --- nested records ------------------------------------------------------------------------------
piece("nown", """select *, case when row_id % 19 > 0 then yoe end as nyoe from people
 left join prose using (row_id)""", "people", "prose")
piece("nroles", " union all ".join(f"""select row_id, {n} as n, title, 'supplier ' || (row_id * {n} % 30) as company,
 case when row_id % 3 <> {n % 3} then industry end as industry, row_id % 3 = {n - 1} as is_current,
 coalesce(case when row_id % 9 <> {n} then (row_id * {n} + {n}) % 70 end, 0)::double as months,
 1990 + (row_id + {n}) % 10 as y0,
 case when row_id % 4 <> {n} then 1990 + (row_id + {n}) % 10 + row_id % 5 end as y1, nyoe,
 '  did' || chr(9) || people_company || ' {n}' as description
 from (select *, company as people_company from nown)""" for n in (1, 2, 3)), "nown")
piece("nprose", """select row_id, lower(trim(regexp_replace(
 'From ' || location || ' ' || coalesce(prose || ' ', '') || coalesce(title || ' ', '') || coalesce(industry || ' ', '')
 || rp || ' ' || company, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x1c-\\x1f]+', ' ', 'g'))) as prose
 from nown join (select row_id, string_agg(concat_ws(' ', title, description, industry), ' ' order by n) as rp
  from nroles group by row_id) using (row_id)""", "nown", "nroles")
_nk = f"""case when {has_any('company', SETTINGS.consulting_companies)} or coalesce({has_any('industry', SETTINGS.consulting_industries)}, false)
 then 'consulting' when {has_any('industry', SETTINGS.product_industries)} then 'product'
 when {has_any('industry', SETTINGS.nontech_industries)} then 'nontech' else 'other' end"""
piece("nrf", f"""select row_id, count(*) as n_roles, count(*) filter (where kind = 'consulting') as n_consulting,
 count(*) filter (where kind = 'product') as n_product, count(*) filter (where kind = 'nontech') as n_nontech,
 count(*) filter (where not is_current) as n_completed,
 coalesce(sum(months) filter (where not is_current), 0) as completed_months, sum(months) as total_months,
 min_by({{'t': coalesce(title, '?'), 'm': months}}, n) filter (where nyoe > 0 and months > nyoe * 12 + 12) as lng,
 min_by({{'t': coalesce(title, '?'), 'm': months, 's': (y1 - y0) * 12}}, n) filter (where months > (y1 - y0) * 12 + 30) as dis
 from (select *, {_nk} as kind from nroles) group by row_id""", "nroles")
piece("npast", """select row_id, di, count(distinct n) as hits from nroles r
 join (select * from lex where kind = 'title') l on contains(lower(r.title), l.phrase)
 where not is_current group by row_id, di""", "nroles", "lex")
piece("nskl", " union all ".join(f"""select row_id,
 lower(case when row_id % 2 = {n % 2} then 'Hot ' || split_part(title, ' ', 2) else 'Click' end) as name,
 row_id % 5 < 3 and row_id % 10 <> {n} and (row_id * {n}) % 3 = 0 as zero from people"""
                                  for n in range(1, 7)), "people")
piece("nsk", """select row_id, count(*) filter (where name in (select unnest(keywords) from spec)) as skill_hits,
 count(*) filter (where zero) as mastery_zero from nskl group by row_id""", "nskl", "spec")
piece("nbase", """select row_id, candidate_id, title, industry, company, nyoe as yoe, location, country, relocate,
 open_to_work, email_ok, phone_ok, response_rate, interview_rate, notice_days, completeness, github,
 '2001-08-01' as last_active, f.* exclude (row_id), skill_hits, mastery_zero,
 case when list_contains((select keywords from spec), 'click') then (row_id % 90)::double
  else ((row_id % 90)::double + (row_id % 80)::double) / 2 end as avg_assessment
 from nown join nrf f using (row_id) join nsk using (row_id)""", "nown", "nrf", "nsk", "spec")
piece("nterms", f"""select row_id, l.di, count(*) as n from (select row_id, unnest({terms_in('prose')}) as phrase
 from nprose) p join (select * from lex where kind = 'term') l using (phrase) group by all""", "nprose", "lex")
piece("nraw", """select p.row_id, d.di,
 4.0::double * max(case when l.kind = 'title' and contains(lower(coalesce(p.title, '')), l.phrase) then 1 else 0 end)
 + coalesce(max(pa.hits), 0) + least(2.5::double, 0.4::double * coalesce(max(te.n), 0)) as raw
 from people p cross join dom d join lex l on l.di = d.di
 left join npast pa on pa.row_id = p.row_id and pa.di = d.di
 left join nterms te on te.row_id = p.row_id and te.di = d.di group by all""",
      "people", "dom", "lex", "npast", "nterms")
piece("nfit", """select row_id, least(1.0, greatest(0.0, sum(case when n <= 1e-9 then 0.0 else raw / n end * b.v))) as role_fit
 from (select *, sqrt(sum(raw * raw) over (partition by row_id)) as n from nraw) a join o_vec b using (di)
 group by row_id""", "nraw", "o_vec")
piece("nevid", """select row_id, found[1:6] as found,
 case when n = 0 then 0.5 else least(1.0, len(found) / least(10.0, greatest(5.0, n * 0.4))) end as evidence
 from (select row_id, (select len(keywords) from spec) as n,
  list_filter((select keywords from spec), lambda k: contains(prose, k)) as found from nprose)""",
      "nprose", "spec")
scored_pieces("n_", "nbase", "nfit", "nevid", "n_scaled", None)
ranked("n_", SETTINGS.weights, "n_sem")
sentences("n_")

# TF-IDF over nested prose is declared before nprose: emit it after
_names = [n for n in PIECES if n in ("n_docs", "n_tok", "n_tf", "n_voc", "n_w", "n_sim", "n_scaled")]
_tail = ["nevid", "n_local", "n_sem", "n_final", "n_ranked", "n_said", "n_told"]
for _n in _names + _tail:
    PIECES[_n] = PIECES.pop(_n)


def joined(col: str) -> str:
    return f"array_to_string({col}, ',')"


def per_domain(src: str, value: str, key: str, people: str) -> str:
    """Comma list of a per-domain value in domain order, 0 where absent."""
    return f"""select {key}, string_agg(cast(coalesce({value}, 0) as varchar), ',' order by d.di)
 from {people} p cross join dom d left join {src} s on s.row_id = p.row_id and s.di = d.di group by {key}"""


ORACLE: dict[str, str] = {}
_o = ORACLE
_o["prose_projection"] = query(
    "select candidate_id, nprose.prose from people join nprose using (row_id)", "people", "nprose")
_o["nested_facts"] = query(f"""select candidate_id, past_hits, n_roles, n_consulting, n_product, n_nontech,
 n_completed, completed_months, total_months, skill_hits, mastery_zero, rel_n, rel_sum, 2 as all_n,
 (row_id % 90 + row_id % 80)::double as all_sum,
 coalesce(lng.t || '|' || {_mo('lng.m')}, '') as overlong,
 coalesce(dis.t || '|' || {_mo('dis.m')} || '|' || {_mo('dis.s')}, '') as misdated
 from (select *, case when list_contains((select keywords from spec), 'click') then 1 else 0 end as rel_n,
  case when list_contains((select keywords from spec), 'click') then (row_id % 90)::double else 0.0 end as rel_sum
  from nbase) join (select p.row_id, string_agg(cast(coalesce(hits, 0) as varchar), ',' order by d.di) as past_hits
  from people p cross join dom d left join npast s on s.row_id = p.row_id and s.di = d.di group by p.row_id)
 using (row_id)""", "nbase", "npast", "dom", "people", "spec")
_o["lexicon_title_match"] = query("""select candidate_id, string_agg(cast(h as varchar), ',' order by di) as hits
 from (select candidate_id, di, max(case when kind = 'title' and contains(lower(coalesce(title, '')), phrase) then 1 else 0 end) as h
 from people cross join lex group by candidate_id, di) group by candidate_id""", "people", "lex")
_o["lexicon_past_titles"] = query("""select p.row_id, string_agg(cast(coalesce(hits, 0) as varchar), ',' order by d.di) as past_hits
 from rolefacts p cross join dom d left join past s on s.row_id = p.row_id and s.di = d.di
 group by p.row_id""", "rolefacts", "dom", "past")
_o["lexicon_term_match"] = query("""select p.row_id as doc_id, coalesce(tt, '') as terms, counts from prose p
 join (select p.row_id, string_agg(cast(coalesce(n, 0) as varchar), ',' order by d.di) as counts from prose p
  cross join dom d left join (select row_id, di, count(*) as n from terms group by all) s
  on s.row_id = p.row_id and s.di = d.di group by p.row_id) using (row_id)
 left join (select row_id, string_agg(phrase, ',' order by phrase) as tt
  from (select distinct row_id, phrase from terms) group by row_id) using (row_id)""",
                                  "prose", "dom", "terms")
_o["domain_vector"] = query("select candidate_id, " + ", ".join(
    f"max(case when di = {i} then {tidy('v', 9)} end) as {n}" for i, n in enumerate(NAMES))
    + " from people join vec using (row_id) group by candidate_id", "people", "vec")
_o["role_fit_cosine"] = query(f"select candidate_id, {tidy('role_fit', 9)} as role_fit "
                              "from people join fit using (row_id)", "people", "fit")
_o["top_domains"] = query("""select candidate_id,
 coalesce(string_agg(domain, ',' order by r) filter (where r <= 2 and v >= 0.2), '') as top2,
 coalesce(string_agg(domain, ',' order by r) filter (where r <= 3 and v >= 0.15), '') as top3
 from people join vec using (row_id) group by candidate_id""", "people", "vec")
_o["jd_title"] = query("select jd_id, title from j_title", "j_title")
_o["jd_experience_band"] = query("select * from j_band", "j_band")
_o["jd_locations"] = query(f"select jd_id, {joined('cities')} as cities, "
                           f"{joined('countries')} as countries from j_place", "j_place")
_o["jd_exclusions"] = query(f"select jd_id, coalesce({joined('excluded')}, '') as excluded "
                            "from jdall left join j_excl using (jd_id)", "jdall", "j_excl")
_o["jd_keywords"] = query(f"select jd_id, {joined('target')} as target_domains, "
                          f"coalesce({joined('keywords')}, '') as keywords from j_spec", "j_spec")
_o["jd_spec"] = query("""select jd_id, title, array_to_string(labels, ', ') as role_domain,
 case when exp_min <= 0 and exp_max >= 50 then 'any' else cast(exp_min as bigint) || '–' || cast(exp_max as bigint) || ' yrs' end as experience,
 coalesce(nullif(array_to_string(case when len(cities) > 0 then cities else countries end, ', '), ''), 'any') as places,
 coalesce(nullif(array_to_string(keywords[1:8], ', '), ''), '—') as key_terms,
 len(cities) > 0 or len(countries) > 0 as has_location_pref from j_spec""", "j_spec")
_o["tfidf_uncapped"] = query(f"select k as doc_id, {tidy('tfidf')} as tfidf from u_sim", "u_sim")
_o["tfidf_similarity"] = query(f"select k as doc_id, {tidy('tfidf')} as tfidf from d_sim", "d_sim")
_o["percentile_scaling"] = query(f"select k as doc_id, {tidy('scaled')} as scaled from d_scaled",
                                 "d_scaled")
_o["dense_cosine"] = query(f"select candidate_id, {tidy('dense')} as dense from dense", "dense")
_o["hybrid_blend"] = query(f"""select candidate_id, {tidy('coalesce(0.5 * tfidf + 0.5 * dense, tfidf)')} as semantic
 from (select printf('CAND_%07d', k) as candidate_id, tfidf from d_sim) left join dense using (candidate_id)""",
                           "d_sim", "dense")
_o["experience_score"] = query(f"select candidate_id, {tidy(EXPERIENCE, 9)} as experience from people",
                               "people", "spec")
_o["location_score"] = query(f"select candidate_id, {LOCATION} as location_score from people",
                             "people", "spec")
_o["keyword_evidence"] = query(f"""select row_id as doc_id, {tidy('evidence', 9)} as evidence, {joined('found')} as terms
 from (select row_id, found[1:6] as found, case when n = 0 then 0.5
  else least(1.0, len(found) / least(10.0, greatest(5.0, n * 0.4))) end as evidence
 from (select row_id, (select len(keywords) from spec) as n,
  list_filter((select keywords from spec), lambda k: contains(prose, k)) as found from prose))""",
                               "prose", "spec")
_rp = "from people left join rolefacts using (row_id)"
_zero = ("select candidate_id, industry, coalesce(n_roles, 0) as n_roles, "
         "coalesce(n_consulting, 0) as n_consulting, coalesce(n_product, 0) as n_product, "
         "coalesce(n_nontech, 0) as n_nontech, coalesce(n_completed, 0) as n_completed, "
         "coalesce(completed_months, 0) as completed_months " + _rp)
_o["company_type"] = query(f"select candidate_id, n_consulting, n_product, n_nontech, "
                           f"{tidy(COMPANY, 9)} as company_type from ({_zero})", "people", "rolefacts")
_o["stuffing_penalty"] = query(f"select candidate_id, skill_hits, {tidy('stuffer', 9)} as stuffer "
                               "from s_local", "s_local")
_o["negative_penalty"] = query("select candidate_id, negative from s_local", "s_local")
_o["job_hopping"] = query(f"select candidate_id, n_completed, {HOP} as hop from ({_zero})",
                          "people", "rolefacts")
_o["recency"] = query(f"select candidate_id, last_active, {RECENCY} as recency {_rp}",
                      "people", "rolefacts")
_o["availability"] = query(f"select candidate_id, {tidy(AVAILABILITY)} as behavioral {_rp}",
                           "people", "rolefacts")
_o["corroboration"] = query(f"""select candidate_id, {tidy('avg_assessment')} as avg_assessment,
 {tidy(VERIFIED)} as verified from (select *, coalesce(rel_mean, all_mean) as avg_assessment
 from people left join assess using (user_id))""", "people", "assess")
_o["integrity_rules"] = query(f"select candidate_id, array_to_string({REASONS}, '; ') as reasons "
                              "from base", "base")
_o["integrity_verdict"] = query(f"select candidate_id, hard, {tidy('soft', 9)} as soft, "
                                "len(reasons) as n_reasons from s_local", "s_local")
_parts = ("role_fit", "evidence", "experience", "company_type", "location_score", "behavioral",
          "verified", "stuffer", "negative", "hop", "soft")
_o["row_parts"] = query("select candidate_id, hard, " + ", ".join(
    f"{tidy(n)} as {n}" for n in _parts) + " from s_local", "s_local")
_o["weighted_base"] = query(f"select candidate_id, {tidy('semantic')} as semantic, "
                            f"{tidy('base')} as base from s_final", "s_final")
_o["final_score"] = query(f"select candidate_id, {tidy('final')} as final, score from s_ranked",
                          "s_ranked")
_o["weight_override"] = query("select candidate_id, score from r_ranked", "r_ranked")
_o["topk_ranking"] = query("select candidate_id, rank, score from s_ranked where rank <= 100",
                           "s_ranked")
_o["vectors_ranking"] = _o["topk_ranking"]
_o["rank_all"] = query("select candidate_id, rank, score from s_ranked", "s_ranked")
_o["topk_per_group"] = query("""select country, candidate_id, r as rank, score from (select *,
 row_number() over (partition by country order by score desc, candidate_id) as r from s_ranked)
 where r <= 10""", "s_ranked")
_o["phrases"] = query(f"select candidate_id, {ROLE_PHRASE} as role_phrase, "
                      f"{PLACE_PHRASE} as location_phrase from people", "people")
_o["explanation"] = query("select candidate_id, rank, printf('%.4f', score) as score, reasoning "
                          "from s_told where rank <= 100", "s_told")
_o["audit"] = query("select * from audited where rank <= 100", "audited")
_o["audit_json"] = _o["audit"]
_o["csv_roundtrip"] = _o["explanation"]
_o["csv_head"] = query("select candidate_id, rank, printf('%.4f', score) as score, reasoning "
                       "from s_told where rank <= 50", "s_told")
_o["flags"] = query(f"select candidate_id, {FLAG} as flag from audited", "audited")
_o["contributions"] = query(" union all ".join(
    f"select candidate_id, rank, '{n}' as component, {tidy(f'{n} * {dbl(w)}')} as value "
    "from audited where rank <= 100" for n, w in zip(_ORDER, SETTINGS.weights.values())), "audited")
_o["post_rank_filter"] = query(f"""select rank, candidate_id, title, domain, yoe, score, {FLAG} as flag from audited
 where country = 'asia' and yoe >= 4 and not honeypot and stuffer >= 0.9 order by rank limit 50""", "audited")
_o["candidate_detail"] = query("""select candidate_id, (n - 1)::int as role_no, r.title, r.company, r.industry, left(r.description, 280) as description
 from nroles r join people p using (row_id) where candidate_id = 'CAND_0000042'""", "nroles", "people")
_o["kpis"] = query(f"""select count(*) as candidates,
 cast(floor(count(*) filter (where country = 'asia') / count(*) * 100) as int) as home_percent,
 count(*) filter (where honeypot) as flagged, {tidy('avg(yoe) filter (where rank <= 10)')} as top10_yoe from audited""", "audited")
_o["title_mix"] = query("""select title, count(*) as "count" from (select * from audited where not honeypot and stuffer >= 0.9
 order by rank limit 100) where title is not null group by title order by count(*) desc, title limit 12""", "audited")
_o["titles_of_best"] = query("""select title, count(*) as "count" from audited where rank <= 100 and title is not null
 group by title order by count(*) desc, title limit 6""", "audited")
_o["score_histogram"] = query("""select cast(coalesce(least(floor((score - lo) / nullif((hi - lo) / 25, 0)), 24), 0) as int) as bin, count(*) as "count"
 from audited, (select min(score) as lo, max(score) as hi from audited) group by 1""", "audited")
_o["scatter"] = query("select candidate_id, title, yoe, score, role_fit from audited", "audited")
_o["country_mix"] = query("""select country, count(*) as "count" from audited where rank <= 100 group by country""", "audited")
_o["experience_bands"] = query("""select case when yoe between 6 and 8 then '6-8' when yoe between 5 and 9 then '5-9'
 when yoe < 5 then '<5' else '9+' end as band, count(*) as "count" from audited where rank <= 100 group by 1""", "audited")
_o["score_summary"] = query("""select min(score) as score_min, max(score) as score_max, count(*) filter (where honeypot) as flagged
 from audited where rank <= 100""", "audited")
_o["leaders"] = query("select rank, candidate_id, score from s_ranked where rank <= 5", "s_ranked")
_o["validate_ok"] = query("select count(*) as checked, 0::bigint as broken from s_ranked where rank <= 100",
                          "s_ranked")
piece("dmg", """select o_orderkey + 2 as row, case when o_orderkey % 50 = 7 then '' when o_orderkey % 50 = 8 then 'CAND_12'
  when o_orderkey % 50 = 9 then 'CAND_0000001' else printf('CAND_%07d', o_orderkey) end as id,
 case when o_orderkey % 40 = 3 then 'x' when o_orderkey % 40 = 4 then '0' || (o_orderkey + 1)
  when o_orderkey % 40 = 5 then '77' else cast(o_orderkey + 1 as varchar) end as rk,
 case when o_orderkey % 60 = 11 then 'high' else cast(cast(floor(o_totalprice / 50000.0) as bigint) as varchar) end as sc,
 o_orderkey % 70 = 13 as short, count(*) over () - 7 as wanted from orders""")
piece("dm", """select *, case when rk = cast(try_cast(rk as bigint) as varchar) then try_cast(rk as bigint) end as n,
 try_cast(sc as double) as s, regexp_matches(id, '^CAND_[0-9]{7}$') as good from dmg where not short""", "dmg")
piece("dpair", """select *, lead(n) over (order by n, row) as n2, lead(s) over (order by n, row) as s2,
 lead(id) over (order by n, row) as id2 from dm where n is not null and s is not null and id <> ''""", "dm")
_o["validate_broken"] = query("""select 'row_count' as rule, null::bigint as row, 'expected ' || max(wanted) || ' data rows, found ' || count(*) as message from dmg
 union all select 'cell_count', row, 'Row ' || row || ': expected 4 columns, got 3' from dmg where short
 union all select 'id_required', row, 'Row ' || row || ': candidate_id is required' from dm where id = ''
 union all select 'id_format', row, 'Row ' || row || ': candidate_id has the wrong form' from dm where id <> '' and not good
 union all select 'id_duplicate', row, 'Row ' || row || ': duplicate candidate_id ' || id from (select *, row_number() over (partition by id order by row) as k from dm where good) where k > 1
 union all select 'rank_integer', row, 'Row ' || row || ': rank must be an integer' from dm where n is null
 union all select 'rank_range', row, 'Row ' || row || ': rank must be between 1 and ' || wanted from dm where n not between 1 and wanted
 union all select 'rank_duplicate', row, 'Row ' || row || ': duplicate rank ' || n from (select *, row_number() over (partition by n order by row) as k from dm where n between 1 and wanted) where k > 1
 union all select 'score_float', row, 'Row ' || row || ': score must be a float' from dm where s is null
 union all select 'rank_missing', null, 'missing rank ' || i from (select unnest(range(1, (select count(*) - 6 from orders))) as i) where i not in (select n from dm where n between 1 and wanted)
 union all select 'score_order', row, 'score must not increase by rank: rank ' || n || ' < rank ' || n2 from dpair where s < s2
 union all select 'tie_break', row, 'equal scores at ranks ' || n || ' and ' || n2 || ' need ascending candidate_id' from dpair where s = s2 and id > id2""",
                              "dmg", "dm", "dpair")
piece("fdmg", """select row_number() over (order by o_orderkey) + 1 as row, case when o_orderkey % 50 = 7 then ''
  when o_orderkey % 50 = 9 then 'CAND_0000001' else printf('CAND_%07d', o_orderkey) end as id, o_orderkey + 1 as n,
 case when o_orderkey % 60 not in (11, 12) then floor(o_totalprice / 50000.0) end as s,
 o_orderkey % 70 = 13 as short, count(*) over () + 3 as wanted from orders""")
piece("fpair", """select *, lead(n) over (order by n, row) as n2, lead(s) over (order by n, row) as s2,
 lead(id) over (order by n, row) as id2 from fdmg where not short and s is not null and id <> ''""", "fdmg")
_o["validate_file"] = query("""select 'row_count' as rule, null::bigint as row,
  'expected ' || max(wanted) || ' data rows, found ' || count(*) as message from fdmg
 union all select 'header', 1, 'header must be exactly candidate_id,rank,score,reasoning'
 union all select 'cell_count', row, 'Row ' || row || ': expected 4 columns, got 3' from fdmg where short
 union all select 'id_required', row, 'Row ' || row || ': candidate_id is required' from fdmg where not short and id = ''
 union all select 'id_duplicate', row, 'Row ' || row || ': duplicate candidate_id ' || id from (select *,
  row_number() over (partition by id order by row) as k from fdmg where not short and id <> '') where k > 1
 union all select 'rank_range', row, 'Row ' || row || ': rank must be between 1 and ' || wanted from fdmg
  where not short and n not between 1 and wanted
 union all select 'score_float', row, 'Row ' || row || ': score must be a float' from fdmg where not short and s is null
 union all select 'rank_missing', null, 'missing rank ' || i from (select unnest(range(1, (select count(*) + 4 from orders))) as i)
  where i not in (select n from fdmg where not short)
 union all select 'score_order', row, 'score must not increase by rank: rank ' || n || ' < rank ' || n2 from fpair where s < s2
 union all select 'tie_break', row, 'equal scores at ranks ' || n || ' and ' || n2 || ' need ascending candidate_id' from fpair
  where s = s2 and id > id2""", "fdmg", "fpair")
_wide = """select candidate_id, title as current_title, nyoe as years_of_experience, 3 as roles, 6 as skills,
 (row_id % 80)::double as excel from nown"""
for _n in ("jsonl_tolerant", "jsonl_strict", "json_array"):
    _o[_n] = query(_wide, "nown")
_o["jsonl_limited"] = query(_wide + " qualify row_number() over (order by row_id) <= 334", "nown")
_o["jsonl_rejected"] = "select count(*) as rejected from customer"
_o["nested_ranking"] = query("select candidate_id, rank, score, reasoning from n_told where rank <= 100",
                             "n_told")
_o["vectors_parquet"] = f"""select printf('CAND_%07d', vec_id) as id, len(embedding) as width, {tidy('sq')} as square
 from embeddings join (select vec_id, sum(x::double * x::double) as sq from (select vec_id, unnest(embedding) as x from embeddings)
 group by vec_id) using (vec_id)"""
_o["jd_files"] = """select lower(r_name) || ' gear' as title, 5.0::double as exp_min, 11.0::double as exp_max,
 case when lower(r_name) = 'europe' then 'asia,europe' else 'asia' end as countries from region"""
