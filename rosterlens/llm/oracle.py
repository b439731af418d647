"""DuckDB SQL for the operators that SQL can express."""

from rosterlens.llm.host_rules import HOST_RATE
from rosterlens.llm.mixing import BLOCK, CYCLE
from rosterlens.llm.vector_codes import ENTRIES, LARGEST, PARTS, ROUNDS, SCALE

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """
reach as (
  select a, b from links
  union
  select reach.a, links.b from reach join links on links.a = reach.b)
"""



def _plain_rounds() -> str:
    """Codes by plain k-means rounds: every part against every entry."""
    def assigned(r: int) -> str:
        return f"""
a{r} as materialized (
  select vec_id, label, p, e, d from (
    select vec_id, label, x.p, e, sum((x.v - c{r}.v) * (x.v - c{r}.v))::bigint d
    from x join c{r} on c{r}.p = x.p and c{r}.i = x.i group by all)
  qualify row_number() over (partition by vec_id, p order by d, e) = 1)"""

    def moved(r: int) -> str:
        return f"""
c{r + 1} as materialized (
  select p, e, i, coalesce(((s - ((s % n) + n) % n) // n)::bigint, c{r}.v) v
  from c{r} left join (
    select a{r}.p, e, i, sum(v) s, count(*) n from a{r} join x using (vec_id, p) group by all)
  using (p, e, i))"""

    rounds = ",".join(assigned(r) + "," + moved(r) for r in range(ROUNDS))
    return f"""
with kept as (
  select vec_id, label, embedding, row_number() over (order by vec_id) - 1 e from embeddings
  where len(embedding) > 0 and len(embedding) % {PARTS} = 0 and len(list_filter(embedding,
    lambda y: coalesce(isfinite(y) and abs(y) * {SCALE} < {LARGEST}, false))) = len(embedding)),
x as materialized (
  select vec_id, label, e as nth, i // (len(embedding) // {PARTS}) p,
    i % (len(embedding) // {PARTS}) i, floor({SCALE} * embedding[i + 1]::double)::bigint v
  from (select *, unnest(range(len(embedding))) i from kept)),
c0 as materialized (select p, nth e, i, v from x where nth < {ENTRIES}),
{rounds},{assigned(ROUNDS)},
coded as (
  select vec_id, label, string_agg(format('{{:02x}}', e), '' order by p) code,
    sum(d)::bigint error from a{ROUNDS} group by 1, 2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
  (select sha256(string_agg(v::varchar, ',' order by p, e, i)) from c{ROUNDS}) codebooks_sha256
from coded
"""


ORACLE = {
    "op11_ball_kmeans_codes": _plain_rounds(),
    "op4_token_group_join": f"""
with recursive words as (
  select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') w
  from documents),
tokens as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
    else list_transform(range(1, len(w) - 3), lambda i: w[i:i+4]) end) t from words),
numbered as (select doc_id, dense_rank() over (order by t) t from tokens),
sizes as (select doc_id, count(*) n from numbered group by 1),
common as (
  select x.doc_id a, y.doc_id b, count(*) c from numbered x join numbered y
    on x.t = y.t and x.doc_id <> y.doc_id group by 1, 2),
links as (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * c >= 80 * (p.n + q.n - c)),
{_REACH}
select d.doc_id, coalesce(n, 0) n_shingles,
  least(d.doc_id, coalesce((select min(b) from reach where a = d.doc_id), d.doc_id)) component_id
from documents d left join sizes using (doc_id)
""",
    "op5_host_rules": rf"""
with words as (
  select doc_id, source, coalesce(text, '') x, {_WORDS} w from documents),
spots as (
  select doc_id, unnest(range(1, len(w) - 3)) i, unnest(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i+4], ' '))) five from words where len(w) > 5),
windows as (
  select doc_id, i, count(*) over (partition by doc_id, five) c from spots),
covered as (
  select doc_id, count(distinct p) n from (
    select doc_id, unnest(range(i, i + 5)) p from windows where c > 1) group by 1),
lines as (
  select doc_id, unnest(string_split(x, chr(10))) line from words),
again as (
  select doc_id, count(*) - count(distinct line) n from lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
counted as (
  select doc_id, source, len(w) n_words, length(array_to_string(w, '')) word_chars,
    length(x) - length(translate(x, '#*$%&|<>', '')) n_symbols,
    coalesce(again.n, 0) n_dup_lines, coalesce(covered.n, 0) n_repeat_words
  from words left join again using (doc_id) left join covered using (doc_id)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from counted),
hosts as (
  select source, count(*) docs, sum(base_failed::int) failures from judged
  where source is not null group by 1),
prior as (
  select avg(failures / docs) m, var_pop(failures / docs) v from hosts),
weighted as (
  select m, case when v > 0 then greatest(1.0, m * (1 - m) / v - 1) else 1.0 end k from prior),
verdicts as (
  select source, (failures + m * k) / (docs + k) > {HOST_RATE} failed from hosts, weighted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint n_repeat_words,
  base_failed, not (base_failed or coalesce(failed, false)) kept
from judged left join verdicts using (source)
""",
    "op6_cover_tree": f"""
with recursive usable as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null
    and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select x.vec_id a, y.vec_id b from usable x join usable y
    on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e)
    and list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH}
select vec_id, (select count(*) from links where a = vec_id) n_links,
  least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) component_id,
  vec_id <= coalesce((select min(b) from reach where a = vec_id), vec_id) kept
from embeddings
""",
    "op7_pfair_mix": f"""
with recursive sized as (
  select source, sqrt(count(*)) w, count(*) over () k from documents group by 1),
exact as (
  select source, w / sum(w) over () * ({CYCLE} - k) e, {CYCLE} - k spare from sized),
given as (
  select *, floor(e) f, row_number() over (order by round(e - floor(e), 9) desc, source) r
  from exact),
shares as (
  select source, (1 + f + case when r <= spare - sum(f) over () then 1 else 0 end)::bigint p
  from given),
listed as (
  select list(p order by source) ps, list(source order by source) names from shares),
run as (
  select 0 t, list_transform(ps, lambda x: 0::bigint) done, null::bigint pick, ps from listed
  union all
  select t + 1, list_transform(range(1, len(ps) + 1),
      lambda i: done[i] + case when i = best then 1 else 0 end), best, ps
  from (select t, done, ps, list_min(list_transform(
      list_filter(range(1, len(ps) + 1), lambda i: done[i] < ps[i]
        and done[i] * {CYCLE} // ps[i] <= t),
      lambda i: {{'due': ((done[i] + 1) * {CYCLE} + ps[i] - 1) // ps[i], 'p': ps[i],
                  'i': i}})).i best
    from run where t < {CYCLE})),
laid as (
  select names[pick] source, t - 1 as "at", row_number() over (partition by pick order by t) - 1 turn
  from run, listed where pick is not null),
ranked as (
  select doc_id, source, row_number() over (
    partition by source order by md5(doc_id::varchar), doc_id) - 1 r from documents)
select doc_id, ranked.source, (r // {BLOCK} // p) * {CYCLE} + "at" slot, (r % {BLOCK})::int place
from ranked join shares using (source)
  join laid on laid.source = ranked.source and turn = r // {BLOCK} % p
""",
    "op8_seed_and_extend": rf"""
with words as (select doc_id, {_WORDS} w from documents),
spots as (
  select doc_id, unnest(range(1, len(w) - 48)) i, unnest(list_transform(range(1, len(w) - 48),
    lambda i: md5(array_to_string(w[i:i+49], ' ')))) fifty from words where len(w) >= 50),
windows as (
  select doc_id, i, min(doc_id) over (partition by fifty) least from spots),
gone as (
  select doc_id, list(distinct p) ps from (
    select doc_id, unnest(range(i, i + 50)) p from windows where doc_id > least) group by 1),
marked as (
  select doc_id, w, coalesce(ps, []) ps from words left join gone using (doc_id))
select doc_id, len(w) n_words, len(ps) n_removed,
  sha256(coalesce(array_to_string(case when len(ps) = 0 then w else
    list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)),
                   lambda i: w[i]) end, ' '), '')) kept_sha256
from marked
""",
}
