"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all({text}, '[^\x20\x09-\x0D]+'), [])"

SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
win as (select doc_id, i, md5(substring(hx, cast(2 * i + 1 as bigint), 200)) as h
        from (select doc_id, hx, unnest(range(0, length(hx) // 2 - 99)) as i from d) t),
bad as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as rn from win) t where rn > 1),
cut as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span
        from (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from bad) t),
spans as (select doc_id, span, min(i) as a, max(i) + 100 as b from cut group by 1, 2),
gaps as (select doc_id, span, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
kept as (select d.doc_id, d.hx, count(g.a) as n_spans, coalesce(sum(g.b - g.a), 0) as n_removed, coalesce(max(g.b), 0) as last,
                coalesce(string_agg(substring(d.hx, cast(2 * g.before + 1 as bigint), cast(2 * (g.a - g.before) as bigint)), '' order by g.a), '') as head
         from d left join gaps g on g.doc_id = d.doc_id group by d.doc_id, d.hx)
select doc_id, cast(length(hx) // 2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans,
       sha256(unhex(head || substring(hx, cast(2 * last + 1 as bigint)))) as kept_sha256
from kept
"""

EMBEDDING_DEDUP = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as materialized (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
both_ways as materialized (select x, y from pairs union all select y, x from pairs),
reach(id, root) as (select vec_id, vec_id from embeddings union select l.y, r.root from reach r join both_ways l on l.x = r.id)
select m.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, m.vec_id = c.component_id as kept
from embeddings m join (select id, min(root) as component_id from reach group by 1) c on c.id = m.vec_id
left join (select x, count(*) as n_links from both_ways group by 1) n on n.x = m.vec_id
"""

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_WORDS.format(text="text")} as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as h
        from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d) t),
seen as (select h, min(doc_id) as first_doc from win group by 1),
gone as (select distinct doc_id, i + k as i
         from (select w.doc_id, w.i from win w join seen s on s.h = w.h where s.first_doc < w.doc_id) b, unnest(range(0, 13)) as t(k)),
each_word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d),
kept as (select e.doc_id, count(g.i) as n_removed, string_agg(e.word, ' ' order by e.i) filter (where g.i is null) as words
         from each_word e left join gone g on g.doc_id = e.doc_id and g.i = e.i group by 1)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.words, '')) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = f"""
with recursive d as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
sh as materialized (select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as h
  from (select doc_id, ws, unnest(range(1, case when len(ws) = 0 then 1 else greatest(len(ws) - 4, 1) + 1 end)) as i from d) t),
n as materialized (select doc_id, count(*) as n from sh group by 1),
links as materialized (select a, b from (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as materialized (select a as x, b as y from links union all select b, a from links),
reach(id, root) as (select doc_id, doc_id from documents union select l.y, r.root from reach r join both_ways l on l.x = r.id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from d left join n on n.doc_id = d.doc_id join (select id, min(root) as component_id from reach group by 1) c on c.id = d.doc_id
"""

_TERMS = r"coalesce(regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

RANKED_SEARCH = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS.format(text=_LOWER)} as ws from documents),
total as (select count(*) as docs, sum(len(ws))::bigint as terms from d where len(ws) > 0),
t as materialized (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) x group by 1, 2),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from t, total group by term, docs),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS.format(text=_LOWER)}) as term from benchmark) x group by 1, 2),
m as (select r, doc_id, 100 - 75 + (75 * len(ws) * docs) // terms as m from d, total where len(ws) > 0),
s as (select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
      from q join t using (term) join w using (term) join m using (r) group by 1, 2, 3),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

PHRASES = r"""
with d as (select coalesce(lang, 'und') as lang, row_number() over () as r,
                  regexp_split_to_array(""" + _LOWER + r""", '[.,;:!?\x0A-\x0D]') as ps from documents),
p as (select lang, r, i, regexp_extract_all(ps[i], '[^\x20\x09]+') as ws from (select lang, r, ps, unnest(range(1, len(ps) + 1)) as i from d) x),
occ as (select lang, k, array_to_string(ws[j:j + k - 1], ' ') as phrase
        from (select lang, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) as j from p, (select unnest([1, 2, 3, 4]) as k) ks) x),
f as materialized (select lang, k, phrase, count(*) as f from occ group by 1, 2, 3),
total as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 30),
cuts as (select lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:k], ' ') as tail
         from (select *, unnest(range(1, k)) as j from c) x),
scored as (select x.lang, x.k, x.phrase, x.a, x.j, h.f as l, t.f as r, ((2000000::hugeint * x.a) // (h.f + t.f))::bigint as score
           from cuts x join f h on h.lang = x.lang and h.phrase = x.head and h.k = x.j join f t on t.lang = x.lang and t.phrase = x.tail and t.k = x.k - x.j),
least_cut as (select * from (select *, row_number() over (partition by lang, k, phrase order by score, j) as place from scored) x where place = 1),
inner_ones as (select lang, kk as k, array_to_string(ws[j:j + kk - 1], ' ') as phrase, max(a) as longer
               from (select lang, a, ws, kk, unnest(range(1, k - kk + 2)) as j from c, (select unnest([2, 3]) as kk) ks where kk < k) x group by 1, 2, 3),
left_over as (select s.* from least_cut s left join inner_ones i on i.lang = s.lang and i.k = s.k and i.phrase = s.phrase
              where i.longer is null or 100 * i.longer::hugeint < 80 * s.a::hugeint),
ranked as (select lang, phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from left_over)
select x.lang, x.rank, x.phrase, x.a, x.l, x.r, t.n, x.score from ranked x join total t using (lang) where x.rank <= 2000
"""

ORACLES = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op3_embedding_dedup": EMBEDDING_DEDUP,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op8_jaccard_join": JACCARD_JOIN,
    "op11_ranked_search": RANKED_SEARCH,
    "op13_phrases": PHRASES,
}
