"""DuckDB SQL of the registered queries, over views of the same tables."""

from __future__ import annotations

from .. import params
from ..functions import questions as Q
from .overlay import ANSWERS, BOOKS, CHUNKS, EXPECTED, PAGES, QUESTIONS, SECOND


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    """A pattern as a literal; RE2 takes the same syntax here but for flags in front, which it shares."""
    return _text(pattern)


STOP = "[" + ",".join(_text(w) for w in params.STOP_WORDS) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def toks(x: str) -> str:
    words = f"string_split(regexp_replace(lower(coalesce({x},'')), '[^a-z0-9\\x{{0900}}-\\x{{097F}}]+', ' ', 'g'), ' ')"
    stem = "case when regexp_matches(t, '^[0-9]') or length(t) < 5 then t when t like '%ies' then regexp_replace(t, 'ies$', 'y') else regexp_replace(t, '(ments|ment|ings|ing|edly|ed|es|s)$', '') end"
    return f"list_transform(list_filter({words}, lambda t: length(t) > 1 and not list_contains({STOP}, t)), lambda t: {stem})"


def line_key(x: str) -> str:
    return "lower(" + strip(f"regexp_replace({x}, '[0-9]+', '', 'g')") + ")"


def useful(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def coverage(q: str, t: str) -> str:
    return f"case when len(list_distinct({q})) > 0 then len(list_intersect(list_distinct({q}), {t})) / len(list_distinct({q}))::double else 0.0 end"


def comparable(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[“”\"''‘’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def mentions(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, {_re(params.MENTION)}, 1), lambda a: upper(a))))"


CH = f"""ch as (select *, case when article is null then [] else [article] end as article_numbers, {mentions('text')} as mentions,
 concat(concat_ws(' — ', book_title, nullif(part, ''), case when section_type = 'article' and article is not null then concat('Article ', article, case when article_title is not null then concat(': ', article_title) else '' end) end), chr(10), text) as search_text from ({CHUNKS}))"""

#: What is searched of each chunk.
INDEXED = f"ix as (select id as chunk_id, {toks("concat_ws(' ', search_text, array_to_string(mentions, ' '))")} as ts from ch)"

NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\\x{00AD}\\x{200B}\\x{FEFF}]', '', 'g'), '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g')"
REPEATING = f"""pg as ({PAGES}), pl as (select book_file, pdf_page, list_transform(string_split(coalesce(text,''), chr(10)), lambda l: {strip('l')}) as lines from pg),
 edge as (select book_file, pdf_page, unnest(list_distinct(list_filter(list_transform(list_concat(lines[1:3], lines[greatest(1,len(lines)-2):]), lambda l: {line_key('l')}), lambda k: length(k) > 3))) as key from pl),
 bs as (select book_file, count(*) as pages from pg group by book_file),
 rep as (select book_file, key, n_pages from (select book_file, key, count(*) as n_pages from edge group by book_file, key) join bs using (book_file) where n_pages >= greatest(3, floor(pages * 0.1)))"""
HDR, HP, LONE = _re(params.HEADER), _re(params.HEADER_PART), _re(params.LONE_NUMBER)
CLEAN = f"""{REPEATING}, ln as (select book_file, pdf_page, unnest(lines) as s, generate_subscripts(lines, 1) - 1 as i, len(lines) as n from pl),
 lt as (select ln.*, regexp_matches(s, {HDR}) and length(s) < 140 as hdr, r.key is not null and length(s) < 140 and s <> '' as rpt, regexp_matches(s, {LONE}) and (i < 3 or i >= n - 3) as num from ln left join rep r on r.book_file = ln.book_file and r.key = {line_key('s')}),
 cp as (select book_file, pdf_page,
  arg_min(try_cast(regexp_extract(s, {LONE}, 1) as int), i) filter (where not hdr and not rpt and num and try_cast(regexp_extract(s, {LONE}, 1) as int) <> 0) as printed_page,
  arg_max(concat('Part ', upper(regexp_extract(s, {HP}, 1)), case when trim(regexp_extract(s, {HP}, 2)) <> '' then concat(' — ', regexp_replace(regexp_extract(s, {HP}, 2), '^[ .—-]+|[ .—-]+$', '', 'g')) else '' end), i) filter (where hdr and regexp_matches(s, {HP})) as header_part,
  coalesce(string_agg(s, chr(10) order by i) filter (where not hdr and not rpt and not num), '') as t from lt group by all),
 clean as (select book_file, pdf_page, printed_page, header_part, {strip(NORMAL)} as text from cp),
 pf as (select *, {useful('text')} as useful, false as devanagari, {useful('text')} >= 40 as kept from clean)"""


def toc(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
    hits = f"len(list_filter({lines}, lambda l: regexp_matches(l, {_re(params.TOC_LINE)})))"
    return f"(len({lines}) > 0 and ((regexp_matches(substr({x}, 1, 400), {_re(params.TOC_MARKER)}) and {hits} >= 3) or 2 * {hits} > len({lines})))"


def title(x: str) -> str:
    """Capitals after every sign that is not a letter."""
    chars = f"string_split(lower({x}), '')"
    return f"array_to_string(list_transform({chars}, lambda c, k: case when k = 1 or not regexp_matches({chars}[k - 1], '\\p{{L}}') then upper(c) else c end), '')"


PART, CHAP, SCHED, ART = (_re(p) for p in (params.PART, params.CHAPTER, params.SCHEDULE, params.ARTICLE))
EVENTS = f"""{CLEAN}, bk as ({BOOKS}), tp as (select pf.book_file, pdf_page, printed_page, header_part, text, bk.kind as book_kind, {toc('text')} as is_toc from pf join bk on bk.file = pf.book_file where kept),
 ev0 as (select book_file, pdf_page, printed_page, book_kind, 0 as n, 'header' as k0, header_part as s from tp where header_part is not null
  union all select book_file, pdf_page, printed_page, book_kind, 1, 'toc', text from tp where is_toc
  union all select book_file, pdf_page, printed_page, book_kind, 2, 'text', '' from tp where is_toc
  union all select * from (select book_file, pdf_page, printed_page, book_kind, 1 + generate_subscripts(ls, 1) as n, 'line' as k0, unnest(ls) as s from (select *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') as ls from tp where not is_toc))),
 ev1 as (select *, case when k0 <> 'line' or book_kind <> 'constitution' then k0 when regexp_matches(s, {PART}) and length(s) < 80 then 'part' when regexp_matches(s, {CHAP}) and length(s) < 90 then 'chapter' when regexp_matches(s, {SCHED}) then 'schedule' when regexp_matches(s, {ART}) then 'article' else k0 end as k1 from ev0),
 ev2 as (select *, coalesce(lag(k1 = 'part' and trim(regexp_extract(s, {PART}, 2)) = '') over (partition by book_file, k1 in ('header','toc','text') order by pdf_page, n), false) as pending from ev1),
 ev as (select book_file, pdf_page, printed_page, n, s, case when k1 not in ('header','toc','text','part') and pending and upper(s) = s and lower(s) <> s and length(s) < 60 then 'title' else k1 end as kind from ev2)"""
SEGMENTS = f"""{EVENTS}, sb as (select *, case when kind = 'header' then s when kind = 'part' then concat('Part ', regexp_extract(s, {PART}, 1), case when trim(regexp_extract(s, {PART}, 2)) <> '' then concat(' — ', {title(f'trim(regexp_extract(s, {PART}, 2))')}) else '' end) end as base0 from ev),
 sc as (select *, last_value(base0 ignore nulls) over w as base from sb window w as (partition by book_file order by pdf_page, n rows unbounded preceding)),
 sd as (select *, last_value(coalesce(base0, case when kind = 'title' then concat(base, ' — ', {title('s')}) end) ignore nulls) over w as run_part,
  last_value(case when kind = 'chapter' then concat('Chapter ', upper(regexp_extract(s, {CHAP}, 1)), case when trim(regexp_extract(s, {CHAP}, 2)) <> '' then concat(' — ', {title(f'trim(regexp_extract(s, {CHAP}, 2))')}) else '' end) when kind = 'part' then '' end ignore nulls) over w as run_chapter,
  sum(case when kind in ('toc','text','part','schedule','article') then 1 else 0 end) over w as opened, row_number() over w as rn from sc window w as (partition by book_file order by pdf_page, n rows unbounded preceding)),
 se as (select *, opened + max(case when rn = 1 and opened = 0 then 1 else 0 end) over (partition by book_file) as seg from sd),
 sf as (select *, row_number() over (partition by book_file, seg order by pdf_page, n) = 1 as head from se),
 sg as (select book_file, seg, max(pdf_page) filter (where head) as pdf_page, max(printed_page) filter (where head) as printed_page,
  coalesce(max(run_part) filter (where kind = 'title'), max(case when kind = 'schedule' then concat({title(f'regexp_extract(s, {SCHED}, 1)')}, ' Schedule') else run_part end) filter (where head)) as part,
  max(case when kind <> 'schedule' then nullif(run_chapter, '') end) filter (where head) as chapter,
  max(case when kind = 'article' then upper(regexp_extract(s, {ART}, 1)) end) filter (where head) as article, max(case when kind = 'article' then trim(regexp_extract(s, {ART}, 2)) end) filter (where head) as article_title,
  max(case when kind in ('toc','schedule','article') then kind else 'text' end) filter (where head) as section_type,
  {strip("coalesce(string_agg(s, chr(10) order by pdf_page, n) filter (where kind not in ('header','part','title','chapter') and s <> ''), '')")} as text from sf group by book_file, seg)"""

LEX = f"""tk as (select doc_id, {toks('text')} as ts from documents), post as (select term, chunk_id, count(*)::int as tf, any_value(len) as len from (select doc_id as chunk_id, len(ts) as len, unnest(ts) as term from tk) group by all),
 dfs as (select term, count(*) as df from post group by term), st as (select count(*) as n, avg(len(ts)) as avgdl from tk),
 qt as (select query_id, term, idx as tpos from (select item_id as query_id, unnest(list_distinct_in_order) as term, generate_subscripts(list_distinct_in_order, 1) as idx from (select item_id, list_filter(qs, lambda t, i: list_position(qs, t) = i) as list_distinct_in_order from (select item_id, {toks('text')} as qs from benchmark)))),
 wq as (select query_id, qt.term, tpos, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) as idf, avgdl from qt left join dfs using (term) cross join st)"""
TOPK = f"""{LEX}, sc as (select query_id, chunk_id, sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) order by tpos) as score from wq join post using (term) group by all),
 tk30 as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from sc where score > 0 qualify rank < 30)"""
#: The same over the chunks as they are indexed.
TOPK_INDEXED = TOPK.replace(f"(select doc_id, {toks('text')} as ts from documents)", "(select chunk_id as doc_id, ts from ix)")
#: The vectors whose id is twenty times a question's, against all; ids of vectors are those of documents.
DENSE = """de as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings), dn as (select q.vec_id // 20 as query_id, d.vec_id as chunk_id, list_inner_product(q.e, d.e) as score from de q, de d where q.vec_id % 20 = 0),
 oth as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from dn where query_id in (select item_id from benchmark) qualify rank < 30)"""
#: The same for an index with a vector for each document, that of its id modulo their number; ``qv`` are the questions that have one.
DENSE_ALL = """de as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings), nv as (select count(*) as m from embeddings),
 ok as (select (select count(*) from documents) = count(*) and min(len(e)) = max(len(e)) as full, max(len(e)) as dim from documents, nv join de on true where vec_id = doc_id % m),
 qv as (select vec_id // 20 as query_id, e from de, ok where vec_id % 20 = 0 and ok.full and len(e) = ok.dim and vec_id // 20 in (select item_id from benchmark)),
 dn as (select q.query_id, doc_id as chunk_id, list_inner_product(q.e, d.e) as score from qv q, documents, nv, de d where d.vec_id = doc_id % m),
 oth as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from dn qualify rank < 30)"""
FUSED = f"""{TOPK}, {DENSE}, ls as (select query_id, chunk_id, 0 as l, rank from tk30 union all select query_id, chunk_id, 1, rank from oth),
 fz as (select query_id, chunk_id, coalesce(max(1.0::double / (61 + rank)) filter (where l = 0), 0) + coalesce(max(1.0::double / (61 + rank)) filter (where l = 1), 0) as rrf, min(l * 1000 + rank) // 1000 as first_list, min(l * 1000 + rank) % 1000 as first_rank from ls group by all)"""

TURNS = f"bt as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations)"

SAN = "trim(regexp_replace(regexp_replace(question, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))"
ALIST = _re(Q.ARTICLE_LIST)


def numbers(x: str) -> str:
    """Articles in words as digits: first tens with what follows, then single words."""
    words, sums = params.NUMBER_WORDS, {}
    for t in (w for w, n in words.items() if n >= 20):
        for u, n in words.items():
            sums.setdefault(words[t] + n, []).append(f"{t}[-\\s]{u}")
    for value, phrases in [*sums.items(), *((n, [w]) for w, n in words.items())]:
        x = f"regexp_replace({x}, '(?i)\\barticle\\s+(?:{'|'.join(phrases)})\\b', 'Article {value}', 'g')"
    return x


def articles(x: str) -> str:
    """Article numbers of the overlay's questions: lists and short ranges."""
    parts = f"list_transform(flatten(list_transform(regexp_extract_all({x}, {ALIST}, 1), lambda s: string_split(regexp_replace(s, '(?i)\\s*(?:,|and|&)\\s*', ',', 'g'), ','))), lambda p: trim(p))"
    rng = "regexp_full_match(p, '(?i)\\d{1,4}\\s*(?:to|-)\\s*\\d{1,4}')"
    a, b = "cast(regexp_extract(p, '^(\\d{1,4})', 1) as int)", "cast(regexp_extract(p, '(\\d{1,4})$', 1) as int)"
    one = f"case when {rng} then (case when {b} > {a} and {b} - {a} <= 12 then list_transform(range({a}, {b} + 1), lambda v: v::varchar) else [regexp_extract(p, '^(\\d{{1,4}})', 1)] end) when regexp_full_match(p, '(?i)\\d{{1,4}}[a-z]{{0,3}}') then [upper(p)] else [] end"
    return f"flatten(list_transform({parts}, lambda p: {one}))"


ASKED = f"""q1 as (select query_id, {SAN} as question from ({QUESTIONS})), q2 as (select query_id, question, {numbers('question')} as qn from q1),
 qa as (select query_id, question, {articles('qn')} as al from q2), asked as (select query_id, question, list_filter(al, lambda a, i: list_position(al, a) = i) as articles from qa)"""
HINTS = "flatten([" + ", ".join(f"case when regexp_matches(question, {_re('(?i)' + p)}) then [{', '.join(map(_text, a))}] else [] end" for p, a, _ in params.CONCEPTS) + "])"
TERMS = "list_filter([question, " + ", ".join(f"case when regexp_matches(question, {_re('(?i)' + p)}) then {_text(t)} end" for p, _, t in params.CONCEPTS) + "], lambda x: x is not null)"
APOST = f"{CH}, ap as (select article, id as chunk_id, row_number() over (partition by article order by id) - 1 as pos from ch where article is not null)"

ANS = f"an as (select *, ['3', (conv_id % 12)::varchar] as known from ({ANSWERS}))"
VALID = "(k::int between 1 and n_sources)"
CITED_IN = f"""ci as (select query_id, known, n_sources, context, answer, regexp_extract_all(answer, '\\[(\\d{{1,2}})\\]', 1) as ks, string_split(regexp_replace(answer, '\\[(\\d{{1,2}})\\]', chr(1), 'g'), chr(1)) as bits from an),
 cj as (select *, list_filter(ks, lambda k: not {VALID}) as bad, array_to_string(list_transform(bits, lambda b, i: concat(b, case when i <= len(ks) and (ks[i]::int between 1 and n_sources) then concat('[', ks[i], ']') else '' end)), '') as text from ci)"""
CITED = f"{ANS}, {CITED_IN}"
BLOCK = f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches({strip('l')}, '^>')), lambda l: {strip(chr(114) + 'egexp_replace(regexp_replace(l, ' + chr(39) + '^' + chr(92) + 's*>' + chr(92) + 's?' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + chr(92) + '[[0-9]+' + chr(92) + ']' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}), ' ')"


def quoted(frm: str) -> str:
    return f"qs as (select *, list_concat(regexp_extract_all(text, '[\"“]([^\"”]{{20,}})[\"”]', 1), case when length({BLOCK}) >= 20 then [{BLOCK}] else [] end) as quotes from {frm})"


def support(q: str, c: str) -> str:
    w = f"string_split({comparable(q)}, ' ')"
    g = f"(case when len({w}) < 3 then [{comparable(q)}] else list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' ')) end)"
    return f"(case when {comparable(q)} = '' or contains({comparable(c)}, {comparable(q)}) then 1.0 else len(list_filter({g}, lambda g: contains({comparable(c)}, g))) / len({g})::double end)"


GROUND_IN = f"""{CITED_IN}, {quoted('cj')}, qx as (select query_id, unnest(quotes) as quote, context from qs), qn as (select query_id, count(*) filter (where {support('quote', 'context')} < 0.9) as bad_quotes from qx group by query_id),
 na as (select query_id, known, context, len(bad) as n_invalid, list_transform(regexp_extract_all(text, '(?i)\\bArticles?\\s+(\\d{{1,3}}[A-Z]{{0,3}})\\b', 1), lambda a: upper(a)) as named from cj),
 nu as (select query_id, n_invalid, list_filter(named, lambda a, i: list_position(named, a) = i and not list_contains(known, a) and not regexp_matches(context, concat('(?i)\\b', a, '\\b'))) as unknown from na),
 gr as (select nu.query_id, coalesce(bad_quotes, 0) as n_unverified, unknown, n_invalid, coalesce(bad_quotes, 0) = 0 and len(unknown) = 0 and n_invalid = 0 as verified from nu left join qn using (query_id))"""
GROUND = f"{ANS}, {GROUND_IN}"


def retrieved(dense: bool) -> str:
    """CTEs from ``asked(query_id, question, articles)`` and ``ap``, ``ch`` to ``planned`` and ``selected``, as the plans define them."""
    hint = 2 if dense else 1
    jac = "len(list_intersect(z, toks)) > 0.8 * greatest(1, len(list_distinct(list_concat(z, toks))))"
    ok = f"not list_contains(ids, chunk_id) and n_chars <= room and (pinned or (n < 7 and not (section_type = 'toc' and n > 2) and len(list_filter(sets, lambda z: {jac})) = 0))"
    return f"""un as (select *, {HINTS} as h0, array_to_string({TERMS}, ' ') as expanded, regexp_matches(question, {_re(params.PURE_ARTICLE)}) as pure,
  case when regexp_matches(question, {_re(params.INJECTION)}) then 'injection' when regexp_matches(question, {_re(params.GREETING)}) then 'greeting' when regexp_matches(question, {_re(params.OFFTOPIC)}) then 'offtopic' else 'question' end as intent from asked),
 live as (select *, list_filter(h0, lambda a, i: list_position(h0, a) = i) as hints, {toks('expanded')} as et, {toks('question')} as ot from un where intent not in ('greeting', 'injection')),
 ct as (select id as chunk_id, section_type, length(text) as n_chars, {toks("concat_ws(' ', search_text, array_to_string(mentions, ' '))")} as ts, {toks('search_text')} as ss, list_distinct({toks('text')}) as toks from ch),
 post as (select term, chunk_id, count(*)::int as tf, any_value(len) as len from (select chunk_id, len(ts) as len, unnest(ts) as term from ct) group by all),
 dfs as (select term, count(*) as df from post group by term), st as (select count(*) as n, avg(len(ts)) as avgdl from ct),
 qt as (select query_id, unnest(dt) as term, generate_subscripts(dt, 1) as tpos from (select query_id, list_filter(et, lambda t, i: list_position(et, t) = i) as dt from live)),
 oq as (select query_id, unnest(dt) as term, generate_subscripts(dt, 1) as tpos from (select query_id, list_filter(ot, lambda t, i: list_position(ot, t) = i) as dt from live)),
 wq as (select query_id, term, tpos, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) as idf, avgdl from qt left join dfs using (term) cross join st),
 idl as (select query_id, sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * 2.5 * 0.5 order by tpos) as ideal from oq left join dfs using (term) cross join st group by 1),
 sc as (select query_id, chunk_id, sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) order by tpos) as score from wq join post using (term) group by all),
 bm as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as rank from sc where score > 0 qualify rank < 30),
 pa as (select query_id, chunk_id, min(apos * 10 + pos) as k from (select query_id, unnest(articles) as article, generate_subscripts(articles, 1) as apos from live) join ap using (article) where pos < 3 group by all),
 pins as (select query_id, chunk_id, row_number() over (partition by query_id order by k) - 1 as place from pa),
 ha as (select query_id, chunk_id, min(apos) as k from (select query_id, unnest(hints) as article, generate_subscripts(hints, 1) as apos from live where len(articles) = 0) join ap using (article) where pos = 0 group by all),
 hn as (select query_id, chunk_id, row_number() over (partition by query_id order by k, chunk_id) - 1 as rank from ha),
 ls as (select query_id, chunk_id, 0 as l, rank from bm union all select query_id, chunk_id, {hint}, rank from hn {"union all select query_id, chunk_id, 1, rank from oth where query_id in (select query_id from live)" if dense else ""}),
 fz as (select query_id, chunk_id, {' + '.join(f"coalesce(max(1.0::double / (61 + rank)) filter (where l = {l}), 0)" for l in range(hint + 1))} as rrf, min(l * 1000 + rank) as first from ls group by all),
 rk as (select query_id, chunk_id, rrf + 0.02::double * {coverage('et', 'ss')} as score, row_number() over (partition by query_id order by rrf + 0.02::double * {coverage('et', 'ss')} desc, first) - 1 as rank from fz join live using (query_id) join ct using (chunk_id) qualify rank < 12),
 cand as (select c.*, section_type, n_chars, toks, row_number() over (partition by query_id order by pinned desc, pos, chunk_id) as k
  from (select query_id, chunk_id, 1.0::double as score, true as pinned, place as pos from pins union all select query_id, chunk_id, score, false, rank from rk) c join ct using (chunk_id)),
 rc(query_id, k, ids, sets, room, n, chunk_id, score, pinned, took) as (select distinct query_id, 0::bigint, []::bigint[], []::varchar[][], 14000::bigint, 0, null::bigint, null::double, null::boolean, false from cand
  union all select query_id, k, case when take then list_append(ids, chunk_id) else ids end, case when take then list_append(sets, toks) else sets end, case when take then room - n_chars else room end, case when take then n + 1 else n end, chunk_id, score, pinned, take
  from (select rc.query_id, cand.k, ids, sets, room, n, cand.chunk_id, cand.score, cand.pinned, toks, n_chars, ({ok.replace('chunk_id', 'cand.chunk_id').replace('pinned', 'cand.pinned')}) as take from rc join cand on cand.query_id = rc.query_id and cand.k = rc.k + 1)),
 selected as (select query_id, chunk_id, score, pinned, n from rc where took),
 tp as (select query_id, arg_min(chunk_id, pinned::int * 1000 + n) as chunk_id from selected group by query_id),
 cf as (select live.query_id, live.query_id in (select query_id from pins) as exact, live.query_id in (select query_id from hn) as hinted, case when ss is not null then {coverage('ot', 'ss')} else 0.0 end as cov, coalesce(bm.score / greatest(1e-6, coalesce(ideal, 0)), 0) as ratio
  from live left join tp using (query_id) left join ct on ct.chunk_id = tp.chunk_id left join bm on bm.query_id = live.query_id and bm.rank = 0 left join idl on idl.query_id = live.query_id),
 pl0 as (select un.query_id, question, intent, articles, case when cf.query_id is null then 'low' when exact then 'high' when len(articles) > 0 then 'low' when intent = 'offtopic' then case when cov >= 0.8 and ratio > 0.6 then 'medium' else 'low' end
   when hinted and cov >= 0.3 then 'high' when cov >= 0.6 and ratio > 0.35 then 'high' when cov >= 0.4 and ratio > 0.2 then 'medium' else 'low' end as confidence,
  {"case when cf.query_id is not null and un.query_id in (select query_id from qv) then 'hybrid' else 'bm25' end" if dense else "'bm25'"} as mode, coalesce(exact and pure, false) as pure_article from un left join cf using (query_id)),
 planned as (select *, case when intent in ('greeting', 'injection') then 'canned' when confidence = 'low' then 'refusal' else 'answer' end as kind,
  case when intent in ('greeting', 'injection') then intent when confidence = 'low' then case when intent = 'offtopic' then 'offtopic' else 'low confidence' end end as reason from pl0)"""


#: Questions with the turns before them.
WITH_HISTORY = f"""q0 as ({QUESTIONS}), t0 as (select c.conv_id, c.turn, c.role, q0.query_id, coalesce(q0.question, c.text) as content from conversations c left join q0 on q0.conv_id = c.conv_id and q0.turn = c.turn where c.role in ('user', 'assistant')),
 h0 as (select *, list({{'r': role, 'c': content}}) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding) as hist from t0),
 h1 as (select query_id, {SAN} as content, hist from (select query_id, content as question, hist from h0 where query_id is not null union all select query_id, question, [] from q0 where query_id < 0)),
 h2 as (select *, list_filter(hist, lambda x: x.r = 'user' and x.c is not null and x.c <> content)[-1].c as prev from h1), h3 as (select *, {articles('cn')} as own, {articles('pn')} as pr from (select *, {numbers('content')} as cn, {numbers('prev')} as pn from h2)),
 h4 as (select query_id, case when len(own) = 0 and regexp_matches(content, {_re(params.FOLLOW_UP)}) and length(content) < 120 and prev is not null then case when len(pr) > 0 then concat(content, ' (Article ', array_to_string(list_filter(pr, lambda a, i: list_position(pr, a) = i), ', Article '), ')') else concat(content, ' (context: ', substr(prev, 1, 150), ')') end else content end as question from h3),
 h5 as (select query_id, question, {articles('qn')} as al from (select *, {numbers('question')} as qn from h4)), asked as (select query_id, question, list_filter(al, lambda a, i: list_position(al, a) = i) as articles from h5)"""
RETRIEVED = f"{WITH_HISTORY}, {APOST}, {retrieved(False)}"
HYBRID = f"""b0 as (select item_id as query_id, text as question from benchmark), b1 as (select query_id, {SAN} as question from b0), b2 as (select query_id, question, {articles('qn')} as al from (select *, {numbers('question')} as qn from b1)),
 asked as (select query_id, question, list_filter(al, lambda a, i: list_position(al, a) = i) as articles from b2), {APOST}, {DENSE_ALL}, {retrieved(True)}"""
PLANS = "query_id, question, intent, array_to_string(articles, ',') as articles, confidence, mode, pure_article, kind, reason"
CONTEXT = """cx as (select query_id, count(*)::int as n_sources, string_agg(text, chr(10) order by n) as context, list_distinct(flatten(list(list_concat(article_numbers, mentions)))) as known from selected join ch on ch.id = chunk_id group by query_id)"""
BLOCKS = "string_agg(concat('[', n, '] (', concat_ws(' | ', concat('Book: ', book_title), concat('PDF p. ', pdf_page), part, case when article is not null then concat('Article ', article) end), ')', chr(10), text), chr(10) || chr(10) order by n)"
OUTCOMES = f"""{CONTEXT}, ex as ({EXPECTED}), oc as (select query_id, not refuse as positive, kind <> 'answer' as refused, confidence, question, case when refuse then kind <> 'answer'
  else kind = 'answer' and (len(list_intersect(list_filter(string_split(ex.articles, ','), lambda a: a <> ''), coalesce(known, []))) > 0 or len(list_filter(string_split(keywords, ','), lambda w: w <> '' and contains(lower(coalesce(context, '')), lower(w)))) > 0) end as ok from ex join planned using (query_id) left join cx using (query_id))"""

SPLIT = r"""string_split(regexp_replace(regexp_replace(text, '\n(\s*\(\d+[A-Z]?\)\s)', chr(2) || '\1', 'g'), '\n(\s*\([a-z]\)\s)', chr(2) || '\1', 'g'), chr(2))"""
PIECES = rf"""flatten(list_transform({SPLIT}, lambda c: case when length(c) <= 800 then [replace(c, chr(10), ' ')] else string_split(regexp_replace(replace(c, chr(10), ' '), '([.;:])\s+([A-Z("])', '\1' || chr(2) || '\2', 'g'), chr(2)) end))"""


def packed(src: str) -> str:
    """CTEs (recursive) that pack the texts of ``src(kid, text)`` to ``pk(kid, piece_no, text)``."""
    tail = "right(buf, 150)"
    carry = f"case when strpos({tail}, '. ') > 0 then substr({tail}, strpos({tail}, '. ') + 2) else '' end"
    return f"""pp0 as (select kid, text, unnest({PIECES}) as piece, generate_subscripts({PIECES}, 1) as n from {src} where length(text) > 900),
 pp as (select kid, {strip('piece')} as s, row_number() over (partition by kid order by n) as k from pp0 where {strip('piece')} <> ''),
 rc as (select kid, k, s as buf, null::varchar as done from pp where k = 1
  union all select pp.kid, pp.k, case when length(buf) + length(s) + 1 <= 800 then buf || ' ' || s else {strip(f"concat({carry}, ' ', s)")} end, case when length(buf) + length(s) + 1 <= 800 then null else buf end from rc join pp on pp.kid = rc.kid and pp.k = rc.k + 1),
 ck as (select kid, k, done as c from rc where done is not null union all select kid, max(k) + 1, arg_max(buf, k) from rc group by kid),
 wn as (select kid, k, c, greatest(0, ceil((length(c) - 1800) / 650.0))::int as w from ck),
 ws as (select kid, k, i, case when i < w then substr(c, 650 * i + 1, 800) else substr(c, 650 * i + 1) end as t from (select *, unnest(range(0, w + 1)) as i from wn) union all select kid, 1, 0, text from {src} where length(text) <= 900),
 pk as (select kid, row_number() over (partition by kid order by k, i) - 1 as piece_no, {strip("regexp_replace(t, '" + chr(92) + "s+', ' ', 'g')")} as text from ws)"""


BUILD = f"""with recursive {SEGMENTS}, sx as (select *, book_file || chr(1) || seg as kid from sg where text <> ''), {packed('sx')},
 c0 as (select sx.* exclude (text), pk.piece_no, pk.text from pk join sx using (kid) join bk on bk.file = book_file where bk.include and (section_type = 'toc' or {useful('pk.text')} >= 120)),
 c1 as (select * from c0 qualify row_number() over (partition by book_file, substr(lower(text), 1, 300) order by seg, piece_no) = 1),
 c2 as (select c1.*, bk.title as book_title, {mentions('text')} as ms, row_number() over (order by bk.position, seg, piece_no) - 1 as id from c1 join bk on bk.file = c1.book_file)
 select id, book_file, book_title, pdf_page, printed_page, part, chapter, coalesce(article, '') as article_numbers, article_title, array_to_string(ms, ',') as mentions, section_type, text,
  concat(concat_ws(' — ', book_title, nullif(part, ''), nullif(chapter, ''), case when section_type = 'article' and article is not null then concat('Article ', article, case when article_title <> '' then concat(': ', article_title) else '' end) end), chr(10), text) as search_text from c2"""

ORACLE: dict[str, str] = {
    "line_keys": f"select doc_id, n, {line_key('line')} as key from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents)",
    "repeating_lines": f"with {REPEATING} select book_file, key, n_pages from rep",
    "clean_pages": f"with {CLEAN} select book_file, pdf_page, printed_page, header_part, text from clean",
    "page_filter": f"with {CLEAN} select book_file, pdf_page, useful, devanagari, kept from pf",
    "book_preview": f"with pg as ({PAGES}) select book_file, count(*) as pages, arg_min(substr({strip('text')}, 1, 800), pdf_page) filter (where pdf_page <= 3 and {strip('text')} <> '') as text from pg group by book_file",
    "book_registry": f"with b as ({BOOKS}) select file, title, case when file in (select source from documents) then 'ok' else 'missing' end as status from b where include",
    "toc_pages": f"with pg as ({PAGES}) select book_file, pdf_page, {toc('text')} as toc from pg",
    "line_markers": f"with {EVENTS} select book_file, kind, count(*) as n from ev group by all",
    "segments": f"with {SEGMENTS} select * from sg where text <> ''",
    "chunk_pieces": r"""with d as (select doc_id, text, string_split(regexp_replace(regexp_replace(text, '\n(\s*\(\d+[A-Z]?\)\s)', chr(2) || '\1', 'g'), '\n(\s*\([a-z]\)\s)', chr(2) || '\1', 'g'), chr(2)) as cl from documents),
 p as (select doc_id, case when length(text) <= 900 then [text] else flatten(list_transform(cl, lambda c: case when length(c) <= 800 then [replace(c, chr(10), ' ')] else string_split(regexp_replace(replace(c, chr(10), ' '), '([.;:])\s+([A-Z("])', '\1' || chr(2) || '\2', 'g'), chr(2)) end)) end as ps from d)
 select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as n from p""",
    "chunk_pack": f"with recursive sx as (select doc_id as kid, text from documents), {packed('sx')} select kid as id, 'text' as section_type, piece_no, text from pk where {useful('text')} >= 120",
    "chunk_build": BUILD,
    "rate_limit": """with recursive e as (select user_id::varchar as key, event_id as id, epoch_ms(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
 r as (select key, rn, id, [t] as held, true as allowed from e where rn = 1
  union all select key, rn, id, case when len(h) < 4 then list_append(h, t) else h end, len(h) < 4 from (select e.key, e.rn, e.id, e.t, list_filter(r.held, lambda x: e.t - x < 86400000) as h from r join e on e.key = r.key and e.rn = r.rn + 1))
 select id, allowed from r""",
    "chunk_dedupe": "select min(doc_id) as doc_id from documents group by substr(lower(text), 1, 300)",
    "chunk_ids": f"with c as ({CHUNKS}), b as ({BOOKS}) select id as old, row_number() over (order by position, id) - 1 as id from c join b on b.file = c.book_file",
    "article_mentions": f"select id, array_to_string({mentions('text')}, ',') as mentions from ({CHUNKS})",
    "search_text": f"with {CH} select id, search_text from ch",
    "book_stats": f"with {CLEAN}, c as ({CHUNKS}), n as (select book_file, count(*) as chunks from c group by 1) select book_file, count(*) as pages, count(*) filter (where not kept) as pages_dropped, coalesce(max(chunks), 0) as chunks from pf left join n using (book_file) group by book_file",
    "quality_report": f"with {CH}, j as (select *, regexp_matches(text, {HDR}) or ({useful('text')} < 120 and section_type <> 'toc') as junk from ch) select count(*) as n_chunks, round(sum(length(text)) / greatest(count(*), 1)::double, 6) as avg_chars, round(100.0::double * count(*) filter (where len(article_numbers) > 0) / greatest(count(*), 1), 6) as tagged_pct, count(*) filter (where junk) as n_junk, round(count(*) filter (where junk) / greatest(count(*), 1)::double, 6) as junk_share from j",
    "junk_chunks": f"with {CH} select id from ch where regexp_matches(text, {HDR}) or ({useful('text')} < 120 and section_type <> 'toc')",
    "chunk_sample": "select doc_id as id from documents order by md5(concat('seed', doc_id)), doc_id limit 10",
    "article_index": f"with {CH} select article, string_agg(id::varchar, ',' order by id) as ids from ch where article is not null group by article",
    "key_check": f"with {CH} select k as article, case when k in (select article from ch where article is not null) then 'OK' else 'MISSING' end as status from (select unnest(['21', '21A', '32', '14', '368']) as k)",
    "manifest": f"with {CLEAN}, {CH}, bp as (select count(*) as pages, count(*) filter (where not kept) as pages_dropped, count(distinct book_file)::int as n_books from pf) select count(*) as count, count(distinct article)::int as articles_indexed, 'model' as embedding_model, 64 as dim, any_value(n_books) as n_books, count(*) as book_chunks, any_value(pages) as pages, any_value(pages_dropped) as pages_dropped from ch, bp",
    "tokenise": f"with {LEX} select doc_id, array_to_string(ts, ' ') as tokens, len(ts) as n_tokens from tk",
    "bm25_index": f"with {LEX} select term, chunk_id, tf, len from post",
    "bm25_idf": f"with {LEX} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs cross join st",
    "bm25_topk": f"with {TOPK} select query_id, chunk_id as doc_id, round(score, 6) as score, rank from tk30",
    "bm25_bounded": f"with {CH}, {INDEXED}, {TOPK_INDEXED} select query_id, chunk_id, round(score, 6) as score, rank from tk30",
    "bm25_ideal": f"with {LEX} select item_id as query_id, round(coalesce(s, 0), 6) as ideal from benchmark left join (select query_id, sum(idf * 2.5 * 0.5 order by tpos) as s from wq group by 1) on query_id = item_id",
    "query_coverage": f"with {TURNS} select conv_id, turn, round({coverage(toks('text'), toks('before'))}, 6) as coverage from bt where before is not null",
    "token_jaccard": f"with {TURNS} select conv_id, turn, round(len(list_intersect({toks('text')}, {toks('before')})) / greatest(1, len(list_distinct(list_concat({toks('text')}, {toks('before')}))))::double, 6) as jaccard from bt where before is not null",
    "l2_normalise": "select vec_id, generate_subscripts(e, 1) - 1 as i, round(unnest(e) / n, 5) as x from (select vec_id, list_transform(embedding, lambda v: v::double * 3) as e, sqrt(list_sum(list_transform(embedding, lambda v: (v::double * 3) * (v::double * 3)))) as n from embeddings)",
    "mean_pool": "select label::bigint as id, i, round(avg(x::double), 6) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by all",
    "dense_topk": "select query_id, vec_id, round(score, 6) as score from (select q.vec_id as query_id, e.vec_id, list_inner_product(list_transform(q.embedding, lambda v: v::double), list_transform(e.embedding, lambda v: v::double)) as score from embeddings q, embeddings e where q.vec_id % 20 = 0) qualify row_number() over (partition by query_id order by score desc, vec_id) <= 30",
    "attach_vectors": "select doc_id as id, case when ok then 'hybrid' else 'bm25' end as mode, ok and vec_id is not null as has_vector from documents left join embeddings on vec_id = doc_id cross join (select (select count(*) from documents) = count(*) and count(*) = count(*) filter (where len(embedding) = 64) as ok from embeddings)",
    "sanitise_questions": f"with {ASKED} select query_id, question from q1",
    "extract_articles": f"with q1 as (select query_id, question from ({QUESTIONS})), q2 as (select query_id, {numbers('question')} as qn from q1), qa as (select query_id, {articles('qn')} as al from q2) select query_id, array_to_string(list_filter(al, lambda a, i: list_position(al, a) = i), ',') as articles from qa",
    "expand_questions": f"with q as ({QUESTIONS}), h as (select query_id, question, {HINTS} as hs from q) select query_id, array_to_string({TERMS}, ' ') as expanded, array_to_string(list_filter(hs, lambda a, i: list_position(hs, a) = i), ',') as hints from h",
    "question_intent": f"with q as ({QUESTIONS}) select query_id, case when regexp_matches(question, {_re(params.INJECTION)}) then 'injection' when regexp_matches(question, {_re(params.GREETING)}) then 'greeting' when regexp_matches(question, {_re(params.OFFTOPIC)}) then 'offtopic' else 'question' end as intent, regexp_matches(question, {_re(params.PURE_ARTICLE)}) as pure from q",
    "article_keys": f"select id, article as key from ({CHUNKS}) where article is not null",
    "validate_requests": "select conv_id * 1000 + turn as query_id, case when turn % 5 = 4 then 0 else length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) end as n_chars, (role in ('user', 'assistant') and text is not null)::int as n_turns, case when turn % 5 = 4 then 'empty' when text is null then 'missing' when regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' then 'empty' when length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 500 then 'too long' end as reason from conversations",
    "follow_up": f"""with q as ({QUESTIONS}), t as (select c.conv_id, c.turn, c.role, coalesce(q.question, c.text) as content from conversations c left join q on q.conv_id = c.conv_id and q.turn = c.turn where c.role in ('user', 'assistant')),
 h as (select *, list({{'r': role, 'c': content}}) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding) as hist from t),
 u as (select conv_id, turn, content, list_filter(hist, lambda x: x.r = 'user' and x.c is not null and x.c <> content)[-1].c as prev from h where role = 'user'),
 v as (select *, {articles('cn')} as own, {articles('pn')} as pa from (select *, {numbers('content')} as cn, {numbers('prev')} as pn from u))
 select conv_id, turn, case when len(own) = 0 and regexp_matches(content, {_re(params.FOLLOW_UP)}) and length(content) < 120 and prev is not null then case when len(pa) > 0 then concat(content, ' (Article ', array_to_string(list_filter(pa, lambda a, i: list_position(pa, a) = i), ', Article '), ')') else concat(content, ' (context: ', substr(prev, 1, 150), ')') end else content end as question from v""",
    "article_lookup": f"with {ASKED}, {APOST}, ua as (select query_id, unnest(articles) as article from asked) select query_id, article, chunk_id, pos from ua join ap using (article)",
    "pinned_chunks": f"with {ASKED}, {APOST}, ua as (select query_id, unnest(articles) as article, generate_subscripts(articles, 1) as apos from asked), m as (select query_id, chunk_id, min(apos * 10 + pos) as place_key from ua join ap using (article) where pos < 3 group by all) select query_id, chunk_id, row_number() over (partition by query_id order by place_key) - 1 as place from m",
    "hint_chunks": f"with {ASKED}, {APOST}, hh as (select query_id, {HINTS} as hs from asked where len(articles) = 0), ua as (select query_id, unnest(hs) as article, generate_subscripts(hs, 1) as apos from hh), m as (select query_id, chunk_id, min(apos) as place_key from ua join ap using (article) where pos = 0 group by all) select query_id, chunk_id, row_number() over (partition by query_id order by place_key, chunk_id) - 1 as rank from m",
    "rank_fusion": f"with {FUSED} select query_id, chunk_id, round(rrf, 9) as rrf, first_list, first_rank from fz",
    "rerank_questions": f"with {FUSED}, rr as (select fz.query_id, chunk_id, first_list, first_rank, rrf + 0.02::double * {coverage(toks('b.text'), toks('d.text'))} as score from fz join benchmark b on b.item_id = fz.query_id join documents d on d.doc_id = fz.chunk_id) select query_id, chunk_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, first_list, first_rank) - 1 as rank from rr qualify rank < 12",
    "question_plans": f"with recursive {RETRIEVED} select {PLANS} from planned",
    "hybrid_plans": f"with recursive {HYBRID} select {PLANS} from planned",
    "diverse_selection": f"with recursive {RETRIEVED} select query_id, chunk_id, round(score, 9) as score, pinned, n from selected",
    "source_citations": f"""with recursive {RETRIEVED} select query_id, n, chunk_id, book_title as book, pdf_page, null::int as printed_page, part, article, article_title, text as snippet, floor(least(1.0, case when pinned then 1.0 else score * 20 end) * 100 + 0.5) / 100 as score
 from selected join planned using (query_id) join ch on ch.id = chunk_id where kind = 'answer' or (kind = 'refusal' and intent <> 'offtopic' and n <= 3)""",
    "prompt_messages": f"""with recursive {RETRIEVED}, bl as (select query_id, {BLOCKS} as context from selected join ch on ch.id = chunk_id group by query_id),
 ht as (select query_id, list_transform(coalesce(hist, [])[greatest(1, len(coalesce(hist, [])) - 3):], lambda t: concat(t.r, ': ', coalesce(substr(t.c, 1, 600), ''))) as turns from h1)
 select query_id, 2 + len(turns) as n_messages, array_to_string(list_concat(['system: Answer from the context only.'], turns, [concat('user: QUESTION: ', question, chr(10), chr(10), 'CONTEXT:', chr(10), coalesce(context, ''), case when pure_article then concat(chr(10), chr(10), 'Quote the article.') else '' end)]), chr(30)) as messages
 from planned left join bl using (query_id) join ht using (query_id) where kind = 'answer'""",
    "answer_log": f"""with recursive {RETRIEVED}, cl as (select query_id, string_agg(chunk_id::varchar, ',' order by n) as chunks from selected group by query_id)
 select query_id, substr(question, 1, 200) as q, array_to_string(articles, ',') as articles, confidence, mode, coalesce(chunks, '') as chunks, case when kind = 'answer' then 'model' end as model, abs(query_id % 1000) as ms, kind, null::boolean as verified from planned left join cl using (query_id)""",
    "question_stream": f"""with recursive {RETRIEVED}, cl as (select query_id, string_agg(chunk_id::varchar, ',' order by n) as chunks from selected group by query_id)
 select query_id, substr(question, 1, 200) as q, array_to_string(articles, ',') as articles, confidence, mode, coalesce(chunks, '') as chunks, case when kind = 'answer' then 'model' end as model, abs(query_id % 1000) as ms, kind from planned left join cl using (query_id)""",
    "index_merge": f"with {CH}, {INDEXED} select term, chunk_id, count(*)::int as tf, any_value(len) as len from (select chunk_id, len(ts) as len, unnest(ts) as term from ix) group by term, chunk_id",
    "index_versions": f"""with {CH}, {INDEXED}, v as (select 1 as version, * from ix union all select unnest([2, 3]), * from ix where chunk_id % 5 <> 0), t as (select version, term from (select version, unnest(ts) as term from v))
 select version, n, avgdl, terms, tokens from (select version, count(*) as n, round(avg(len(ts)), 6) as avgdl from v group by version) join (select version, count(distinct term) as terms, count(*) as tokens from t group by version) using (version)""",
    "outcomes": f"with recursive {RETRIEVED}, {OUTCOMES} select query_id, positive, refused, ok, concat(case when ok then 'PASS' else 'FAIL' end, '  [', rpad(confidence, 6, ' '), '] ', question) as line from oc",
    "evaluation": f"""with recursive {RETRIEVED}, {OUTCOMES}, an as (select query_id, answer, coalesce(n_sources, 0) as n_sources, coalesce(context, '') as context, coalesce(known, []) as known from (select query_id - 1 as query_id, answer from ({ANSWERS})) a left join cx using (query_id)), {GROUND_IN}
 select round(100.0::double * avg(ok::int) filter (where positive), 1) as hit_rate, round(100.0::double * avg(ok::int) filter (where not positive), 1) as refusal_accuracy,
 (select round(100.0::double * count(*) filter (where not verified) / greatest(1, count(*)), 1) from gr join oc using (query_id) where positive and not refused) as flag_rate from oc""",
    "page_numbers": "select source as book_file, row_number() over (partition by source order by doc_id)::int as pdf_page, md5(text) as digest from documents",
    "chunk_files": f"with {CH} select id, book_file, pdf_page, part, article, array_to_string(mentions, ',') as mentions, section_type, md5(search_text) as digest from ch",
    "article_index_file": f"with {APOST} select article, chunk_id, pos from ap",
    "index_health": f"with {CH} select case when ok then 'hybrid' else 'bm25' end as mode, (select count(*) from ch) as chunks, (select count(distinct article) from ch)::int as articles, ok as embeddings from (select count(*) = (select count(*) from ch) and count(*) filter (where len(embedding) = 64) = (select count(*) from ch) as ok from embeddings)",
    "vector_file": """with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings where vec_id is not null),
 s as (select *, case when x = 0 then 1.0::double else power(2.0::double, greatest(floor(log2(abs(x))), -14) - 10) end as s from v) select vec_id, i, round_even(x / s, 0) * s as x from s""",
    "context_blocks": f"with {APOST}, sel as (select regexp_replace(article, '[^0-9]', '', 'g')::bigint as query_id, chunk_id from ap where pos < 3), se as (select *, row_number() over (partition by query_id order by chunk_id) as n from sel) select query_id, string_agg(concat('[', n, '] (', concat_ws(' | ', concat('Book: ', book_title), concat('PDF p. ', pdf_page), part, case when article is not null then concat('Article ', article) end), ')', chr(10), text), chr(10) || chr(10) order by n) as context from se join ch on ch.id = se.chunk_id group by query_id",
    "citation_check": f"with {CITED} select query_id, text, array_to_string(list_transform(bad, lambda k: k::int::varchar), ',') as invalid from cj",
    "answer_quotes": f"with {ANS}, {quoted('(select query_id, answer as text from an)')} select query_id, array_to_string(quotes, '|') as quotes from qs",
    "quote_support": f"with {ANS}, {quoted('(select query_id, answer as text, context from an)')}, u as (select query_id, context, unnest(quotes) as quote, generate_subscripts(quotes, 1) - 1 as n from qs) select query_id, n, round({support('quote', 'context')}, 6) as support from u",
    "grounding": f"with {GROUND} select query_id, verified, n_unverified, array_to_string(unknown, ',') as unknown, n_invalid from gr",
    "regeneration": f"""with f as (with {GROUND} select gr.*, text from gr join cj using (query_id)), s as (with an as (select *, ['3', (conv_id % 12)::varchar] as known from ({SECOND})), {GROUND_IN} select gr.query_id, verified as v2, text as t2 from gr join cj using (query_id)),
 r as (select *, not verified and (n_unverified > 0 or len(unknown) > 0) and v2 as take from f join s using (query_id)) select query_id, md5(case when take then t2 else text end) as text, verified or take as verified, take as regenerated from r""",
    "flag_rate": f"with {GROUND} select count(*) as answers, round(100.0::double * count(*) filter (where not verified) / greatest(1, count(*)), 1) as flag_rate from gr",
}
#: Late rows leave no trace in the stream.
ORACLE["rate_limit_stream"] = ORACLE["rate_limit"]
ORACLE["published_quality"] = ORACLE["quality_report"]
ORACLE["published_books"] = f"with {CLEAN}, {CH}, n as (select book_file, count(*) as chunks, count(distinct article) as articles from ch group by 1) select book_file, count(*) as pages, count(*) filter (where not kept) as pages_dropped, coalesce(max(chunks), 0) as chunks, coalesce(max(articles), 0) as articles from pf left join n using (book_file) group by book_file"
