"""DuckDB equivalents of the registered queries, written independently of them where SQL can express them."""

from __future__ import annotations

from vigilake.llm import licenses, mixing, secrets

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({LOWER.format(f'coalesce({column}, {_quoted("")})')}, '{pattern}')"


DECONTAMINATION = f"""
with items as (select cast(item_id as varchar) as item, {_words('text', LETTERS)} as ws from benchmark where text is not null),
windows as (
    select distinct item, least(10, len(ws)) as size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as words
    from (select item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from items where len(ws) > 0)),
docs as (select doc_id, {_words('text', LETTERS)} as ws from documents),
places as (select doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') as words
           from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as i from docs, (select distinct size from windows))),
hits as (select doc_id, i, p.size, item from places p join windows w on p.words = w.words and p.size = w.size),
hit_words as (select doc_id, count(distinct j) as n_hit
              from (select doc_id, unnest(range(i, i + size)) as j from (select distinct doc_id, i, size from hits)) group by doc_id),
hit_items as (select doc_id, list_sort(list(distinct item)) as items from hits group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

EXACT = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from n
"""

MIXING = f"""
with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size,
                     md5(coalesce(cast(doc_id as varchar), '') || ':{mixing.SEED}') as key from documents),
sources as (select source, sum(size) as source_size, {mixing.MAX_EPOCHS} * sum(size) as top,
                   case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
            from docs group by source),
filling as (select *, (sum(source_size) over () - coalesce(sum(top) over (order by top / weight, source rows between unbounded preceding and 1 preceding), 0))
                      / cast(sum(weight) over (order by top / weight, source rows between current row and unbounded following) as double) as level
            from sources),
goals as (select source, source_size, least(cast(top as double), weight * (select arg_min(level, top / weight) from filling where level * weight <= top)) as target from filling),
budgets as (select *, cast(floor(target + 0.5) as bigint) as budget from goals),
placed as (select d.*, source_size, target, budget, coalesce(sum(size) over (partition by d.source order by key rows between unbounded preceding and 1 preceding), 0) as before
           from docs d join budgets b on d.source is not distinct from b.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(case when source_size = 0 then 0 else budget // source_size * size + greatest(0, least(size, budget % source_size - before)) end as bigint) as taken
from placed
"""

JACCARD = f"""
with recursive docs as (select doc_id, {_words('text', WORDS)} as ws from documents),
shingles as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end as s
             from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from docs where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, e.b from reach r join edges e on r.b = e.a),
groups as (select a as doc_id, min(b) as component_id, count(*) as component_size from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_size, 1) as component_size
from docs d left join sizes s using (doc_id) left join groups g using (doc_id)
"""

SUFFIXES = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
starts as (select doc_id, unnest(range(n - 49)) as p, h from docs where n >= 50),
windows as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from starts),
firsts as (select doc_id, p, min(doc_id) over (partition by s) as least from windows),
hits as (select doc_id, p, coalesce(p - lag(p) over (partition by doc_id order by p) > 50, true) as fresh from firsts where least < doc_id),
spans as (select doc_id, min(p) as lo, max(p) + 50 as hi
          from (select doc_id, p, sum(cast(fresh as int)) over (partition by doc_id order by p) as g from hits) group by doc_id, g),
parts as (select d.doc_id, s.lo, substr(h, 2 * coalesce(lag(s.hi) over w, 0) + 1, 2 * (s.lo - coalesce(lag(s.hi) over w, 0))) as part, s.hi
          from spans s join docs d using (doc_id) window w as (partition by s.doc_id order by s.lo)),
cut as (select doc_id, string_agg(part, '' order by lo) as stay, max(hi) as tail, count(*) as n_spans, sum(hi - lo) as removed
        from (select p.*, s.lo as slo from parts p join spans s using (doc_id, lo)) group by doc_id)
select d.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(case when n_spans is null then h else stay || substr(h, 2 * tail + 1) end)) as kept_sha256
from docs d left join cut using (doc_id)
"""


def _secrets() -> str:
    rules = ", ".join(f"({r.order}, {_quoted(r.kind)}, {r.tail}, {r.least})" for r in secrets.default_rules())
    found = " union all ".join(
        f"select doc_id, {r.order} as o, string_split_regex(t, {_quoted(r.pattern)}) as parts, "
        f"regexp_extract_all(t, {_quoted(r.pattern)}) as hits, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) as counts from docs where regexp_matches(t, {_quoted(r.pattern)})"
        for r in secrets.default_rules())
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
rules as (select * from (values {rules}) v(o, kind, tail, least)),
found as (select * from ({found}) where len(hits) > 0),
each as (select doc_id, o, unnest(range(1, len(hits) + 1)) as i, unnest(parts[:len(hits)]) as part, unnest(hits) as hit, unnest(counts) as count from found),
placed as (select doc_id, o, length(hit) as n, length(count) as c,
                  sum(length(part) + length(hit)) over (partition by doc_id, o order by i) as stop from each),
spans as (select doc_id, p.o, kind, cast(stop - case when tail then c else n end as bigint) as start, cast(stop as bigint) as stop from placed p join rules r using (o) where c >= least),
lists as (select doc_id, count(*) filter (o = 0) as n_assign, count(*) filter (o = 1) as n_access, count(*) filter (o = 2) as n_hex,
                 coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, o) filter (o < 3), '') as base,
                 string_agg(kind || ':' || start || ':' || stop, ',' order by start, o) as spans, count(*) as n_spans
          from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans
from docs left join lists using (doc_id)
"""


def _licenses() -> str:
    rules = licenses.signatures()
    rows = ", ".join(f"({r.order}, '{r.label}', {r.priority}, {r.confidence}, ' {r.keyword} ', {_quoted(r.pattern)})" for r in rules)
    gap, word = licenses.GAP, licenses.WORD
    phrases = " union all ".join(
        f"select doc_id, '{label}' as label, unnest(range(1, len(ws) - {len(p.split()) - 1} + 1)) as i, ws, {len(p.split())} as n, '{p}' as phrase from docs where len(ws) >= {len(p.split())}"
        for p, label in licenses.BASE_PHRASES)
    return f"""
with docs as (select doc_id, {_words('text', LETTERS)} as ws from documents),
base as (select doc_id, label, i - 1 as i from ({phrases}) where array_to_string(ws[i:i + n - 1], ' ') = phrase),
base_rows as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as base_labels from base group by doc_id),
texts as (select doc_id, lower(regexp_replace(coalesce(text, ''), '{gap}*({word}+){gap}*', ' \\1 ', 'g')) as w from documents
          where regexp_matches(coalesce(text, ''), {_quoted(licenses.GATE)})),
rules as (select * from (values {rows}) v(o, label, priority, sure, keyword, pattern)),
found as (select doc_id, o, string_split_regex(w, pattern) as parts, regexp_extract_all(w, pattern) as hits from texts join rules on contains(w, keyword)),
each as (select doc_id, o, unnest(range(1, len(hits) + 1)) as i, unnest(parts[:len(hits)]) as part, unnest(hits) as hit from found where len(hits) > 0),
placed as (select doc_id, o, length(hit) as n, sum(length(part) + length(hit)) over (partition by doc_id, o order by i) as stop from each),
spans as (select doc_id, p.o, label, priority, sure, stop - n as start, stop from placed p join rules r using (o)),
own as (select doc_id, list(distinct label) as own, max(sure) as sure, count(*) as n_detections from spans a
        where not exists (select 1 from spans b where b.doc_id = a.doc_id and b.start <= a.start and b.stop >= a.stop and b.priority >= a.priority
                          and (b.stop - b.start > a.stop - a.start or b.priority > a.priority or b.o < a.o)) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base_labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(own, [])))), ','), '') as labels,
       cast(coalesce(sure, case when n_base > 0 then 0.5 else 0 end) as double) as score, coalesce(n_detections, 0) as n_detections
from docs left join base_rows using (doc_id) left join own using (doc_id)
"""


FILL_IN_MIDDLE = """
with docs as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
tokens as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w,
           [cast('0x' || substr(x, 8 * i + 1, 8) as bigint) for i in range(4)] as h from docs),
cuts as (select *, len(w) as n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) as a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) as b
         from tokens),
parts as (select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as s,
          case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
               when h[4] % 100 < 20 then 'spm' else 'psm' end as form from cuts)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars,
       cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parts
"""


ORACLES = {
    "op1_benchmark_decontamination": DECONTAMINATION,
    "op2_license_scan": _licenses(),
    "op4_exact_dedup": EXACT,
    "op7_ngram_jaccard_join": JACCARD,
    "op8_secret_scan": _secrets(),
    "op9_suffix_array_dedup": SUFFIXES,
    "op10_source_mixing": MIXING,
    "op11_fill_in_middle": FILL_IN_MIDDLE,
}
