"""DuckDB SQL for the operators that SQL can express.

The white space of words is written as the class ``[\\x20\\x09-\\x0D]``.
"""

from .divergence import LEAST_DOCS, TOP
from .line_dedup import LEAST_PAGES, RATIO
from .quality import THRESHOLDS, stop_forms
from .substring_dedup import WINDOW

_WORD = r"[^\x20\x09-\x0D]+"

_WINDOWS = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words, row_number() over () as rid from documents),
p as (select rid, unnest(words) as word, unnest(range(len(words))) as pos from d),
w as (select rid, pos, word, string_agg(word, ' ') over k as win, count(*) over k as n from p
      window k as (partition by rid order by pos rows between current row and {WINDOW - 1} following)),
r as (select rid, pos from (select rid, pos, count(*) over (partition by win) as times from w where n = {WINDOW}) where times > 1),
m as (select w.rid, w.pos, w.word, max(r.pos) over (partition by w.rid order by w.pos rows between unbounded preceding and current row) as last
      from w left join r on r.rid = w.rid and r.pos = w.pos),
g as (select rid, count_if(coalesce(pos - last < {WINDOW}, false)) as gone, coalesce(string_agg(word, ' ' order by pos) filter (not coalesce(pos - last < {WINDOW}, false)), '') as kept from m group by 1)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(g.gone, 0)::bigint as n_removed, sha256(coalesce(g.kept, '')) as kept_sha256 from d left join g using (rid)
"""

_LINES = f"""
with d as (select doc_id, source, text, row_number() over () as rid from documents),
l as (select rid, source, unnest(string_split(text, chr(10))) as line from d),
n as (select source, count(*) as pages from d group by 1),
f as (select source, trim(line) as line, count(distinct rid) as c from l where trim(line) <> '' group by 1, 2),
bad as (select f.source, f.line from f join n on f.source is not distinct from n.source
        where f.c >= {LEAST_PAGES} and f.c > n.pages * {RATIO}::double),
p as (select rid, source, string_split(text, chr(10)) as lines from d),
k as (select p.rid, p.lines, u.i, p.lines[u.i] as line, b.line is not null as gone
      from p, lateral (select unnest(range(1, len(p.lines) + 1)) as i) u
      left join bad b on b.source is not distinct from p.source and b.line = trim(p.lines[u.i])),
g as (select rid, count(*) as n_lines, count_if(gone) as n_removed,
             coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept from k group by 1)
select d.doc_id, coalesce(g.n_lines, 0)::bigint as n_lines, coalesce(g.n_removed, 0)::bigint as n_removed,
       sha256(coalesce(g.kept, '')) as kept_sha256
from d left join g using (rid)
"""

_MIX = rf"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
                  md5(coalesce(doc_id::varchar, '')) as turn from documents),
t as (select source, sum(size)::bigint as source_size from s group by 1),
w as (select *, ([3.0, 1.0, 2.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
             (2 * source_size)::double as cap, sum(source_size) over () * 1.5::double as budget from t),
o as (select *, cap / weight as fill from w),
v as (select *, (budget - coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as level from o),
x as (select *, coalesce(min_by(level, fill) filter (level <= fill) over (), 0) as found from v),
h as (select source, source_size, least(cap, found * weight) as target from x),
i as (select *, floor(target)::bigint as base, floor(round(sum(target) over (), 3))::bigint - sum(floor(target)::bigint) over () as lacking,
             case when floor(target) < 2 * source_size then (floor(target) + 1) / target end as next from h),
g as (select source, source_size, target,
             base + case when next is not null and row_number() over (order by next nulls last, source nulls last) <= lacking then 1 else 0 end as goal from i),
q as (select s.doc_id, s.size, g.source_size, g.target, g.goal,
             sum(s.size) over (partition by s.source order by s.turn, s.size rows between unbounded preceding and current row)::bigint as ends
      from s join g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (greatest(0, least(size, goal - (ends - size))) + greatest(0, least(size, goal - (ends + source_size - size))))::bigint as taken,
       case when least(size, goal - (ends - size)) > 0 then ends / target
            when least(size, goal - (ends + source_size - size)) > 0 then (ends + source_size) / target end as finish
from q
"""


def _sql_rule(count: str, whole: str | None, low: int | None, high: int | None) -> str:
    value, scale = (count, "1") if whole is None else (f"{count} * 100", whole)
    parts = [f"{value} >= {low} * {scale}"] * (low is not None) + [f"{value} <= {high} * {scale}"] * (high is not None)
    return " and ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in stop_forms())
_QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
g as (select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
      from w, lateral (select unnest(range(1, len(words) - 1)) as i) u),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from g) where n > 1),
c as (select rid, count(distinct i + j) as n from r, (select unnest([0, 1, 2]) as j) group by 1),
m as (select doc_id, len(words)::bigint as n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             coalesce(c.n, 0)::bigint as n_repeat_words,
             (length(text) - length(replace(text, '!', '')))::bigint as n_exclaims,
             len(list_filter(words, lambda w: w in ({_STOPS})))::bigint as n_stop_words
      from w left join c using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and {" and ".join(_sql_rule(*rule[1:]) for rule in THRESHOLDS)} as kept from f
"""

_WARC = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as hex from p),
f as (select hex, payload_bytes, min(page_id) as first from h group by 1, 2),
b as (select h.*, f.first, list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::bigint) as groups from h join f using (hex, payload_bytes))
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((groups[(i // 4) + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from b
"""

_DIVERGENCE = rf"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as rid,
                  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select lang, source, rid, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*) as lang_n from w group by 1, 2 having count(distinct rid) >= {LEAST_DOCS}),
v as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from k group by 1),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
g as (select distinct lang, source from d),
t as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c on c.lang = g.lang and c.source = g.source group by 1, 2),
p as (select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (t.total + 2 * v.v) as p,
             1 + 1000000000::hugeint * (k.lang_n + 2) // (v.lang_total + 2 * v.v) as q
      from t join v using (lang) join k using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
      union all
      select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from x)
select lang, source, part, item, value, rank::int as rank from r where part = 'pair' or rank <= {TOP}
"""

_AUDIT = rf"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{_WORD}') as words, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
             (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
             + 16 * coalesce(w.doc_id > first, false)::int as mask
      from w left join l on l.doc_id = w.doc_id),
c as (select part, mask, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from m group by 1, 2),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as f(name, bit)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from (select *, unnest(range(1, 6)) as step from o)),
r as (select part, filter_order, step,
             coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
             coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as removed,
             coalesce(sum(n) filter (mask & before <> 0 and mask & bit <> 0), 0)::bigint as redundant,
             coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
             coalesce(sum(good) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost,
             coalesce(sum(toxic) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
      from c, s group by 1, 2, 3)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley from r
"""

ORACLES = {"op1_substring_dedup": _WINDOWS, "op3_mixing": _MIX, "op5_warc": _WARC, "op6_quality": _QUALITY, "op8_line_dedup": _LINES, "op11_divergence": _DIVERGENCE, "op12_filter_audit": _AUDIT}
