"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

OP1_URL_FILTER = r"""with recursive u as (select page_id, html, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
j as (select *, case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7' when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
  when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/' when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from p),
r as (select *, case when rule in ('com/en/', 'net/de/', 'org/es/') then 'block' when rule is not null then 'allow' end as by_rule from j),
h as (select host, count(*) as pages, count(*) filter (where by_rule = 'allow') as allowed, count(*) filter (where by_rule = 'block') as blocked from r where host <> '' group by host),
s as (select host, 1 as kind, allowed as n from h where allowed > 0 union all select host, -1, blocked from h where blocked > 0),
a as (select kind, sum(n) as total from s group by kind),
l as (select host as src, translate(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst from r),
e as (select src, dst, count(*) as n from l where src <> '' and dst <> '' and src <> dst group by 1, 2),
b as (select src as f, dst as t, 1 as kind, n from e union all select dst, src, -1, n from e),
w as (select f, t, kind, n / sum(n) over (partition by f, kind) as part from b),
m as (select 0 as k, host, kind, 0.15::double * n / total as v from s join a using (kind) union all select k + 1, w.t, m.kind, 0.85::double * sum(w.part * m.v) from m join w on w.f = m.host and w.kind = m.kind where k < 150 group by k, w.t, m.kind),
c as (select host, kind, sum(v) as v from m group by 1, 2),
g as (select host, sum(case when kind = 1 then x else 0 end) as trust, sum(case when kind = -1 then x else 0 end) as distrust from (select host, c.kind, v / sum(v) over (partition by c.kind) * total as x from c join a using (kind)) group by 1)
select page_id, host, path, rule, coalesce(by_rule, case when (coalesce(distrust, 0) - coalesce(trust, 0)) / pages > 0.5 + 1e-9 then 'block' else 'allow' end) as verdict from r left join h using (host) left join g using (host)"""

OP2_SUFFIX_DEDUP = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents), n as (select doc_id, b, octet_length(b) as n from d),
w as (select doc_id, i, md5(b[i:i + 199]) as w from (select doc_id, b, unnest(range(1, n - 198)) as i from n where n >= 200)),
again as (select w from w group by w having count(*) > 1),
h as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w semi join again using (w)),
g as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as run from h),
r as (select doc_id, run, min(i) as first, max(i) + 199 as last from g group by 1, 2),
k as (select doc_id, first, last, coalesce(lag(last) over (partition by doc_id order by first), 0) as upto from r),
pieces as (select doc_id, first as place, hex(b[upto + 1:first - 1]) as piece from k join n using (doc_id) union all select doc_id, n + 1, hex(b[max(last) + 1:n]) from k join n using (doc_id) group by doc_id, b, n),
kept as (select doc_id, sha256(unhex(string_agg(piece, '' order by place))) as h from pieces group by 1),
sums as (select doc_id, sum(last - first + 1) as removed, count(*) as spans from k group by 1)
select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, coalesce(h, sha256(b)) as kept_sha256 from n left join sums using (doc_id) left join kept using (doc_id)"""

OP4_MIXING = r"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rank from d group by source),
w as (select *, [5, 2, 1][1 + (rank - 1) % 3]::double as weight, [1.5, 1.0, 0.5][1 + (rank - 1) % 3]::double as ramp, 2.0::double * source_size as cap from s),
l as (select *, (sum(1.5::double * source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) as level, row_number() over (order by cap / weight, rank) as place from w),
t as (select *, least(cap, coalesce((select level from l where level * weight <= cap order by place limit 1) * weight, cap)) as target from l),
r as (select d.doc_id, d.size, d.source, t.source_size, t.target, t.ramp, coalesce(sum(d.size) over (partition by d.source order by d.h, d.doc_id rows between unbounded preceding and 1 preceding), 0) as start from d join t on d.source is not distinct from t.source),
x as (select *, cast(greatest(0, least(size, cast(round(target) as bigint) - start)) as bigint) as first_words, cast(greatest(0, least(size, cast(round(target) as bigint) - source_size - start)) as bigint) as second_words from r),
y as (select *, start / target as u, (start + source_size) / target as v from x)
select doc_id, size, source_size, target, first_words + second_words as taken, case when first_words > 0 then 2 * u / (ramp + sqrt(greatest(0::double, ramp * ramp + 4 * (1 - ramp) * u))) end as position,
case when second_words > 0 then 2 * v / (ramp + sqrt(greatest(0::double, ramp * ramp + 4 * (1 - ramp) * v))) end as second_position from y"""

OP6_CHAT = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(t, '([<\[])(\\*)(/s>|s>|/INST\]|INST\]|/ROLE\]|ROLE\]|TEXT\])', '\1\\\2\3', 'g')) as shown, length(regexp_replace(role, '([<\[])(\\*)(/s>|s>|/INST\]|INST\]|/ROLE\]|ROLE\]|TEXT\])', '\1\\\2\3', 'g')) as shown_role from c),
g as (select conv_id, count(*) as n_turns, string_agg(concat(role, chr(10), t, chr(10)), '' order by turn, role, t) as turns, string_agg(case when role = 'assistant' then t else '' end, '' order by turn, role, t) as learned,
  3 + sum(case role when 'user' then 15 + shown when 'assistant' then 4 + shown else 23 + shown_role + shown end) as chars from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(learned) as bigint) as loss_chars, sha256(learned) as loss_sha256, cast(chars as bigint) as formatted_chars from g"""

_MARKED = "select doc_id, x, '{kind}' as kind, {rank} as rank, string_split(regexp_replace(x, '{pattern}', chr(1048573)||'\\0'||chr(1048574), 'g'), chr(1048573)) as pieces from t"


def _op11() -> str:
    """Base matches lie between marks; candidates likewise, and each of their windows is counted by itself."""
    from .secret_scan import ALLOWED_BEFORE, ALLOWED_INSIDE, CLASSES

    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    base = [("assign", either + r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    runs = [(f"c{k}", f"[{c.signs}]+") for k, c in enumerate(CLASSES)]
    marked = " union all ".join(_MARKED.format(kind=kind, rank=rank, pattern=pattern) for rank, (kind, pattern) in enumerate(base + runs))
    classes = " union all ".join(f"select start as c_start, s, doc_id, x, unnest(range(1, length(s) - {c.window - 2})) as i, {c.window} as size, {c.bits}::double as bits, {c.digits} as digits, {c.lower} as lower, {c.upper} as upper from p where kind = 'c{k}' and length(s) >= {c.window}" for k, c in enumerate(CLASSES))
    assigned = r"""length(regexp_extract(s, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 8"""
    quoted = lambda pattern: pattern.replace("'", "''")
    return rf"""with t as (select doc_id, coalesce(text, '') as x from documents), m as ({marked}),
u as (select doc_id, x, kind, rank, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i from m where len(pieces) > 1),
v as (select *, coalesce(sum(length(replace(piece, chr(1048574), ''))) over (partition by doc_id, kind order by i rows between unbounded preceding and 1 preceding), 0) as start from u),
p as (select doc_id, x, kind, rank, start, split_part(piece, chr(1048574), 1) as s from v where i > 1),
b as (select doc_id, kind, rank, start, start + length(s) as stop from p where (kind = 'assign' and {assigned}) or (kind = 'access' and length(s) >= 16) or (kind = 'hex' and length(s) >= 32)),
w as (select *, substring(s, i, size) as w from ({classes})),
h as (select *, list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda c: cast(round(c * log2(c) * 1048576) as bigint))) as total from w),
g as (select doc_id, x, c_start + i - 1 as start, c_start + i - 1 + size as stop from h where total <= floor((log2(size) - bits) * size * 1048576) and length(regexp_replace(w, '[^0-9]', '', 'g')) >= digits and length(regexp_replace(w, '[^a-z]', '', 'g')) >= lower and length(regexp_replace(w, '[^A-Z]', '', 'g')) >= upper),
o as (select *, case when start > max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from g),
r as (select *, sum(fresh) over (partition by doc_id order by start, stop rows unbounded preceding) as run from o),
e as (select doc_id, x, min(start) as start, max(stop) as stop from r group by doc_id, x, run),
a as (select doc_id, kind, rank, start, stop from b union all select doc_id, 'entropy', 3, start, stop from e where not exists (select 1 from b where b.doc_id = e.doc_id and b.start < e.stop and e.start < b.stop)
  and not regexp_matches(substring(x, greatest(1, start - 31)::bigint, least(32, start)::bigint), '{quoted(ALLOWED_BEFORE)}') and not regexp_matches(substring(x, (start + 1)::bigint, (stop - start)::bigint), '{quoted(ALLOWED_INSIDE)}')),
k as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) filter (where kind <> 'entropy') as base, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as spans from a group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join k on k.doc_id = t.doc_id"""


OP11_SECRET_SCAN = _op11()

OP12_HARD_NEGATIVES = """with r as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as id, b.label as label, cast(list_inner_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, anchor_label, id as positive_id, score as positive_score from s where label = anchor_label qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, positive_id, positive_score, id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> p.anchor_label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
