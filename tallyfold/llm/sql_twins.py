"""SQL of the operators that SQL can express, built from small expression helpers."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _canonical(u: str) -> str:
    host = f"regexp_replace(regexp_replace({_host(u)}, ':(80|443)$', ''), '(?s)^(?:www|m)\\.(.+\\..+)$', '\\1')"
    path = f"regexp_replace(regexp_replace({_path(u)}, '(/index)?\\.html?$', ''), '/+$', '')"
    kept = f"list_sort(list_filter(string_split(regexp_extract({u}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)')))"
    tail = f"case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"
    return f"case when contains({u}, '://') then {host} || {path} || {tail} else {u} end"


def _own(host: str, path: str, column: str) -> str:
    """Rule or verdict of the longest rule that fits."""
    return f"""(select {column} from rules where ({host} = rhost or ends_with({host}, '.' || rhost)) and starts_with({path}, rpath)
      order by length(rule) desc limit 1)"""


URLS = f"""
with recursive rules as (
  select *, split_part(rule, '/', 1) as rhost, substr(rule, instr(rule, '/')) as rpath
  from (values ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) r(kind, rule)),
urls as (select page_id, url, html, {_host("url")} as host, {_path("url")} as path, {_canonical("url")} as spelling from pages),
marks as (
  select *, list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?\\s*canonical\\b')),
      lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)) as canon,
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
      lambda t: regexp_extract(t, '(?is)\\bcontent\\s*=\\s*["'']?[0-9.]*\\s*[;,]\\s*url\\s*=\\s*''?([^"''\\s>]+)', 1)) as jump
  from urls),
found as (
  select spelling as src, case when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t else t end as target
  from (select spelling, url, unnest(list_concat(coalesce(canon, []), coalesce(jump, []))) as t from marks)),
targets as (select distinct src, target, {_canonical("target")} as dst from found where contains(target, '://')),
links as (select src as a, dst as b from targets where src <> dst union select dst, src from targets where src <> dst),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a as spelling, least(a, min(b)) as class from reach group by a),
own as (
  select page_id, host, path, spelling, {_own("host", "path", "rule")} as rule, {_own("host", "path", "kind")} as kind from urls),
votes as (
  select spelling, kind from own where spelling is not null
  union all select dst, {_own(_host("target"), _path("target"), "kind")} from targets),
per as (
  select coalesce(c.class, v.spelling) as class, bool_or(coalesce(kind = 'allow', false)) as allowed, bool_or(coalesce(kind = 'block', false)) as blocked
  from votes v left join classes c using (spelling) group by 1)
select o.page_id, o.host, o.path, o.rule, coalesce(o.kind, case when p.allowed then 'allow' when p.blocked then 'block' else 'allow' end) as verdict
from own o left join classes c using (spelling) left join per p on p.class = coalesce(c.class, o.spelling)"""


def licenses(templates: list, near: int, weak: int, missing: int, lost: float, least_cover: float) -> str:
    """Diagonal voting over the same templates; documents must have distinct ids."""
    rows = ", ".join(
        f"({i}, '{label}', {str(base).lower()}, {k}, {len(words) - k + 1}, {at}, '{' '.join(words[at : at + k])}')"
        for i, label, base, k, words in templates
        for at in range(len(words) - k + 1)
    )
    return f"""
with templates(template, label, base, k, grams, tpos, gram) as (values {rows}),
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
places as (select doc_id, w, unnest(range(len(w))) as pos from words),
grams as (
  select doc_id, pos, 2 as k, w[pos + 1] || ' ' || w[pos + 2] as gram from places where pos + 2 <= len(w)
  union all select doc_id, pos, 3, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] from places where pos + 3 <= len(w)),
votes as (
  select doc_id, template, label, base, k, grams, pos - tpos as diagonal, list(tpos) as tset, min(pos) as a, max(pos) as z
  from grams join templates using (k, gram) group by all
  having k = 2 or count(*) >= greatest(2, grams // {weak})),
marked as (
  select *, case when k = 2 or coalesce(diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > greatest({near}, (grams + k - 1) // {near}), true)
    then 1 else 0 end as new from votes),
merged as (select *, sum(new) over (partition by doc_id, template order by diagonal rows unbounded preceding) as span from marked),
spans as (
  select doc_id, template, label, base, k, grams, span, len(list_distinct(flatten(list(tset)))) as there, min(a) as first, max(z) + max(k) - 1 as last
  from merged group by doc_id, template, label, base, k, grams, span),
good as (
  select *, there::double / grams as cover from spans
  where case when k = 2 then there = grams else grams - there <= greatest({missing}::double, grams * {lost}::double) and there::double / grams >= {least_cover}::double
    and last - first + 1 <= grams + k - 1 + greatest({near}, (grams + k - 1) // 4) end),
per as (
  select doc_id, count(*) filter (base) as n_base, min(first) filter (base) as first_word, max(first) filter (base) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(cover) as score
  from good group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from words left join per using (doc_id)"""
