"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from foliogrid.llm.decontaminate import WINDOW

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
with w as (select doc_id, avg(case when quality = 1 then 2.0 else 0.5 end)::double as weight from labels where quality is not null group by doc_id),
d as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '{_SPACED}')), 0)::bigint as size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / 281474976710656.0) / coalesce(w.weight, 1.0) as key
  from documents d left join w on d.doc_id = w.doc_id),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) - 1 as place from s),
c as (select *, [3.0, 1.0, 2.0][(place % 3 + 1)::int]::double as weight, source_size * 2.0::double as cap, (sum(source_size) over ())::double * 1.5::double as whole from r),
l as (select *, (whole - (sum(cap) over (order by cap / weight, place rows unbounded preceding) - cap))
               / sum(weight) over (order by cap / weight desc, place desc rows unbounded preceding) as level from c),
f as (select *, cap <= level * weight as is_full from l),
t as (select *, (whole - sum(case when is_full then cap else 0 end) over ()) / nullif(sum(case when is_full then 0 else weight end) over (), 0) as rest from f),
g as (select source, source_size, case when is_full then cap else least(cap, rest * weight) end::double as target from t),
b as (
  select d.*, g.source_size, g.target, sum(size) over (partition by d.source order by key, doc_id, size rows unbounded preceding) - size as before,
         case when g.source_size > 0 then floor(g.target / g.source_size) else 0 end as whole
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (size * (whole + case when size > 0 and before + size / 2.0 <= target - whole * source_size then 1 else 0 end))::bigint as taken
from b
"""

_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '')
 || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
 || 'Content-Length: ' || strlen({0})::varchar || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"""

OP3 = f"""
with p as (select page_id, url, coalesce(html, '') as body, substr(md5(coalesce(page_id::varchar, '')), 1, 2) as fate, length(coalesce(html, '')) // 2 as half from pages),
q as (select *, case when fate = '00' then substr(body, 1, half) || case when substr(body, half + 1, 1) = '~' then '^' else '~' end || substr(body, half + 2)
                     when fate = '01' then substr(body, 1, half) else body end as copy from p),
r as (select page_id, fate, {_RECORD.format("body")} as record, {_RECORD.format("copy")} as other from q),
s as (select page_id, fate, strlen(record)::bigint as length, sha256(record) as sha, strlen(other)::bigint as replica_length, sha256(other) as replica_sha from r),
o as (select *, row_number() over (order by page_id nulls first, sha) - 1 as ordinal from s),
n as (select *, ordinal // 4096 as file, (ordinal % 4096)::bigint as number from o),
e as (select *, (sum(length) over (partition by file order by number rows unbounded preceding) - length)::bigint as "offset" from n)
select page_id, file, number, "offset", case when fate = '02' then 'missing' else 'altered' end as kind, length,
       case when fate <> '02' then replica_length end as replica_length, sha, case when fate <> '02' then replica_sha end as replica_sha
from e where fate = '02' or sha <> replica_sha
"""

OP5 = rf"""
with dw as (select row_number() over () as row, doc_id, coalesce(regexp_extract_all({_LOW.format("text")}, '{_ALNUM}'), []) as w from documents),
bw as (select item_id::varchar as item, regexp_extract_all({_LOW.format("text")}, '{_ALNUM}') as w from benchmark),
win as (select distinct item, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) as win from bw, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) as u(i) where len(w) > 0),
sizes as (select distinct len(win) as n from win),
found as (
  select row, i, n, item from (select row, i, n, list_slice(w, i, i + n - 1) as win from dw, sizes, unnest(range(1, len(w) - n + 2)) as u(i)) d join win using (win)),
hit as (select row, count(distinct p) as n_hit from found, unnest(range(i, i + n)) as v(p) group by row),
items as (select row, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct row, item from found where item is not null) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (row) left join items using (row)
"""

ORACLES = {"op2_mixing": OP2, "op3_warc_fixity": OP3, "op5_decontamination": OP5}
