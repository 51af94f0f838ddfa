"""The operators' queries as DuckDB SQL, by a plainer way each, where SQL can say them.

Packing and token counts need the tokenizer, SimHash its 64-bit hash, the search and the
quality scores a fit; those are tested against brute force, exact round trips and
held-out accuracy instead.
"""

from __future__ import annotations

from . import licenses, sharding, urlfilter

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def sharding_sql(n: int = 24) -> str:
    """Draws over all leaves' paths; the checksum bit by bit from its polynomial."""

    def descend(shape: sharding.Tree) -> str:
        def winner(level: dict[str, float]) -> str:
            draws = [f"{{'d': -ln((('0x' || substr(md5(k || '|{name}'), 1, 12))::bigint + 0.5) / 281474976710656.0) / {w!r}, 'n': '{name}'}}" for name, w in sorted(level.items())]
            return f"list_sort([{', '.join(draws)}])[1].n"

        racks = {region: {rack: sum(leaves.values()) for rack, leaves in below.items()} for region, below in shape.items()}
        top = winner({region: sum(below.values()) for region, below in racks.items()})
        middle = " ".join(f"when '{region}' then {winner(below)}" for region, below in racks.items())
        last = " ".join(f"when '{rack}' then {winner({str(s): w for s, w in leaves.items()})}" for below in shape.values() for rack, leaves in below.items())
        return f"(select (case rack {last} end)::int from (select case region {middle} end as rack from (select {top} as region)))"

    return f"""with c as (select list(v order by i) as tbl from (select i, list_reduce(range(8)::bigint[], lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v from range(256) r(i))),
d as (select doc_id, coalesce(doc_id::varchar, 'null') as k, encode(coalesce(text, '')) as b from documents),
s as (select doc_id, k, (octet_length(b) + 8)::bigint as size, {descend(sharding.tree(n))} as shard, {descend(sharding.tree(n + 1))} as grown_shard, hex(b) as x from d),
t as (select *, xor(list_reduce(range(0, length(x) // 2), lambda c, i: xor(tbl[(xor(c, ('0x' || substr(x, 2 * i + 1, 2))::bigint) & 255) + 1], c >> 8), 4294967295), 4294967295) as text_crc32 from s, c)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by substr(md5(k || '|' || text_crc32), 1, 3), doc_id) - 1 as slot, grown_shard from t"""


def licenses_sql() -> str:
    """Over all paragraphs: no anchors here."""
    m = licenses.train()
    weights = ", ".join(f"({_text(g)}, {list(w)})" for g, w in sorted(m.weights.items()))
    known = sorted({(s, f"{family}#{i}", family, len(licenses.shingles_of(licenses.words_of(t)))) for family, ts in licenses.TEMPLATES.items() for i, t in enumerate(ts) for s in licenses.shingles_of(licenses.words_of(t))})
    shingles = ", ".join(f"({_text(s)}, {_text(t)}, {_text(f)}, {n})" for s, t, f, n in known)
    runs = lambda n: f"list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))"
    sure = ", ".join(f"case when sum(w[{k + 1}]) + {m.bias[k]} >= {m.cuts[k]} then {_text(f)} end" for k, f in enumerate(licenses.FAMILIES))
    k = len(licenses.FAMILIES)
    return f"""with w(gram, w) as (values {weights}), t(shingle, template, kin, n_template) as (values {shingles}),
b as (select doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{licenses.ENDED}', '\\1' || chr(1), 'g'), '{licenses.BLANK}', chr(1), 'g'), chr(1)) as parts from documents),
l as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as par from b),
p as (select doc_id, par, list_filter(regexp_split_to_array({_LOWER.format('line')}, '[^0-9a-z]+'), lambda x: x <> '') as words from l),
g as (select doc_id, par, unnest(list_distinct(words || {runs(2)} || {runs(3)})) as gram from p),
s as (select doc_id, par, list_filter([{sure}], lambda x: x is not null) as families, sum(w[{k + 1}]) + {m.bias[k]} >= {m.cuts[k]} as some_licence from g join w using (gram) group by all),
f as (select doc_id, par, unnest(case when len(families) > 0 then families when some_licence then ['unknown'] else [] end) as family from s),
h as (select doc_id, par, list_distinct(case when len(words) < {licenses.SHINGLE} then [array_to_string(words, ' ')] else {runs(licenses.SHINGLE)} end) as own from p semi join f using (doc_id, par)),
n as (select doc_id, par, kin, template, count(*) / least(any_value(len(own)), any_value(n_template)) as alike from (select doc_id, par, own, unnest(own) as shingle from h) join t using (shingle) group by all),
r as (select f.doc_id, family, coalesce((select max(alike) from n where n.doc_id = f.doc_id and n.par = f.par and n.kin = f.family), 0) >= {licenses.ALIKE} as confirmed from f)
select d.doc_id, coalesce(array_to_string(list_sort(list(distinct family) filter (confirmed)), ','), '') as families, count(family) as n_licence, count(*) filter (confirmed) as n_confirmed, count(*) filter (family = 'unknown') as n_unknown
from documents d left join r using (doc_id) group by d.doc_id"""


def urls_sql(rules: tuple = urlfilter.RULES) -> str:
    """Components by recursion over links with absolute targets (the driver's pages have none at all)."""

    def rule(host: str, path: str) -> str:
        fits = []
        for name, _ in sorted(rules, key=lambda r: -len(r[0])):
            at, _, start = name.partition("/")
            fits.append(f"when ({host} = '{at}' or ends_with({host}, '.{at}')) and starts_with({path}, '/{start}') then '{name}'")
        return f"case {' '.join(fits)} end"

    verdict = "case {0} " + " ".join(f"when '{name}' then '{v}'" for name, v in rules) + " end"
    host, path = "regexp_extract({0}, '^(?s:.*?)://([^/?#]*)', 1)", "coalesce(regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"
    host = f"{_LOWER.format(host)}"
    return f"""with recursive links as (select url as a, regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([a-z]+://[^"]+)"', 1) as b from pages where url is not null),
edges as (select a, b from links where b <> '' union select b, a from links where b <> ''),
reach as (select a, a as b from edges union select r.a, e.b from reach r join edges e on e.a = r.b),
spread as (select a, bool_or({verdict.format(rule(host.format('b'), path.format('b')))} = 'block') as blocked, bool_or({verdict.format(rule(host.format('b'), path.format('b')))} = 'allow') as allowed from reach group by a),
p as (select page_id, url, {host.format('url')} as host, {path.format('url')} as path from pages),
q as (select *, {rule('host', 'path')} as rule from p)
select page_id, host, path, rule, coalesce({verdict.format('rule')}, case when coalesce(blocked, false) and not coalesce(allowed, false) then 'block' else 'allow' end) as verdict from q left join spread on spread.a = q.url"""


LINES = """with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (select doc_id, i - 1 as pos, array_to_string(lines[i:i + 2], chr(10)) as w from l, lateral (select unnest(range(1, len(lines) - 1)) as i)),
v as (select * from w where trim(replace(w, chr(10), '')) <> ''),
f as (select w, min({'d': doc_id, 'p': pos}) as first from v group by w having count(*) > 1),
later as (select doc_id, pos from v join f using (w) where {'d': doc_id, 'p': pos} <> first),
c as (select doc_id, list(distinct p) as gone from (select doc_id, unnest([pos, pos + 1, pos + 2]) as p from later) group by doc_id)
select l.doc_id, coalesce(len(lines), 0)::int as n_lines, coalesce(len(gone), 0)::int as n_removed,
  case when gone is null then text else array_to_string(list_filter(lines, lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text from l left join c using (doc_id)"""

_WORDS = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WINDOWS = f"""with d as (select doc_id, {_WORDS} as words from documents), i as (select item_id, {_WORDS} as words from benchmark),
iw as (select distinct item_id::varchar as item_id, least(10, len(words)) as span, array_to_string(words[a:a + least(10, len(words)) - 1], ' ') as w from i, lateral (select unnest(range(1, len(words) - least(10, len(words)) + 2)) as a) where len(words) > 0),
dw as (select doc_id, a, span, array_to_string(words[a:a + span - 1], ' ') as w from d, (select distinct span from iw), lateral (select unnest(range(1, len(words) - span + 2)) as a)),
h as (select doc_id, a, span, item_id from dw join iw using (span, w)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(a, a + span)) as p from h) group by doc_id),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as named from h group by doc_id)
select d.doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(named, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join n using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_hash_tree_sharding": sharding_sql(),
        "op3_license_paragraphs": licenses_sql(),
        "op5_url_redirects": urls_sql(),
        "op8_line_windows": LINES,
        "op9_winnowing": WINDOWS,
    }
