"""DuckDB SQL for the opN_ queries that SQL can express: plain statements of the contracts, over whole tables."""

from __future__ import annotations

from .repetition import Rules

WORDS = r"'[^\x20\x09-\x0D]+'"
ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SUFFIX_DEDUP = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
chunks as (select rid, doc_id, len(h) // 2 as n, c, substr(h, 1024 * c + 1, 1024 + 98) as part from (select *, unnest(range(0, len(h) // 1024 + 1)) as c from d)),
windows as (select rid, doc_id, 512 * c + i as pos, substr(part, 2 * i + 1, 100) as w from (select *, unnest(range(0, 512)) as i from chunks) where 512 * c + i + 50 <= n),
firsts as (select w, min(doc_id) as first from windows group by w having count(*) > 1),
hits as (select rid, pos from windows join firsts using (w) where first < doc_id),
runs as (select rid, min(pos) as a, max(pos) + 50 as b from (
  select rid, pos, sum(fresh) over (partition by rid order by pos) as run from (
    select rid, pos, case when pos <= 50 + lag(pos) over (partition by rid order by pos) then 0 else 1 end as fresh from hits)) group by rid, run),
kept as (select rid, coalesce(lag(b) over (partition by rid order by a), 0) as a, a as b from runs union all select rid, max(b), 100000000 from runs group by rid),
texts as (select rid, string_agg(substr(h, 2 * a + 1, 2 * (least(b, len(h) // 2) - a)), '' order by a) as kept from kept join d using (rid) group by rid)
select d.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::BIGINT as n_removed, coalesce(n_spans, 0)::BIGINT as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join (select rid, sum(b - a) as n_removed, count(*) as n_spans from runs group by rid) using (rid) left join texts using (rid)
"""


def repetition(rules: Rules = Rules()) -> str:
    sizes = sorted({rules.window, *(k for k, _ in rules.coverage)})
    grams, found = [], []
    for k in sizes:
        grams.append(
            f"g{k} as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from (select rid, i, array_to_string(ws[i + 1 : i + {k}], ' ') as gram from (select rid, ws, unnest(range(0, len(ws) - {k - 1})) as i from d))) where n > 1),\n"
            f"c{k} as (select rid, count(*) as n, sum(chars) as chars from words where exists (select 1 from (select distinct rid, i + unnest(range(0, {k})) as i from g{k}) x where x.rid = words.rid and x.i = words.i) group by rid)"
        )
        found.append(f"left join (select rid, n as n{k}, chars as chars{k} from c{k}) using (rid)")
    bad = " or ".join([f"coalesce(chars{k}, 0)::DOUBLE / greatest(word_chars, 1) > {most}::DOUBLE" for k, most in rules.coverage])
    failed = f"n_words < {rules.least_words} or 100 * n_repeat_words > {rules.window_percent} * n_words"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {WORDS}) as ws from documents),
words as (select rid, unnest(range(0, len(ws))) as i, length(unnest(ws)) as chars from d),
lines as (select rid, line, count(*) as n from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, {WORDS}) group by rid, line),
by_line as (select rid, sum(n - 1) as n_dup_lines, sum(n * length(array_to_string(regexp_extract_all(line, {WORDS}), ''))) filter (where n > 1) as chars_lines from lines group by rid),
{(","+chr(10)).join(grams)},
m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0)::BIGINT as n_dup_lines,
  coalesce(n{rules.window}, 0)::BIGINT as n_repeat_words, chars_lines, {", ".join(f"chars{k}" for k in sizes)} from d left join by_line using (rid) {" ".join(found)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} as base_failed,
  not ({failed} or {bad} or coalesce(chars_lines, 0)::DOUBLE / greatest(word_chars, 1) > {rules.line_coverage}::DOUBLE or n_symbols > {rules.symbols_per_word}::DOUBLE * n_words) as kept from m
"""


SUBSTRINGS = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as ws from documents),
windows as (select rid, i, array_to_string(ws[i + 1 : i + 35], ' ') as w from (select rid, ws, unnest(range(0, len(ws) - 34)) as i from d)),
gone as (select distinct rid, i + unnest(range(0, 35)) as i from (select rid, i, count(*) over (partition by w) as n from windows) where n > 1),
words as (select rid, unnest(range(0, len(ws))) as i, unnest(ws) as word from d),
kept as (select rid, string_agg(word, ' ' order by i) as kept, count(*) as n from words anti join gone using (rid, i) group by rid)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (rid)
"""

DECONTAMINATION = f"""
with items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), {ITEM_WORDS}) as ws from benchmark where item_id is not null),
wanted as (select distinct item_id, least(len(ws), 10) as size, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') as w from (select *, unnest(range(0, greatest(len(ws) - 9, 1))) as i from items where len(ws) > 0)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), {ITEM_WORDS}) as ws from documents),
places as (select rid, size, i, array_to_string(ws[i + 1 : i + size], ' ') as w from (select rid, ws, size, unnest(range(0, len(ws) - size + 1)) as i from d, (select distinct size from wanted))),
hits as (select rid, i, p.size, item_id from places p join wanted using (size, w)),
covered as (select rid, count(*) as n_hit from (select distinct rid, i + unnest(range(0, size)) as i from hits) group by rid),
named as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct rid, item_id::VARCHAR as item from hits) group by rid)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rid) left join named using (rid)
"""


def url_rules(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
with rules(h, p, v) as (values {values}),
cut as (select row_number() over () as rid, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (select rid, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), {UPPER_LOWER}), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
won as (select rid, arg_max(h || p, 1000000 * (length(h) + length(p)) + length(h)) as rule, arg_max(v, 1000000 * (length(h) + length(p)) + length(h)) as verdict
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join won using (rid)
"""


NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), {WORDS}) as ws from documents),
shingles as (select distinct doc_id, array_to_string(ws[i + 1 : i + 5], ' ') as s from (select doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) as i from d where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as k from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 75 * (p.n + q.n - k)),
edges as (select x, y from links union all select y, x from links),
reach as (select x as doc_id, x as low from edges union select reach.doc_id, edges.y from reach join edges on edges.x = reach.low)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(low, d.doc_id) as component_id, coalesce(low, d.doc_id) = d.doc_id as kept
from d left join sizes using (doc_id) left join (select doc_id, min(low) as low from reach group by doc_id) using (doc_id)
"""


def usable(dim: int | None = None) -> str:
    return ("len(embedding) = %d" % dim if dim else "len(embedding) > 0") + " and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


SQUARED = "(list_dot_product({0}, {0}) + list_dot_product({1}, {1}) - 2 * list_dot_product({0}, {1}))::BIGINT"
#: The floor of a sum over a count, without fractions.
MEAN = "((sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE"


def lloyd(k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64) -> str:
    """Whole numbers as doubles, exact below 2**53."""
    steps = [
        f"""vs as materialized (select row_number() over () as r, vec_id, embedding, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) as v from embeddings where {usable(dim)}),
 c0 as materialized (select row_number() over (order by sha256(concat('{seed}:', vec_id)), embedding) - 1 as cluster, v as c from vs where vec_id is not null qualify cluster < {k})"""
    ]
    for i in range(rounds + 1):
        far = SQUARED.format("v", "c")
        steps.append(f"a{i} as materialized (select r, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(cluster, {far} * {k} + cluster) as cluster, min({far}) as distance from vs, c{i} group by r)")
        if i < rounds:
            steps.append(f"m{i} as (select cluster, list(q order by i) as c from (select cluster, i, {MEAN} as q from a{i}, range(1, {dim + 1}) t(i) group by cluster, i) group by cluster)")
            steps.append(f"c{i + 1} as materialized (select cluster, coalesce(m.c, o.c) as c from c{i} o left join m{i} m using (cluster))")
    return f"""with {", ".join(steps)} select vec_id, cluster::INT as cluster, distance, (sum(distance) over (partition by cluster))::BIGINT as cluster_inertia, (sum(distance) over ())::BIGINT as inertia,
 sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) as centroid_sha256 from a{rounds} join c{rounds} using (cluster)"""


def quantise(entries: int = 256, rounds: int = 4, parts: int = 4, dim: int = 64) -> str:
    width = dim // parts
    cut = f"select *, p, list_slice(x, p * {width} + 1, (p + 1) * {width}) as v from vs, range({parts}) t(p)"
    steps = [
        f"vs as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) as x from embeddings where {usable()})",
        f"ps as materialized ({cut}), b0 as materialized (select p, r - 1 as e, v as c from ps where r <= {entries})",
    ]
    for i in range(rounds + 1):
        far = SQUARED.format("v", "c")
        steps.append(f"a{i} as materialized (select r, p, any_value(v) as v, arg_min(e, {far} * {entries} + e) as e, min({far}) as error from ps join b{i} using (p) group by r, p)")
        if i < rounds:
            steps.append(f"m{i} as (select p, e, list(q order by i) as c from (select p, e, i, {MEAN} as q from a{i}, range(1, {width + 1}) t(i) group by p, e, i) group by p, e)")
            steps.append(f"b{i + 1} as materialized (select p, e, coalesce(m.c, o.c) as c from b{i} o left join m{i} m using (p, e))")
    return f"""with {", ".join(steps)}, said as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' order by p, e)) as codebooks_sha256 from b{rounds}),
 coded as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(error)::BIGINT as error from a{rounds} group by r)
 select vec_id, code, error, (sum(error) over (partition by label))::BIGINT as label_error, codebooks_sha256 from coded join vs using (r), said"""


def chat(marks: dict[str, tuple[str, str]], control: list[str]) -> str:
    rx = "|".join("".join("\\" + c if c in "[]/" else c for c in m) for m in control)

    def size(x: str) -> str:
        return f"length(regexp_replace(replace({x}, '\\', '\\\\'), '{rx}', '\\0.', 'g'))"

    head = " ".join(f"when role = '{r}' then {len(a)}" for r, (a, _) in marks.items())
    tail = " ".join(f"when role = '{r}' then {len(b)}" for r, (_, b) in marks.items())
    return f"""with rows as (select conv_id, case when conv_id is null then row_number() over () end as own, turn, coalesce(role, '') as role, coalesce(text, '') as text from
  (select conv_id, turn, role, text from conversations union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
 placed as (select *, row_number() over w as nth, lag(role) over w is distinct from role as fresh, lead(role) over w is distinct from role as final from rows window w as (partition by conv_id, own order by turn nulls first, role, text)),
 sized as (select *, {size('text')} + case when not fresh then 6 {head} else 13 + {size('role')} end + case when not final then 0 {tail} else 7 end as size from placed)
 select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by nth)) as turns_sha256,
 coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::BIGINT as loss_chars, sha256(coalesce(string_agg(text, '' order by nth) filter (where role = 'assistant'), '')) as loss_sha256,
 (3 + sum(size))::BIGINT as formatted_chars from sized group by conv_id, own"""
