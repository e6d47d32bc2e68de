"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import math

from volsmith.llm import licenses, quality
from volsmith.llm.common import LOWER, UPPER

WORDS = r"[^\x20\x09-\x0D]+"

EXACT = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d"""

NEAR = f"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') as w from documents),
s as (
    select doc_id, unnest(case when len(w) < 5 then [w]
        else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as shingle
    from d where len(w) > 0),
u as (select distinct doc_id, shingle from s),
n as (select doc_id, count(*) as n from u group by 1),
pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from u a join u b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (
    select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
    where 100 * common >= 85 * (x.n + y.n - common)),
reach as (
    select doc_id, doc_id as other from d union
    select r.doc_id, l.b from reach r join links l on r.other = l.a),
least as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from least left join n using (doc_id)"""

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h) as n, sha1(h) as digest, max(page_id) over (partition by h) as first_id from p)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> first_id then first_id end as refers_to
from q"""

QUALITY = rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (
    select doc_id, source, regexp_extract_all(t, '{WORDS}') as w, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) as lines
    from d),
windows as (
    select doc_id, i, w[i:i + 2] as window3 from (
        select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, window3) > 1),
covered as (
    select doc_id, count(distinct word_at) as n from (select doc_id, unnest([i, i + 1, i + 2]) as word_at from twice) group by 1),
rules as (
    select w.doc_id, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, n_symbols,
           len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
           len(w) < {quality.MIN_WORDS} or 100 * coalesce(n, 0) > {quality.MAX_REPEATED} * len(w) as base_failed
    from w left join covered using (doc_id)),
hosts as (
    select source, count(*) as n, sum(base_failed::int) as failed from rules where source is not null group by 1),
moments as (
    select (sum(failed) + 0.5) / (sum(n) + 1) as mean, var_pop(failed / n) as spread, avg(1 / n) as noise from hosts),
prior as (
    select mean, greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * noise, 1e-6) - 1, 1) as strength
    from moments),
rates as (
    select source, (failed + mean * strength) / (n + strength) as rate, n, strength from hosts, prior),
rejected as (
    select source from rates where rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) > {quality.MAX_HOST_RATE})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (source is null or source not in (select source from rejected)) as kept
from rules"""


def _licenses() -> str:
    def starts(phrase: str) -> str:
        match = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        return f"list_filter(range(1, len(w) + 1), lambda i: coalesce({match}, false))"

    found = ", ".join(f"{starts(p)} as s{k}" for k, p in enumerate(licenses.PHRASES))
    every = " || ".join(f"s{k}" for k in range(len(licenses.PHRASES)))
    held = ", ".join(f"case when len(s{k}) > 0 then '{label}' end" for k, label in enumerate(licenses.PHRASES.values()))
    rows = []
    for label, text in licenses.TEMPLATES.items():
        own = licenses.template_tokens(text)
        need = math.ceil(licenses.THRESHOLD * len(own) - 1e-9)
        rows.append(f"('{label}', [{', '.join(repr(t) for t in own)}], {need})")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select doc_id, regexp_extract_all(t, '{word}') as w from d),
p as (select doc_id, len(w) as n_words, {found} from w),
b as (
    select doc_id, n_words, list_transform({every}, lambda i: i - 1) as places,
           list_filter([{held}], lambda x: x is not null) as base
    from p),
templates(label, own, need) as (values {', '.join(rows)}),
lines as (
    select doc_id, list_distinct(regexp_extract_all(line, '{word}')) as held
    from (select doc_id, unnest(string_split(t, chr(10))) as line from d)),
matched as (
    select doc_id, label, len(list_intersect(own, held)) / len(own) as containment
    from lines, templates where len(list_intersect(own, held)) >= need),
found as (select doc_id, list(distinct label) as labels, max(containment) as best from matched group by 1)
select doc_id, n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word,
       array_to_string(list_sort(base), ',') as base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') as labels,
       case when len(places) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from b left join found using (doc_id)"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Assignment and integer means unrolled round by round; whole numbers throughout."""
    steps = [f"""
with v as materialized (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as e from embeddings
    where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (
    select vec_id, part, e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] as x from v, range({parts}) t(part)),
c0 as materialized (
    select part, entry, x as c from (
        select part, x, row_number() over (partition by part order by vec_id) - 1 as entry from p) where entry < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
    select vec_id, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
                                         entry := entry)) as best, any_value(x) as x
    from p join c{r} using (part) group by vec_id, part)""")
        if r < rounds:
            steps.append(f"""
m{r} as materialized (
    select part, entry, list((s - ((s % n) + n) % n) // n order by i) as c from (
        select part, best.entry as entry, i, cast(sum(x[i]) as bigint) as s, count(*) as n
        from a{r}, range(1, 1 + (select max(len(x)) from p)) t(i) group by all) group by part, entry),
c{r + 1} as materialized (
    select part, entry, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (part, entry))""")
    return ",".join(steps) + f""",
coded as (
    select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error
    from a{rounds} group by vec_id),
books as (
    select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join v using (vec_id), books"""


COLLOCATIONS = rf"""
with d as (
    select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from w group by lang),
f1 as (select lang, w1, count(*) as f from (select lang, unnest(w) as w1 from w) group by all),
f2 as (
    select lang, g.a as w1, g.b as w2, count(*) as f from (
        select lang, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1]))) as g from w)
    group by all),
f3 as (
    select lang, g.a as w1, g.b as w2, g.c as w3, count(*) as f from (
        select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]))) as g from w)
    group by all having count(*) >= 10),
three as (
    select f3.lang, f3.w1, f3.w2, f3.w3, f3.f as a, x.f as l1, y.f as r1, z.f as l2, u.f as r2,
           (1000000::hugeint * f3.f * f3.f) // (x.f::hugeint * y.f) as s1, (1000000::hugeint * f3.f * f3.f) // (z.f::hugeint * u.f) as s2
    from f3 join f1 x on x.lang = f3.lang and x.w1 = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
    join f2 z on z.lang = f3.lang and z.w1 = f3.w1 and z.w2 = f3.w2 join f1 u on u.lang = f3.lang and u.w1 = f3.w3),
around as (
    select lang, w1, w2, max(a) as most from (
        select lang, w1, w2, a from three union all select lang, w2, w3, a from three) group by all),
scored as (
    select f2.lang, f2.w1 || ' ' || f2.w2 as phrase, f2.f as a, x.f as l, y.f as r,
           (1000000::hugeint * f2.f * f2.f) // (x.f::hugeint * y.f) as score
    from f2 join f1 x on x.lang = f2.lang and x.w1 = f2.w1 join f1 y on y.lang = f2.lang and y.w1 = f2.w2
    left join around o on o.lang = f2.lang and o.w1 = f2.w1 and o.w2 = f2.w2
    where f2.f >= 10 and not coalesce(100 * o.most >= 50 * f2.f, false)
    union all
    select lang, w1 || ' ' || w2 || ' ' || w3, a, case when s1 <= s2 then l1 else l2 end,
           case when s1 <= s2 then r1 else r2 end, least(s1, s2) from three),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
       cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000"""


ORACLES = {
    "op4_exact_dedup": EXACT,
    "op5_near_dedup": NEAR,
    "op7_warc": WARC,
    "op9_quality": QUALITY,
    "op10_licenses": _licenses(),
    "op12_vector_codes": _vector_codes(),
    "op13_collocations": COLLOCATIONS,
}
