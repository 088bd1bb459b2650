"""The training-data operators as registered queries, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(load)`` where ``load(table)`` reads one given table."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP5_SQL = r"""
with t as (select distinct conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\|') as speaker, replace(coalesce(text, ''), '<|', '<\|') as said from conversations),
o as (select *, turn // 64 as part, md5(speaker || ' ' || said) as dig from t),
p as (select distinct conv_id, speaker as participant from t where speaker <> 'system'),
s as (select conv_id, participant, part, turn, dig, speaker = participant as mine, said || '<|end|>' as body,
        case when speaker = participant then '<|assistant|>' when speaker = 'system' then '<|system|>' else '<|user:' || speaker || '|>' end || chr(10) as lead
      from o join p using (conv_id)),
l as (select *, coalesce(sum(length(lead) + length(body) + 1) over (partition by conv_id, participant, part order by turn, dig rows between unbounded preceding and 1 preceding), 0) + length(lead) as a from s)
select conv_id, participant, part, count(*) as turns, string_agg(lead || body || chr(10), '' order by turn, dig) as text,
       string_agg(case when mine then a::bigint || '-' || (a + length(body))::bigint end, ',' order by turn, dig) as mask
from l group by all
"""

#: Base32 of the SHA-1: each five hex digits are twenty bits, four letters.
OP6_SQL = f"""
with d as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
v as (select page_id, octet_length(encode(body)) as payload_bytes, hex, min(page_id) over (partition by body) as owner from d)
select page_id, payload_bytes, {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, {1 + 5 * g}, 5))::bigint >> {15 - 5 * i} & 31)::int, 1)" for g in range(8) for i in range(4))} as payload_digest,
       case when owner = page_id then 'response' else 'revisit' end as record_type, case when owner <> page_id then owner end as refers_to
from v
"""

OP7_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""


#: The crc32 of text as a DuckDB macro: a table of 256 remainders, then one step for each byte (plain bytes in hex).
CRC_SQL = """
crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as tab)
"""


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::int + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(tab[(xor(c, b) % 256 + 1)::int], c // 256)))"


OP11_SQL = f"""
with {CRC_SQL},
t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
o as (select *, row_number() over (partition by c order by turn nulls first, md5(length(role) || ':' || role || text)) as p from t),
n as (select c, count(*) as n, {_crc("c::varchar")} % 6 as h from o, crc_table group by c, tab),
r as (select n.c, b.p, b.role, b.text from n join o b on b.c = n.c - n.c % 100 and b.p <= n.h
      union all select n.c, n.h + o.p, o.role, o.text from n join o on o.c = n.c and o.p > n.h),
q as (select c, row_number() over (partition by c order by p) as d, role, text from r),
l as (select n.c, coalesce(max(d), 0) as len from n left join q on q.c = n.c group by n.c),
x as (select a.c, a.d, md5(string_agg(length(b.role) || ':' || length(b.text) || ':' || b.role || b.text, '' order by b.d)) as k, any_value(length(a.text)) as size
      from q a join q b on a.c = b.c and b.d <= a.d group by a.c, a.d
      union all select c, 0, '', 0 from n),
y as (select x.*, p.k as pk, len from x join l on l.c = x.c left join x p on p.c = x.c and p.d = x.d - 1),
nodes as (select d, k, any_value(pk) as pk, min(c) as conv_id, count(*) as n, (count(*) - 1) * any_value(size) as save,
            sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where len = d), '')) as ends from y group by d, k),
kids as (select d - 1 as d, pk as k, count(*) as n from nodes where d > 0 group by all),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children, par.conv_id as parent from nodes left join kids using (d, k) left join nodes par on par.d = nodes.d - 1 and par.k = nodes.pk),
under as (select distinct a.d, a.k, b.d as bd, b.k as bk from y a join y b on a.c = b.c and b.d >= a.d)
select f.conv_id, f.d as depth, f.parent as parent_conv_id, f.n as n_convs, f.n_children,
       count(*) filter (where g.n_children = 0) as n_leaves, sum(g.save)::bigint as saved_tokens, f.ends as ends_sha256
from full_nodes f join under u on u.d = f.d and u.k = f.k join full_nodes g on g.d = u.bd and g.k = u.bk
group by all
"""

OP12_SQL = f"""
with recursive {CRC_SQL},
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
c as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by all),
h as (select run, n, {_crc("(coalesce(doc_id::varchar, '') || ':' || run)")} as h from c, crc_table),
s as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
w as (select word, sum(n)::bigint as n from s where length(word) >= 6 group by word having sum(n) >= 5),
g as (select word, n, unnest(range(1, length(word) + 1))::int as i from w),
holes as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from g),
near as (select x.word, y.word as near, y.n as m from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
         union select x.word, y.word, y.n from holes x join w y on x.a || x.b = y.word
         union select y.word, x.word, x.n from holes x join w y on x.a || x.b = y.word),
best as (select word, count(*) as n_near, arg_min(struct_pack(near, m), struct_pack(x := -m, y := near)) as b from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= 5 * w.n then b.near end as form, case when b.m >= 5 * w.n then b.m end as form_n from w left join best using (word)),
hops as (select word, word as root from forms union select hops.word, f.form from hops join forms f on f.word = hops.root where f.form is not null)
select forms.word, forms.form, hops.root, forms.n, forms.n_near, forms.form_n
from forms join hops on hops.word = forms.word join forms last on last.word = hops.root and last.form is null
"""

OP13_SQL = """
with l as (select rid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
           from (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents)),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, max(doc_id) as best from (select distinct key, doc_id from k where length(key) >= 40) group by key having count(*) >= 5),
m as (select k.*, best is not null and doc_id is distinct from best as gone from k left join o using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by rid
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(load):
    from gaugewell.llm.prefix_trie import shared_head_trie

    return shared_head_trie(load("conversations"))


@query("op12_spelling_variants", OP12_SQL)
def op12_spelling_variants(load):
    from gaugewell.llm.spelling import spelling_variants

    return spelling_variants(load("documents"), typo_every=199)


@query("op13_line_dedup", OP13_SQL)
def op13_line_dedup(load):
    from gaugewell.llm.line_dedup import mark_lines

    return mark_lines(load("documents"))


@query("op5_perspectives", OP5_SQL)
def op5_perspectives(load):
    from pyspark.sql import functions as F

    from gaugewell.llm.chat_format import LAST, TURNS, rotate, whole_parts

    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    part = F.when(F.col("part") < LAST // TURNS, F.col("part")).alias("part")  # null turns are in no numbered part
    return whole_parts(rotate(load("conversations"))).select("conv_id", "participant", part, F.col("turns").cast("long").alias("turns"), "text", F.when(F.size("mask") > 0, mask).alias("mask"))


@query("op6_warc", OP6_SQL)
def op6_warc(load):
    from gaugewell.llm.warc import archive_pages

    return archive_pages(load("pages"))


@query("op7_exact_dedup", OP7_SQL)
def op7_exact_dedup(load):
    from gaugewell.llm.exact_dedup import mark_duplicates

    return mark_duplicates(load("documents"), keep="largest")


@query("op1_toxicity")
def op1_toxicity(load):
    from gaugewell.llm.toxicity import held_out_score

    return held_out_score(load("documents"), load("labels"))


@query("op2_quality")
def op2_quality(load):
    from gaugewell.llm.quality import held_out_score

    return held_out_score(load("documents"), load("labels"))


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _url_sql() -> str:
    from gaugewell.llm.url_filter import LIMIT, TWO_PART_SUFFIXES, Z

    fits = [(says, text, text.partition("/")) for says, text in sorted(URL_RULES, key=lambda r: -len(r[1]))]
    case = lambda pick: "case " + " ".join(f"when (host = '{h}' or host like '%.{h}') and path like '{s}{p}%' then '{pick(says, text)}'" for says, text, (h, s, p) in fits) + " end"
    two = ", ".join(f"'{s}'" for s in TWO_PART_SUFFIXES)
    last = lambda n: f"array_to_string(list_slice(labels, -{n}, -1), '.')"
    size = lambda table: f"select (1 - rho) / rho as s from (select least(greatest(coalesce(round(sum((k - n * m) ** 2 - n * m * (1 - m)), 6) / nullif(round(sum(n * (n - 1) * m * (1 - m)), 6), 0), 0.5), 0.001), 0.999) as rho from {table})"
    return f"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') as h,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
p as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
known as (select doc_id as id, max(1 - quality) as bad from labels where doc_id is not null and quality is not null group by 1),
hosts as (select host, count(*) as pages, count(bad) as n, coalesce(sum(bad), 0) as k, string_split(host, '.') as labels
          from p left join known on page_id = id group by host),
named as (select host, n, k, case when {last(2)} in ({two}) then {last(3)} else {last(2)} end as domain,
            case when {last(2)} in ({two}) then {last(2)} else {last(1)} end as suffix from hosts),
domains as (select domain, any_value(suffix) as suffix, sum(n) as n, sum(k) as k from named group by domain),
suffixes as (select suffix, sum(n) as n, sum(k) as k, (sum(sum(k)) over () + 1) / (sum(sum(n)) over () + 2) as m from domains group by suffix),
a as ({size('suffixes')}),
d as (select domain, d.n, d.k, (x.m * s + x.k) / (s + x.n) as m from domains d join suffixes x using (suffix), a),
b as ({size('d')}),
h as (select host, g.n, g.k, (d.m * s + d.k) / (s + d.n) as m from named g join d using (domain), b),
c as ({size('h')}),
post as (select host, m * s + k as bad, (1 - m) * s + n - k as good from h, c),
rep as (select host, bad / (bad + good) as r, greatest(0, bad / (bad + good) - {Z} * sqrt(bad * good / ((bad + good) ** 2 * (bad + good + 1)))) as lo from post)
select page_id, host, path, {case(lambda says, text: text)} as rule,
       coalesce({case(lambda says, text: says)}, case when lo > {LIMIT} then 'block' else 'allow' end) as verdict,
       round(r, 6) as reputation, round(lo, 6) as bound
from p join rep using (host)
"""


@query("op3_url_filter", _url_sql())
def op3_url_filter(load):
    """Pages whose id has a quality label are the labelled ones; quality 0 is a bad outcome."""
    from pyspark.sql import functions as F

    from gaugewell.llm.url_filter import judge

    outcomes = load("labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return judge(load("pages"), outcomes, URL_RULES)


@query("op4_decontaminate")
def op4_decontaminate(load):
    from gaugewell.llm.decontaminate import find_overlaps

    return find_overlaps(load("documents"), load("benchmark"))


@query("op8_pack")
def op8_pack(load):
    from gaugewell.llm.packing import pack

    return pack(load("documents"), public_tokenizer("byte_bpe_50k.json"))


@query("op9_pii_surrogates")
def op9_pii_surrogates(load):
    """The key is a secret of whoever runs it; the registered query reads it from the session, with a fixed one for tests."""
    from gaugewell.llm.pii import pseudonymise

    docs = load("documents")
    return pseudonymise(docs, docs.sparkSession.conf.get("spark.gaugewell.pii.key", "not a secret").encode())


@query("op10_simhash_groups")
def op10_simhash_groups(load):
    from gaugewell.llm.simhash import fingerprint_groups

    return fingerprint_groups(load("documents"))
