"""The registered queries of this subpackage: one opN_<name> per operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import exact_topk, fill_middle, line_dedup, media_chunks, mixing, ngram_join, periodic_runs, secret_scan, sentencepiece_codec, token_files, toxicity, vector_neighbors, warc_bundles

#: Folder of the public tokenizers' files.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_vector_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, the lines removed and the SHA-256 of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup.dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentencepiece_codec.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files.token_files(docs, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.score_documents(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan.secret_digest(secret_scan.find_secrets(docs))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_middle.fill_middle(docs).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: A page's record; equal payloads of at least 1000 bytes are stored once.
OP2_SQL = """
with q as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
t as (select d, max(page_id) as top from q where n >= 1000 group by d)
select q.page_id, cast(n as bigint) as payload_bytes, q.d as payload_digest,
  case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < top then top end as refers_to
from q left join t on q.d = t.d
"""

#: All pairs of a label by cosine, and reachability.
OP4_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x from embeddings),
ok as (
  select * from v where label is not null and x is not null
  and len(list_filter(x, lambda a: a is null or not isfinite(a))) = 0 and list_sum(list_transform(x, lambda a: a * a)) > 0),
link as (
  select a.vec_id as u, b.vec_id as w from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= 0.93),
reach as (select vec_id as u, vec_id as w from v union select r.u, l.w from reach r join link l on r.w = l.u),
top as (select u, min(w) as component_id from reach group by u)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id = component_id as kept
from v join top on v.vec_id = top.u left join (select u, count(*) as n from link group by u) c on v.vec_id = c.u
"""

#: Distinct five-word shingles, pairs by shared shingles, and reachability.
OP5_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select u, v from p join n x on p.u = x.doc_id join n y on p.v = y.doc_id where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id as u, doc_id as v from documents union select r.u, l.v from reach r join link l on r.v = l.u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, t.component_id
from documents d left join n on d.doc_id = n.doc_id join (select u, min(v) as component_id from reach group by u) t on d.doc_id = t.u
"""

#: Lines by their shingles, all pairs of lines that share one, and the texts without the lines that have an earlier match.
OP6_SQL = """
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents where text is not null),
w as (
  select doc_id, k, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from l),
s as (
  select distinct doc_id, k, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, k, count(*) as n from s group by all),
p as (
  select a.doc_id as d, a.k as k, b.doc_id as e, b.k as j, count(*) as c from s a join s b
  on a.g = b.g and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.k < a.k)) group by all),
gone as (
  select distinct p.d, p.k from p join n x on p.d = x.doc_id and p.k = x.k join n y on p.e = y.doc_id and p.j = y.k where 100 * c >= 80 * (x.n + y.n - c)),
r as (
  select l.doc_id, count(*) as n_lines, count(g.d) as n_removed, string_agg(case when g.d is null then line end, chr(10) order by l.k) as t
  from l left join gone g on l.doc_id = g.d and l.k = g.k group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(case when d.text is not null then coalesce(r.t, '') end) as text_sha256
from documents d left join r on d.doc_id = r.doc_id
"""

#: kind, pattern over the text or (True) the text in lower case, least characters of group 2; group 1 stands in front of the span,
#: or (False) is part of it. Fixed values, written out anew for DuckDB.
_RULES_SQL = (
    ("assign", r"""()(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", True, 12),
    ("access", "()(AKIA[A-Z0-9]+)", False, 18),
    ("hex", "()([0-9a-f]+)", False, 16),
    ("private_key", "()(-----BEGIN [A-Z ]*PRIVATE KEY-----)", False, 0),
    ("github", "()(gh[pousr]_[A-Za-z0-9]{36,})", False, 0),
    ("slack", "()(xox[abprs]-[A-Za-z0-9-]{10,})", False, 0),
    ("jwt", r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", False, 0),
    ("google", "()(AIza[A-Za-z0-9_-]{35})", False, 0),
    ("bearer", r"()(bearer\x20+[a-z0-9._~+/=-]{20,})", True, 0),
)


def _rule_sql(order: int, kind: str, pattern: str, low: bool, least: int) -> str:
    """(doc_id, kind, o, s, e) of a rule's matches: the parts between them give their places."""
    text, pattern = ("low" if low else "t"), pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {order} as o, cast(s as bigint) as s, cast(s + n as bigint) as e from (
  select doc_id, len(v[i]) as size, len(m[i]) - len(a[i]) as n,
    list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) + len(a[i]) as s
  from (select *, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, regexp_extract_all({text}, '{pattern}') as m, regexp_extract_all({text}, '{pattern}', 1) as a, regexp_extract_all({text}, '{pattern}', 2) as v,
      regexp_split_to_array({text}, '{pattern}') as p from d))) where size >= {least}"""


#: Matches of every rule with their places, base kinds counted and hashed.
OP10_SQL = (
    "with d as (select doc_id, coalesce(text, '') as t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),\nx as ("
    + "\nunion all ".join(_rule_sql(k, *rule) for k, rule in enumerate(_RULES_SQL))
    + """),
f as (select *, concat(kind, ':', s, ':', e) as one from x)
select d.doc_id, count(*) filter (where o = 0) as n_assign, count(*) filter (where o = 1) as n_access, count(*) filter (where o = 2) as n_hex,
  sha256(coalesce(string_agg(one, ',' order by s, o) filter (where o < 3), '')) as base_sha256, coalesce(string_agg(one, ',' order by s, o), '') as spans
from d left join f on d.doc_id = f.doc_id group by d.doc_id"""
)


#: All pairs of a query and another row, their integer products, and the first five.
OP11_SQL = """
with v as (
  select vec_id, list_transform(cast(embedding as double[]), lambda x: cast(floor(256 * x) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda a: a is null or not isfinite(a))) = 0),
p as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(cast(a.x as double[]), cast(b.x as double[])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from p)
select query_id, cast(place as int) as rank, vec_id, score from r where place <= 5
"""

#: CRC-32 of the decimal doc_id, bit by bit: a character is mixed in (c >= 0), then eight shifts (-1) follow.
_CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x:
    [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end))"""

#: Pairs of equal words of a document, stretches of neighbouring pairs with one distance, and the smallest distance of each stretch.
OP12_SQL = f"""
with t as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, {_CRC32_SQL} as h from documents),
u as (select doc_id, w, len(w) as n, h, h // 10 as g from t),
s as (
  select doc_id, w, n, case when h % 10 = 0 and n > 0 then g % n else n end as a, case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) else 1 end as p from u),
x as (
  select doc_id, i, w[1 + case when i < a then i else a + (i - a) % p end] as word from (select *, unnest(range(n)) as i from s)),
e as (select l.doc_id, l.i, r.i - l.i as q from x l join x r on l.doc_id = r.doc_id and l.word = r.word and l.i < r.i),
island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from e),
stretch as (select doc_id, q, min(i) as start, count(*) as c from island group by doc_id, q, k having count(*) >= q and count(*) + q >= 12),
run as (select doc_id, start, c + q as length, min(q) as period from stretch group by all),
lost as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
best as (
  select doc_id, count(*) as n_runs, first({{'start': start, 'length': length, 'period': period}} order by length desc, start, period) as b,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines from run group by doc_id),
kept as (select x.doc_id, string_agg(word, ' ' order by x.i) as t from x anti join lost on x.doc_id = lost.doc_id and x.i = lost.i group by x.doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, b.start as start, b.length as length, b.period as period, 1000 * b.length // b.period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from documents d left join best on d.doc_id = best.doc_id left join kept on d.doc_id = kept.doc_id
"""

#: Tokens as a list, cut at the numbers that the hash draws.
OP13_SQL = """
with t as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as w,
    sha256(concat('42:', doc_id)) as h from documents),
d as (
  select *, len(w) as n, list_transform(range(4), lambda k: cast(concat('0x', substr(h, 1 + 8 * k, 8)) as bigint)) as r from t),
c as (
  select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; tests hold the others against brute force."""
    return {"op2_warc_bundles": OP2_SQL, "op4_vector_neighbors": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_line_dedup": OP6_SQL, "op10_secret_scan": OP10_SQL, "op11_exact_topk": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_fill_middle": OP13_SQL}
