"""Queries over real JSON files: conversations are written as files of processed documents, then listed and parsed.

Ten conversations are one file, named by its number. The nodes have every shape that the parser must take: absent, null and empty fields, numbers as ids (zero counts as absent), bare
metadata, speakers as a text, a list, a text with commas or a text with a JSON list, elements that are no objects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.functions.metadata import flat_json, flat_values
from nodeloom.operators import episodes, manifest, quality, store
from nodeloom.plans.corpus import Corpus, with_tables
from nodeloom.sources.files import list_files, read_nodes
from nodeloom.sources.shared import file_system, scratch

#: The nodes as they were before they became JSON, for DuckDB.
NODES = """j as (select n.*, conv_id // 10 as ep, row_number() over (partition by conv_id // 10 order by conv_id, turn) - 1 as pos from n),
k as (select *, pos = 0 and ep % 3 = 0 as bare, conv_id * 7 + turn as spot from j),
raw as (select ep, pos, conv_id, turn,
  case when spot % 29 = 0 then '' when spot % 31 = 0 then 'None' when spot % 37 = 0 then 'Please share the source  material.' else t end as page_content,
  case when bare or (conv_id + turn) % 17 = 0 then null else node_id end as node_id, case when bare then null else node_type end as node_type,
  case when bare then null else nullif(episode_date, '') end as episode_date, case when bare then null else nullif(speaker_scope, '') end as speaker_scope,
  case when not bare and turn > 0 and conv_id <> 0 then cast(conv_id as varchar) end as episode_id,
  case when not bare and turn % 4 = 3 then concat('Conversation ', conv_id) end as episode_title,
  case when ep % 2 = 0 then concat('Episode ', ep) end as file_title, not bare as has_metadata,
  case when bare then '' when turn % 4 in (0, 1) then r when turn % 4 = 2 then concat(r, '|Guest') else concat(r, '|Host') end as speakers,
  concat(case when bare then 'unknown' else node_type end, ' ', case when bare or (conv_id + turn) % 17 = 0 then concat('index_', pos) else node_id end) as label, bare
  from k join (select conv_id, turn, coalesce(role, 'x') as r, text as t from conversations) c using (conv_id, turn))"""


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def _member(key: str, value: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit(f'"{key}":'), value))


_written: dict[tuple[str, str], str] = {}


def folder_of(c: Corpus) -> str:
    """The folder of the JSON files of a session and input, written when first asked for (or when it is gone)."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key in _written:
        path = c.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written[key])
        if path.getFileSystem(c.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return _written[key]
    _written[key] = write_files(c)
    return _written[key]


def write_files(c: Corpus) -> str:
    """Write the conversations as JSON files; the folder."""
    conv, turn = F.col("conv_id"), F.col("turn")
    ep = F.floor(conv / 10).cast("long")
    rows = c.nodes.drop("page_content").join(c.table("conversations").select("conv_id", "turn", F.coalesce("role", F.lit("x")).alias("role"), "text"), ["conv_id", "turn"]).withColumn("ep", ep)
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("ep").orderBy("conv_id", "turn")) == 1)  # ten conversations
    at, role = conv * 7 + turn, F.col("role")
    texts = F.when(turn % 4 == 1, F.concat(F.lit("["), _quoted(role), F.lit(',"unknown",5,'), _quoted(role), F.lit("]")))
    texts = texts.when(turn % 4 == 2, _quoted(F.concat(role, F.lit(", multiple, Guest")))).otherwise(_quoted(F.concat(F.lit("["), _quoted(role), F.lit(',"Host",null]'))))
    members = [
        _member("node_id", _quoted(F.col("node_id")), (conv + turn) % 17 != 0),
        _member("node_type", _quoted(F.col("node_type")), F.lit(True)),
        _member("episode_date", _quoted(F.col("episode_date")), F.lit(True)),
        _member("speaker_scope", _quoted(F.col("speaker_scope")), F.col("speaker_scope") != ""),
        _member("episode_id", conv.cast("string"), turn > 0),
        _member("episode_title", _quoted(F.concat(F.lit("Conversation "), conv)), turn % 4 == 3),
        _member("speaker", F.when(turn % 4 == 0, _quoted(F.concat(F.lit(" "), role, F.lit(" ")))).otherwise(F.lit('"Mixed"')), turn % 4 != 1),
        _member("speakers", texts, turn % 4 != 0),
        _member("n", turn.cast("string"), F.lit(True)),
        _member("flag", F.when(turn % 2 == 0, F.lit("true")).otherwise(F.lit("false")), F.lit(True)),
        _member("nested", F.concat(F.lit('{"a":[1,'), turn, F.lit("]}")), F.lit(True)),
        _member("gone", F.lit("null"), F.lit(True)),
    ]
    metadata = F.when(F.col("first") & (F.col("ep") % 3 == 0), F.lit("{}")).otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}")))
    content = F.when(at % 29 == 0, F.lit("")).when(at % 31 == 0, F.lit('"page_content":null,')).when(at % 37 == 0, F.lit('"page_content":"Please share the source  material.",')).otherwise(F.concat(F.lit('"page_content":'), F.coalesce(_quoted(F.col("text")), F.lit("null")), F.lit(",")))
    rows = rows.select("ep", F.struct("conv_id", "turn", F.concat(F.lit("{"), content, F.lit('"metadata":'), metadata, F.lit("}")).alias("json")).alias("node"))
    files = rows.groupBy("ep").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x["json"]), ",").alias("nodes"))
    title = F.when(F.col("ep") % 2 == 0, F.concat(F.lit(',"episode_title":"Episode '), F.col("ep"), F.lit('"'))).otherwise(F.lit(""))
    folder = scratch(c.spark, "documents")
    files.select("ep", F.concat(F.lit('{"documents":['), F.col("nodes"), F.lit(',"no object",7]'), title, F.lit("}")).alias("value")).repartition("ep").write.partitionBy("ep").text(folder)
    fs, _ = file_system(c.spark, folder)
    for part in fs.globStatus(file_system(c.spark, f"{folder}/ep=*/part-*")[1]):
        number = part.getPath().getParent().getName().removeprefix("ep=")
        fs.rename(part.getPath(), file_system(c.spark, f"{folder}/ep={number}/episode.{number}.processed_documents.json")[1])
    return folder


def _ep(path: str = "source_file") -> Column:
    return F.regexp_extract(path, r"ep=(\d+)", 1).cast("long").alias("ep")


_REGISTRY: dict[str, tuple[Callable[[Corpus], DataFrame], str]] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL over the nodes as they were before they became JSON."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        head = with_tables("").rstrip()
        _REGISTRY[f.__name__] = (f, f"{head},\n{NODES}\n{sql}")
        return f

    return register


def _nodes(c: Corpus) -> DataFrame:
    return read_nodes(c.spark, folder_of(c))


@query("select distinct ep, true as named from raw")
def json_files(c: Corpus) -> DataFrame:
    """The files, each with a fingerprint of its path, size and time."""
    found = list_files(c.spark, folder_of(c))
    return found.select(_ep(), F.col("fingerprint").rlike(r"ep=(\d+)/episode\.\1\.processed_documents\.json\|[0-9]+\|[0-9]+$").alias("named"))


@query("select ep, pos, page_content, node_id, node_type, episode_date, speaker_scope, episode_id, episode_title, file_title, has_metadata, label from raw")
def json_nodes(c: Corpus) -> DataFrame:
    rows = _nodes(c)
    return rows.select(_ep(), F.col("pos").cast("long").alias("pos"), "page_content", "node_id", "node_type", "episode_date", "speaker_scope", "episode_id", "episode_title", "file_title", "has_metadata", "label")


@query("select ep, pos, speakers from raw")
def json_speakers(c: Corpus) -> DataFrame:
    return _nodes(c).select(_ep(), F.col("pos").cast("long").alias("pos"), F.array_join("speakers", "|").alias("speakers"))


@query("""select ep, pos, case when bare then 0 else 8 + (case when (conv_id + turn) % 17 <> 0 then 1 else 0 end) + (case when speaker_scope is not null then 1 else 0 end) + (case when turn > 0 then 1 else 0 end)
  + (case when turn % 4 = 3 then 1 else 0 end) + (case when turn % 4 in (2, 3) then 1 else 0 end) - 1 end as n_keys,
  case when not bare then cast(turn as varchar) end as n, case when not bare then case when turn % 2 = 0 then 'true' else 'false' end end as flag,
  case when not bare then concat('{"a":[1,', turn, ']}') end as nested, case when not bare then '' end as gone from raw""")
def json_flat_values(c: Corpus) -> DataFrame:
    """Flattened metadata: scalars as they are, null empty, nested values as JSON."""
    rows = _nodes(c).withColumn("flat", flat_values(F.try_parse_json("metadata_json")))
    values = [F.try_element_at("flat", F.lit(k)).alias(k) for k in ("n", "flag", "nested", "gone")]
    return rows.select(_ep(), F.col("pos").cast("long").alias("pos"), F.size(F.map_keys("flat")).cast("long").alias("n_keys"), *values)


@query("""select ep, pos, case when bare then '{}' else concat('{', case when turn > 0 then concat('"episode_date": "', coalesce(episode_date, ''), '", "episode_id": ', conv_id) else concat('"episode_date": "', coalesce(episode_date, ''), '"') end,
  case when turn % 4 = 3 then concat(', "episode_title": "Conversation ', conv_id, '"') else '' end, ', "flag": ', case when turn % 2 = 0 then 'true' else 'false' end, ', "gone": "", "n": ', turn,
  ', "nested": "{\\"a\\": [1, ', turn, ']}"') end as head from raw""")
def json_flat_text(c: Corpus) -> DataFrame:
    """Flattened metadata as the JSON text that the store keeps, up to the node's own id."""
    rows = _nodes(c).withColumn("flat", flat_json(F.col("metadata_json")))
    return rows.select(_ep(), F.col("pos").cast("long").alias("pos"), F.when(F.col("flat") == "{}", F.col("flat")).otherwise(F.regexp_extract("flat", r'^(.*?\]\}")', 1)).alias("head"))


@query("""select ep, coalesce(nullif(arg_min(coalesce(episode_id, ''), pos) filter (where has_metadata), ''), concat('episode.', ep, '.processed_documents')) as episode_id,
  coalesce(arg_min(episode_title, pos) filter (where episode_title is not null), max(file_title), concat('episode.', ep)) as episode_title,
  coalesce(arg_min(episode_date, pos) filter (where episode_date is not null), '') as episode_date, count(*) as documents,
  count(*) filter (where length(trim(regexp_replace(page_content, '\\s+', ' ', 'g'))) > 0) as insertable from raw group by ep""")
def json_rollup(c: Corpus) -> DataFrame:
    """Episodes of the files: the id is that of the first node with metadata, the title falls back to the file's and to its stem."""
    return episodes.rollup(_nodes(c)).select(_ep(), "episode_id", "episode_title", "episode_date", "documents", "insertable")


@query("""select ep, pos, r.i as rule_no, r.name as rule, label from raw,
  unnest([{'i': 0, 'name': 'empty_content', 'hit': page_content = ''},
  {'i': 1, 'name': 'asks_for_source', 'hit': page_content = 'Please share the source  material.' and node_type is not null and node_type <> 'leaf_chunk'}, {'i': 2, 'name': 'missing_node_id', 'hit': node_id is null},
  {'i': 3, 'name': 'missing_episode_date', 'hit': episode_date is null}, {'i': 4, 'name': 'missing_speaker_scope', 'hit': node_type is not null and speaker_scope is null}]) as t(r) where r.hit""")
def json_violations(c: Corpus) -> DataFrame:
    """Rules that the parsed nodes break, all five."""
    return quality.violations(_nodes(c)).select(_ep(), F.col("pos").cast("long").alias("pos"), "rule_no", "rule", "label")


@query("select conv_id, turn, concat(r, '|Guest|3') as names, array_to_string(list_sort(['3=3', 'guest=Guest', concat(lower(r), '=', r)]), '|') as structs from (select conv_id, turn, coalesce(role, 'x') as r from conversations)")
def tolerant_speakers(c: Corpus) -> DataFrame:
    """Manifest speakers of any form: names, and sorted (id, name) of the distinct ones."""
    role = F.coalesce("role", F.lit("x"))
    text = F.concat(F.lit('[{"name":'), _quoted(F.concat(F.lit(" "), role)), F.lit('},"Guest",3,{"x":1},"",null]'))
    rows = c.table("conversations").select("conv_id", "turn", manifest.tolerant_names(F.try_parse_json(text)).alias("names"))
    structs = F.transform(F.array_sort(manifest.speaker_structs(F.col("names"))), lambda x: F.concat_ws("=", x["id"], x["name"]))
    return rows.select("conv_id", "turn", F.array_join("names", "|").alias("names"), F.array_join(F.array_sort(structs), "|").alias("structs"))


@query("""select node_id, concat('new ', turn) as page_content from n where conv_id % 3 = 0
union all select n.node_id, n.page_content from n join store s on n.node_id = s.node_id where n.conv_id % 3 <> 0""")
def upsert_store(c: Corpus) -> DataFrame:
    """The store after an upsert: replaced rows, new rows, and the rest as it was."""
    held = c.nodes.join(c.store, "node_id", "left_semi").select("node_id", "page_content")
    rows = c.nodes.where("conv_id % 3 = 0").select("node_id", F.concat(F.lit("new "), "turn").alias("page_content"))
    return store.upserted(held, rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir)) for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items()}
