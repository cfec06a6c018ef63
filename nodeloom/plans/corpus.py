"""The node model over conversations: a conversation is a file, a turn a node, a role a speaker.

Also the tables that an import keeps (files, ledger, manifest, selection, stored ids), derived by rule so that every
branch of the operators has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.metadata import names_somebody
from nodeloom.functions.text import filled


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        date = F.when(conv % 11 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((1 + conv % 28).cast("string"), 2, "0")))
        kind = F.when(turn == 0, "episode_thesis").when(turn % 3 == 1, "leaf_chunk").when(turn % 3 == 2, "cluster_summary").otherwise("position_card")
        scope = F.when((conv + turn) % 13 == 0, "").when(turn % 2 == 1, "single").otherwise("multi")
        at = conv * 7 + turn
        text = F.when(at % 29 == 0, "  ").when(at % 31 == 0, "Please provide the transcript.").otherwise(F.col("text"))
        rows = self.table("conversations").select(
            "conv_id",
            "turn",
            turn.cast("int").alias("pos"),
            F.concat(F.lit("c"), conv, F.lit("-"), turn).alias("node_id"),
            F.concat(F.lit("/corpus/conv_"), conv, F.lit(".processed_documents.json")).alias("source_file"),
            conv.cast("string").alias("episode_id"),
            F.concat(F.lit("Conversation "), conv).alias("episode_title"),
            date.alias("episode_date"),
            kind.alias("node_type"),
            F.when(F.col("role") == "system", "multiple").when(turn % 5 == 4, "").otherwise(F.col("role")).alias("speaker"),
            scope.alias("speaker_scope"),
            text.alias("page_content"),
        )
        rows = rows.withColumn("speakers", F.filter(F.array("speaker"), lambda s: names_somebody(filled(s))))
        return rows.withColumns({"label": F.concat_ws(" ", "node_type", "node_id"), "file_title": F.lit(None).cast("string"), "has_metadata": F.lit(True)})

    @property
    def speakers(self) -> DataFrame:
        return self.nodes.select("source_file", F.explode("speakers").alias("speaker")).distinct()

    @property
    def selection(self) -> DataFrame:
        user = (F.col("speaker") == "user") & (F.col("conv_id") % 3 != 0)
        assistant = (F.col("speaker") == "assistant") & (F.col("conv_id") % 5 != 0)
        return self.nodes.where(user | assistant).select("source_file", "speaker").distinct()

    @property
    def saved(self) -> DataFrame:
        return self.nodes.where("conv_id % 2 = 0").select("source_file").distinct()

    @property
    def store(self) -> DataFrame:
        return self.nodes.join(self.table("labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi").select("node_id")

    @property
    def files(self) -> DataFrame:
        rows = self.nodes.groupBy("source_file").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("turn").alias("last"))
        return rows.select("source_file", "conv_id", F.concat_ws("~", "source_file", "n", "last").alias("fingerprint"))

    @property
    def ledger(self) -> DataFrame:
        rows = self.files.where((F.col("conv_id") % 5).isin(0, 1))
        return rows.select("fingerprint", F.when(F.col("conv_id") % 5 == 0, "completed").otherwise("failed").alias("status"))

    @property
    def entries(self) -> DataFrame:
        mark = F.when(F.col("conv_id") % 6 == 0, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint"))
        return self.files.where("conv_id % 2 = 0").select("source_file", mark.alias("source_fingerprint"), F.lit(3).cast("long").alias("document_count"), F.col("conv_id").alias("ord"))

    @property
    def entry_speakers(self) -> DataFrame:
        rows = self.nodes.join(self.entries.select("source_file"), "source_file", "left_semi").where("conv_id % 4 <> 0 or speaker = 'user'")
        return rows.select("source_file", F.explode("speakers").alias("speaker")).distinct()


#: The same tables for DuckDB.
TABLES = {
    "n": """select conv_id, turn, concat('c', conv_id, '-', turn) as node_id, concat('/corpus/conv_', conv_id, '.processed_documents.json') as source_file,
  cast(conv_id as varchar) as episode_id, concat('Conversation ', conv_id) as episode_title,
  case when conv_id % 11 = 0 then '' else concat('2024-01-', lpad(cast(1 + conv_id % 28 as varchar), 2, '0')) end as episode_date,
  case when turn = 0 then 'episode_thesis' when turn % 3 = 1 then 'leaf_chunk' when turn % 3 = 2 then 'cluster_summary' else 'position_card' end as node_type,
  case when role = 'system' then 'multiple' when turn % 5 = 4 then '' else role end as speaker,
  case when (conv_id + turn) % 13 = 0 then '' when turn % 2 = 1 then 'single' else 'multi' end as speaker_scope,
  case when (conv_id * 7 + turn) % 29 = 0 then '  ' when (conv_id * 7 + turn) % 31 = 0 then 'Please provide the transcript.' else text end as page_content
  from conversations""",
    "sp": "select distinct source_file, speaker from n where speaker not in ('', 'multiple')",
    "sel": "select distinct source_file, speaker from n where (speaker = 'user' and conv_id % 3 <> 0) or (speaker = 'assistant' and conv_id % 5 <> 0)",
    "saved": "select distinct source_file from n where conv_id % 2 = 0",
    "store": "select node_id from n where conv_id in (select doc_id from labels)",
    "files": "select source_file, min(conv_id) as conv_id, concat(source_file, '~', count(*), '~', max(turn)) as fingerprint from n group by source_file",
    "ledger": "select fingerprint, case when conv_id % 5 = 0 then 'completed' else 'failed' end as status from files where conv_id % 5 in (0, 1)",
    "entries": "select source_file, case when conv_id % 6 = 0 then concat(fingerprint, 'x') else fingerprint end as source_fingerprint, 3 as document_count, conv_id as ord from files where conv_id % 2 = 0",
    "esp": "select distinct n.source_file, n.speaker from n join entries e on n.source_file = e.source_file where n.speaker not in ('', 'multiple') and (n.conv_id % 4 <> 0 or n.speaker = 'user')",
    "good": "select *, length(trim(regexp_replace(coalesce(page_content, ''), '\\s+', ' ', 'g'))) > 0 as ok, lower(trim(regexp_replace(coalesce(page_content, ''), '\\s+', ' ', 'g'))) as low from n",
    "asks": """select *, ((contains(low, 'please provide') or contains(low, 'please share') or contains(low, 'send me'))
  and (contains(low, 'transcript') or contains(low, 'source text') or contains(low, 'podcast text') or contains(low, 'material')))
  or contains(low, 'once shared') or contains(low, 'once you share') or contains(low, 'when you provide') as ask from good""",
    "viol": """select source_file, conv_id, turn, concat(node_type, ' ', node_id) as label, r.i as rule_no, r.name as rule from asks,
  unnest([{'i': 0, 'name': 'empty_content', 'hit': not ok}, {'i': 1, 'name': 'asks_for_source', 'hit': ok and ask and node_type <> 'leaf_chunk'},
  {'i': 2, 'name': 'missing_node_id', 'hit': coalesce(node_id, '') = ''}, {'i': 3, 'name': 'missing_episode_date', 'hit': episode_date = ''},
  {'i': 4, 'name': 'missing_speaker_scope', 'hit': speaker_scope = ''}]) as t(r) where r.hit""",
    "inc": """select n.* from n where node_type = 'episode_thesis' or (node_type = 'cluster_summary' and speaker_scope <> 'single') or speaker in ('', 'multiple')
  or exists (select 1 from sel where sel.source_file = n.source_file and sel.speaker = n.speaker)""",
    "eff": "select sp.* from sp semi join sel on sp.source_file = sel.source_file and sp.speaker = sel.speaker",
    "found": """select f.source_file, f.fingerprint, coalesce(a.source_file, b.source_file) as entry_file,
  case when a.source_file is not null then 'fingerprint' when b.source_file is not null then 'source_file' end as matched_by
  from files f left join entries a on f.fingerprint = a.source_fingerprint left join entries b on f.source_file = b.source_file""",
    "roll": """select source_file, arg_min(episode_id, turn) as episode_id, arg_min(episode_title, turn) as episode_title,
  coalesce(arg_min(episode_date, turn) filter (where episode_date <> ''), '') as episode_date, count(*) as documents, count(*) filter (where ok) as insertable from good group by source_file""",
    "fresh": "select r.source_file, f.fingerprint as source_fingerprint, r.episode_id, r.episode_title, r.episode_date, coalesce(c.n, 0) as document_count from roll r join files f on r.source_file = f.source_file left join (select source_file, count(*) as n from inc group by source_file) c on r.source_file = c.source_file where f.conv_id % 3 = 0",
    "merged": """select coalesce(a.source_file, b.source_file) as source_file, coalesce(b.source_fingerprint, a.source_fingerprint) as source_fingerprint, b.episode_title as episode_title, b.episode_date as episode_date,
  coalesce(a.document_count, 0) + coalesce(b.document_count, 0) as document_count from entries a full join fresh b on a.source_file = b.source_file""",
}


def with_tables(sql: str) -> str:
    """The query behind the definitions of all tables."""
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in TABLES.items()) + "\n" + sql
