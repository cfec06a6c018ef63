"""Registry of the core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.functions import text
from nodeloom.functions.metadata import flat_values
from nodeloom.operators import episodes, manifest, order, quality, selection, store
from nodeloom.plans.corpus import Corpus, with_tables

_REGISTRY: dict[str, tuple[Callable[[Corpus], DataFrame], str | None]] = {}


def query(sql: str | None, tables: bool = True):
    """Register a query under its function's name, with its SQL over the derived tables (or the plain ones)."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        _REGISTRY[f.__name__] = (f, with_tables(sql) if sql and tables else sql)
        return f

    return register


@query("select source_file, count(*) as pending, count(distinct speaker) filter (where speaker not in ('', 'multiple')) as speakers from inc anti join store on inc.node_id = store.node_id where length(trim(page_content)) > 0 group by source_file")
def pending_per_source(c: Corpus) -> DataFrame:
    rows = store.pending_nodes(selection.included(c.nodes, c.selection).where(text.has_text(F.col("page_content"))), c.store)
    return rows.groupBy("source_file").agg(F.count("*").alias("pending"), F.count_distinct(F.get("speakers", F.lit(0))).alias("speakers"))


@query("select conv_id, turn, node_id, source_file, episode_id, episode_title, episode_date, node_type, speaker, speaker_scope, page_content from n")
def scan_nodes(c: Corpus) -> DataFrame:
    return c.nodes.select("conv_id", "turn", "node_id", "source_file", "episode_id", "episode_title", "episode_date", "node_type", "speaker", "speaker_scope", "page_content")


@query("select node_id from good where ok")
def has_text_filter(c: Corpus) -> DataFrame:
    return c.nodes.where(text.has_text(F.col("page_content"))).select("node_id")


@query("select node_id, ask from asks")
def missing_context(c: Corpus) -> DataFrame:
    return c.nodes.select("node_id", text.asks_for_source(F.col("page_content")).alias("ask"))


@query("select source_file, turn, label, rule_no, rule from viol")
def violations_long(c: Corpus) -> DataFrame:
    return quality.violations(c.nodes).select("source_file", F.col("pos").cast("long").alias("turn"), "label", "rule_no", "rule")


@query("""select bucket, string_agg(concat(label, ': ', rule), '; ' order by rn) filter (where rn <= 10) as digest, greatest(count(*), 10) - 10 as more
from (select *, conv_id % 10 as bucket, row_number() over (partition by conv_id % 10 order by source_file, turn, rule_no) as rn from viol) group by bucket""")
def violation_digest(c: Corpus) -> DataFrame:
    number = F.regexp_extract("source_file", r"conv_(\d+)", 1).cast("long")
    return quality.digest(quality.violations(c.nodes), number % 10, "bucket")


@query("select n.source_file, count(v.label) as n_violations, count(v.label) = 0 as valid from (select distinct source_file from n) n left join viol v on n.source_file = v.source_file group by n.source_file")
def file_validity(c: Corpus) -> DataFrame:
    return quality.file_validity(c.nodes)


@query("select node_id from inc")
def include_documents(c: Corpus) -> DataFrame:
    return selection.included(c.nodes, c.selection).select("node_id")


@query("select source_file, count(*) as selected from inc group by source_file")
def selected_per_episode(c: Corpus) -> DataFrame:
    return selection.included(c.nodes, c.selection).groupBy("source_file").agg(F.count("*").alias("selected"))


@query("select eff.source_file, eff.speaker from eff")
def effective_speakers(c: Corpus) -> DataFrame:
    return selection.effective(c.speakers, c.selection)


@query("select source_file, node_type, count(*) as n from n group by all")
def node_counts(c: Corpus) -> DataFrame:
    return episodes.node_counts(c.nodes)


@query("select source_file, case when turn % 4 = 0 then 'unknown' else node_type end as node_type, count(*) as n from n group by all")
def node_counts_unknown(c: Corpus) -> DataFrame:
    lost = F.when(F.col("turn") % 8 == 0, F.lit(None)).when(F.col("turn") % 4 == 0, "").otherwise(F.col("node_type"))
    return episodes.node_counts(c.nodes.withColumn("node_type", lost))


@query("select source_file, string_agg(speaker, ', ' order by speaker) as speakers from sp group by source_file")
def episode_speakers(c: Corpus) -> DataFrame:
    return episodes.episode_speakers(c.nodes).groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("speakers"))


@query("select distinct speaker from sp")
def global_speakers(c: Corpus) -> DataFrame:
    return episodes.episode_speakers(c.nodes).select("speaker").distinct()


@query("select coalesce(min(nullif(episode_date, '')), 'Unknown') as start_date, coalesce(max(nullif(episode_date, '')), 'Unknown') as end_date from n")
def date_range(c: Corpus) -> DataFrame:
    return episodes.date_range(c.nodes)


@query("select speaker, coalesce(min(nullif(episode_date, '')), 'Unknown') as start_date, coalesce(max(nullif(episode_date, '')), 'Unknown') as end_date from n group by speaker")
def date_range_per_speaker(c: Corpus) -> DataFrame:
    return episodes.date_range(c.nodes, "speaker")


@query("select * from roll")
def episode_rollup(c: Corpus) -> DataFrame:
    return episodes.rollup(c.nodes)


@query("select count(*) filter (where ok) as insertable, count(*) as documents from good")
def insertable_count(c: Corpus) -> DataFrame:
    return c.nodes.agg(F.count_if(text.has_text(F.col("page_content"))).alias("insertable"), F.count("*").alias("documents"))


@query("""select speaker, case when bool_and(on_) then 'checked' when bool_or(on_) then 'partial' else 'unchecked' end as state
from (select sp.speaker, sel.speaker is not null as on_ from sp left join sel on sp.source_file = sel.source_file and sp.speaker = sel.speaker) group by speaker""")
def speaker_tristate(c: Corpus) -> DataFrame:
    return selection.tristate(c.speakers, c.selection)


@query("select source_file, fingerprint from files where fingerprint not in (select fingerprint from ledger where status = 'completed')")
def pending_files(c: Corpus) -> DataFrame:
    return store.pending_files(c.files, c.ledger).select("source_file", "fingerprint")


@query("select node_id from n where node_id in (select node_id from store)")
def existing_nodes(c: Corpus) -> DataFrame:
    return store.existing_nodes(c.nodes, c.store).select("node_id")


@query("select node_id from n where node_id not in (select node_id from store)")
def pending_nodes(c: Corpus) -> DataFrame:
    return store.pending_nodes(c.nodes, c.store).select("node_id")


@query("select source_file, entry_file, matched_by from found")
def manifest_lookup(c: Corpus) -> DataFrame:
    return manifest.lookup(c.files, c.entries).select("source_file", "entry_file", "matched_by")


@query("""select source_file, case when entry_file is null then 'no_entry' when wanted = 0 then 'none_selected' when wanted = had then 'covered' else 'new_speaker' end as decision,
  entry_file is not null and (wanted = 0 or wanted = had) as skip
from (select f.source_file, f.entry_file, count(e.speaker) as wanted, count(s.speaker) as had from found f left join eff e on f.source_file = e.source_file
  left join esp s on f.entry_file = s.source_file and e.speaker = s.speaker group by f.source_file, f.entry_file)""")
def skip_decision(c: Corpus) -> DataFrame:
    return manifest.skip_decision(c.files, c.entries, c.entry_speakers, selection.effective(c.speakers, c.selection))


@query("select source_file, case matched_by when 'fingerprint' then '[imported]' when 'source_file' then '[changed]' else '' end as badge from found")
def status_badge(c: Corpus) -> DataFrame:
    return manifest.badges(c.files, c.entries)


def _new_entries(c: Corpus) -> DataFrame:
    some = c.files.where("conv_id % 3 = 0")
    return manifest.entries_of(selection.included(c.nodes, c.selection), episodes.rollup(c.nodes), some)


def _merged(c: Corpus) -> DataFrame:
    return manifest.merged(c.entries.drop("ord"), _new_entries(c))


@query("select source_file, source_fingerprint, episode_title, episode_date, document_count from merged")
def manifest_merge(c: Corpus) -> DataFrame:
    return _merged(c).select("source_file", "source_fingerprint", "episode_title", "episode_date", "document_count")


@query("select distinct source_file, lower(speaker) as speaker_id, speaker from (select * from esp union all select inc.source_file, speaker from inc where conv_id % 3 = 0 and speaker not in ('', 'multiple'))")
def manifest_speakers(c: Corpus) -> DataFrame:
    new = episodes.episode_speakers(selection.included(c.nodes, c.selection).where("conv_id % 3 = 0"))
    return manifest.merged_speakers(c.entry_speakers, new).select("source_file", "speaker_id", "speaker")


@query("select count(*) as episode_count, sum(document_count)::bigint as chunk_count, min(nullif(episode_date, '')) as start_date, max(nullif(episode_date, '')) as end_date, (select count(distinct speaker) from esp) as speaker_count from merged")
def manifest_header(c: Corpus) -> DataFrame:
    return manifest.header(_merged(c), c.entry_speakers)


@query("select source_file, row_number() over (order by coalesce(nullif(episode_date, ''), '9999-99-99'), coalesce(episode_title, ''), source_file) as place from merged")
def manifest_order(c: Corpus) -> DataFrame:
    rows = _merged(c).withColumn("episode_title", text.filled(F.col("episode_title")))
    return order.positions(rows, episodes.catalogue_order(), "place").select("source_file", "place")


@query("select source_file, row_number() over (order by coalesce(nullif(episode_date, ''), '9999-99-99'), lower(episode_title), source_file) as place from roll")
def episode_order(c: Corpus) -> DataFrame:
    return order.positions(episodes.rollup(c.nodes), episodes.display_order(), "place").select("source_file", "place")


@query("select source_file, speaker from sel where source_file in (select source_file from saved) union select source_file, speaker from sp where source_file not in (select source_file from saved)")
def default_selection_fill(c: Corpus) -> DataFrame:
    return selection.with_defaults(c.speakers, c.selection, c.saved)


@query("select source_file, speaker from sel union select source_file, speaker from sp where speaker = 'user'")
def selection_toggle_global(c: Corpus) -> DataFrame:
    return selection.set_speakers(c.speakers, c.selection, True, "user")


@query("select source_file, speaker from sel where not (speaker = 'assistant' and source_file = '/corpus/conv_1.processed_documents.json')")
def selection_toggle_episode(c: Corpus) -> DataFrame:
    return selection.set_speakers(c.speakers, c.selection, False, "assistant", "/corpus/conv_1.processed_documents.json")


@query("select source_file, speaker from sel where source_file <> '/corpus/conv_2.processed_documents.json' union select source_file, speaker from sp where source_file = '/corpus/conv_2.processed_documents.json'")
def selection_all_in_episode(c: Corpus) -> DataFrame:
    return selection.set_speakers(c.speakers, c.selection, True, None, "/corpus/conv_2.processed_documents.json")


@query("select source_file, speaker from sp")
def initial_selection(c: Corpus) -> DataFrame:
    return selection.set_speakers(c.speakers, c.selection.limit(0), True)


@query("select source_file, speaker from sp where source_file = '/corpus/conv_3.processed_documents.json'")
def selection_none_globally(c: Corpus) -> DataFrame:
    """Nobody is selected anywhere, then everybody in one file."""
    nobody = selection.set_speakers(c.speakers, c.selection, False)
    return selection.set_speakers(c.speakers, nobody, True, None, "/corpus/conv_3.processed_documents.json")


@query("""select r.source_file, concat(case matched_by when 'fingerprint' then '[imported] ' when 'source_file' then '[changed] ' else '' end,
  coalesce(nullif(r.episode_date, ''), 'unknown date'), ' - ', r.episode_title) as label from roll r join found f on r.source_file = f.source_file""")
def episode_labels(c: Corpus) -> DataFrame:
    return episodes.labels(episodes.rollup(c.nodes), manifest.badges(c.files, c.entries))


@query("select source_file, fingerprint from files where fingerprint = (select max(fingerprint) from files where conv_id < 10)")
def episode_by_fingerprint(c: Corpus) -> DataFrame:
    mark = c.files.where("conv_id < 10").agg(F.max("fingerprint")).first()[0]
    return episodes.by_fingerprint(c.files, mark).select("source_file", "fingerprint")


_BATCHED = "(select *, (rn - 1) // 3 as batch from (select *, row_number() over (partition by source_file order by turn) as rn from n))"


@query(f"select node_id, rn, cast(batch as bigint) as batch from {_BATCHED}")
def batches(c: Corpus) -> DataFrame:
    return order.batches(c.nodes, "source_file", "turn", 3).select("node_id", "rn", "batch")


@query(f"select source_file, cast(batch as bigint) as batch, min(rn) as first_rn, max(rn) as last_rn from {_BATCHED} group by all")
def batch_ranges(c: Corpus) -> DataFrame:
    rows = order.batches(c.nodes, "source_file", "turn", 3)
    return rows.groupBy("source_file", "batch").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


@query("select source_file, inserted, sum(inserted) over (order by source_file)::bigint as running from (select source_file, count(*) as inserted from n where node_id not in (select node_id from store) group by source_file)")
def running_inserted(c: Corpus) -> DataFrame:
    rows = store.pending_nodes(c.nodes, c.store).groupBy("source_file").agg(F.count("*").alias("inserted"))
    return order.running_total(rows, [F.col("source_file")], F.col("inserted"), "running").select("source_file", "inserted", "running")


@query("select speaker, arg_max(node_id, turn * 1000000 + conv_id) as node_id from n where speaker <> '' group by speaker")
def last_wins_index(c: Corpus) -> DataFrame:
    rows = c.nodes.select("speaker", "node_id", (F.col("turn") * 1000000 + F.col("conv_id")).alias("ord"))
    return order.last_of_key(rows, "speaker", "ord").select("speaker", "node_id")


@query("select source_file, fingerprint from files where fingerprint not in (select fingerprint from ledger where status = 'completed') order by source_file limit 1")
def one_file(c: Corpus) -> DataFrame:
    return store.pending_files(c.files, c.ledger).orderBy("source_file").limit(1).select("source_file", "fingerprint")


@query("select p_partkey, coalesce(nullif(trim(lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'podcast') as slug from part", tables=False)
def slugify_names(c: Corpus) -> DataFrame:
    return c.table("part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("select page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'Podcast Export') as folder from pages", tables=False)
def safe_folder(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", text.folder_name(F.col("url")).alias("folder"))


@query("select page_id, coalesce(nullif(regexp_extract(url, '([^/]+)/+[^/]+/*$', 1), ''), 'Podcast Export') as name from pages", tables=False)
def default_names(c: Corpus) -> DataFrame:
    """What an export is called when only its folder is known: as the folder above."""
    return c.table("pages").select("page_id", text.or_default(text.parent_name(F.col("url")), text.DEFAULT_FOLDER).alias("name"))


@query("select event_id, props ->> '$.k' as k, coalesce(props ->> '$.missing', 'unknown') as missing from events", tables=False)
def props_metadata(c: Corpus) -> DataFrame:
    value = F.try_parse_json("props")
    return c.table("events").select("event_id", F.try_variant_get(value, "$.k", "string").alias("k"), F.coalesce(F.try_variant_get(value, "$.missing", "string"), F.lit("unknown")).alias("missing"))


@query("select event_id, coalesce(props ->> '$.k', '') as k from events", tables=False)
def sanitize_flat(c: Corpus) -> DataFrame:
    flat = flat_values(F.try_parse_json("props"))
    return c.table("events").select("event_id", F.coalesce(F.try_element_at(flat, F.lit("k")), F.lit("")).alias("k"))


@query("select count(*) as documents, count(*) filter (where node_id not in (select node_id from store)) as inserted, count(distinct node_id) filter (where node_id in (select node_id from store)) as skipped_existing from n")
def import_result(c: Corpus) -> DataFrame:
    return store.import_counts(c.nodes, c.store)


@query("select n.node_id, n.conv_id, round(sqrt(list_sum([cast(x as double) * x for x in e.embedding])), 4) as norm from n join embeddings e on n.conv_id = e.vec_id where n.node_id not in (select node_id from store)")
def embed_upsert(c: Corpus) -> DataFrame:
    vectors = c.table("embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    rows = store.pending_nodes(c.nodes, c.store).join(vectors, "conv_id")
    squares = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return rows.select("node_id", "conv_id", F.round(F.sqrt(squares), 4).alias("norm"))


@query(None)
def embedded_nodes(c: Corpus) -> DataFrame:
    """Pending nodes with vectors of the hash embedder; SQL has no such model."""
    return store.embedded(store.pending_nodes(c.nodes, c.store).select("node_id", "page_content"), store.hash_embedder())


@query(None)
def fingerprint_files(c: Corpus) -> DataFrame:
    """Size and time of the input tables' files; SQL cannot see them."""
    rows = c.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(c.sf_dir)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.concat_ws("|", "length", F.unix_micros("modificationTime")).alias("fingerprint"))


@query("select node_type, episode_date, node_id from (select *, row_number() over (partition by node_type order by coalesce(nullif(episode_date, ''), '9999-99-99'), node_id) as rn from n) where rn <= 10")
def first_nodes_per_type(c: Corpus) -> DataFrame:
    place = Window.partitionBy("node_type").orderBy(text.or_default(F.col("episode_date"), episodes.NO_DATE), "node_id")
    return c.nodes.withColumn("rn", F.row_number().over(place)).where("rn <= 10").select("node_type", "episode_date", "node_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir)) for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
