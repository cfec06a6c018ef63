"""Command line: import pending files, export selected nodes, save a selection, or report what an import would find."""

from __future__ import annotations

import argparse
import dataclasses
from pathlib import Path

from pyspark.sql import SparkSession

from nodeloom.operators import episodes, selection
from nodeloom.operators.store import named_embedder, pending_files
from nodeloom.plans.imports import LEDGER, Summary, export, import_pending, latest
from nodeloom.sources import manifest_json
from nodeloom.sources.commits import Commits
from nodeloom.sources.files import list_files, parse_files, read_nodes, texts_of
from nodeloom.sources.settings import ExportPlan, ImportConfig, load_config, resolve


def run_import(spark: SparkSession, config: ImportConfig, base: str, args: argparse.Namespace) -> None:
    stop = Path(resolve(base, config.stop_file))
    store = f"{resolve(base, config.persist_dir)}/{config.collection_name}"
    show = lambda s: print(f"[{min(s.files, s.pending)}/{s.pending}] documents={s.documents} inserted={s.inserted}")
    options = {"file_glob": config.file_glob, "batch_size": config.import_batch_size, "progress": show, "model": config.embedding_model, "ledger_json": args.ledger_json, "per_commit": args.per_commit}
    folder, ledger = resolve(base, config.processed_data_dir), resolve(base, config.state_path)
    out = import_pending(spark, folder, ledger, store, named_embedder(config.embedding_model), args.one_file, config.skip_existing_ids, stop.exists, **options)
    print(f"stopped={out.stopped} files={out.files} documents={out.documents} inserted={out.inserted} skipped={out.skipped_existing}")


def doctor(spark: SparkSession, config: ImportConfig, base: str) -> bool:
    """Print PASS, WARN or FAIL for each thing that an import needs; whether none failed."""
    folder, store = resolve(base, config.processed_data_dir), f"{resolve(base, config.persist_dir)}/{config.collection_name}"
    lines: list[tuple[str, str]] = []
    try:
        named_embedder(config.embedding_model)
        lines.append(("PASS", f"embedder {config.embedding_model}"))
    except ValueError as e:
        lines.append(("FAIL", str(e)))
    try:
        files = list_files(spark, folder, config.file_glob)
        n = files.count()
    except Exception as e:  # whatever a folder that cannot be listed raises
        lines.append(("FAIL", f"{folder}: {str(e).splitlines()[0]}"))
    else:
        lines.append(("PASS" if n else "WARN", f"{n} files in {folder}"))
        pending = pending_files(files, latest(Commits(spark, store, ledger=resolve(base, config.state_path)).read("ledger", LEDGER))).count()
        lines.append(("PASS", f"{pending} of them pending"))
        broken = files.join(parse_files(texts_of(spark, folder, config.file_glob)).where("readable").select("source_file"), "source_file", "left_anti").count() if n else 0
        lines.append(("WARN" if broken else "PASS", f"{broken} of them cannot be read"))
    if Path(resolve(base, config.stop_file)).exists():
        lines.append(("WARN", f"{config.stop_file} is there: an import would stop"))
    for state, text in lines:
        print(f"{state} {text}")
    return all(state != "FAIL" for state, _ in lines)


def save_selection(spark: SparkSession, plan: ExportPlan, path: str, file_glob: str) -> None:
    """Write a settings document in which every file has all its speakers."""
    files, nodes = list_files(spark, plan.processed_data_dir, file_glob), read_nodes(spark, plan.processed_data_dir, file_glob)
    manifest_json.write_settings(path, dataclasses.asdict(plan), episodes.episode_speakers(nodes), files)


def run_export(spark: SparkSession, plan: ExportPlan, settings: str | None, mode: str, file_glob: str) -> Summary:
    """Export by a plan; files that the settings do not name have all their speakers."""
    files = list_files(spark, plan.processed_data_dir, file_glob) if plan.processed_data_dir else None
    if missing := plan.missing(files.count() if files is not None else 0):
        raise SystemExit("before an export: " + "; ".join(missing))
    speakers = episodes.episode_speakers(read_nodes(spark, plan.processed_data_dir, file_glob))
    if settings is None:
        chosen = speakers
    else:
        _, rows, saved = manifest_json.read_settings(spark, settings)
        chosen = selection.with_defaults(speakers, manifest_json.by_file(files, rows).select("source_file", "speaker"), manifest_json.by_file(files, saved).select("source_file"))
    return export(spark, plan.processed_data_dir, plan.output_root, plan.podcast_name, chosen, named_embedder(plan.embedding_model), mode, file_glob, about=plan.about(), model=plan.embedding_model)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nodeloom", description=__doc__)
    parser.add_argument("action", choices=("import", "export", "select", "doctor"), nargs="?", default="import")
    parser.add_argument("--config")
    for name in ("processed-data-dir", "persist-dir", "collection-name"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--one-file", action="store_true")
    parser.add_argument("--per-commit", type=int, default=1000, help="files of one job; the stop file is asked before each")
    parser.add_argument("--ledger-json", help="a JSON ledger whose completed files are not imported again")
    parser.add_argument("--settings", help="export: a settings document to use; select: the one to write")
    parser.add_argument("--mode", choices=("update", "generate"), default="update")
    for name in ("podcast-name", "output-root", "embedding-model", "database-id"):
        parser.add_argument(f"--{name}")
    args = parser.parse_args(argv)
    config = load_config(args.config, processed_data_dir=args.processed_data_dir, persist_dir=args.persist_dir, collection_name=args.collection_name)
    base = str(Path(args.config).resolve().parent) if args.config and Path(args.config).exists() else str(Path.cwd())
    spark = SparkSession.builder.appName("nodeloom").getOrCreate()
    if args.action == "import":
        run_import(spark, config, base, args)
    elif args.action == "doctor":
        if not doctor(spark, config, base):
            raise SystemExit(1)
    else:
        reading = args.action == "export" and args.settings
        plan = ExportPlan.of(manifest_json.read_settings(spark, args.settings)[0]) if reading else ExportPlan()
        given = {k: v for k in ("podcast_name", "database_id", "processed_data_dir", "output_root", "collection_name", "embedding_model") if (v := getattr(args, k))}
        plan = dataclasses.replace(plan, **given).named_after(spark).filled(spark)
        if args.action == "select":
            save_selection(spark, plan, args.settings, config.file_glob)
            print(f"saved {args.settings}")
        else:
            out = run_export(spark, plan, args.settings, args.mode, config.file_glob)
            print(f"episodes={out.files} selected={out.documents} inserted={out.inserted}")


if __name__ == "__main__":
    main()
