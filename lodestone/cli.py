"""Commands: ``python -m lodestone.cli ingest|search|evaluate|datasets|doctor``."""

from __future__ import annotations

import argparse
import json
import sys

from lodestone.config import EvalConfig, SearchConfig
from lodestone.errors import EngineError
from lodestone.operators import store
from lodestone.plans import evaluate, ops, search
from lodestone.plans.ingest import Warehouse, ingest_paths


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    top.add_argument("--warehouse", default="warehouse", help="root folder of the tables")
    top.add_argument("--output", choices=("text", "json"), default="text")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("paths", nargs="+")
    p.add_argument("--dataset-name", required=True)
    p = sub.add_parser("search")
    p.add_argument("-q", "--query", required=True)
    p.add_argument("--dataset-id", action="append", default=[])
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--score-threshold", type=float, default=0.4)
    p.add_argument("--parent-window", type=int, default=0)
    p.add_argument("--audit-path")
    p = sub.add_parser("evaluate")
    p.add_argument("-d", "--records", required=True)
    p.add_argument("--min", action="append", default=[], metavar="METRIC=VALUE")
    p.add_argument("--artifacts")
    p = sub.add_parser("datasets")
    p.add_argument("--name")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--offset", type=int, default=0)
    sub.add_parser("doctor")
    return top


def _show(rows: list[dict], output: str) -> None:
    for r in rows:
        print(json.dumps(r, default=str, ensure_ascii=False) if output == "json" else "  ".join(f"{k}={v}" for k, v in r.items()))


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if spark is None:
        from lodestone.session import local_session

        spark = local_session("*")
    warehouse = Warehouse(spark, args.warehouse)
    as_dicts = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    try:
        if args.command == "ingest":
            report = ingest_paths(warehouse, args.paths, args.dataset_name)
            rows = as_dicts(report.documents.orderBy("filename"))
            _show(rows, args.output)
            for w in report.warnings:
                print(f"warning: {w}", file=sys.stderr)
            return int(not rows or any(r["status"] == "failed" for r in rows))
        if args.command == "search":
            search.validate(args.query, args.dataset_id)
            config = SearchConfig(top_k=args.top_k, score_threshold=args.score_threshold, parent_window=args.parent_window)
            queries = spark.createDataFrame([("1", args.query, args.dataset_id)], "query_id string, query string, dataset_ids array<string>")
            cited = search.search(warehouse.read("chunks"), queries, config)
            result = search.answer(cited, queries, datasets=warehouse.read("datasets")).cache()
            _show(as_dicts(result.select("response", "citations", "failed_dataset_ids")), args.output)
            if args.audit_path:
                ops.write_audit(result, args.audit_path)
            return 0
        if args.command == "evaluate":
            thresholds = {k: float(v) for k, _, v in (m.partition("=") for m in args.min)}
            report = evaluate.run(warehouse.read("chunks"), evaluate.load_records(spark, args.records), None, EvalConfig(thresholds=thresholds))
            _show(as_dicts(report.aggregates.orderBy("metric")), args.output)
            _show(as_dicts(report.failures), args.output)
            if args.artifacts:
                evaluate.write_artifacts(report, args.artifacts)
            return int(not report.passed)
        if args.command == "datasets":
            if not 0 < args.limit <= 10_000 or args.offset < 0:
                raise EngineError("search.invalid_request", "limit lies in 1 to 10,000, offset is not negative")
            _show(as_dicts(store.list_datasets(warehouse.read("datasets"), warehouse.read("documents"), args.name, args.limit, args.offset).select("id", "name", "embed_model", "chunk_count", "created_at")), args.output)
            return 0
        rows = as_dicts(ops.doctor(spark))
        _show(rows, args.output)
        return int(any(r["status"] == "fail" for r in rows))
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
