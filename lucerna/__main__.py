"""Command line: ``python -m lucerna --data DIR [--config FILE ...]``.

A configuration is YAML (or JSON): ``folder`` (a data set with config.yaml and ground truth), ``scenario`` and
``queries``, ``settings`` (a full configuration or a part of it), ``overrides`` (lists to combine), ``endpoint`` (an
OpenAI-compatible server) and ``output``. Without a configuration the offline demonstration over ``--data`` runs.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Config, TableRoles
from .operators.features import FeatureCache, PseudoLabelCache
from .plans import lexicon, scenarios
from .plans.drift import MODES, run_group
from .plans.engine import Engine
from .plans.experiments import Experiment, overview, payload, rounds, selected_rules, usage_report
from .sources.backends import Endpoint, HttpBackend
from .sources.datasets import StateStore, ground_truth, load_dataset, parse_yaml, read_table, result_table, save_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lucerna", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--config", action="append", default=[], help="configuration file; may be repeated")
    p.add_argument("--data", help="folder with documents.parquet and labels.parquet for the demonstration")
    p.add_argument("--cold", action="store_true", help="read and write no cache")
    p.add_argument("--certificate", action="store_true", help="compute error certificates")
    p.add_argument("--debug", action=argparse.BooleanOptionalAction, default=False, help="print the whole payload")
    p.add_argument("--drift", choices=sorted(scenarios.DRIFT_GROUPS), help="answer the second query of each pair of a group with the first one's view")
    p.add_argument("--mode", choices=MODES, default="selective", help="how drifted queries are answered")
    p.add_argument("--views", help="folder of the views and the journal of drifted queries")
    p.add_argument("--ls-configs", action="store_true", help="list configuration files below the working folder and stop")
    return p


def resolve(path: str, root: Path = Path(".")) -> Path:
    """A configuration by its path, or by its path below the folder of experiments."""
    for p in (Path(path), root / "experiments" / path):
        if p.is_file():
            return p
    raise FileNotFoundError(path)


def demonstration(spark: SparkSession, data: str, config: Config, cache: str | None = None) -> Engine:
    """Two semantic queries over labelled documents, answered by the lexical backend."""
    labels = read_table(spark, f"{data}/labels.parquet")
    table = read_table(spark, f"{data}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {"toxic": labels.filter("toxic = 1").select("doc_id"), "junk": labels.filter("quality = 0").select("doc_id")}
    roles = TableRoles(base=("lang", "source", "n_chars"), ids=("doc_id",), payload=("text",))
    return Engine(table, roles, {"toxic": lexicon.toxic_query(), "junk": lexicon.junk_query()}, truth, lexicon.backend(), "doc_id", config, FeatureCache(cache) if cache else None)


def configured(spark: SparkSession, given: dict[str, Any], cold: bool) -> Experiment:
    table, roles = load_dataset(spark, given["folder"], given.get("file", "data_full.csv"))
    queries = scenarios.queries_of(given["scenario"], given.get("queries"))
    truth = {n: ground_truth(spark, given["folder"], scenarios.truth_name(n), list(q.selected)) for n, q in queries.items()}
    row_id = given.get("row_id", "_row_id")
    if row_id not in table.columns:
        # a digest of the row, so that it is the same in every run
        table = table.withColumn(row_id, F.xxhash64(*table.columns))
    cache = FeatureCache(given["cache"]) if given.get("cache") and not cold else None
    engine = Engine(table, roles, queries, truth, HttpBackend(Endpoint(**given["endpoint"])), row_id, Config(**given.get("settings", {})), cache)
    if cache:
        engine.store, engine.pseudo_labels = StateStore(spark, f"{given['cache']}/state"), PseudoLabelCache(given["cache"])
    return Experiment(engine, given.get("overrides", {}))


def drifted(spark: SparkSession, given: dict[str, Any], group: str, mode: str, views: str, cold: bool) -> DataFrame:
    """The pairs of a drift group, as one table."""
    pairs = scenarios.DRIFT_GROUPS[group]
    engine = configured(spark, given | {"queries": sorted({q for pair in pairs for q in pair})}, cold).engine
    return result_table(spark, run_group(engine, group, pairs, mode, views, cold))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.ls_configs:
        print("\n".join(str(p) for p in sorted(Path(".").rglob("*.y*ml"))))
        return 0
    if not args.config and not args.data:
        parser().print_help()
        return 2
    spark = SparkSession.builder.appName("lucerna").getOrCreate()
    for path in args.config:
        given = parse_yaml(resolve(path).read_text())
        if args.drift:
            out = drifted(spark, given, args.drift, args.mode, args.views or f"{given['folder']}/views", args.cold)
        else:
            experiment = configured(spark, given, args.cold)
            experiment.with_certificate = args.certificate
            out = experiment.table()
            usage_report(spark, {json.dumps(p["settings"]): p["usage"] for p in experiment.payloads}).show(truncate=False)
            if args.debug:
                print(json.dumps(experiment.payloads, indent=1, default=str))
        out.show(truncate=False)
        if given.get("output"):
            save_csv(out, given["output"])
    if args.data:
        engine = demonstration(spark, args.data, Config())
        states = engine.run(args.certificate)
        overview(spark, states, engine.config).show(truncate=60)
        if len(engine.config.dynamic_setting) > 1:
            rounds(spark, states).show(truncate=False)
        selected_rules(spark, engine, states).show(truncate=False)
        if args.debug:
            print(json.dumps(payload(engine, states), indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
