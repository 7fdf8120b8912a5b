"""Command line: python -m orrery.plans.cli COMMAND."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import __version__
from orrery.operators import linkage, review, spatial
from orrery.plans import reports
from orrery.plans import run as runs
from orrery.session import build_session
from orrery.sources import vectors
from orrery.sources.config import load_config, resolved
from orrery.sources.manifest import load_manifest
from orrery.staging import cleanup, ship


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as text columns, blank for missing, with its line as ordinal."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])
    return rows.withColumn("ordinal", F.monotonically_increasing_id() + 1)  # a file with quoted line breaks is one part, read in order


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    rows, crs = vectors.read_features(spark, path)
    get = lambda n: F.coalesce(F.get_json_object("properties", f"$.{n}"), F.lit(""))
    return spatial.with_bounds(rows.select(get("candidate_id").alias("candidate_id"), get("field_id").alias("field_id"), "geometry")), crs


def migrate(spark: SparkSession, old_labels: str, old_shapes: str, new_labels: str, new_shapes: str, out: str) -> dict[str, Path]:
    a, old_crs = candidates(spark, old_shapes)
    b, new_crs = candidates(spark, new_shapes)
    vectors.same_metric_crs(old_crs, new_crs, "candidates")
    have = lambda df: df.withColumns({c: F.lit("") for c in linkage.REVIEW_FIELDS if c not in df.columns})
    got = linkage.migrate_labels(have(read_rows(spark, old_labels)), a, have(read_rows(spark, new_labels)), b, 250.0)
    names = {"updated": "updated_labeling_table.csv", "report": "label_migration_report.csv", "retired": "retired_labels.csv", "new_candidates": "new_candidates.csv"}
    drop = {"updated": ("ordinal", "migration_status"), "retired": ("ordinal",), "new_candidates": ("ordinal",)}
    return {k: reports.write_csv(got[k].drop(*drop.get(k, ())), Path(out) / n) for k, n in names.items()}


def learning(spark: SparkSession, scores: str, labels: str | None, out: str, **about: str) -> Path:
    rows = read_rows(spark, scores)
    none = spark.createDataFrame([], "candidate_id string, ordinal int, expert_label string, false_positive_reason string")
    got = review.learning_rows(rows, read_rows(spark, labels) if labels else none)
    return reports.write_csv(got.withColumns({k: F.lit(v or "") for k, v in about.items()}).orderBy("ordinal").drop("ordinal"), Path(out))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="orrery", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status")
    sub.add_parser("validate-config").add_argument("config")
    c = sub.add_parser("static-candidates")
    c.add_argument("--input", "-i", required=True)
    c = [c, sub.add_parser("run-mvp")]
    c[1].add_argument("--manifest", "-m", required=True)
    c[1].add_argument("--labels", help="reviewed labeling table, for the precision in the validation summary")
    for x in c:
        x.add_argument("--config", "-c", required=True)
        x.add_argument("--output-dir", "-o", required=True)
    c = sub.add_parser("export-learning-dataset")
    c.add_argument("--scores", required=True)
    c.add_argument("--output", required=True)
    for name in ("labels", "run-id", "feature-snapshot-id", "aoi-name", "geometry-ref"):
        c.add_argument(f"--{name}")
    c = sub.add_parser("migrate-labels")
    for name in ("old-labels", "old-candidates", "new-labels", "new-candidates", "output-dir"):
        c.add_argument(f"--{name}", required=True)
    a = p.parse_args(args)
    if a.command == "status":
        print(f"orrery {__version__}")
        return 0
    if a.command == "validate-config":
        print(json.dumps(resolved(load_config(a.config)), indent=2))
        return 0
    given = SparkSession.getActiveSession()
    spark = given or build_session()
    ship(spark)
    if a.command == "static-candidates":
        paths = runs.static_candidates(spark, a.input, load_config(a.config), a.output_dir)
    elif a.command == "run-mvp":
        config, manifest = load_config(a.config), load_manifest(a.manifest)
        paths = runs.write_artifacts(runs.run(spark, config, manifest), config, manifest, a.output_dir, read_rows(spark, a.labels) if a.labels else None)
    elif a.command == "migrate-labels":
        paths = migrate(spark, a.old_labels, a.old_candidates, a.new_labels, a.new_candidates, a.output_dir)
    else:
        paths = {"learning_dataset": learning(spark, a.scores, a.labels, a.output, run_id=a.run_id, feature_snapshot_id=a.feature_snapshot_id, aoi_name=a.aoi_name, geometry_ref=a.geometry_ref)}
    print(reports.GUARD)
    for name, path in paths.items():
        print(f"{name}={path}")
    if given is None:  # nobody else reads what this application has staged
        cleanup(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
