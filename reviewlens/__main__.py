"""Command line: list and run registered queries, evaluate or audit a stored model, rerun disputed reports."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from reviewlens import plans
from reviewlens.operators import evaluate, model, signals
from reviewlens.session import build_session
from reviewlens.sources import files


def _examples(spark, path: str):
    """Examples of a corpus file with their flat features as columns."""
    rows = files.load_examples(spark, path)
    wide = [F.try_element_at("features", F.lit(key)).alias(c) for key, c in signals.FEATURES.items()]
    return rows.select(F.col("exampleId").alias("example_id"), "label", F.try_element_at("metadata", F.lit("priors")).alias("priors"), *wide)


def _slots(spark, path: str) -> tuple[str, model.Slots]:
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    slots = model.read_artifact(text)
    if slots is None:
        raise ValueError(f"{path} holds no model")
    # weights are stored by feature name, tables have their columns
    short = lambda m: m and model.Model(m.intercept, {signals.FEATURES.get(k, k): v for k, v in m.coefficients.items()}, m.calibration, {signals.FEATURES.get(k, k): v for k, v in m.sketches.items()})
    return text, model.Slots(short(slots.local), short(slots.graph))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reviewlens", description=__doc__)
    parser.add_argument("--master", help="the cluster's, if it isn't in Spark's own settings")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--output", help="a folder for Parquet; else the first rows are shown")
    audit = sub.add_parser("audit", help="evaluate a stored model on a corpus file")
    audit.add_argument("artifact")
    audit.add_argument("corpus")
    audit.add_argument("--slot", default=evaluate.LOCAL_SLOT)
    audit.add_argument("--priors", action="append", default=[], help="a digest of the present priors")
    dispute = sub.add_parser("dispute", help="rerun reports (a JSON document a line)")
    dispute.add_argument("artifact")
    dispute.add_argument("documents")
    return parser


def main(argv: list[str] | None = None) -> int:
    """0, or 1 if the audit has problems, a report doesn't agree, or an input can't be read."""
    args = _parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(plans.QUERIES)))
        return 0
    spark = build_session("reviewlens", args.master)
    try:
        if args.command == "run":
            if args.query not in plans.QUERIES:
                raise ValueError(f"no query {args.query!r}")
            out = plans.QUERIES[args.query](spark, args.tables)
            out.write.parquet(args.output) if args.output else out.show(20, truncate=False)
            return 0
        text, slots = _slots(spark, args.artifact)
        if args.command == "audit":
            digest = model.artifact_priors(text).get(args.slot)
            row = evaluate.audit(_examples(spark, args.corpus), slots, args.slot, digest, set(args.priors)).first()
            print("\n".join(f"{k}: {v}" for k, v in row.asDict().items()))
            return int(bool(row["problems"]))
        documents = spark.read.text(args.documents).where(F.trim("value") != "").withColumnRenamed("value", "document")
        rows = evaluate.reproduce(documents, slots).select("slot", "claimed", "probability", "agrees", "problem").collect()
        print("\n".join(f"{r['slot']} {r['claimed']} {r['probability']} {'agrees' if r['agrees'] else r['problem']}" for r in rows))
        return int(not all(r["agrees"] for r in rows))
    except ValueError as e:
        print(str(e), file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
