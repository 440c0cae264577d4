"""Command line: the conversion and staging jobs as spark-submit entry points.

    python -m specweave hcir --source-view V --output-dir O [--max-molecules N] [--expected-ir-length L]
    python -m specweave msms --source-view V --output-dir O --molecule-ref REF.parquet
                             [--expected-train-molecules N ...]
    python -m specweave stage-hcir --source-view V --full-dir F --eval-dir E --expected train=N validation=N test=N
    python -m specweave stage-msms --source-view V --full-dir F --eval-dir E --molecule-ref REF.parquet
                                   --expected train=M:S validation=M:S test=M:S

Flag names follow the original converters so existing launch scripts keep
working; the batch-size flags are accepted and validated but have no Spark
meaning (the Parquet writer buffers on its own).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..operators.enrich import store_reference, stored_buckets
from . import jobs


def _session(checkpoint_dir: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("specweave")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def _reference(spark: SparkSession, path: str):
    """A stored reference by its folder, any other Parquet table as a frame."""
    return path if stored_buckets(spark, path) else spark.read.parquet(path)


def _pairs(items: list[str], conv) -> dict:
    out = {}
    for item in items:
        k, _, v = item.partition("=")
        out[k] = conv(v)
    return out


# Flag names and defaults of the original converters are kept.
def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specweave", description="Aligned-spectra preparation on Spark")
    p.add_argument("--checkpoint-dir", default=None, help="folder shared by the driver and all executors (spark.checkpoint.dir)")
    sub = p.add_subparsers(dest="command", required=True)

    h = sub.add_parser("hcir", help="NMR/IR conversion (J1)")
    h.add_argument("--source-view", required=True)
    h.add_argument("--output-dir", required=True)
    h.add_argument("--batch-rows", type=int, default=4096)
    h.add_argument("--max-molecules", type=int, default=0)
    h.add_argument("--expected-ir-length", type=int, default=0)
    h.add_argument("--line-index", default=None, help="folder that keeps line counts of the text files for later runs")
    h.add_argument("--rejects", default=None, help="quarantine failing lines in this folder instead of failing")

    m = sub.add_parser("msms", help="MS/MS conversion (J2)")
    m.add_argument("--source-view", required=True)
    m.add_argument("--output-dir", required=True)
    m.add_argument("--molecule-ref", required=True, help="Parquet table (smiles, canonical_smiles, fingerprint, formula)")
    m.add_argument("--manifest", default=None)
    m.add_argument("--batch-molecules", type=int, default=4096)
    m.add_argument("--max-molecules", type=int, default=0)
    for split in ("train", "validation", "test"):
        m.add_argument(f"--expected-{split}-molecules", type=int, default=0)
    m.add_argument("--fingerprint-type", default=None, help="what the reference table's bits are, for the summary")
    m.add_argument("--fingerprint-radius", type=int, default=None)
    m.add_argument("--line-index", default=None, help="folder that keeps line counts of the text files for later runs")
    m.add_argument("--rejects", default=None, help="quarantine failing lines in this folder instead of failing")

    r = sub.add_parser("store-reference", help="write a molecule reference bucketed by SMILES, for several conversions")
    r.add_argument("--molecule-ref", required=True, help="Parquet table (smiles, canonical_smiles, fingerprint, formula)")
    r.add_argument("--output-dir", required=True)
    r.add_argument("--buckets", type=int, required=True)

    sh = sub.add_parser("stage-hcir", help="convert if needed, verify, stage eval set, write READY (J3)")
    sh.add_argument("--source-view", required=True)
    sh.add_argument("--full-dir", required=True)
    sh.add_argument("--eval-dir", required=True)
    sh.add_argument("--expected", nargs=3, required=True, metavar="SPLIT=ROWS")
    sh.add_argument("--eval-rows", type=int, default=2048)
    sh.add_argument("--expected-ir-length", type=int, default=400)

    sm = sub.add_parser("stage-msms", help="convert if needed, verify summary, stage eval set (J4)")
    sm.add_argument("--source-view", required=True)
    sm.add_argument("--full-dir", required=True)
    sm.add_argument("--eval-dir", required=True)
    sm.add_argument("--molecule-ref", required=True)
    sm.add_argument("--expected", nargs=3, required=True, metavar="SPLIT=MOLECULES:SPECTRA")
    sm.add_argument("--eval-rows", type=int, default=2048)
    sm.add_argument("--manifest", default=None)
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command in ("hcir", "msms"):
        jobs.validate_args(args.max_molecules, args.batch_rows if args.command == "hcir" else args.batch_molecules, args.command)
    spark = _session(args.checkpoint_dir)
    if args.command == "hcir":
        result = jobs.convert_hcir(spark, args.source_view, args.output_dir, args.max_molecules, args.expected_ir_length,
                                   on_error="quarantine" if args.rejects else "fail", rejects=args.rejects, line_index=args.line_index)
    elif args.command == "msms":
        expected = {s: getattr(args, f"expected_{s}_molecules") for s in ("train", "validation", "test")}
        bits = {"type": args.fingerprint_type, "radius": args.fingerprint_radius}
        result = jobs.convert_msms(spark, args.source_view, args.output_dir, _reference(spark, args.molecule_ref),
                                   args.max_molecules, expected, args.manifest,
                                   fingerprint={k: v for k, v in bits.items() if v is not None},
                                   on_error="quarantine" if args.rejects else "fail", rejects=args.rejects, line_index=args.line_index)
    elif args.command == "store-reference":
        store_reference(spark.read.parquet(args.molecule_ref), args.output_dir, args.buckets)
        result = {"reference": args.output_dir, "buckets": args.buckets}
    elif args.command == "stage-hcir":
        result = jobs.stage_hcir(spark, args.source_view, args.full_dir, args.eval_dir,
                                 _pairs(args.expected, int), args.eval_rows, args.expected_ir_length)
    else:
        expected = _pairs(args.expected, lambda v: tuple(int(x) for x in v.split(":")))
        result = jobs.stage_msms(spark, args.source_view, args.full_dir, args.eval_dir,
                                 _reference(spark, args.molecule_ref), expected, args.eval_rows, args.manifest)
    print(json.dumps(result, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
