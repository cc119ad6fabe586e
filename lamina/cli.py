"""Command line: python -m lamina.cli calibrate|compare|records|seed-runs|import-arrays|simulate|audit|inventory|verify ..."""

from __future__ import annotations

import argparse
import json

from lamina.operators import audit
from lamina.operators.thresholds import Thresholds
from lamina.plans import pipelines, seeds
from lamina.plans import reads as R
from lamina.session import builder
from lamina.sources import fasta, files, logits, simulate


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamina")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("calibrate", help="thresholds from validation logits")
    c.add_argument("logits")
    c.add_argument("thresholds")
    c.add_argument("--acceptance", type=float, default=0.95)
    c.add_argument("--temperature", type=float, default=1.0)
    c = sub.add_parser("compare", help="closed set against cascade")
    c.add_argument("logits")
    c.add_argument("thresholds")
    c.add_argument("output")
    c = sub.add_parser("records", help="a wide row for each archive, and each prefix of molecules and reads")
    c.add_argument("logits")
    c.add_argument("thresholds")
    c.add_argument("output")
    c.add_argument("--molecules", type=int, default=20)
    c.add_argument("--reads", type=int, default=50)
    c.add_argument("--read-sweep", type=int, nargs="*", default=[1, 5, 10, 20, 50])
    c.add_argument("--molecule-sweep", type=int, nargs="*", default=[1, 5, 10, 20])
    c = sub.add_parser("seed-runs", help="runs by seed over a folder of tables, their summary and a manifest; what is there already is kept")
    c.add_argument("tables")
    c.add_argument("output")
    for name, value in (("presence", R.PRESENCE), ("energy", R.ENERGY), ("proxy", R.PROXY)):
        c.add_argument(f"--{name}", type=float, default=value)
    c.add_argument("--repetitions", type=int, default=2000)
    c.add_argument("--workers", type=int, default=4)
    c.add_argument("--prune", action="store_true", help="delete outputs of other thresholds or inputs")
    c = sub.add_parser("inventory", help="lengths and digests of all files of a folder")
    c.add_argument("folder")
    c.add_argument("output")
    c = sub.add_parser("verify", help="files that are missing, unexpected or changed since an inventory")
    c.add_argument("folder")
    c.add_argument("inventory")
    c.add_argument("output")
    c = sub.add_parser("import-arrays", help="array files to a table of logits")
    c.add_argument("folder")
    c.add_argument("output")
    c = sub.add_parser("simulate", help="references as FASTA and reads as a table")
    c.add_argument("output")
    c.add_argument("--categories", nargs="+", default=["BCH", "Convolutional", "LDPC", "Polar"])
    c.add_argument("--archives", type=int, default=2)
    c.add_argument("--molecules", type=int, default=4)
    c.add_argument("--reads", type=int, default=5)
    c.add_argument("--error-rate", type=float, default=0.05)
    c = sub.add_parser("audit", help="limits and uniqueness of references in FASTA")
    c.add_argument("fasta")
    c.add_argument("output")
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = builder("lamina").getOrCreate()
    if a.command == "calibrate":
        t = pipelines.calibrate(logits.validated(logits.load(spark, a.logits)), a.acceptance, a.temperature)
        with open(a.thresholds, "w", encoding="utf-8") as f:
            json.dump(t.row(), f, indent=2)
    elif a.command == "compare":
        with open(a.thresholds, encoding="utf-8") as f:
            t = Thresholds(**json.load(f))
        compared = pipelines.compare(logits.validated(logits.load(spark, a.logits)), t)
        compared.write.mode("overwrite").parquet(f"{a.output}/archives")
        pipelines.summary(spark.read.parquet(f"{a.output}/archives")).write.mode("overwrite").json(f"{a.output}/summary")
    elif a.command == "records":
        with open(a.thresholds, encoding="utf-8") as f:
            t = Thresholds(**json.load(f))
        rows = logits.validated(logits.load(spark, a.logits))
        pipelines.records(rows, t, (a.molecules, a.reads), tuple(a.read_sweep), tuple(a.molecule_sweep)).write.mode("overwrite").parquet(a.output)
    elif a.command == "seed-runs":
        g = seeds.graph(spark, a.tables, f"{a.output}/stages", a.presence, a.energy, a.proxy, repetitions=a.repetitions)
        g.run(workers=a.workers)
        for name in ("summary", "pooled", "matrices", "counts", "intervals"):
            g.table(name).coalesce(1).write.mode("overwrite").json(f"{a.output}/{name}")
        g.manifest().coalesce(1).write.mode("overwrite").json(f"{a.output}/manifest")
        if a.prune:
            g.prune()
    elif a.command == "inventory":
        files.hashes(spark, a.folder).write.mode("overwrite").parquet(a.output)
    elif a.command == "verify":
        files.verify(files.hashes(spark, a.folder), spark.read.parquet(a.inventory)).write.mode("overwrite").json(a.output)
    elif a.command == "import-arrays":
        logits.save(logits.from_arrays(spark, a.folder), a.output)
    elif a.command == "simulate":
        refs = simulate.references(spark, a.categories, a.archives, a.molecules)
        refs.write.mode("overwrite").parquet(f"{a.output}/references")
        refs = spark.read.parquet(f"{a.output}/references")
        fasta.write(refs.selectExpr("concat_ws('|', category, archive_id, molecule_id) AS id", "sequence"), f"{a.output}/fasta")
        simulate.reads(refs, a.reads, a.error_rate).write.mode("overwrite").parquet(f"{a.output}/reads")
    elif a.command == "audit":
        refs = fasta.read(spark, a.fasta).selectExpr("split(id, '[|]')[0] AS category", "sequence")
        audit.reference_audit(refs, "sequence", "category").write.mode("overwrite").json(a.output)


if __name__ == "__main__":
    main()
