"""Command line: python -m cueloom.cli --job DIR [options]."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from cueloom.config import load_config
from cueloom.plans.engine import run_job, run_jobs
from cueloom.session import drop_cuts, local_session


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    """The options; the three offset options exclude each other."""
    p = argparse.ArgumentParser(prog="cueloom", description="Merge two timed transcripts of a meeting into one.")
    p.add_argument("--job", help="job folder")
    p.add_argument("--all-jobs", nargs=2, metavar=("ROOT", "OUT"), help="merge all job folders under ROOT in one plan and write to OUT")
    p.add_argument("--config", default="config.yaml", help="application settings")
    how = p.add_mutually_exclusive_group()
    how.add_argument("--offset-sec", type=float, help="fixed offset in seconds")
    how.add_argument("--offset-auto", action="store_true", help="estimate the offset (default)")
    how.add_argument("--offset-skip", action="store_true", help="no offset")
    p.add_argument("--single-vtt", action="store_true", help="primary recording only")
    p.add_argument("--clean", action="store_true", help="drop checkpoints first")
    p.add_argument("--best-effort", action="store_true", help="write output although chunks failed")
    p.add_argument("--chunk", type=int, action="append", help="only this chunk; may be given several times")
    p.add_argument("--force", action="store_true", help="annotate completed chunks again")
    p.add_argument("--provider", help="annotator to use instead of the configured one")
    p.add_argument("--debug", action="store_true", help="detailed log")
    return p.parse_args(argv)


def setup_logging(path: Path, level: str) -> None:
    """Log to the console and to the job's log file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(message)s", handlers=[logging.StreamHandler(sys.stdout), logging.FileHandler(path, encoding="utf-8")], force=True)


def main(argv: list[str] | None = None) -> int:
    """Runs one job; 0 on success, 1 on an error."""
    args = parse_args(argv)
    options = {"offset_sec": args.offset_sec, "offset_skip": args.offset_skip, "single_vtt": args.single_vtt, "best_effort": args.best_effort, "debug": args.debug}
    if args.all_jobs:
        return _run(lambda spark: run_jobs(spark, *args.all_jobs, load_config(args.config, None, options), args.provider).show())
    if not args.job:
        print("--job or --all-jobs is needed", file=sys.stderr)
        return 1
    job = Path(args.job)
    if not job.is_dir():
        print(f"no such job folder: {job}", file=sys.stderr)
        return 1
    if args.clean and args.chunk:
        print("--clean and --chunk exclude each other", file=sys.stderr)
        return 1
    if args.chunk and min(args.chunk) < 0:
        print("--chunk takes numbers from 0", file=sys.stderr)
        return 1
    config = load_config(args.config, job, options)
    setup_logging(config["_resolved"]["logs_dir"] / "run.log", config["logging"]["log_level"])
    return _run(lambda spark: run_job(spark, job, config, args.clean, args.chunk, args.provider, args.force))


def _run(work: Callable[[SparkSession], object]) -> int:
    spark = local_session()
    try:
        work(spark)
    except Exception:
        logging.getLogger("cueloom").exception("job failed")
        return 1
    finally:
        drop_cuts(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
