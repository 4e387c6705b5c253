"""python -m tessavox preprocess|train|inference|converter|analysis: the jobs of a configuration file."""

from __future__ import annotations

import argparse
import json

from tessavox.plans import jobs
from tessavox.plans.session import session


def main() -> None:
    p = argparse.ArgumentParser(prog="tessavox", description=__doc__)
    p.add_argument("job", choices=["preprocess", "train", "inference", "converter", "analysis"])
    p.add_argument("--config", help="the project's configuration (JSON)")
    p.add_argument("--input", help="preprocess: a folder of slices; analysis: the folder to search")
    p.add_argument("--output", help="preprocess: the folder for the normalised slices; analysis: the report's name")
    p.add_argument("--mode", default="train", choices=["train", "inference"], help="preprocess: the section with the settings")
    args = p.parse_args()
    config = {}
    if args.config:
        with open(args.config) as f:
            config = json.load(f)
    spark = session(f"tessavox {args.job}")
    if args.job == "preprocess":
        jobs.preprocess(spark, config, args.input, args.output, args.mode)
    elif args.job == "train":
        jobs.training(spark, config)
    elif args.job == "inference":
        jobs.inference(spark, config)
    elif args.job == "converter":
        jobs.conversion(spark, config)
    else:
        jobs.analysis(spark, args.input, args.output or "evaluation_report", config)
    spark.stop()


if __name__ == "__main__":
    main()
