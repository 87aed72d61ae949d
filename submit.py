"""Command line for ``spark-submit``: ``submit.py train ...`` and ``submit.py score ...``."""

from __future__ import annotations

import argparse

from coppice.operators.forest import DEPTHS, TREES
from coppice.plans.jobs import DROPPED, score_job, train_job
from coppice.session import session


def _numbers(text: str) -> list[int]:
    return [int(part) for part in text.split(",")]


def _names(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--data", required=True, help="delimited text, any Hadoop path")
    common.add_argument("--model", required=True, help="where the model is saved")
    common.add_argument("--metrics", help="folder to which a stamped metrics row is appended")
    common.add_argument("--run-id", help="a run's metrics replace those of an earlier try of the same id")
    common.add_argument("--sep", default=";")
    common.add_argument("--schema", help="column types as DDL; spares the pass that infers them")
    common.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="for the text reader")
    common.add_argument("--label", help="label column; default: the last one, or the model's")
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("train", parents=[common])
    train.add_argument("--validation", help="hold-out text to score after training")
    train.add_argument("--drop", type=_names, default=list(DROPPED), help="columns that are no features")
    train.add_argument("--key", type=_names, help="columns that decide a row's fold and are no features; default: random folds")
    train.add_argument("--trees", type=_numbers, default=list(TREES))
    train.add_argument("--depths", type=_numbers, default=list(DEPTHS))
    train.add_argument("--folds", type=int, default=5)
    train.add_argument("--seed", type=int, default=42)
    train.add_argument("--parallelism", type=int, default=1, help="fits in training at a time")
    train.add_argument("--cache", action="store_true", help="keep the vectors in executor storage")
    train.add_argument("--partitions", type=int, help="canonical row order in so many partitions")
    train.add_argument("--rejected", help="folder for rows that cannot be read, which are then no training rows")
    train.add_argument("--max-rejected", type=float, default=1.0, help="share of such rows from which the job fails")
    train.add_argument("--ledger", help="folder that records finished fits; a search begun again makes only the others")
    train.add_argument("--nested", action="store_true", help="one fit per fold; smaller forests are read off the largest")
    train.add_argument("--max-memory-mb", type=int, default=256, help="split statistics gathered per pass")
    score = jobs.add_parser("score", parents=[common])
    score.add_argument("--predictions", help="folder for the scored rows, as parquet")
    score.add_argument("--features", type=_names, help="feature columns in training order, for a bare forest")
    return parser.parse_args(argv)


def _report(title: str, metrics) -> None:
    for row in metrics.collect():
        print(f"{title}: rows {row.n_rows}, F1 {row.f1:.4f}, accuracy {row.accuracy:.4f}")


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    spark = session(f"coppice-{args.job}")
    shared = {
        "metrics_path": args.metrics,
        "sep": args.sep,
        "schema": args.schema,
        "label": args.label,
        "run_id": args.run_id,
        "options": dict(option.split("=", 1) for option in args.option),
    }
    if args.job == "score":
        _report("Test", score_job(spark, args.data, args.model, features=args.features, predictions_path=args.predictions, **shared))
        return
    trained = train_job(
        spark,
        args.data,
        args.model,
        args.validation,
        **shared,
        rejected_path=args.rejected,
        max_rejected=args.max_rejected,
        drop=args.drop,
        key=args.key,
        trees=args.trees,
        depths=args.depths,
        folds=args.folds,
        seed=args.seed,
        parallelism=args.parallelism,
        cache=args.cache,
        partitions=args.partitions,
        ledger=args.ledger,
        nested=args.nested,
        maxMemoryInMB=args.max_memory_mb,
    )
    trained.scores.show(trained.scores.count(), truncate=False)
    if trained.validation is not None:
        _report("Validation", trained.validation)
    print(f"model saved in {args.model}")


if __name__ == "__main__":
    main()
