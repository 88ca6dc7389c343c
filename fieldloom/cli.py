"""Shell verbs over a stored study: ``python -m fieldloom.cli VERB PATH ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from fieldloom.sources.study import open_study


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fieldloom")
    verbs = out.add_subparsers(dest="verb", required=True)
    for name, extra in {"validate": [], "info": [], "support-id": [], "stats": ["slot"], "integrate": ["slot"], "probe": ["slot"], "rows": ["slot"], "evaluate": ["keys"], "dict-dump": ["model"]}.items():
        verb = verbs.add_parser(name)
        verb.add_argument("path")
        for argument in extra:
            verb.add_argument(argument)
        if name in ("stats", "integrate"):
            verb.add_argument("--by")
        if name == "integrate":
            verb.add_argument("--region")
        if name == "probe":
            verb.add_argument("--at", nargs="*", default=[], metavar="AXIS=INDEX")
        if name == "rows":
            verb.add_argument("begin", type=int)
            verb.add_argument("end", type=int)
        if name == "evaluate":
            verb.add_argument("--slot")
    return out


def run(spark: SparkSession, arguments: list[str]) -> tuple[str, int]:
    """The text that a verb prints, and its exit code."""
    from fieldloom.operators import access, models, statistics, supports
    from fieldloom.operators.integrate import integrate
    from fieldloom.plans import rules

    args = parser().parse_args(arguments)
    study = open_study(spark, args.path, strict=args.verb not in ("validate", "info"))
    m = study.manifest
    show = lambda frame: statistics.as_text(frame.limit(1000).collect(), frame.columns)
    if args.verb == "validate":
        found = rules.findings(study)
        return rules.report_text(found), int(any(f.severity == "error" for f in found))
    if args.verb == "info":
        return "\n".join(rules.info_lines(study)), 0
    if args.verb == "support-id":
        return "\n".join(f"{name} {digest}" for name, digest in supports.support_ids(study).items()), 0
    if args.verb == "dict-dump":
        return next(c.dict or "" for c in m.models if c.id == args.model), 0
    if args.verb == "evaluate":
        keys = spark.read.option("header", True).csv(args.keys, inferSchema=False)
        typed = models.keys_table(study, keys if "row" in keys.columns else keys.selectExpr("row_number() OVER (ORDER BY monotonically_increasing_id()) - 1 AS row", "*"))
        slot = m.find(args.slot) if args.slot else next(s for s in m.slots if s.source != "data")
        return show(models.prediction(study, slot, typed).orderBy("row")), 0
    slot = m.find(args.slot)
    if args.verb == "stats":
        frame = statistics.scalar_statistics(study, slot.name, args.by) if slot.location == "row" else statistics.field_statistics(study, slot, args.by).orderBy("row")
    elif args.verb == "integrate":
        frame = integrate(study, slot, args.by, args.region).orderBy("row")
    elif args.verb == "probe":
        frame = access.at(study, slot, **{k: int(v) for k, _, v in (x.partition("=") for x in args.at)})
    else:
        frame = study.long(slot, args.begin, args.end).orderBy("instance", "draw", "site", "component")
    return show(frame), 0


def main() -> int:
    spark = SparkSession.builder.appName("fieldloom").getOrCreate()
    text, code = run(spark, sys.argv[1:])
    print(text)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
