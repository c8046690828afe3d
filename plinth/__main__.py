"""Commands: python -m plinth list | run | explain | validate | route | solve | parse | index | search | evaluate | drift."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plinth")
    some = out.add_subparsers(dest="command", required=True)
    some.add_parser("list", help="names of the registered queries")
    for name, text in (("run", "a query's rows, shown or written as Parquet"), ("explain", "a query's plan")):
        p = some.add_parser(name, help=text)
        p.add_argument("query")
        p.add_argument("sf_dir")
        if name == "run":
            p.add_argument("--out")
            p.add_argument("--show", type=int, default=20)
    p = some.add_parser("validate", help="verdicts on plans (YAML files) by offerings (JSON lines of course, term, subject, level, units)")
    p.add_argument("plans")
    p.add_argument("offered")
    p = some.add_parser("route", help="how a question would be answered")
    p.add_argument("question")
    p = some.add_parser("solve", help="a shortest plan by offerings, as YAML")
    p.add_argument("offered")
    p.add_argument("--taken", default="", help="courses held, by commas")
    p.add_argument("--load", type=float, default=15.0)
    p.add_argument("--horizon", type=int, default=12)
    p = some.add_parser("parse", help="course pages (HTML files) to JSON lines, and a report of what could not be read")
    p.add_argument("pages")
    p.add_argument("out")
    p.add_argument("--most", type=int, default=100, help="failures listed of each kind")
    p = some.add_parser("index", help="a search index of texts (JSON lines of id, text)")
    p.add_argument("texts")
    p.add_argument("out")
    p = some.add_parser("search", help="the likest texts of an index")
    p.add_argument("index")
    p.add_argument("question")
    p.add_argument("-k", type=int, default=5)
    p = some.add_parser("evaluate", help="graded answers (JSON lines) to results.csv, results.json and report.md")
    p.add_argument("answers")
    p.add_argument("out")
    p.add_argument("--snapshot", default="")
    p = some.add_parser("drift", help="what moved between two snapshots of a store (snapshot, or snapshot@version)")
    p.add_argument("store")
    p.add_argument("before")
    p.add_argument("after")
    p.add_argument("--keys", required=True, help="columns, by commas")
    p.add_argument("--value", required=True)
    for name in ("validate", "solve"):
        some.choices[name].add_argument("--gold", help="a rules file (YAML) in the place of the program that is built in")
    return out


OFFERED = "course string, term string, subject string, level int, units double"
ANSWER = "config string, id string, type string, quality double, citation_ok boolean, cost_usd double, hit_tokens long, prompt_tokens long, latency_s double"


def offerings(spark, path: str):
    """(offered, catalogue) of JSON lines of OFFERED."""
    rows = spark.read.schema(OFFERED).json(path)
    return rows, {r["course"]: (r["subject"], r["level"], r["units"]) for r in rows.select("course", "subject", "level", "units").distinct().toLocalIterator()}


def solve(spark, args, program) -> int:
    import yaml

    from .functions.terms import season_of
    from .operators import solve as solver

    offered, catalogue = offerings(spark, args.offered)
    seasons: dict[str, set] = {}
    for r in offered.select("course", season_of(offered["term"]).alias("season")).distinct().toLocalIterator():
        seasons.setdefault(r["course"], set()).add(r["season"])
    taken = {c.strip() for c in args.taken.split(",")} - {""}
    terms = solver.solve(program, catalogue, {c: frozenset(s) for c, s in seasons.items()}, taken, solver.Policy(load=args.load, horizon=args.horizon))
    if terms is None:
        print(f"no plan within {args.horizon} terms")
        return 1
    names = solver.term_names(len(terms))
    print(yaml.safe_dump({"plan_id": "shortest", "taken": sorted(taken), "terms": [{"term": n, "courses": t} for n, t in zip(names, terms, strict=True) if t]}, sort_keys=False), end="")
    return 0


def parse(spark, args) -> int:
    from pyspark.sql import functions as F

    from .operators import courses, reports
    from .sources import readers
    from .sources.scratch import kept

    pages = readers.html_files(spark, args.pages).select(F.col("path").alias("url"), "html")
    rows = kept(courses.parse_courses(pages), "courses")
    readers.write_json(rows, f"{args.out}/courses")
    reports.write_run_report(rows, f"{args.out}/report.md", args.most)
    failed = rows.where(F.size("flags") > 0).count()
    print(f"{rows.count()} courses, {failed} with flags")
    return 0


def drift(spark, args) -> int:
    from pyspark.sql import functions as F

    from .sources.snapshots import Store

    at = lambda x: (x.split("@")[0], int(x.split("@")[1]) if "@" in x else None)
    keys = args.keys.split(",")
    rows = Store(spark, args.store).drift(at(args.before), at(args.after), keys, args.value).where("changed").orderBy(*(F.col(k) for k in keys))
    for r in rows.toLocalIterator():
        print(" ".join(str(r[k]) for k in keys), f"{r['before']} -> {r['after']}", sep=": ")
    return 0


def main(argv: list[str] | None = None) -> int:
    """0: done; validate: 1 if a plan isn't valid."""
    from pyspark.sql import functions as F

    from .operators import degree, eval_run, inverted, reports, routing
    from .plans import degrees, pages, records, tables, texts  # noqa: F401  they register the queries
    from .plans.program import PROGRAM
    from .plans.registry import QUERIES
    from .session import build
    from .shipping import ship
    from .sources.documents import plan_files
    from .sources.rules import read_program

    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = build()
    ship(spark)
    if args.command == "route":
        print(routing.classify(spark.createDataFrame([(args.question,)], "text string"), "text").first()["route"])
    elif args.command in ("parse", "drift"):
        return {"parse": parse, "drift": drift}[args.command](spark, args)
    elif args.command == "index":
        inverted.build(spark.read.schema("id string, text string").json(args.texts), "id", "text", args.out)
    elif args.command == "search":
        for r in inverted.search(spark, args.index, spark.createDataFrame([(0, args.question)], "q int, text string"), "q", "id", k=args.k).orderBy("rank").collect():
            print(f"{r['rank']}. {r['id']} ({r['score']:.4f})")
    elif args.command == "evaluate":
        table = eval_run.results(spark.read.schema(ANSWER).json(args.answers))
        eval_run.write_results(table, args.out, snapshot=args.snapshot)
        reports.write_markdown(eval_run.report(table, {"snapshot": args.snapshot or "none"}), f"{args.out}/report.md")
    elif args.command == "solve":
        return solve(spark, args, read_program(args.gold) if args.gold else PROGRAM)
    elif args.command == "validate":
        offered, catalogue = offerings(spark, args.offered)
        plans = plan_files(spark, args.plans)
        failures = degree.validate(plans, read_program(args.gold) if args.gold else PROGRAM, catalogue, offered)
        bad = {}
        for r in failures.orderBy("plan", "seq", "place").select("plan", degree.rendered().alias("text")).toLocalIterator():
            bad.setdefault(r["plan"], []).append(r["text"])
        for r in plans.select("plan").distinct().orderBy("plan").toLocalIterator():
            print(f"{r['plan']}: {'invalid' if r['plan'] in bad else 'valid'}", *bad.get(r["plan"], []), sep="\n  ")
        return int(bool(bad))
    else:
        df = QUERIES[args.query](spark, args.sf_dir)
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.orderBy(*(F.col(c) for c in df.columns[:1])).show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
