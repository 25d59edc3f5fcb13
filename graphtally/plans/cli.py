"""Command line: build a summary of a graph, or estimate the queries of a folder.

    python -m graphtally.plans.cli -b -m cset -d graph.txt
    python -m graphtally.plans.cli -q -m wj -d graph.txt -i queries/ -o result.txt -p 0.03 -n 30 -s 0
    python -m graphtally.plans.cli -x accuracy -d graph.txt -i queries/ -o results/
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from ..operators import bound_sketch, charsets, random_walk, sampling, typed_summary
from ..operators.base import Estimator, summary_path
from ..operators.graph import Graph
from ..sources import text
from ..sources.files import read_texts, write_text
from .harness import cost_report, error_lines, result_lines, run_trials, trial_stats
from .pattern import Pattern
from .store import Store

METHODS = ("cset", "sumrdf", "bsk", "cs", "wj", "jsub", "impr")
#: Sampling ratios of the varying-ratio experiment.
RATIOS = (1e-4, 3e-4, 1e-3, 3e-3, 1e-2, 3e-2)
SUMMARIZING, SAMPLING = ("cset", "sumrdf", "bsk"), ("wj", "cs", "impr", "jsub")
EXPERIMENTS = ("build", "accuracy", "ratios", "efficiency")


def experiment(kind: str, data: str, queries: str, out: str, n: int = 30) -> list[list[str]]:
    """The command lines of an experiment; results lie in the folder ``out``, one file a run."""

    def asked(m: str, *more: str, name: str = "") -> list[str]:
        return ["-q", "-m", m, "-d", data, "-i", queries, "-o", f"{out.rstrip('/')}/{kind}_{m}{name}.txt", "-n", str(n), *more]

    if kind == "build":
        return [["-b", "-m", m, "-d", data] for m in SUMMARIZING]
    if kind == "accuracy":
        return [asked(m) for m in METHODS]
    if kind == "ratios":
        return [asked(m, "-p", f"{p:g}", name=f"_{p:g}") for p in RATIOS for m in SAMPLING]
    return [["-b", "-m", m, "-d", data, "-s", str(s), "-o", f"{out.rstrip('/')}/{kind}_build_{m}_{s}.txt"] for m in SUMMARIZING for s in range(6)] + [asked(m, "--repeat-fixed") for m in METHODS]


def method(name: str, p: float = 0.03, budget: int = 4096, threshold: float = 0.15) -> Estimator:
    return {
        "cset": lambda: charsets.CharacteristicSets(), "sumrdf": lambda: typed_summary.TypedSummary(p, threshold), "bsk": lambda: bound_sketch.BoundSketch(budget),
        "cs": lambda: sampling.CorrelatedSampling(p), "wj": lambda: sampling.WanderJoin(p), "jsub": lambda: sampling.JSub(p), "impr": lambda: random_walk.RandomWalk(p),
    }[name]()


def graph(spark: SparkSession, path: str) -> Graph:
    """A line-format file, converted once to the native layout beside it, or a folder in that layout."""
    store = Store(spark, f"{path}.native")
    if not all(store.has(t) for t in ("vertices", "vlabels", "edges")):
        text.read_text(spark, path).stored(store)
    return Graph(store.table("vertices"), store.table("vlabels"), store.table("edges").select("src", "dst", "el"))


def patterns(spark: SparkSession, path: str) -> dict[str, Pattern]:
    """The pattern of a file, or of every .txt file below a folder, by name; on any store that Spark reads."""
    return {name: Pattern.from_lines(said.splitlines()) for name, said in read_texts(spark, path, ".txt").items()}


def summary(spark: SparkSession, path: str, name: str, m: Estimator, p: float, seed: int, budget: int) -> Store:
    return Store(spark, summary_path(path, name, p, seed, budget if name == "bsk" else None))


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("-b", "--build", action="store_true", help="build the summary")
    a.add_argument("-q", "--query", action="store_true", help="estimate")
    a.add_argument("-m", "--method", choices=METHODS)
    a.add_argument("-x", "--experiment", choices=EXPERIMENTS, help="run a grid of builds or estimates; -o is a folder")
    a.add_argument("-d", "--data", required=True, help="graph in the line format")
    a.add_argument("-i", "--input", help="pattern file or folder")
    a.add_argument("-o", "--output", help="result file; errors go beside it with the ending .err")
    a.add_argument("-p", "--ratio", type=float, default=0.03)
    a.add_argument("-n", "--trials", type=int, default=30)
    a.add_argument("-s", "--seed", type=int, default=0)
    a.add_argument("--budget", type=int, default=4096)
    a.add_argument("--threshold", type=float, default=0.15)
    a.add_argument("--timeout", type=float, default=300.0, help="seconds a trial")
    a.add_argument("--costs", help="folder for a Parquet table of what the trials cost the executors")
    a.add_argument("--repeat-fixed", action="store_true", help="as many trials of fixed estimators, for their times")
    o = a.parse_args(args)
    if o.experiment:
        return max(main(line) for line in experiment(o.experiment, o.data, o.input, o.output or ".", o.trials))
    if not o.method:
        a.error("a method or an experiment is required")
    spark = SparkSession.builder.getOrCreate()
    g, m = graph(spark, o.data), method(o.method, o.ratio, o.budget, o.threshold)
    store = summary(spark, o.data, o.method, m, o.ratio, o.seed, o.budget)
    if o.build:
        began = time.perf_counter()
        m.summarize(g, store)
        if o.output:  # a summary that was there takes no time
            write_text(spark, o.output, f"{o.method} {time.perf_counter() - began:.3f} {store.size()}\n")
    if o.query:
        trials = run_trials(spark, g, patterns(spark, o.input), [m], o.trials, o.seed, o.timeout, {m.name: m.summarize(g, store)}, o.repeat_fixed).cache()
        for lines, ending in ((result_lines(trial_stats(trials)), ""), (error_lines(trials), ".err")):
            said = "".join(f"{r['value']}\n" for r in lines.orderBy("query").collect())  # a line or two a query
            if o.output:
                write_text(spark, o.output + ending, said)
            else:
                print(said, end="")
        if o.costs:
            cost_report(trials).write.mode("overwrite").parquet(o.costs)
        trials.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
