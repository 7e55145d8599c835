"""python -m binloom build | search | count | inspect

A list of sequence files becomes an index with a user bin per file; a file of
queries is searched for user bins that hold enough of each query's k-mers.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from binloom.config import FilterConfig
from binloom.operators import inspect, kmers, tree
from binloom.sources import sequences


def _queries(spark: SparkSession, args, k: int):
    records = sequences.read_sequences(spark, args.query).withColumn("query_id", F.xxhash64("file", "name"))
    return records.select("query_id", "name").distinct(), kmers.queries_of(records, "query_id", "text", k)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="binloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("-i", "--input", required=True, help="text file with a sequence file per line")
    build.add_argument("-o", "--output", required=True)
    build.add_argument("-k", "--kmer", type=int, default=20)
    build.add_argument("--fpr", type=float, default=0.05)
    for name, threshold in (("search", 0.7), ("count", 1)):
        command = commands.add_parser(name)
        command.add_argument("-i", "--index", required=True)
        command.add_argument("-q", "--query", required=True)
        command.add_argument("-o", "--output", required=True)
        command.add_argument("--threshold", type=type(threshold), default=threshold)
    commands.add_parser("inspect").add_argument("-i", "--index", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("binloom").getOrCreate()

    if args.command == "build":
        files = [r[0].strip() for r in spark.read.text(args.input).toLocalIterator() if r[0].strip()]  # a line per user bin
        if not files:
            raise SystemExit("there are no input files")
        values = kmers.bins_of(sequences.read_numbered(spark, files), "bin", "text", args.kmer)
        index = tree.build(values, FilterConfig(maximum_fpr=args.fpr, disable_estimate_union=True))
        index.save(args.output)
        spark.createDataFrame([(json.dumps({"k": args.kmer, "files": files}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/files")
        return
    index = tree.Tree.load(spark, args.index)
    about = json.loads(spark.read.text(f"{args.index}/files").first()[0])
    if args.command == "inspect":
        shapes = inspect.inspect_tree(index).orderBy("ibf_id")
        print("\t".join(shapes.columns))
        for row in shapes.toLocalIterator():  # a filter at a time, all of them
            print("\t".join("" if x is None else str(x) for x in row))
        for name, value in inspect.totals(index).first().asDict().items():
            print(f"{name}\t{value}")
        return
    names, asked = _queries(spark, args, about["k"])
    if args.command == "search":
        found = kmers.search(index, asked, args.threshold)
        rows = names.join(found, "query_id", "left").select("name", F.coalesce("user_bins", F.lit("")))
        sequences.write_tsv(rows, args.output, "QUERY_ID", "USER_BINS")
    else:
        counted = kmers.counts(index, asked, args.threshold).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("user_bin_id", "cnt"))).alias("c"))
        rows = names.join(counted, "query_id").select("name", F.array_join(F.transform("c", lambda x: x["cnt"].cast("string")), ","))
        sequences.write_tsv(rows, args.output, "QUERY_ID", "COUNTS")


if __name__ == "__main__":
    main()
