"""python -m graphlex smoke | fit EDGES MODEL | encode EDGES MODEL OUT [MODE...] | decode ENCODED MODEL OUT | view NAME EDGES OUT

EDGES, ENCODED and OUT are Parquet paths; MODEL is a JSON file.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.views import build_view
from .plans.tokenizer import GraphTokenizer, TokenizerModel
from .sources.records import edges_of
from .sources.synthetic import synthetic_graphs


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("graphlex").getOrCreate()
    what, *rest = args
    if what == "smoke":
        edges = edges_of(synthetic_graphs(spark, 24, min_nodes=8, max_nodes=16, families=("cycle", "star", "motif_mix"), seed=7))
        small = {"compact": {"max_macros": 2, "max_macro_len": 5, "max_merges": 4}, "motif": {"most_structural": 0}}
        GraphTokenizer(small).fit(edges).encode(edges).groupBy("mode").avg("token_count", "bits_per_edge", "lossless_expand_match").show()
    elif what == "fit":
        GraphTokenizer().fit(spark.read.parquet(rest[0])).save(rest[1])
    elif what == "encode":
        TokenizerModel.load(spark, rest[1]).encode(spark.read.parquet(rest[0]), *rest[3:]).write.mode("overwrite").parquet(rest[2])
    elif what == "decode":
        TokenizerModel.load(spark, rest[1]).decode(spark.read.parquet(rest[0])).write.mode("overwrite").parquet(rest[2])
    elif what == "view":
        build_view(rest[0], spark.read.parquet(rest[1])).write.mode("overwrite").parquet(rest[2])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
