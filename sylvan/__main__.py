"""python -m sylvan [OPTIONS] TABLE LABEL: fit a tree to a Parquet or ARFF table and print it; without arguments, the options."""

import sys

from pyspark.sql import SparkSession

from .operators.tree import fit
from .plans import options
from .plans.render import text
from .sources import arff


def main(args: list[str]) -> str:
    if len(args) < 2:
        return f"{__doc__}\n\n{options.listing()}"
    *flags, path, label = args
    chosen = options.parse(flags)
    session = SparkSession.builder.getOrCreate()
    table = arff.read(session, path) if path.endswith(".arff") else session.read.parquet(path)
    return text(fit(table, label, options=chosen))


if __name__ == "__main__":
    print(main(sys.argv[1:]))
