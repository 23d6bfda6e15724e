"""Every query on empty tables, on tables with nothing but keys, and on repeated rows."""

import pytest
from pyspark.sql import functions as F

from minutario.llm.queries import QUERIES

TABLES = ("meetings", "decisions", "candidates", "adjudications", "chunks", "stage_reviews", "documents", "eval_items")


@pytest.fixture(scope="module", params=["empty", "keys", "copies"])
def edge(request, spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp(request.param)
    for name in TABLES:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        few = df.limit(5)
        if request.param == "empty":
            few = df.where("false")
        elif request.param == "keys":
            few = few.select(df.columns[0], *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns[1:]])
        else:
            few = few.unionByName(few).unionByName(few)
        few.coalesce(1).write.parquet(str(out / f"{name}.parquet"))
    return request.param, str(out)


#: Rows that come out all the same: a table's people, its agreement, a total, and answers that are null.
ALWAYS = {"p6_annotators": 12, "p6_agreement": 2, "p7_fill": 1}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edges(spark, edge, name):
    kind, path = edge
    n = len(QUERIES[name](spark, path).collect())
    if kind == "empty" or kind == "keys" and name != "p5_found":
        assert n == ALWAYS.get(name, 0)
