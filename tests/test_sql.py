"""Functions and table functions of SQL against the column functions they are made of."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import chunker
from larkspur.plans.sql import SCALAR, register, sql_text

TEXTS = [None, "", " ", "plain", "it's \\n a 'quoted' \\ text", "---\ntitle: x\n---\n# A\nb", "# One\n\ntext\n## Two\n### Three\nmore\n```\n# no\n```\nend", "p" * 1500 + "\n\n" + "q " * 900, "Çedilla OOM drain É̀ ﬁn"]


@pytest.fixture(scope="module")
def rows(spark):
    register(spark)
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")


@pytest.mark.parametrize("name", [n for n, (p, _, _) in SCALAR.items() if p == "text STRING"])
def test_functions_of_texts(rows, name):
    _, kind, expression = SCALAR[name]
    both = rows.select("id", F.expr(f"{name}(t)").alias("a"), expression("t").cast(kind).alias("b"))
    assert both.where("not (a <=> b)").count() == 0


def test_functions_of_several_arguments(spark, rows):
    made = spark.sql("SELECT section_replaced('# T\n\n## A\nold\n## B\nb', 'A', \"it's new\") AS r, new_document('x/my-file.md', 'H', ' body ') AS d, label_of(0.05D) AS l, cosine_of(unit_vector(array(3F, 4F)), array(0.6D, 0.8D)) AS c").first()
    assert made["r"] == "# T\n\n## A\n\nit's new\n\n## B\nb"
    assert made["d"] == "# my file\n\n## H\n\nbody\n"
    assert made["l"] == "strong match" and abs(made["c"] - 1) < 1e-6


@pytest.mark.parametrize("name,fenced", [("chunks_of", False), ("fenced_chunks_of", True)])
def test_table_function(spark, rows, name, fenced):
    mine = spark.sql(f"SELECT r.id, c.* FROM {{rows}} r, LATERAL {name}(r.t) c", rows=rows)
    own = chunker.chunk(rows, "t", fenced)
    assert mine.columns == own.columns
    assert sorted(mine.collect()) == sorted(own.collect())
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_literals_stay_as_they_are(spark):
    c = F.concat(F.lit("and(x) or(y) 'in(z)' =("), F.when((F.col("a") > 1) & ~F.col("a").isin(2, 3), F.lit("\\not(1)")).otherwise(F.lit(">(")))
    rows = spark.createDataFrame([(1,), (2,), (4,)], "a int").select(c.alias("x"), F.expr(sql_text(c)).alias("y"))
    assert rows.where("x <> y").count() == 0
