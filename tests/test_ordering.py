import random

import pytest
from pyspark.sql import functions as F

from delaylake.operators.ordering import running_before


@pytest.mark.parametrize("rows, parts", [(0, 1), (1, 3), (500, 8), (500, 1)])
def test_running_total(spark, rows, parts):
    draw = random.Random(rows)
    values = [draw.randint(-5, 9) for _ in range(rows)]
    keys = draw.sample(range(10 * rows + 1), rows)
    df = spark.createDataFrame(list(zip(keys, values)), "k int, v int").repartition(parts)
    found = running_before(df, [F.desc("k")], F.col("v"), "before").collect()
    total = 0
    expected = []
    for k, v in sorted(zip(keys, values), reverse=True):
        expected.append((k, v, total))
        total += v
    assert sorted(map(tuple, found), reverse=True) == expected
