import random

from lodestone.llm.components import components


def test_few_edges_in_one_task_as_in_rounds(spark):
    rng = random.Random(1)
    for n, m in ((30, 12), (60, 60), (200, 150)):
        rows = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 1), (5, 5)]
        edges = spark.createDataFrame(rows, "u long, v long")
        assert sorted(map(tuple, components(edges, 10**6).collect())) == sorted(map(tuple, components(edges).collect()))
    assert components(spark.createDataFrame([], "u long, v long"), 10).collect() == []
