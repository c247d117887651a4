import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from weftgraph.session import session

    s = session("tests", cores=8, memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def example(spark):
    from weftgraph.operators.build import example_graph

    return example_graph(spark)


@pytest.fixture(scope="session")
def adjacency(spark):
    """Graphs from adjacency maps: vertex -> out-neighbours, edge ids in order."""
    from weftgraph import Graph

    def build(links):
        rows, k = [], 0
        for a, near in links.items():
            for b in near:
                rows.append((k, a, b))
                k += 1
        v = spark.createDataFrame([(x,) for x in links], "id bigint")
        return Graph(v, spark.createDataFrame(rows, "eid bigint, src bigint, dst bigint"))

    return build
