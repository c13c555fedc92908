from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mergetide.llm.common import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return {x: l for x, l in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.comp for r in got} == brute(edges)


def test_shapes(spark):
    check(spark, [(i, i + 1) for i in range(60)])
    check(spark, [(0, i) for i in range(1, 40)] + [(100, i) for i in range(30, 60)] + [(200, 200), (-5, 300), (300, -5)])
    check(spark, [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=40))
def test_any_graph(spark, edges):
    check(spark, edges)
