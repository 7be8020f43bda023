"""Views of the typed graph, late partitions, and the order of the investigation queue."""

import random
from datetime import datetime

import pytest

from runlens.operators import diagnostics
from runlens.operators import typed_graph as G
from runlens.plans import monitoring
from runlens.sources import logs

EDGE = "id string, source string, target string, type string, stage string, asset string, state string, reference_id string"


def flow(i, a, b, stage="s"):
    return (i, a, b, "dataflow", stage, None, None, None)


def reads(i, a, b, state="automatic"):
    return (i, a, b, "dependency", None, a if state != "unresolved" else None, state, f"r{i}")


EDGES = [flow("f1", "a", "b"), flow("f2", "b", "c", "gold"), flow("f3", "c", "a"), flow("f4", "x", "c"), reads("d1", "c", "q"), reads("d2", "ref1", "q", "unresolved"), flow("f5", "q", "z"), flow("f6", "m", "n", "gold")]
ASSETS = [(n, f"conn-{n}", "delta" if n in "az" else None, "table", "declared") for n in "abcxqzmn"]


def shown(spark, edges=EDGES, focuses=None, **options):
    frame = spark.createDataFrame(edges, EDGE)
    assets = spark.createDataFrame(ASSETS, "asset string, connection_name string, format string, endpoint_kind string, declaration_status string")
    seeds = focuses and spark.createDataFrame(focuses, "label string, kind string, focus string")
    out = {}
    for r in G.visible(frame, assets, seeds, **options).collect():
        out.setdefault(r.label, set()).add(r.id)
    return out if focuses else out.get(0, set())


def test_views_by_focus_and_direction(spark):
    got = shown(spark, focuses=[("1", "asset", "b"), ("2", "dataflow", "f5"), ("3", "reference", "rd2"), ("4", "dependency", "d1"), ("5", "asset", "none")], direction="downstream")
    assert got == {"1": {"f2", "f3", "f1", "d1", "f5"}, "2": {"f5"}, "3": {"d2", "f5"}, "4": {"d1", "f5"}}
    got = shown(spark, focuses=[("1", "asset", "b"), ("2", "dataflow", "f5")], direction="upstream")
    assert got == {"1": {"f1", "f3", "f2", "f4"}, "2": {"f5", "d1", "d2", "f2", "f1", "f3", "f4"}}


def test_views_by_filter(spark):
    everything = {e[0] for e in EDGES}
    assert shown(spark) == everything - {"d2"} and shown(spark, show_references=True) == everything
    assert shown(spark, filters={"stages": ["gold"]}, direction="downstream") == {"f2", "f3", "f1", "d1", "f5", "f6"}
    assert shown(spark, filters={"connections": ["conn-z"], "formats": ["delta"]}, direction="upstream") == {"f5", "d1", "f1", "f2", "f3", "f4"}
    assert shown(spark, filters={"resolutions": ["unresolved"]}, direction="both") == {"d2", "f5"}
    # the second trace stays within the first
    assert shown(spark, focuses=[("1", "asset", "q")], filters={"stages": ["gold"]}, direction="downstream") == {}
    assert shown(spark, edges=[]) == set()


def test_views_of_a_chain(spark):
    chain = [flow(f"e{i}", f"n{i:02}", f"n{i + 1:02}") for i in range(25)]
    assert shown(spark, edges=chain, focuses=[("1", "asset", "n05")], direction="downstream") == {"1": {f"e{i}" for i in range(5, 25)}}


def test_entities_with_issues(spark):
    edges = spark.createDataFrame(EDGES, EDGE)
    view = spark.createDataFrame([(0, "f5"), (0, "d1")], "label int, id string")
    got = {(r.entity, r.issues) for r in G.view_entities(view, edges).collect()}
    assert got == {("q", 1), ("z", 0), ("c", 0)}


def test_late_files_of_the_hour_before(spark):
    hour = lambda h: datetime(2026, 7, 22, h)
    files = [("r", f"{h}/{n}", 1, hour(h), "hour", hour(h)) for h, n in ((8, "old"), (10, "late"), (11, "known"), (11, "new"))]
    listed = spark.createDataFrame(files, "root string, uri string, revision int, modified timestamp, granularity string, partition_value timestamp")
    manifest = spark.createDataFrame([("11/known", 1)], "uri string, revision int")
    state = spark.createDataFrame([("r", hour(11), hour(11), hour(11))], "root string, checkpoint timestamp, boundary_modified timestamp, last_scanned timestamp")
    plan, after = logs.plan_partitions(listed, manifest, state, "2026-07-22 11:30:00")
    assert sorted((r.uri, r.via) for r in plan.collect()) == [("10/late", "incremental"), ("11/new", "incremental")]
    assert tuple(after.first()) == ("r", hour(11), hour(11), hour(11))
    plan, after = logs.plan_partitions(listed, manifest, state.limit(0), "2026-07-22 12:30:00")
    assert sorted(r.uri for r in plan.collect()) == ["10/late", "11/new", "8/old"]
    assert tuple(after.first()) == ("r", hour(11), hour(11), hour(12))
    plan, _ = logs.plan_partitions(listed, manifest, state, "2026-07-22 11:30:00", ("2026-07-22", "2026-07-22"))
    assert {r.uri: r.via for r in plan.collect()} == {"10/late": "incremental", "11/new": "incremental", "8/old": "lookback"}
    # without files a root keeps its state
    _, after = logs.plan_partitions(listed.limit(0), manifest, state, "2026-07-22 11:30:00")
    assert tuple(after.first()) == ("r", hour(11), hour(11), hour(11))


def test_orphans_come_before_mismatches(spark):
    df, jf = monitoring.load(spark, "/root/testdata/sf0.001")
    rows = diagnostics.investigation_queue(df, jf, top=10_000).collect()
    severities = [r.severity for r in rows]
    assert severities == sorted(severities) and {"bad", "warning"} == set(severities)
    kinds = [r.category for r in rows]
    assert kinds.index("orphan dataflow job id") < kinds.index("reconciliation mismatch")
    last_timed = max(i for i, r in enumerate(rows) if r.severity == "warning" and r.latest_time is not None)
    assert all(r.latest_time is None for r in rows[last_timed + 1 :])


def brute(edges, assets, focuses, direction, filters, show):
    """The view by loops over relations, label by label."""
    shown = focuses is not None or show or "unresolved" in filters.get("resolutions", [])
    open_ = [e for e in edges if shown or e[3] == "dataflow" or e[5] is not None]
    info = {a[0]: a for a in assets}

    def walked(rels, starts):
        out = set()
        for here, there, nodes in ((2, 1, {u for u, _ in starts}), (1, 2, {d for _, d in starts})):
            if direction == ("downstream" if here == 2 else "upstream"):
                continue
            todo, seen = list(nodes), set(nodes)
            while todo:
                n = todo.pop()
                for e in rels:
                    if n is not None and e[here] == n:
                        out.add(e[0])
                        if e[there] not in seen:
                            seen.add(e[there])
                            todo.append(e[there])
        return out

    def fits(e):
        ends = [info[x] for x in e[1:3] if x in info]
        tests = {"connections": lambda v: any(a[1] in v for a in ends), "formats": lambda v: any(a[2] in v or a[3] in v for a in ends), "stages": lambda v: e[3] == "dataflow" and e[4] in v, "resolutions": lambda v: e[6] in v or any(a[4] in v for a in ends)}
        return all(tests[k](v) for k, v in filters.items())

    found = {}
    for label in sorted({f[0] for f in focuses}) if focuses else [0]:
        scope = open_
        if focuses:
            own = [f for f in focuses if f[0] == label]
            at = [e for e in open_ for _, kind, focus in own if (kind == e[3] and e[0] == focus) or (kind == "reference" and e[7] == focus)]
            ids = walked(open_, [(f, f) for _, kind, f in own if kind == "asset"] + [e[1:3] for e in at]) | {e[0] for e in at}
            scope = [e for e in open_ if e[0] in ids]
        ids = {e[0] for e in scope}
        if filters:
            seeds = [e for e in scope if fits(e)]
            ids = walked(scope, [e[1:3] for e in seeds]) | {e[0] for e in seeds}
        found |= {label: ids} if ids else {}
    return found


def many_alike(seed, nodes=9, n=60):
    """Random relations, of which many have the same ends, with loops, references and ends that are null or no assets."""
    rng = random.Random(seed)
    name = lambda: rng.choice([f"n{rng.randrange(nodes)}"] * 12 + [None, "gone"])
    edges = [flow(f"f{i}", name(), name(), rng.choice(["silver", "gold", None])) for i in range(n)]
    edges += [(f"d{i}", f"r{i % 4}" if open_ else a, name(), "dependency", None, None if open_ else a, "unresolved" if open_ else "manual", f"r{i % 4}") for i in range(n // 3) for open_, a in [(rng.random() < 0.5, f"n{rng.randrange(nodes)}")]]
    assets = [(f"n{i}", f"conn-{i % 4}", "delta" if i % 3 else None, "table", "declared" if i % 2 else "discovered_only") for i in range(nodes)]
    focuses = [(f"{i % 6}", kind, f) for i, (kind, f) in enumerate([(k, f"{k[0] if k != 'dependency' else 'd'}{rng.randrange(n // 3)}") for k in ("dataflow", "dependency") for _ in range(5)] + [("asset", f"n{rng.randrange(nodes)}") for _ in range(3)] + [("reference", f"r{rng.randrange(4)}") for _ in range(2)])]
    focuses = [(a, k, f.replace("d", "f") if k == "dataflow" else f) for a, k, f in focuses]
    return edges, assets, focuses


CASES = [(1, 9, "both", {}, True), (2, 30, "both", {"resolutions": ["unresolved"]}, True), (3, 60, "upstream", {"stages": ["gold"]}, True), (4, 30, "downstream", {"connections": ["conn-1"], "formats": ["delta"]}, False)]


@pytest.mark.parametrize(("seed", "nodes", "direction", "filters", "focused"), CASES)
def test_views_equal_loops(spark, seed, nodes, direction, filters, focused):
    edges, assets, focuses = many_alike(seed, nodes)
    frame = spark.createDataFrame(edges + edges[:5], EDGE)
    described = spark.createDataFrame(assets, "asset string, connection_name string, format string, endpoint_kind string, declaration_status string")
    seeds = spark.createDataFrame(focuses, "label string, kind string, focus string") if focused else None
    rows = G.visible(frame, described, seeds, direction, filters).collect()
    got = {}
    for r in rows:
        got.setdefault(r.label, set()).add(r.id)
    assert got == brute(edges, assets, focuses if focused else None, direction, filters, False) and len(rows) == len({(r.label, r.id) for r in rows})


def test_relations_alike_are_walked_as_one(spark, monkeypatch):
    """200 views of 1,500 relations between 5 nodes: tables between the rounds grow with views and nodes, and with relations, but not with both."""
    written = []
    plain = G.settled

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "settled", counted)
    edges = spark.range(1500).selectExpr("concat('f', id) as id", "concat('n', id % 5) as source", "concat('n', (id + 1) % 5) as target", "'dependency' as type", "cast(null as string) as stage", "cast(null as string) as asset", "'unresolved' as state", "'r' as reference_id")
    assets = spark.createDataFrame([("n0", "c", None, None, None)], "asset string, connection_name string, format string, endpoint_kind string, declaration_status string")
    focuses = spark.range(200).selectExpr("cast(id as string) as label", "'asset' as kind", "'n0' as focus")
    assert G.visible(edges, assets, focuses, "both", {"resolutions": ["unresolved"]}).count() == 200 * 1500
    assert max(written) <= 200 * 5 * 2
