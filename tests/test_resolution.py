"""The registry of assets against a loop over its nodes, and the resolution cascade's outcomes one by one."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from runlens.operators import resolution as R


def registered_in_a_loop(nodes):
    """Founder, reason and the founders that were met, for each node (environment, position, values by kind)."""
    owner, held, out = {}, defaultdict(dict), {}
    for env, position, values in sorted(nodes, key=lambda n: n[1]):
        own = {k: v for k, v in values.items() if v is not None}
        met = {owner[env, k, v] for k, v in own.items() if (env, k, v) in owner}
        reason = None
        if len(met) > 1:
            reason = "identifiers resolve to different assets"
        elif met and any(held[next(iter(met))].get(k, v) != v for k, v in own.items()):
            reason = "asset identifiers conflict"
        asset = next(iter(met)) if len(met) == 1 else position
        if reason is None:
            for k, v in own.items():
                owner[env, k, v] = asset
                held[asset][k] = v
        out[position] = (asset if own else None, reason, sorted(met) if reason else [])
    return out


@pytest.mark.parametrize(("n", "values"), [(10_000, 6_000), (600, 25)])
def test_registry_equals_a_loop(spark, n, values):
    """10,000 nodes of which a third share one path, and few with dense identifiers, in which most are in conflict."""
    rng = random.Random(n)
    pick = lambda p, prefix: f"{prefix}{rng.randrange(values)}" if rng.random() < p else None
    nodes = []
    for position in range(n):
        path = "hot" if rng.random() < 0.33 else pick(0.6, "p")
        nodes.append((position % 3, position, {"api_endpoint": pick(0.1, "a"), "logical_table": pick(0.7, "t"), "physical_path": path}))
    rng.shuffle(nodes)
    frame = spark.createDataFrame([(e, f"n{p}", p, v["api_endpoint"], v["logical_table"], v["physical_path"]) for e, p, v in nodes], "environment int, node string, position long, api_endpoint string, logical_table string, physical_path string")
    got = {int(r.node[1:]): r for r in R.register_assets(frame).collect()}
    want = registered_in_a_loop(nodes)
    assert set(got) == set(want)
    name = {p: got[p].asset for p in got}
    for p, (asset, reason, met) in want.items():
        assert (got[p].reason, got[p].conflict, got[p].candidates) == (reason, reason is not None, sorted({name[m] for m in met}))
        if reason is None and asset is not None:
            assert name[p] == name[asset]
    alone = [p for p, (asset, reason, _) in want.items() if reason or asset is None]
    assert len({name[p] for p in alone}) == len(alone)
    founders = {asset for asset, reason, _ in want.values() if reason is None and asset is not None}
    assert len({name[f] for f in founders} | {name[p] for p in alone}) == len(founders) + len(alone)


CONTEXT = {"connection_type": "database", "database_type": "mssql", "host": "srv", "catalog": "c1"}


def references(spark, *rows):
    names = ["reference", "kind", "value", "catalog", "database", "schema_name", "table", "api_method", *[f"context_{c}" for c in R.ENDPOINT]]
    made = [{"reference": i, **r} for i, r in enumerate(rows)]
    schema = ", ".join(f"{n} {'long' if n == 'reference' else 'string'}" for n in names)
    return R.reference_identity(spark.createDataFrame([tuple(m.get(n) for n in names) for m in made], schema))


def table(name, context=None, **parts):
    told = dict(zip(("table", "schema_name", "database", "catalog"), reversed(name.split(".")), strict=False))
    return {"kind": "table", "value": name, **told, **parts, **{f"context_{k}": v for k, v in (context or {}).items()}}


def test_every_outcome_of_the_cascade(spark):
    scope = "mssql:srv|catalog:c1"
    identifiers = [("logical_table", "i|c1.d.s.one", "a1"), ("logical_table", "j|c2.d.s.two", "a2"), ("logical_table", "k|c3.d.s.two", "a3"), ("logical_table", "i|c1.x.s.many", "a4"), ("logical_table", "i|c1.y.s.many", "a5"), ("logical_table", "l|c9.d.s.far", "a6"), ("physical_path", "s3://b/x", "a7"), ("api_endpoint", "https://h|GET https://h/v1", "a8")]
    index = spark.createDataFrame(identifiers, "kind string, value string, asset string")
    scopes = spark.createDataFrame([("a1", scope), ("a4", scope), ("a5", scope), ("a2", "other")], "asset string, scope string")
    lake = {"connection_type": "lakehouse", "workspace_id": "w"}
    cases = [
        ({"kind": "path", "value": " S3A://b//x/ "}, ("automatic", None, "a7", "exact_identifier", ["a7"])),
        ({"kind": "path", "value": "s3://b/y"}, ("unresolved", "no_match", None, "no_declared_asset_match", [])),
        ({"kind": "api", "value": "get https://h/v1"}, ("unresolved", "no_match", None, "no_declared_asset_match", [])),
        (table("One", CONTEXT), ("automatic", None, "a1", "connection_scoped_table", ["a1"])),
        (table("s.many", CONTEXT), ("unresolved", "multiple_matches", None, "multiple_connection_table_matches", ["a4", "a5"])),
        (table("s.far", lake), ("automatic", None, "a6", "qualified_cross_connection", ["a6"])),
        (table("far", lake), ("unresolved", "out_of_scope", None, "out_of_scope_table_candidate", ["a6"])),
        (table("s.two", lake), ("unresolved", "multiple_matches", None, "multiple_table_suffix_matches", ["a2", "a3"])),
        (table("two", lake), ("unresolved", "out_of_scope", None, "out_of_scope_table_candidates", ["a2", "a3"])),
        (table("two", CONTEXT), ("unresolved", "out_of_scope", None, "out_of_scope_table_candidates", ["a2", "a3"])),
        (table("far"), ("automatic", None, "a6", "connection_scoped_table", ["a6"])),
        (table("two"), ("unresolved", "multiple_matches", None, "multiple_connection_table_matches", ["a2", "a3"])),
        # a fully qualified name has to be the whole name
        (table("far", lake, catalog="C9", database="d", schema_name="s"), ("automatic", None, "a6", "qualified_cross_connection", ["a6"])),
        (table("d.s.far", lake), ("unresolved", "no_match", None, "no_declared_asset_match", [])),
        ({"kind": "other", "value": "load(x)"}, ("unresolved", "no_match", None, "no_declared_asset_match", [])),
        ({"kind": "table", "value": None}, ("unresolved", "no_match", None, "no_declared_asset_match", [])),
    ]
    got = R.resolve(references(spark, *[c for c, _ in cases]), index, scopes).orderBy("reference").collect()
    for r, (case, want) in zip(got, cases, strict=True):
        assert (r.state, r.reason, r.asset, r.method, r.candidates) == want, case
        assert r.candidate_count == len(want[4])


def test_many_candidates_are_counted_and_listed_in_part(spark):
    index = spark.range(1000).select(F.lit("logical_table").alias("kind"), F.concat(F.lit("i|c"), "id", F.lit(".s.t")).alias("value"), F.format_string("a%04d", "id").alias("asset"))
    scopes = spark.createDataFrame([], "asset string, scope string")
    refs = references(spark, *[table("s.t")] * 500)
    out = R.resolve(refs, index, scopes).select("reference", "candidates", "candidate_count").collect()
    assert len(out) == 500 and {(len(r.candidates), r.candidates[0], r.candidates[-1], r.candidate_count) for r in out} == {(20, "a0000", "a0019", 1000)}


def test_mappings_win_conflict_or_miss(spark):
    index = spark.createDataFrame([("logical_table", "i|c.s.t", "a1"), ("physical_path", "s3://b/x", "a2")], "kind string, value string, asset string")
    scopes = spark.createDataFrame([], "asset string, scope string")
    out = R.resolve(references(spark, table("s.t"), table("s.u"), table("s.v"), table("s.w")), index, scopes)
    mappings = spark.createDataFrame([(1, "table_reference", "s.t", "physical_path", "s3://b/x"), (2, "table_reference", "s.u", "physical_path", "gone"), (3, "table_reference", "s.v", "physical_path", "s3://b/x"), (4, "table_reference", "s.v", "logical_table", "i|c.s.t")], "mapping long, reference_type string, reference_value string, target_kind string, target_value string")
    got = [(r.state, r.reason, r.asset, r.method, r.mapping) for r in R.map_references(out, mappings, index).orderBy("reference").collect()]
    assert got == [("manual", None, "a2", "manual_mapping", 1), ("unresolved", "target_missing", None, "manual_target_missing", 2), ("unresolved", "no_match", None, "manual_mapping_ambiguous", None), ("unresolved", "no_match", None, "no_declared_asset_match", None)]


def test_groups_of_occurrences(spark):
    rows = [("a", "automatic", None, "x"), ("a", "manual", None, "x"), ("b", "automatic", None, "x"), ("b", "automatic", None, "y"), ("c", "unresolved", "no_match", None), ("c", "unresolved", "out_of_scope", None), ("d", "automatic", None, "x"), ("d", "unresolved", "multiple_matches", None), ("e", "automatic", None, "x")]
    out = R.group_resolution(spark.createDataFrame(rows, "k string, state string, reason string, asset string"), ["k"])
    assert sorted((r.k, r.occurrences, r.state, r.reason, r.asset) for r in out.collect()) == [("a", 2, "manual", None, "x"), ("b", 2, "unresolved", "conflicting_targets", None), ("c", 2, "unresolved", "out_of_scope", None), ("d", 2, "unresolved", "multiple_matches", "x"), ("e", 1, "automatic", None, "x")]
