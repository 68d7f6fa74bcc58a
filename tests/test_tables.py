"""The table layer, graphs, sources and checks on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.functions import columns as C
from dyadic.functions import matrices
from dyadic.operators import cube as U
from dyadic.operators import encode as E
from dyadic.operators import graph as G
from dyadic.operators import metrics as M
from dyadic.operators import simulate as sim
from dyadic.operators import table as T
from dyadic.operators import validate as V
from dyadic.sources import tables as src


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "p", "q", "e", 1.5), ("b", "y", None, "q", "e", -2.0)], src.OBSERVATIONS)
    src.write_delimited(rows, f"{tmp_path}/obs")
    assert T.same_rows(src.delimited(spark, f"{tmp_path}/obs", src.OBSERVATIONS), rows)
    src.append(rows, f"{tmp_path}/log")
    src.append(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
    (tmp_path / "dense.txt").write_text("1\t2\n3\t4\n")
    assert [(r.id, r.x) for r in src.dense_features(spark, f"{tmp_path}/dense.txt", None, 2).collect()] == [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert src.is_sparse(["id", "index", "value"]) and not src.is_sparse(["id", "a", "b"])
    src.write_matrix(rows, f"{tmp_path}/m", ["y"])
    assert spark.range(1).select(src.numbers(F.lit("1, 2.5,3"))).first()[0] == [1.0, 2.5, 3.0]
    src.write_split(T.bernoulli_split(rows, "src_id", 0.5), f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/split/train").count() + spark.read.parquet(f"{tmp_path}/split/test").count() == 2


def test_bucketed_tables_join_without_a_shuffle(spark):
    a = src.bucketed(spark.range(100).withColumnRenamed("id", "k"), "bucketed_a", ["k"], 4)
    b = src.bucketed(spark.range(50).withColumnRenamed("id", "k"), "bucketed_b", ["k"], 4)
    plan = a.hint("merge").join(b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_encoding(spark):
    obs = spark.createDataFrame([("b", "a", 1.0), ("a", "c", 2.0), ("c", "c", 3.0)], "src_id string, dst_id string, y double")
    rows, dicts = E.index_observations(obs, same_ids=True, drop_self_links=True)
    assert {(r.src_idx, r.dst_idx) for r in rows.collect()} == {(2, 1), (1, 3)}
    more = spark.createDataFrame([("z", 5), ("b", 2), ("d", 3)], "src_id string, at int")
    assert {(r.id, r.idx) for r in E.extended(dicts["src"], more, "src_id", "at").collect()} == {("a", 1), ("b", 2), ("c", 3), ("d", 4), ("z", 5)}
    with pytest.raises(ValueError):
        E.index_observations(obs, same_ids=False, drop_self_links=True)


def test_dense_and_sparse_are_inverse(spark):
    dense = spark.createDataFrame([(1, 0.0, 2.0), (2, 3.0, None)], "row int, a double, b double")
    triples = E.dense_to_triples(dense, "row", ["a", "b"])
    assert {tuple(r) for r in triples.collect()} == {(1, 2, 2.0), (2, 1, 3.0)}
    assert {tuple(r) for r in E.triples_to_dense(triples, 2).collect()} == {(1, 0.0, 2.0), (2, 3.0, 0.0)}


def test_errors_are_raised(spark):
    df = spark.createDataFrame([("a|b|c", -1.0)], "s string, v double")
    for bad in (E.split_column(df, "s", ["x", "y"], "|"), T.normalize_by(df, ["s"], "v", "o"), T.label_score(df, "v", "s")):
        with pytest.raises(Exception):
            bad.collect()


def test_groups_without_data(spark):
    df = spark.createDataFrame([("g", 0.0), ("g", 0.0), ("h", 1.0)], "g string, v double")
    assert {(r.g, r.o) for r in T.normalize_by(df, ["g"], "v", "o").collect()} == {("g", 0.0), ("h", 1.0)}
    rows = spark.createDataFrame([("a", 1, 0.5, 1), ("a", 0, 0.4, 2), ("b", 1, 0.2, 3)], "g string, y int, p double, k int")
    assert {(r.g, r.precision) for r in M.precision_at_k(rows, "g", "y", "p", "k", 2).collect()} == {("a", 0.5), ("b", None)}
    assert [(r.g, r.auc) for r in M.auc_by_group(rows, "g", "y", "p").collect()] == [("a", 1.0)]


def test_overwrite_takes_nulls_of_matched_rows(spark):
    x = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, j int, v string")
    y = spark.createDataFrame([(1, 2, None)], "k int, j int, v string")
    assert {tuple(r) for r in E.overwrite(x, y, ["k", "j"]).collect()} == {(1, 1, "a"), (1, 2, None)}


def test_splits_are_stable_and_sized(spark):
    df = spark.range(200).select((F.col("id") % 10).alias("item"), (F.col("id") % 3).alias("cat"), F.col("id"))
    a = {tuple(r) for r in T.split_within_items(df, "item", "id", 0.3).collect()}
    assert a == {tuple(r) for r in T.split_within_items(df.repartition(7), "item", "id", 0.3).collect()}
    assert sum(r[-1] for r in a) == 60
    by_cat = T.split_within_items(df, "item", "id", 0.4, category="cat").groupBy("item").agg(F.count_distinct(F.when(F.col("train"), F.col("cat"))).alias("k")).collect()
    assert all(r.k == 2 for r in by_cat)
    cold = T.cold_start_split(df, "item", "cat", "id", 2, 0, 90).where("test").count()
    assert cold == 90


def test_power_iteration_keeps_mass_and_finds_the_vector(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0), (3, 1, 1.0)], "from int, to int, value double")
    nodes = spark.createDataFrame([(k, 0.25, 0.25, 0.85) for k in (1, 2, 3, 4)], "node int, init double, prior double, w double")
    ranks, info = G.eigenvector(edges, nodes, 1e-9)
    got = np.array([r.ev for r in ranks.orderBy("node").collect()])
    m = np.zeros((4, 4))
    for f, t, v in [(1, 2, 0.5), (1, 3, 0.5), (2, 3, 1.0), (3, 1, 1.0)]:
        m[t - 1, f - 1] = 0.85 * v
    m += np.outer(np.full(4, 0.25), 1 - np.array([0.85, 0.85, 0.85, 0.0]))
    v = np.full(4, 0.25)
    for _ in range(500):
        v = m @ v
    assert abs(got.sum() - 1) < 1e-9 and np.allclose(got, v, atol=1e-6) and info["steps"] < 100


def test_edge_weights_with_reverse_votes(spark):
    votes = spark.createDataFrame([(1, 2, 3.0, 1.0, 2.0, 2.0), (1, 3, 0.0, 5.0, 0.0, 0.0)], "voter int, author int, n_pos double, n_neg double, n_pos_rev double, n_neg_rev double")
    for fn in ("raw", "log", "sigmoid"):
        rows = G.edge_weights(votes, [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0], fn).collect()
        assert sum(r["value"] for r in rows) == pytest.approx(1)


def test_dags_with_two_parents(spark):
    dag = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "a"), ("c", "b")], "node_id string, parent_id string")
    up = G.closure(dag)
    assert {r.ancestor for r in up.where("node = 'c'").collect()} == {"c", "a", "b", "r"}
    obs = spark.createDataFrame([("c", 1, 2, 5), ("c", 2, 0, 0)], "p_node string, t_node int, n_pos int, n_trials int")
    assert {tuple(r) for r in G.rollup(obs, up).collect()} == {(n, 1, 2, 5) for n in "cabr"}
    assert {(r.node, r.level) for r in G.levels(dag).collect()} == {("r", 0), ("a", 1), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError):
        G.validate_tree(dag)
    with pytest.raises(ValueError):
        G.levels(spark.createDataFrame([("a", "r"), ("b", "a"), ("a", "b")], "node_id string, parent_id string"))


def test_cube_parents_are_sums_of_children(spark):
    tree = spark.createDataFrame([("x", "all"), ("y", "all")], "node_id string, parent_id string")
    base = spark.createDataFrame([("x", "x", 1), ("x", "y", 2), ("y", "y", 4)], "a string, b string, v int")
    dims = {"a": U.dimension(tree), "b": U.dimension(tree)}
    cells = {(r.a, r.b): r.v for r in U.hierarchical_cube(base, dims, {"v": ("sum", "v")}).collect()}
    assert cells[("all", "all")] == 7 and cells[("x", "all")] == 3 and cells[("all", "y")] == 6
    avg = {(r.a, r.b): r.m for r in U.hierarchical_cube(base, dims, {"m": ("avg", "v")}).collect()}
    assert avg[("all", "all")] == pytest.approx(7 / 3)
    assert U.level_lattice([1, 1]) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert U.cube_dag([tree, tree]).count() == 2 * 3 + 3 * 2


def test_matrices(spark):
    m = [[4.0, 1.0], [1.0, 3.0]]
    df = spark.createDataFrame([(m, [1.0, 2.0])], "m array<array<double>>, v array<double>")
    out = matrices.eigen(matrices.product(matrices.inverse(df, "m", "inv"), ["m", "inv"], "one"), "m", "e").first()
    assert np.allclose(out["one"], np.eye(2)) and np.allclose(out.e["values"], np.linalg.eigvalsh(m)[::-1])
    r = df.select(C.inverse_2x2(F.col("m")).alias("i"), C.quadratic(F.col("m"), F.col("v")).alias("q"), C.normalized(F.col("v")).alias("n"), C.context_slice(F.col("v"), F.lit(2), 1).alias("s")).first()
    assert np.allclose(r.i, np.linalg.inv(m)) and r.q == 20.0 and np.allclose(r.n, [1 / 3, 2 / 3]) and r.s == [2.0]
    rows = spark.createDataFrame([("g", [1.0, float(k)], 2.0 * k + 1) for k in range(5)], "g string, x array<double>, y double")
    assert np.allclose(matrices.ridge_by_group(rows, "g", "x", "y", 1e-9).first().beta, [1, 2], atol=1e-4)


def test_checks(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("a", None, 2.0)], "src_id string, dst_id string, y double")
    assert V.validate(df.limit(1), V.OBSERVATION_SPEC).count() == 1
    for spec in (V.OBSERVATION_SPEC, V.Spec({"z": "any"}), V.Spec({"src_id": "number"}), V.Spec({"src_id": "any"}, unique=("src_id",)), V.Spec({"y": "any"}, values={"y": (1.0,)})):
        with pytest.raises(ValueError):
            V.validate(df, spec)
    assert [r.y for r in V.binary_labels(spark.createDataFrame([(-1,), (1,), (0,)], "y int"), "y").collect()] == [0.0, 1.0, 0.0]


def test_random_helpers(spark):
    df = spark.range(2000).withColumn("p", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    share = sim.categorical(df, "p", "z", "id").groupBy("z").count().collect()
    assert all(abs(r["count"] / 2000 - {1: 0.2, 2: 0.5, 3: 0.3}[r.z]) < 0.05 for r in share)
    rng = np.random.default_rng(0)
    assert abs(sim.dirichlet(np.ones(4), rng).sum() - 1) < 1e-12
    assert abs(sim.gamma_by_moments(3.0, 2.0, 20000, rng).mean() - 3) < 0.1


def test_timestamps(spark):
    r = spark.range(1).select(C.format_timestamp(F.lit(0)).alias("a"), C.parse_timestamp(F.lit("1969-12-31 16:00:00")).alias("b"), C.parse_timestamp(F.lit("nonsense")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("1969-12-31 16:00:00", 0, None)


def test_reports(spark):
    from dyadic.operators.report import as_text, timed

    df = spark.createDataFrame([("a", 1.5), ("bb", None)], "k string, v double")
    assert as_text(df).splitlines() == [" k    v", " a  1.5", "bb     "]
    assert as_text(df, latex=True).splitlines()[1] == "a & 1.5 \\\\"
    assert timed(lambda: 3, 2)[0] == 3


def test_closure_of_a_deep_tree(spark):
    n = 200
    edges = spark.range(1, n + 1).select(F.col("id").alias("node_id"), (F.col("id") - 1).alias("parent_id"))
    up = G.closure(edges)
    assert up.count() == (n + 1) * (n + 2) // 2
    assert up.where(f"node = {n} and ancestor = 0").count() == 1


def test_lines_without_ids_are_numbered_across_splits(spark, tmp_path):
    lines = [f"{k}.5\t{k * 2}" for k in range(5000)]
    (tmp_path / "dense").mkdir()
    (tmp_path / "dense" / "a.txt").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "dense" / "b.txt").write_text("\n".join(lines[3000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        rows = src.dense_features(spark, f"{tmp_path}/dense", None, 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.id: r.x for r in rows} == {k + 1: [k + 0.5, 2.0 * k] for k in range(5000)}


def test_samples_and_partitioned_tables(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 4).alias("g"), "id")
    one, two = ({tuple(r) for r in T.sampled(df.repartition(k), ["g"], 3, "id").collect()} for k in (1, 5))
    assert one == two and len(one) == 12
    src.partitioned(df, f"{tmp_path}/parts", ["g"])
    assert spark.read.parquet(f"{tmp_path}/parts").where("g = 1").count() == 25
    assert {p.name for p in tmp_path.glob("parts/g=*")} == {f"g={k}" for k in range(4)}


def test_cold_start_split_and_shared_dictionary_read_rows_once(spark):
    from dyadic.operators import encode, table

    df = spark.range(3000).select((F.col("id") % 70).alias("u"), (F.col("id") % 110).alias("i"), F.col("id").alias("k"))
    out = table.cold_start_split(df, "u", "i", "k", 2, 3, 1500)
    # Two joins with the cold ids, none with numbered rows.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert out.where("test").count() == 1500 and out.count() == 3000
    ids = encode.dictionary((df, "u"), (df, "i"))
    assert [tuple(r) for r in ids.orderBy("idx").collect()] == [(x, x + 1) for x in range(110)]
