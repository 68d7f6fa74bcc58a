"""Localized factors over several applications: a user's global factor ties the applications' local ones together. Exact EM.

x (features) and y (responses) of user i in application k are linear in a local factor z_ik, which is
linear in the user's global factor u_i. Loadings are a table with a row for each (application, item). A user's data enter
only through sums for each (user, application), which the shuffle combines; users are then solved in stacked
numpy, and statistics for (application, item) are grouped sums again. What reaches the driver is one small
matrix for each application.

Rows may have a weight (a Gaussian row's noise is divided by it, a logistic row counts as often) and may be logistic: y is then 0 or 1, its
likelihood is replaced by the quadratic bound at xi, which makes it Gaussian in the factor, and xi is a column of the rows that each
step writes anew from second moments. History then holds a lower bound, which never falls.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bound_weight
from .graph import cut, forget
from .simulate import normal


@dataclass
class App:
    a: np.ndarray  # local x global
    var_z: float = 1.0


@dataclass
class MultiApp:
    apps: dict[str, App]
    loadings: DataFrame | None  # app, item, load (bias, then loading), noise
    n_global: int
    var_u: float = 1.0
    history: list[float] = field(default_factory=list)

    @property
    def most_local(self) -> int:
        return max((len(a.a) for a in self.apps.values()), default=0)


def _by_app(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("app")]


def initial(rows: DataFrame, n_global: int, n_local: dict[str, int] | int, seed: int = 0) -> MultiApp:
    """rows (user, app, item, y): biases are means, loadings small random numbers that depend on (seed, app, item)."""
    names = [r["app"] for r in rows.select("app").distinct().orderBy("app").collect()]
    local = {n: n_local if isinstance(n_local, int) else n_local[n] for n in names}
    if not names:
        return MultiApp({}, rows.selectExpr("app", "item", "array(y) AS load", "y AS noise").limit(0), n_global)
    if "logistic" in rows.columns:
        # A logistic item's bias is the logit of its mean, and it has no noise of its own.
        stats = rows.groupBy("app", "item").agg(F.avg("y").alias("mean"), F.var_pop("y").alias("var"), F.max("logistic").alias("logistic"))
        rate = F.greatest(F.least(F.col("mean"), F.lit(0.99)), F.lit(0.01))
        stats = stats.withColumn("mean", F.when(F.col("logistic"), F.log(rate / (1 - rate))).otherwise(F.col("mean"))).withColumn("var", F.when(F.col("logistic"), 1.0).otherwise(F.col("var")))
    else:
        stats = rows.groupBy("app", "item").agg(F.avg("y").alias("mean"), F.var_pop("y").alias("var"))
    random = [0.1 * normal(seed, f"loading{k}", F.col("app"), F.col("item")) for k in range(max(local.values()))]
    load = F.slice(F.array("mean", *random), F.lit(1), _by_app(local) + 1)
    loadings = cut(stats.select("app", "item", load.alias("load"), F.greatest(F.when(F.col("var") > 0, F.col("var")).otherwise(1.0), F.lit(1e-3)).alias("noise")))
    return MultiApp({n: App(np.eye(k, n_global)) for n, k in local.items()}, loadings, n_global)


# --- users --------------------------------------------------------------------------------------


def posterior(model: MultiApp, data: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple:
    """Posteriors of many users at once. data: app -> (precision n x k x k, linear term n x k, has data n) of the local factor's likelihood.

    u and its variance; for each app z, its variance and its covariance with u (meaningful where there are data); and what the
    marginal log-likelihood has beside the data's own constant.
    """
    g = model.n_global
    n = len(next(iter(data.values()))[2])
    info, total, value = np.tile(np.eye(g) / model.var_u, (n, 1, 1)), np.zeros((n, g)), np.zeros(n)
    parts = {}
    for name, (p, h, has) in data.items():
        a, v = model.apps[name].a, model.apps[name].var_z
        k = len(a)
        # Given u, z has mean A u and variance v; with the data its variance is w and its mean w (A u / v + h).
        w = np.linalg.inv(np.eye(k) / v + p)
        slope = w @ a / v
        info += has[:, None, None] * (a.T @ (np.eye(k) / v - w / v**2) @ a)
        wh = np.einsum("nij,nj->ni", w, h)
        total += has[:, None] * (wh @ a / v)
        value += has * 0.5 * (np.einsum("ni,ni->n", h, wh) - np.linalg.slogdet(np.eye(k) + v * p)[1])
        parts[name] = (w, wh, slope)
    var_u = np.linalg.inv(info)
    u = np.einsum("nij,nj->ni", var_u, total)
    value += 0.5 * (np.einsum("ni,ni->n", total, u) - np.linalg.slogdet(info)[1] - g * np.log(model.var_u))
    local = {}
    for name, (w, wh, slope) in parts.items():
        cov = slope @ var_u
        local[name] = (wh + np.einsum("nij,nj->ni", slope, u), w + cov @ np.transpose(slope, (0, 2, 1)), cov)
    return u, var_u, local, value


def _row_terms(rows: DataFrame) -> tuple[Column, Column, Column]:
    """Response, precision and constant of each row (with its item's noise) as those of a Gaussian likelihood."""
    w = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    y, plain = F.col("y"), w / F.col("noise")
    base = -0.5 * (F.log(2 * np.pi * F.col("noise")) - F.log(w))
    if "logistic" not in rows.columns:
        return y, plain, base
    lam = bound_weight(F.col("xi"))
    o = (y - 0.5) / (2 * lam)
    bound = w * (-F.log1p(F.exp(-F.col("xi"))) - F.col("xi") / 2 + lam * F.col("xi") * F.col("xi") + lam * o * o)
    return F.when(F.col("logistic"), o).otherwise(y), F.when(F.col("logistic"), 2 * lam * w).otherwise(plain), F.when(F.col("logistic"), bound).otherwise(base)


def _messages(rows: DataFrame, model: MultiApp) -> DataFrame:
    """(user, app, p, h, base): the precision (upper triangle), linear term and constant of the likelihood of a user's data in an application."""
    k = model.most_local
    c = lambda i: F.coalesce(F.get("load", F.lit(i + 1)), F.lit(0.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # A table whose rows are counted in sums and whose names don't clash with a user's columns.
    joined = rows.join(model.loadings, ["app", "item"])
    y, precision, base = _row_terms(joined)
    joined = joined.select("user", "app", "load", (y - F.col("load")[0]).alias("d"), precision.alias("prec"), base.alias("base"))
    d, prec = F.col("d"), F.col("prec")
    sums = joined.groupBy("user", "app").agg(
        *(F.sum(c(i) * c(j) * prec).alias(f"p{i}_{j}") for i, j in pairs), *(F.sum(c(i) * d * prec).alias(f"h{i}") for i in range(k)),
        F.sum(F.col("base") - 0.5 * d * d * prec).alias("base"),
    )
    return sums.select("user", "app", F.array(*(f"p{i}_{j}" for i, j in pairs)).alias("p"), F.array(*(f"h{i}" for i in range(k))).alias("h"), "base")


_MOMENTS = "app string, u array<double>, uu array<double>, z array<double>, zz array<double>, zu array<double>, z2 double, loglik double, lead boolean"


def moments(rows: DataFrame, model: MultiApp) -> DataFrame:
    return moments_of(_messages(rows, model), model)


def moments_of(sums: DataFrame, model: MultiApp) -> DataFrame:
    """One row for each (user, app, p, h, base), app being a string: u, z, and second moments uu, zz (of 1 and z, upper triangles), zu and z2.
    Of a user's rows one leads and has the user's marginal log-likelihood."""
    parts = sums.groupBy("user").agg(F.collect_list(F.struct("app", "p", "h", "base")).alias("parts"))
    most, (up0, up1), names = model.most_local, np.triu_indices(model.most_local), list(model.apps)
    apps = MultiApp(model.apps, None, model.n_global, model.var_u)  # without the table, which tasks can't use
    kind = dict(sums.dtypes)["user"]

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            flat = [(i, p) for i, parts in enumerate(pdf["parts"]) for p in parts]
            user = np.array([i for i, _ in flat])
            app = np.array([names.index(p["app"]) for _, p in flat])
            base = np.bincount(user, [p["base"] for _, p in flat], n)
            upper = np.array([p["p"] for _, p in flat]).reshape(len(flat), -1)
            linear = np.array([p["h"] for _, p in flat]).reshape(len(flat), -1)
            data = {}
            for a, name in enumerate(names):
                k, own = len(apps.apps[name].a), np.flatnonzero(app == a)
                full = np.zeros((n, most, most))
                full[user[own][:, None], up0, up1] = upper[own]
                full[user[own][:, None], up1, up0] = upper[own]
                h = np.zeros((n, most))
                h[user[own]] = linear[own]
                has = np.zeros(n)
                has[user[own]] = 1
                data[name] = (full[:, :k, :k], h[:, :k], has)
            u, var_u, local, value = posterior(apps, data)
            g0, g1 = np.triu_indices(apps.n_global)
            uu = (u[:, :, None] * u[:, None, :] + var_u)[:, g0, g1]
            leads = np.r_[True, user[1:] != user[:-1]]
            out: dict[str, list] = {c: [None] * len(flat) for c in ("z", "zz", "zu", "z2")}
            for a, name in enumerate(names):
                own = np.flatnonzero(app == a)
                if not len(own):
                    continue
                z, var_z, cov = (x[user[own]] for x in local[name])
                z1 = np.concatenate([np.ones((len(own), 1)), z], axis=1)
                zz = z1[:, :, None] * z1[:, None, :]
                zz[:, 1:, 1:] += var_z
                o0, o1 = np.triu_indices(z1.shape[1])
                zu = (z[:, :, None] * u[user[own]][:, None, :] + cov).reshape(len(own), -1)
                z2 = (z * z).sum(1) + np.trace(var_z, axis1=1, axis2=2)
                for c, values in (("z", z), ("zz", zz[:, o0, o1]), ("zu", zu), ("z2", z2)):
                    for at, v in zip(own, values):
                        out[c][at] = v
            yield pd.DataFrame(
                {
                    "user": pdf["user"].to_numpy()[user], "app": [names[a] for a in app], "u": list(u[user]), "uu": list(uu[user]), **out,
                    "loglik": np.where(leads, (value + base)[user], 0.0), "lead": leads,
                }
            )

    return parts.mapInPandas(run, f"user {kind}, {_MOMENTS}")


def two_level_vectors(obs: DataFrame, entity: str, context: str, regressor: str, loading: dict[str, float], var_local: dict[str, float], var_global: float, k: int) -> DataFrame:
    """(user, u, app, z, ...) as `moments_of` gives them: posteriors of an entity's global vector u and of its vector z = loading u + noise in each context, from
    a two-way interaction: residuals r = <z, x> with noise s2, x being the other end's vector."""
    from .factor import gram_sums

    sums = gram_sums(obs.select(F.col(entity).alias("user"), F.col(context).cast("string").alias("app"), F.col(regressor).alias("x"), "r", "s2"), ["user", "app"], "x", k)
    apps = {str(c): App(q * np.eye(k), var_local[c]) for c, q in loading.items()}
    return moments_of(sums.select("user", "app", F.col("xx").alias("p"), F.col("xo").alias("h"), F.lit(0.0).alias("base")), MultiApp(apps, None, k, var_global))


# --- EM -----------------------------------------------------------------------------------------


def item_statistics(rows: DataFrame, moments: DataFrame, most_local: int) -> DataFrame:
    """(app, item, n, yy, zz, yz): sums over a model's rows of y^2, of second moments of 1 and z (upper triangle), and of y times 1 and z; each times the row's weight, and for a logistic row
    with the response and the weight of its bound."""
    size = (most_local + 1) * (most_local + 2) // 2
    one_z = lambda i: F.lit(1.0) if i == 0 else F.get("z", F.lit(i - 1))
    y, w, _ = _row_terms(rows)
    rows = rows.withColumn("noise", F.lit(1.0)).select("user", "app", "item", y.alias("y"), w.alias("__w"))
    weighted = lambda c: F.sum(F.col("__w") * c)
    sums = rows.join(moments.select("user", "app", "z", "zz"), ["user", "app"]).groupBy("app", "item").agg(
        F.count("*").alias("n"), weighted(F.col("y") * F.col("y")).alias("yy"),
        *(weighted(F.get("zz", F.lit(i))).alias(f"zz{i}") for i in range(size)), *(weighted(F.col("y") * one_z(i)).alias(f"yz{i}") for i in range(most_local + 1)),
    )
    # Slots beyond an application's own factors have no values.
    kept = lambda prefix, m: F.filter(F.array(*(f"{prefix}{i}" for i in range(m))), lambda x: x.isNotNull()).alias(prefix)
    return sums.select("app", "item", "n", "yy", kept("zz", size), kept("yz", most_local + 1))


def _solved(stats: DataFrame, ridge: float) -> DataFrame:
    """app, item, load, noise: regressions of y on 1 and z, stacked for each number of factors."""
    kind = dict(stats.dtypes)["item"]

    def run(batches):
        for pdf in batches:
            for size, own in pdf.groupby(pdf["yz"].map(len)):
                xx = np.zeros((len(own), size, size))
                up0, up1 = np.triu_indices(size)
                xx[:, up0, up1] = xx[:, up1, up0] = np.stack(own["zz"].to_numpy())
                xy = np.stack(own["yz"].to_numpy())
                b = np.linalg.solve(xx + ridge * np.eye(size), xy[:, :, None])[:, :, 0]
                rest = np.einsum("ni,nij,nj->n", b, xx, b) - 2 * np.einsum("ni,ni->n", b, xy) + own["yy"].to_numpy()
                yield pd.DataFrame({"app": own["app"].to_numpy(), "item": own["item"].to_numpy(), "load": list(b), "noise": np.maximum(rest / own["n"].to_numpy(), 1e-6)})

    return stats.mapInPandas(run, f"app string, item {kind}, load array<double>, noise double")


def em_step(rows: DataFrame, model: MultiApp, ridge: float = 0.0, fix_var_u: bool = True) -> MultiApp:
    """One exact EM step; history gets the marginal log-likelihood before it."""
    g, k = model.n_global, model.most_local
    found = cut(moments(rows, model))
    slots = lambda column, m: [F.sum(F.get(column, F.lit(i))).alias(f"{column}{i}") for i in range(m)]
    u2 = sum((F.get("uu", F.lit(i * g - i * (i - 1) // 2)) for i in range(g)), F.lit(0.0))
    lead = lambda c: F.sum(F.when(F.col("lead"), c).otherwise(0.0))
    sums = found.groupBy("app").agg(
        F.count("*").alias("n"), F.sum("z2").alias("z2"), F.sum("loglik").alias("loglik"), lead(u2).alias("u2"), lead(F.lit(1.0)).alias("users"),
        *slots("uu", g * (g + 1) // 2), *slots("zu", k * g),
    ).collect()
    apps = dict(model.apps)
    for r in sums:
        k = len(apps[r["app"]].a)
        uu = np.zeros((g, g))
        up0, up1 = np.triu_indices(g)
        uu[up0, up1] = uu[up1, up0] = [r[f"uu{i}"] for i in range(len(up0))]
        zu = np.array([r[f"zu{i}"] for i in range(k * g)]).reshape(k, g)
        a = np.linalg.solve(uu + ridge * np.eye(g), zu.T).T
        apps[r["app"]] = App(a, max((r["z2"] - 2 * np.sum(a * zu) + np.sum((a @ uu) * a)) / (r["n"] * k), 1e-6))
    new = _solved(item_statistics(rows, found, model.most_local), ridge)
    known = model.loadings.join(new.select("app", "item", F.col("load").alias("l"), F.col("noise").alias("s")), ["app", "item"], "left")
    noise = F.coalesce("s", "noise")
    if "logistic" in rows.columns:
        known = known.join(rows.groupBy("app", "item").agg(F.max("logistic").alias("logistic")), ["app", "item"], "left")
        noise = F.when(F.coalesce("logistic", F.lit(False)), 1.0).otherwise(noise)
    loadings = cut(known.select("app", "item", F.coalesce("l", "load").alias("load"), noise.alias("noise")))
    forget(found)
    var_u = model.var_u if fix_var_u else sum(r["u2"] for r in sums) / (sum(r["users"] for r in sums) * g)
    return MultiApp(apps, loadings, g, var_u, [*model.history, sum(r["loglik"] for r in sums)])


def tightened(rows: DataFrame, found: DataFrame, model: MultiApp) -> DataFrame:
    """rows with the xi at which the bound is tightest: the root of the mean square of the linear predictor under the posterior."""
    load = lambda i: F.get("load", F.lit(i))

    def square(size: int) -> Column:
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        return sum(((1.0 if i == j else 2.0) * load(i) * load(j) * F.get("zz", F.lit(at)) for at, (i, j) in enumerate(pairs)), F.lit(0.0))

    value = F.lit(None).cast("double")
    for size in {len(a.a) + 1 for a in model.apps.values()}:
        value = F.when(F.size("load") == size, square(size)).otherwise(value)
    joined = rows.drop("xi").join(model.loadings.select("app", "item", "load"), ["app", "item"]).join(found.select("user", "app", "zz"), ["user", "app"])
    return joined.withColumn("xi", F.sqrt(F.greatest(value, F.lit(1e-12)))).select(*rows.columns)


def prepared(rows: DataFrame, weight: str | None = None, logistic: str | None = None) -> DataFrame:
    """(user, app, item, y) with weight, logistic and xi as far as columns for them are named; rows of weight 0 inform nothing and go."""
    columns = ["user", "app", "item", F.col("y").cast("double").alias("y")]
    if weight:
        rows = rows.where(F.col(weight) > 0)
        columns.append(F.col(weight).cast("double").alias("weight"))
    if logistic:
        columns += [F.col(logistic).cast("boolean").alias("logistic"), F.lit(1.0).alias("xi")]
    return rows.select(*columns)


def fit(rows: DataFrame, n_global: int, n_local: dict[str, int] | int, iterations: int = 5, ridge: float = 0.0, seed: int = 0, weight: str | None = None, logistic: str | None = None) -> MultiApp:
    """EM. weight names a column of row weights, logistic a boolean one that marks items whose y is 0 or 1."""
    rows = cut(prepared(rows, weight, logistic))
    model = initial(rows, n_global, n_local, seed)
    for _ in range(iterations):
        last, model = model, em_step(rows, model, ridge)
        if logistic:
            # The posterior that the step's statistics came from, under the new loadings: each of the three raises the bound.
            found = cut(moments(rows, last))
            old, rows = rows, cut(tightened(rows, found, model))
            forget(old, found)
        forget(last.loadings)
    forget(rows)
    return model


def factors(rows: DataFrame, model: MultiApp) -> DataFrame:
    """(user, u, app, z): posterior means, one row for each application that a user has data in."""
    return moments(rows, model).select("user", "u", "app", "z")


def predict(rows: DataFrame, found: DataFrame, model: MultiApp) -> DataFrame:
    """rows (user, app, item) with pred; users without factors get the bias."""
    out = rows.join(model.loadings.select("app", "item", F.col("load").alias("__l")), ["app", "item"], "left").join(found.select("user", "app", F.col("z").alias("__z")), ["user", "app"], "left")
    slope = F.aggregate(F.zip_with(F.expr("slice(__l, 2, size(__l))"), "__z", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("pred", F.col("__l")[0] + F.coalesce(slope, F.lit(0.0))).drop("__l", "__z")


def save(spark: SparkSession, model: MultiApp, path: str, mode: str = "overwrite") -> None:
    """Loadings as a table, the rest as one JSON text of the size of its applications' matrices."""
    model.loadings.write.mode(mode).parquet(f"{path}/loadings")
    apps = {n: {"a": a.a.tolist(), "var_z": a.var_z} for n, a in model.apps.items()}
    text = json.dumps({"apps": apps, "n_global": model.n_global, "var_u": model.var_u, "history": model.history})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/model")


def load(spark: SparkSession, path: str) -> MultiApp:
    found = json.loads(spark.read.text(f"{path}/model").first()[0])
    apps = {n: App(np.array(a["a"]), a["var_z"]) for n, a in found["apps"].items()}
    return MultiApp(apps, spark.read.parquet(f"{path}/loadings"), found["n_global"], found["var_u"], found["history"])


def check(rows: DataFrame, model: MultiApp) -> DataFrame:
    """(app, item) pairs of rows that the model doesn't know."""
    return rows.select("app", "item").distinct().join(model.loadings, ["app", "item"], "left_anti")


def complete_loglik(rows: DataFrame, found: DataFrame, model: MultiApp) -> float:
    """Log-density of responses, local factors and global factors together, at the factors' posterior means (as `factors` gives them)."""
    tables = F.create_map(*(x for name, app in model.apps.items() for x in (F.lit(name), F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in app.a)))))
    spread = F.create_map(*(x for name, app in model.apps.items() for x in (F.lit(name), F.lit(float(app.var_z)))))
    mean = F.transform(tables[F.col("app")], lambda row: F.aggregate(F.zip_with(row, "u", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    v = spread[F.col("app")]
    local = found.agg(F.sum(-0.5 * (square(F.zip_with("z", mean, lambda a, b: a - b)) / v + F.size("z") * F.log(2 * np.pi * v)))).first()[0]
    users = found.groupBy("user").agg(F.any_value("u").alias("u"))
    whole = users.agg(F.sum(-0.5 * (square(F.col("u")) / model.var_u + F.size("u") * float(np.log(2 * np.pi * model.var_u))))).first()[0]
    return float(observed_loglik(rows, found, model) + (local or 0.0) + (whole or 0.0))


def observed_loglik(rows: DataFrame, found: DataFrame, model: MultiApp) -> float:
    """Log-likelihood of responses given the factors' posterior means."""
    e = predict(rows, found, model).join(model.loadings.select("app", "item", F.col("noise").alias("s2")), ["app", "item"])
    return e.agg(F.sum(-0.5 * ((F.col("y") - F.col("pred")) ** 2 / F.col("s2") + F.log(2 * np.pi * F.col("s2"))))).first()[0]
