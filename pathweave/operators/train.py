"""Training as Spark jobs.

Parameters live in a table ``(name, row, vec, m, v)`` partitioned by
``epoch`` in the shared folder (vec = weights, m / v = Adam moments).

Training is synchronous Adam per mini-batch, as on a single device: the result
depends on the batch size and the seed, not on cores, shards or blocks (sums of floats
in another order apart). No task reads the parameter table: a shard of the batch gets the
embedding rows that it touches, target rows come in blocks, gradients are summed
by row and applied in the JVM. One step is a handful of jobs, so batches should be as
large as the learning rate bears (8,192 by default; the reference's 1,024 is a parameter).

Steps follow one another, so where all parameters are a few numbers (``HERE``, counted) jobs cost
far more than the steps: one task then takes an epoch's bags in order, in slices of bounded size,
with the parameters in its memory; the dropout masks are drawn by all tasks before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.backprop import adam_step, bags_backward, bags_forward, dropout_mask, softmax_block, softmax_block_grad
from ..sources.lines import scratch_path
from .ranking import global_index, reliable_checkpoint
from .scoring import BLOCK_BYTES, FAN_IN, block_pairs, blocks, matrix

PARAM_COLS = ["name", "row", "vec", "m", "v"]
HERE = 1 << 16  # numbers of a model that one task trains
SLICE = 1 << 21  # numbers of a matrix that such a task has at once


def _uniform(seed: int, name: str, *parts):
    """Repeatable uniform [0, 1) from a 64-bit hash (no driver-side generator)."""
    h = F.xxhash64(F.lit(seed), F.lit(name), *parts)
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def init_params(spark: SparkSession, token_vocab: DataFrame, path_vocab: DataFrame, target_vocab: DataFrame,
                token_dim: int, path_dim: int, seed: int = 42) -> DataFrame:
    """Embeddings by variance scaling (scale 1, fan-out, uniform: limit = sqrt(3 / columns));
    transform and attention by Glorot uniform; zero Adam moments."""
    code = 2 * token_dim + path_dim

    def table(df: DataFrame, name: str, dim: int, limit: float, row_col="idx") -> DataFrame:
        vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                          lambda d: (_uniform(seed, name, F.col(row_col), d) * 2 - 1) * limit)
        zeros = F.array_repeat(F.lit(0.0), dim)
        return df.select(F.lit(name).alias("name"), F.col(row_col).cast("int").alias("row"), vec.alias("vec"),
                         zeros.alias("m"), zeros.alias("v"))

    parts = [
        table(token_vocab, "token", token_dim, float(np.sqrt(3.0 / token_dim))),
        table(path_vocab, "path", path_dim, float(np.sqrt(3.0 / path_dim))),
        table(target_vocab, "target", code, float(np.sqrt(3.0 / code))),
        table(spark.range(code).withColumnRenamed("id", "idx"), "transform", code, float(np.sqrt(6.0 / (2 * code)))),
        table(spark.range(1).withColumnRenamed("id", "idx"), "attention", code, float(np.sqrt(6.0 / (code + 1)))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def param_count(params: DataFrame) -> DataFrame:
    """Parameters per matrix and in total."""
    per = params.groupBy("name").agg(F.sum(F.size("vec")).cast("long").alias("n_params"))
    total = per.agg(F.lit("total").alias("name"), F.sum("n_params").cast("long").alias("n_params"))
    return per.unionByName(total)


def train_bags(encoded: DataFrame) -> DataFrame:
    """B7 + B18 train form: bags of valid contexts with a known target (bags are bounded by max_contexts)."""
    v = encoded.filter("valid")
    g = v.groupBy("ex", "target_idx").agg(F.collect_list("src_idx").alias("s"), F.collect_list("path_idx").alias("p"),
                                          F.collect_list("dst_idx").alias("d"))
    return g.filter(F.col("target_idx") > 0)


def steps_of_epoch(bags: DataFrame, epoch: int, batch: int, seed: int) -> tuple[str, int, int]:
    """Bags in the epoch's seeded order, cut into mini-batches of exactly ``batch`` examples:
    (folder partitioned by step, steps, examples). The order depends on the seed alone."""
    order = [F.xxhash64(F.lit(seed), F.lit(epoch), F.col("ex")), F.col("ex")]
    cut = global_index(bags.withColumn("_o", order[0]), ["_o", "ex"], "_i").withColumn("step", F.floor(F.col("_i") / batch).cast("int")).drop("_o")
    path, n = scratch_path(bags.sparkSession, "batches"), cut.count()
    if n:
        cut.write.partitionBy("step").parquet(path)
    return path, -(-n // batch), n


def _used(bags: DataFrame) -> DataFrame:
    """Scatter list: the distinct (shard, name, row) that the bags of each shard touch."""
    token = bags.select("shard", F.lit("token").alias("name"), F.explode(F.concat("s", "d")).alias("row"))
    path = bags.select("shard", F.lit("path").alias("name"), F.explode("p").alias("row"))
    return token.unionByName(path).distinct()


def _small(params: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Transform and attention: config-sized matrices (code_dim squared), read by the driver."""
    rows = params.filter(F.col("name").isin("transform", "attention")).select("name", "row", "vec").collect()
    W = np.array([r["vec"] for r in sorted((r for r in rows if r["name"] == "transform"), key=lambda r: r["row"])])
    return W, np.array(next(r["vec"] for r in rows if r["name"] == "attention"))


class _Shard:
    """A shard's bags on its own rows of the embedding tables (row numbers are local)."""

    def __init__(self, bags, rows, keep, seed, width):
        name = np.array(rows.column("name").to_pylist())
        number = rows.column("row").to_numpy()
        vecs = rows.column("vec").combine_chunks()
        self.rows, self.table = {}, {}
        for part in ("token", "path"):
            at = np.flatnonzero(name == part)
            at = at[np.argsort(number[at], kind="stable")]
            self.rows[part], self.table[part] = number[at], matrix(vecs.take(pa_array(at)))
        order = np.argsort(bags.column("ex").to_numpy(), kind="stable")  # sums in one order, however rows arrive
        bags = bags.take(pa_array(order))
        self.ex = bags.column("ex").to_numpy()
        self.y = bags.column("target_idx").to_numpy()
        lists = {c: bags.column(c).combine_chunks() for c in ("s", "p", "d")}
        self.lens = np.diff(lists["s"].offsets.to_numpy())
        flat = {c: lists[c].flatten().to_numpy() for c in lists}
        self.s, self.d = (np.searchsorted(self.rows["token"], flat[c]) for c in ("s", "d"))
        self.p = np.searchsorted(self.rows["path"], flat["p"])
        self.bags = bags
        self.mask = None
        if keep < 1.0:
            self.mask = np.vstack([dropout_mask(e, n, width, keep, seed) for e, n in zip(self.ex, self.lens)])

    def forward(self, W, a):
        return bags_forward(self.s, self.p, self.d, self.lens, self.table["token"], self.table["path"], W, a, self.mask)


def pa_array(at):
    import pyarrow as pa

    return pa.array(at)


def run_step(params: DataFrame, bags: DataFrame, n: int, shards: int, t: int, target_rows: int, lr: float, keep: float,
             seed: tuple[int, ...], block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One Adam step on a mini-batch of n examples -> (new parameters, one row of loss sum).

    1. gather: a shard's distinct rows of the embedding tables are joined to it; nothing else
       of the tables reaches its task;
    2. forward: code vectors per shard;
    3. softmax by target blocks: every block yields a mergeable state per example (maximum,
       scaled sum, scaled sum of rows, own score and row), so log-sum-exp and the code vector's gradient
       need no pass over all targets in one task;
    4. scatter: gradients of the shard's own rows, summed by (name, row); a block's target
       gradients from its rows and the batch's code vectors;
    5. Adam in the JVM, row by row.
    """
    import pyarrow as pa

    W, a = _small(params)
    width = W.shape[0]
    bags = bags.select("ex", "target_idx", *[F.col(c).cast("array<int>").alias(c) for c in ("s", "p", "d")],
                       F.pmod(F.xxhash64("ex"), F.lit(shards)).cast("int").alias("shard"))
    tables = params.filter(F.col("name").isin("token", "path")).select("name", "row", "vec")
    rows = reliable_checkpoint(_used(bags).join(tables, ["name", "row"]))

    def forward(left, right):
        kind = pa.schema([("ex", pa.int64()), ("target_idx", pa.int32()), ("code", pa.list_(pa.float64()))])
        if left.num_rows == 0:
            return kind.empty_table()
        shard = _Shard(left, right, keep, seed, width)
        codes, _ = shard.forward(W, a)
        return pa.table([pa.array(shard.ex), pa.array(shard.y, pa.int32()), pa.array(list(codes), pa.list_(pa.float64()))], schema=kind)

    codes = bags.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(forward, "ex long, target_idx int, code array<double>")
    codes = reliable_checkpoint(codes)
    targets = params.filter(F.col("name") == "target").select(F.col("row").alias("idx"), "vec")
    tb = blocks(target_rows, width, block_bytes)

    def block(left, right):
        idx = right.column("idx").to_numpy()
        order = np.argsort(idx, kind="stable")
        idx, Y = idx[order], matrix(right.column("vec"))[order]
        order = np.argsort(left.column("ex").to_numpy(), kind="stable")
        C, y = matrix(left.column("code"))[order], left.column("target_idx").to_numpy()[order]
        at = np.minimum(np.searchsorted(idx, y), len(idx) - 1)
        return idx, Y, C, np.where(idx[at] == y, at, -1), order

    def state(left, right):
        kind = pa.schema([("ex", pa.int64()), ("tb", pa.int32()), ("m", pa.float64()), ("z", pa.float64()),
                          ("u", pa.list_(pa.float64())), ("own", pa.float64()), ("row", pa.list_(pa.float64()))])
        if left.num_rows == 0 or right.num_rows == 0:
            return kind.empty_table()
        _, Y, C, want, order = block(left, right)
        m, z, u, own = softmax_block(C, want, Y)
        here = want >= 0
        return pa.table([left.column("ex").take(pa.array(order)), left.column("rb_").cast(pa.int32()), pa.array(m), pa.array(z),
                         pa.array(list(u), pa.list_(pa.float64())), pa.array(own, mask=~here),
                         pa.array([Y[w] if w >= 0 else None for w in want], pa.list_(pa.float64()))], schema=kind)

    # as many examples in a block as fit it; the batch is bounded by its size
    states = block_pairs(codes, "ex", blocks(n, width, block_bytes), targets, "idx", tb).applyInArrow(
        state, "ex long, tb int, m double, z double, u array<double>, own double, row array<double>")
    states = _merged(states, tb)
    lse = F.col("m") + F.log("z")
    states = states.select("ex", lse.alias("lse"), (lse - F.col("own")).alias("loss"),
                           F.zip_with("u", "row", lambda x, r: (x / F.col("z") - r) / n).alias("dv"))
    states = reliable_checkpoint(states)

    def backward(left, right):
        kind = pa.schema([("name", pa.string()), ("row", pa.int32()), ("g", pa.list_(pa.float64()))])
        if left.num_rows == 0:
            return kind.empty_table()
        shard = _Shard(left, right, keep, seed, width)
        _, cache = shard.forward(W, a)
        gT, gP, gW, ga = bags_backward(matrix(shard.bags.column("dv")), cache, shard.s, shard.p, shard.d,
                                       shard.table["token"], shard.table["path"], W, a, shard.mask)
        parts = [("token", shard.rows["token"], gT), ("path", shard.rows["path"], gP),
                 ("transform", np.arange(len(gW)), gW), ("attention", np.zeros(1, int), ga[None, :])]
        return pa.concat_tables([pa.table([pa.array([x] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], schema=kind)
                                 for x, r, g in parts])

    def target_grad(left, right):
        kind = pa.schema([("name", pa.string()), ("row", pa.int32()), ("g", pa.list_(pa.float64()))])
        if left.num_rows == 0 or right.num_rows == 0:
            return kind.empty_table()
        idx, Y, C, want, order = block(left, right)
        g = softmax_block_grad(C, want, Y, left.column("lse").to_numpy()[order], n)
        return pa.table([pa.array(["target"] * len(idx), pa.string()), pa.array(idx, pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], schema=kind)

    grad = "name string, row int, g array<double>"
    back = bags.join(states.select("ex", "dv"), "ex").groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(backward, grad)
    coded = codes.join(states.select("ex", "lse"), "ex")
    target = block_pairs(coded, "ex", blocks(n, width, block_bytes), targets, "idx", tb).applyInArrow(target_grad, grad)
    grads = _summed(back.unionByName(target))
    return adam(params, grads, t, lr), states.agg(F.sum("loss").alias("loss"))


def _merged(states: DataFrame, tb: int) -> DataFrame:
    """One state per example from those of its target blocks, FAN_IN at a time."""
    if tb > 1:
        states = states.repartition("ex")

    def merge(a, b):
        m = F.greatest(a["m"], b["m"])
        x, y = F.exp(a["m"] - m), F.exp(b["m"] - m)
        return F.struct(m.alias("m"), (a["z"] * x + b["z"] * y).alias("z"), F.zip_with(a["u"], b["u"], lambda p, q: p * x + q * y).alias("u"),
                        F.coalesce(a["own"], b["own"]).alias("own"), F.coalesce(a["row"], b["row"]).alias("row"))

    while tb > 1:
        tb = -(-tb // FAN_IN)
        g = states.groupBy("ex", F.floor(F.col("tb") / FAN_IN).cast("int").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("tb", "m", "z", "u", "own", "row"))).alias("s"))
        first = F.get("s", 0)
        one = F.aggregate(F.slice("s", 2, FAN_IN), F.struct(*[first[c].alias(c) for c in ("m", "z", "u", "own", "row")]), merge)
        states = g.select("ex", F.col("up").alias("tb"), one.alias("s")).select("ex", "tb", "s.*")
    return states.drop("tb")


def _summed(grads: DataFrame) -> DataFrame:
    """Gradients summed by (name, row), pre-aggregated on the map side."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = grads.groupBy("name", "row").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    return s.select("name", "row", vector_to_array("g").alias("g"))


def adam(params: DataFrame, grads: DataFrame, t: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """Dense Adam step t on the parameter table: rows without a gradient have gradient 0."""
    j = params.join(grads, ["name", "row"], "left")
    g = F.coalesce(F.col("g"), F.array_repeat(F.lit(0.0), F.size("vec")))
    j = j.select("name", "row", "vec", F.zip_with("m", g, lambda m, x: m * b1 + x * (1 - b1)).alias("m"),
                 F.zip_with("v", g, lambda v, x: v * b2 + x * x * (1 - b2)).alias("v"))
    rate = F.zip_with("m", "v", lambda m, v: m / (1 - b1**t) / (F.sqrt(v / (1 - b2**t)) + eps) * lr)
    return j.select("name", "row", F.zip_with("vec", rate, lambda x, d: x - d).alias("vec"), "m", "v")


def _masked(bags: DataFrame, width: int, keep: float, seed: tuple[int, ...]) -> DataFrame:
    """The bags with their dropout masks as bits."""
    import pyarrow as pa

    def draw(batches):
        for b in batches:
            lens = np.diff(b.column("s").offsets.to_numpy())
            bits = [np.packbits(dropout_mask(e, n, width, keep, seed) > 0).tobytes() for e, n in zip(b.column("ex").to_pylist(), lens)]
            yield b.append_column("mask", pa.array(bits, pa.binary()))

    return bags.mapInArrow(draw, bags.withColumn("mask", F.lit(b"")).schema)


def epoch_here(bags: DataFrame, params: list, epoch: int, steps: int, batch: int, lr: float, keep: float, seed: int) -> tuple[list, float]:
    """One epoch of the mini-batches of ``steps_of_epoch`` in one task -> (parameter rows, loss sum).

    A batch's gradients are summed over slices of its bags, so memory does not grow with the
    batch; Adam runs where a batch ends.
    """
    import pyarrow as pa

    tables = {}
    for name in sorted({r["name"] for r in params}):
        rows = sorted((r for r in params if r["name"] == name), key=lambda r: r["row"])
        tables[name] = (np.array([r["row"] for r in rows]), *(np.array([r[c] for r in rows], dtype=float) for c in ("vec", "m", "v")))
    width, most = len(tables["transform"][0]), max(1, SLICE // max(1, len(tables["target"][0])))

    def train(batches):
        number = {k: t[0] for k, t in tables.items()}
        P, M, V = ({k: t[i].copy() for k, t in tables.items()} for i in (1, 2, 3))
        zero = {k: np.zeros_like(x) for k, x in P.items()}
        g, n, t, total = {k: x.copy() for k, x in zero.items()}, 0, epoch * steps, 0.0

        def step():
            nonlocal g, n, t
            t += 1
            adam_step(P, M, V, {k: x / n for k, x in g.items()}, t, lr)
            g, n = {k: x.copy() for k, x in zero.items()}, 0

        def add(b):
            lens = np.diff(b.column("s").offsets.to_numpy())
            flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("s", "p", "d")}
            s, d = (np.searchsorted(number["token"], flat[c]) for c in ("s", "d"))
            p, y = np.searchsorted(number["path"], flat["p"]), b.column("target_idx").to_numpy(zero_copy_only=False)
            mask = None
            if keep < 1.0:
                size = -(-lens * width // 8)
                bits = np.unpackbits(np.frombuffer(b"".join(b.column("mask").to_pylist()), np.uint8))
                at = np.repeat(np.cumsum(size) * 8 - size * 8 - (np.cumsum(lens) - lens) * width, lens * width) + np.arange(lens.sum() * width)
                mask = bits[at].reshape(-1, width) / keep
            W, a, Y = P["transform"], P["attention"][0], P["target"]
            C, cache = bags_forward(s, p, d, lens, P["token"], P["path"], W, a, mask)
            at = np.minimum(np.searchsorted(number["target"], y), len(Y) - 1)
            want, loss, dv = np.where(number["target"][at] == y, at, -1), 0.0, np.empty_like(C)
            for i in range(0, len(C), most):
                part, own = C[i : i + most], want[i : i + most]
                m, z, u, score = softmax_block(part, own, Y)
                lse = m + np.log(z)
                loss += float((lse - score).sum())
                dv[i : i + most] = u / z[:, None] - Y[own]
                g["target"] += softmax_block_grad(part, own, Y, lse, 1)
            for k, x in zip(("token", "path", "transform", "attention"), bags_backward(dv, cache, s, p, d, P["token"], P["path"], W, a, mask)):
                g[k] += x
            return loss

        for b in batches:
            ends = np.cumsum(np.diff(b.column("s").offsets.to_numpy()))
            i = 0
            while i < b.num_rows:
                begun = ends[i - 1] if i else 0
                j = min(max(i + 1, int(np.searchsorted(ends, begun + SLICE // width, "right"))), i + batch - n, b.num_rows)
                total += add(b.slice(i, j - i))
                n, i = n + j - i, j
                if n == batch:
                    step()
        if n:
            step()
        vecs = lambda x: pa.array(list(x), pa.list_(pa.float64()))
        for k in P:
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(P[k])), pa.array(number[k], pa.int32()), vecs(P[k]), vecs(M[k]), vecs(V[k])], names=PARAM_COLS)
        none = pa.array([[]], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(["loss"]), pa.array([0], pa.int32()), vecs([[total]]), none, none], names=PARAM_COLS)

    b = bags.select("ex", "target_idx", *[F.col(c).cast("array<int>").alias(c) for c in ("s", "p", "d")])
    b = _masked(b, width, keep, (seed, epoch)) if keep < 1.0 else b
    order = b.withColumn("_o", F.xxhash64(F.lit(seed), F.lit(epoch), F.col("ex"))).repartition(1).sortWithinPartitions("_o", "ex")
    out = order.drop("_o").mapInArrow(train, "name string, row int, vec array<double>, m array<double>, v array<double>").collect()
    return [r for r in out if r["name"] != "loss"], next(r["vec"][0] for r in out if r["name"] == "loss")


def epoch_path(base: str, epoch: int) -> str:
    return f"{base}/epoch={epoch}"


def fit(spark: SparkSession, bags: DataFrame, init: DataFrame | None, base: str, epochs: int, shards: int,
        start_epoch: int = 0, batch_size: int = 8192, lr: float = 1e-3, seed: int = 42, keep: float = 0.75,
        on_epoch=None, target_rows: int = 1 << 20, block_bytes: int = BLOCK_BYTES, eval_every: int | None = None, on_step=None,
        here: int = HERE):
    """Train from ``start_epoch`` (0 = from ``init``) for ``epochs`` more epochs,
    saving every epoch (A17). ``on_epoch(epoch, path)`` runs the per-epoch evaluation;
    ``on_step(step, path)`` runs every ``eval_every`` steps within an epoch (I14).
    ``target_rows`` is a bound of the target vocabulary. Models of at most ``here`` numbers are
    trained by one task (unless steps are watched). Returns [(epoch, mean loss)]."""
    if start_epoch == 0:
        init.write.mode("overwrite").parquet(epoch_path(base, 0))
    log = []
    bags = reliable_checkpoint(bags)
    numbers = spark.read.parquet(epoch_path(base, start_epoch)).agg(F.sum(F.size("vec"))).collect()[0][0]
    if numbers <= here and not (on_step is not None and eval_every):
        return _fit_here(spark, bags, base, epochs, start_epoch, batch_size, lr, seed, keep, on_epoch)
    for e in range(start_epoch, start_epoch + epochs):
        batches, steps, n = steps_of_epoch(bags, e, batch_size, seed)
        cur, losses = epoch_path(base, e), []
        for k in range(steps):
            size, t = min(batch_size, n - k * batch_size), e * steps + k + 1
            part = spark.read.parquet(f"{batches}/step={k}")
            params, loss = run_step(spark.read.parquet(cur), part, size, shards, t, target_rows, lr, keep, (seed, e), block_bytes)
            new = epoch_path(base, e + 1) if k + 1 == steps else scratch_path(spark, "step")
            params.write.mode("overwrite").parquet(new)
            losses.append(loss.collect()[0]["loss"])  # one number
            if k:
                _delete(spark, cur)  # the step before
            cur = new
            if on_step is not None and eval_every and t % eval_every == 0:
                on_step(t, cur)
        if not steps:
            spark.read.parquet(cur).write.mode("overwrite").parquet(epoch_path(base, e + 1))
        _delete(spark, batches)
        log.append((e + 1, sum(losses) / n if n else None))
        if on_epoch is not None:
            on_epoch(e + 1, epoch_path(base, e + 1))
    return log


def _fit_here(spark: SparkSession, bags: DataFrame, base: str, epochs: int, start_epoch: int, batch_size: int, lr: float, seed: int,
              keep: float, on_epoch) -> list:
    log, n = [], bags.count()
    for e in range(start_epoch, start_epoch + epochs):
        params, loss = spark.read.parquet(epoch_path(base, e)).select(*PARAM_COLS), None
        if n:
            rows, loss = epoch_here(bags, params.collect(), e, -(-n // batch_size), batch_size, lr, keep, seed)
            params = spark.createDataFrame(rows, params.schema)
        params.write.mode("overwrite").parquet(epoch_path(base, e + 1))
        log.append((e + 1, loss / n if n else None))
        if on_epoch is not None:
            on_epoch(e + 1, epoch_path(base, e + 1))
    return log


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def latest_epoch(spark: SparkSession, base: str) -> int:
    """Newest saved epoch (from the partition column)."""
    return spark.read.parquet(base).agg(F.max("epoch")).collect()[0][0]


def retained_epochs(spark: SparkSession, base: str, keep: int = 10) -> DataFrame:
    """The newest ``keep`` versions (older ones are the ones to delete)."""
    e = spark.read.parquet(base).select("epoch").distinct()
    from pyspark.sql import Window

    return e.withColumn("k", F.dense_rank().over(Window.orderBy(F.col("epoch").desc()))).filter(F.col("k") <= keep)


def prune_epochs(spark: SparkSession, base: str, keep: int = 10) -> None:
    """Delete all but the newest ``keep`` versions."""
    kept = {r["epoch"] for r in retained_epochs(spark, base, keep).collect()}  # at most ``keep`` numbers
    every = {r["epoch"] for r in spark.read.parquet(base).select("epoch").distinct().collect()}
    for e in sorted(every - kept):
        _delete(spark, epoch_path(base, e))


def release(params: DataFrame) -> DataFrame:
    """Weights only, without the optimizer moments (cannot be trained further)."""
    return params.select("name", "row", "vec")


def assert_trainable(params: DataFrame) -> None:
    if not {"m", "v"} <= set(params.columns):
        raise ValueError("released parameters carry no optimizer state; training cannot resume from them")


def as_model_params(params: DataFrame, token_dim: int, path_dim: int):
    """Model parameters of a saved epoch for the forward pass (transform and
    attention are config-sized matrices, read as numpy)."""
    from .model import ModelParams

    def emb(name):
        return params.filter(F.col("name") == name).select(F.col("row").alias("idx"), "vec")

    W, a = _small(params)
    return ModelParams(emb("token"), emb("path"), emb("target"), W, a, token_dim, path_dim)
