"""Dataset build queries: histograms, cuts, vocabularies, encoding, sampling,
filters, text forms and stores (A3-A10, A16, A19, A20, B1-B8, B18, C1-C3,
D1-D3, D5, D13, E1, F1-F4, F6, G1, G2, G4-G6, H18, H20, J5, K4)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FIXTURE
from ..operators import examples as X
from ..operators import vocab as V
from ..operators.pipeline import Build
from ..operators.ranking import global_index, stored
from ..sources import fixtures as fx
from ..sources import lines as L
from . import sqlfn as S
from .oracle_fixtures import with_fx
from .registry import register

MAXC = FIXTURE.max_contexts
CTX_TEXT = f"src || ',' || cast({S.h8('path')} AS varchar) || ',' || dst"
LINES_SQL = f"SELECT ex, target || ' ' || string_agg({CTX_TEXT}, ' ' ORDER BY pos) AS line FROM fx_ctx GROUP BY ex, target"


def _hist_sql(name: str) -> str:
    return f"SELECT word, cast(cnt AS bigint) AS cnt FROM {name}"


@register("target_histogram", with_fx(_hist_sql("tgt_hist"), "tgt_hist"))
def q_target_histogram(spark, sf_dir):
    """Train targets."""
    return Build(spark, sf_dir).target_hist


@register("token_histogram", with_fx(_hist_sql("tok_hist"), "tok_hist"))
def q_token_histogram(spark, sf_dir):
    """Train source and destination tokens."""
    return Build(spark, sf_dir).token_hist


@register("path_histogram", with_fx(_hist_sql("path_hist"), "path_hist"))
def q_path_histogram(spark, sf_dir):
    """D3: train paths."""
    return Build(spark, sf_dir).path_hist


@register("vocab_cut_strict", with_fx("""
SELECT 'token' AS vocab, word, cast(cnt AS bigint) AS cnt FROM tok_counts
UNION ALL SELECT 'path', word, cast(cnt AS bigint) FROM path_counts
UNION ALL SELECT 'target', word, cast(cnt AS bigint) FROM tgt_counts
""", "tok_counts", "path_counts", "tgt_counts"))
def q_vocab_cut_strict(spark, sf_dir):
    """count maps after the strict cut (ties at the border dropped)."""
    b = Build(spark, sf_dir)
    parts = [b.token_counts.select(F.lit("token").alias("vocab"), "word", "cnt"),
             b.path_counts.select(F.lit("path").alias("vocab"), "word", "cnt"),
             b.target_counts.select(F.lit("target").alias("vocab"), "word", "cnt")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("vocab_cut_topn", with_fx("""
SELECT 'token' AS vocab, word, cast(r AS bigint) AS r FROM tok_rank WHERE r < 5
UNION ALL SELECT 'path', word, cast(r AS bigint) FROM path_rank WHERE r < 20
UNION ALL SELECT 'target', word, cast(r AS bigint) FROM tgt_rank WHERE r < 15
""", "tok_rank", "path_rank", "tgt_rank"))
def q_vocab_cut_topn(spark, sf_dir):
    """first N of each histogram by count desc, word."""
    b, s = Build(spark, sf_dir), FIXTURE
    parts = [V.cut_topn(b.token_ranked, s.word_vocab_size).select(F.lit("token").alias("vocab"), "word", "r"),
             V.cut_topn(b.path_ranked, s.path_vocab_size).select(F.lit("path").alias("vocab"), "word", "r"),
             V.cut_topn(b.target_ranked, s.target_vocab_size).select(F.lit("target").alias("vocab"), "word", "r")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


VOCAB_SQL = """
SELECT 'token' AS vocab, word, cast(idx AS int) AS idx FROM tok_vocab
UNION ALL SELECT 'path', word, cast(idx AS int) FROM path_vocab
UNION ALL SELECT 'target', word, cast(idx AS int) FROM tgt_vocab
"""


def _vocabs(b: Build) -> DataFrame:
    parts = [b.token_vocab.select(F.lit("token").alias("vocab"), "word", "idx"),
             b.path_vocab.select(F.lit("path").alias("vocab"), "word", "idx"),
             b.target_vocab.select(F.lit("target").alias("vocab"), "word", "idx")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("vocab_index", with_fx(VOCAB_SQL, "tok_vocab", "path_vocab", "tgt_vocab"))
def q_vocab_index(spark, sf_dir):
    """Numbered vocabularies, special word first."""
    return _vocabs(Build(spark, sf_dir))


@register("specials_then_words", with_fx("""
SELECT 'token' AS vocab, '<PAD>' AS word, 0 AS idx UNION ALL SELECT 'token', '<OOV>', 1
UNION ALL SELECT 'token', word, cast(r + 2 AS int) FROM tok_counts WHERE r < 5
UNION ALL SELECT 'target', '<OOV>', 0
UNION ALL SELECT 'target', word, cast(r + 1 AS int) FROM tgt_counts WHERE r < 15
""", "tok_counts", "tgt_counts"))
def q_specials_then_words(spark, sf_dir):
    """Separate PAD / OOV mode: token specials PAD=0, OOV=1; target only OOV=0."""
    s = FIXTURE.with_(separate_oov_and_pad=True)
    b = Build(spark, sf_dir, s)
    tok = b.token_vocab.select(F.lit("token").alias("vocab"), "word", "idx")
    tgt = b.target_vocab.select(F.lit("target").alias("vocab"), "word", "idx")
    return tok.unionByName(tgt)


ENC_COLS = "ex, pos, src_idx, path_idx, dst_idx, target_idx"


@register("encode_lookup", with_fx(f"SELECT {ENC_COLS} FROM encoded", "encoded"))
def q_encode_lookup(spark, sf_dir):
    """Sampled contexts as indices (miss -> OOV index)."""
    return Build(spark, sf_dir).encoded.select("ex", "pos", "src_idx", "path_idx", "dst_idx", "target_idx")


@register("decode_lookup", with_fx("""
SELECT e.ex, e.target, coalesce(v.word, '<PAD_OR_OOV>') AS decoded
FROM (SELECT DISTINCT ex, target, target_idx FROM encoded) e LEFT JOIN tgt_vocab v ON e.target_idx = v.idx
""", "encoded", "tgt_vocab"))
def q_decode_lookup(spark, sf_dir):
    """Target index back to the word (OOV word on a miss)."""
    b, s = Build(spark, sf_dir), FIXTURE
    e = b.encoded.select("ex", "target", "target_idx").distinct()
    d = V.reverse_lookup(e, "target_idx", b.target_vocab, "decoded", s.target_specials.oov, s.target_vocab_size, s)
    return d.select("ex", "target", "decoded")


@register("vocab_membership", with_fx("SELECT ex, pos, src_in, path_in, dst_in FROM tiers", "tiers"))
def q_vocab_membership(spark, sf_dir):
    """Is each context part a key of its count map."""
    return Build(spark, sf_dir).tiered.select("ex", "pos", "src_in", "path_in", "dst_in")


@register("ctx_full_found", with_fx("SELECT ex, pos, tier = 1 AS full_found FROM tiers", "tiers"))
def q_ctx_full_found(spark, sf_dir):
    """B3."""
    return Build(spark, sf_dir).tiered.select("ex", "pos", "full_found")


@register("ctx_partial_found", with_fx("SELECT ex, pos, tier = 2 AS partial_found FROM tiers", "tiers"))
def q_ctx_partial_found(spark, sf_dir):
    """At least one part known, not all three."""
    return Build(spark, sf_dir).tiered.select("ex", "pos", "partial_found")


@register("sample_contexts", with_fx("SELECT ex, pos, src, path, dst FROM sampled", "sampled"))
def q_sample_contexts(spark, sf_dir):
    """sampled bags (max 4), full-found first, seeded order."""
    return Build(spark, sf_dir).sampled.select("ex", "pos", "src", "path", "dst")


@register("drop_empty_examples", with_fx("""
SELECT ex, role FROM flags GROUP BY ex, role HAVING sum(CASE WHEN keep THEN 1 ELSE 0 END) = 0
""", "flags"))
def q_drop_empty_examples(spark, sf_dir):
    """Examples left with no context after sampling."""
    return Build(spark, sf_dir).sizes.filter("k = 0").select("ex", "role")


@register("truncate_contexts", with_fx(f"SELECT ex, pos, src, path, dst FROM fx_ctx WHERE pos <= {MAXC}", "fx_ctx"))
def q_truncate_contexts(spark, sf_dir):
    """first max contexts, no sampling."""
    return X.truncate_contexts(fx.fx_ctx(spark, sf_dir), MAXC).select("ex", "pos", "src", "path", "dst")


@register("max_contexts", with_fx("""
SELECT cast(coalesce(max(n), 0) AS bigint) AS max_contexts FROM (SELECT ex, count(*) AS n FROM fx_ctx GROUP BY ex)
""", "fx_ctx"))
def q_max_contexts(spark, sf_dir):
    """D5."""
    return X.max_contexts(fx.fx_ctx(spark, sf_dir))


@register("collect_example", with_fx(f"""
SELECT ex, target, string_agg({CTX_TEXT}, ' ' ORDER BY pos) AS contexts FROM sampled GROUP BY ex, target
""", "sampled"))
def q_collect_example(spark, sf_dir):
    """Sampled bag as one row, position order."""
    c = X.collect_example(Build(spark, sf_dir).sampled, L.context_text())
    return c.select("ex", "target", F.array_join("contexts", " ").alias("contexts"))


VALID_SQL = """
SELECT ex, role, target_idx, cast(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS bigint) AS n_valid FROM encoded
GROUP BY ex, role, target_idx
"""


def _valid_counts(b: Build) -> DataFrame:
    return b.encoded.groupBy("ex", "role", "target_idx").agg(F.sum(F.col("valid").cast("long")).alias("n_valid"))


@register("filter_eval_rows", with_fx(f"SELECT ex, n_valid FROM ({VALID_SQL}) WHERE role = 'test' AND n_valid > 0",
                                      "encoded"))
def q_filter_eval_rows(spark, sf_dir):
    """Evaluation keeps rows with at least one non-PAD context."""
    v = _valid_counts(Build(spark, sf_dir))
    return v.filter((F.col("role") == "test") & (F.col("n_valid") > 0)).select("ex", "n_valid")


@register("filter_train_rows", with_fx(f"""
SELECT ex, target_idx FROM ({VALID_SQL}) WHERE role = 'train' AND n_valid > 0 AND target_idx > 0
""", "encoded"))
def q_filter_train_rows(spark, sf_dir):
    """B6 and a known target."""
    s = FIXTURE
    v = _valid_counts(Build(spark, sf_dir))
    return v.filter((F.col("role") == "train") & (F.col("n_valid") > 0)
                    & (F.col("target_idx") > s.target_specials.oov_idx)).select("ex", "target_idx")


@register("context_valid_mask", with_fx("""
SELECT ex, pos, CASE WHEN valid THEN 1.0 ELSE 0.0 END::double AS mask FROM encoded
""", "encoded"))
def q_context_valid_mask(spark, sf_dir):
    """1.0 if any part is not PAD."""
    e = Build(spark, sf_dir).encoded
    return e.select("ex", "pos", F.when(F.col("valid"), 1.0).otherwise(0.0).alias("mask"))


@register("project_for_role", with_fx("""
SELECT 'train' AS role, ex, target_idx, cast(NULL AS varchar) AS target, cast(count(*) AS bigint) AS n
FROM encoded WHERE role = 'train' GROUP BY ex, target_idx
UNION ALL SELECT 'test', ex, target_idx, target, cast(count(*) AS bigint) FROM encoded WHERE role = 'test'
GROUP BY ex, target_idx, target
""", "encoded"))
def q_project_for_role(spark, sf_dir):
    """Train form carries the target index only; evaluate form also the target string."""
    e = Build(spark, sf_dir).encoded
    tr = e.filter(F.col("role") == "train").groupBy("ex", "target_idx").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("train").alias("role"), "ex", "target_idx", F.lit(None).cast("string").alias("target"), "n")
    te = e.filter(F.col("role") == "test").groupBy("ex", "target_idx", "target").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("test").alias("role"), "ex", "target_idx", "target", "n")
    return tr.unionByName(te)


@register("record_former", with_fx(f"SELECT {ENC_COLS} FROM encoded", "encoded"))
def q_record_former(spark, sf_dir):
    """K4: to the model-input record (one struct) and back."""
    e = Build(spark, sf_dir).encoded
    packed = e.select(F.struct("ex", "pos", "src_idx", "path_idx", "dst_idx", "target_idx").alias("rec"))
    return packed.select("rec.*")


@register("pad_contexts", with_fx(f"""
SELECT ex, cast({MAXC} - count(*) AS int) AS n_pad,
  array_to_string(list_concat(list(src ORDER BY pos), list_transform(range({MAXC} - count(*)), lambda i: '<PAD_OR_OOV>')), ' ') AS padded
FROM sampled GROUP BY ex
""", "sampled"))
def q_pad_contexts(spark, sf_dir):
    """Source tokens of each sampled bag padded with the PAD word up to max."""
    s = Build(spark, sf_dir).sampled
    g = s.groupBy("ex").agg(F.array_sort(F.collect_list(F.struct("pos", "src"))).alias("a"))
    toks = F.transform("a", lambda x: x["src"])
    n_pad = (F.lit(MAXC) - F.size("a")).cast("int")
    padded = F.concat(toks, F.array_repeat(F.lit("<PAD_OR_OOV>"), F.greatest(n_pad, F.lit(0))))
    return g.select("ex", n_pad.alias("n_pad"), F.array_join(padded, " ").alias("padded"))


@register("chunk_array", with_fx("""
SELECT ex, cast((pos - 1) // 3 AS int) AS chunk, string_agg(src, ' ' ORDER BY pos) AS items FROM fx_ctx
GROUP BY ex, (pos - 1) // 3
""", "fx_ctx"))
def q_chunk_array(spark, sf_dir):
    """Consecutive chunks of 3 of each bag (array form: transform over sequence + slice)."""
    c = fx.fx_ctx(spark, sf_dir)
    g = c.groupBy("ex").agg(F.array_sort(F.collect_list(F.struct("pos", "src"))).alias("a"))
    a = F.transform("a", lambda x: x["src"])
    chunks = F.transform(F.sequence(F.lit(0), F.size("a") - 1, F.lit(3)), lambda i: F.slice(a, i + 1, 3))
    return g.select("ex", F.posexplode(chunks).alias("chunk", "items")).select(
        "ex", F.col("chunk").cast("int"), F.array_join("items", " ").alias("items"))


@register("split_by_group", with_fx("""
SELECT role, cast(count(DISTINCT grp) AS bigint) AS n_groups, cast(count(*) AS bigint) AS n_examples,
       cast((SELECT count(*) FROM (SELECT grp FROM fx_split GROUP BY grp HAVING count(DISTINCT role) > 1)) AS bigint)
       AS n_groups_in_two_roles
FROM fx_split GROUP BY role
""", "fx_split"))
def q_split_by_group(spark, sf_dir):
    """Whole groups per role, with the check that no group is in two roles."""
    sp = fx.fx_split(spark, sf_dir)
    bad = sp.groupBy("grp").agg(F.count_distinct("role").alias("r")).filter("r > 1").agg(F.count(F.lit(1))).scalar()
    return sp.groupBy("role").agg(F.count_distinct("grp").alias("n_groups"), F.count(F.lit(1)).alias("n_examples")) \
        .withColumn("n_groups_in_two_roles", bad)


@register("repeat_epochs", with_fx("""
SELECT cast(e.epoch AS int) AS epoch, s.role, cast(count(*) AS bigint) AS n FROM fx_split s
CROSS JOIN range(3) e(epoch) GROUP BY e.epoch, s.role
""", "fx_split"))
def q_repeat_epochs(spark, sf_dir):
    """The dataset three times, each row tagged with its epoch (explode, not a cross join)."""
    sp = fx.fx_split(spark, sf_dir)
    r = sp.select("role", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"))
    return r.groupBy("epoch", "role").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("epoch").cast("int"), "role", "n")


SHUFFLE_SQL = """
SELECT cast(e.epoch AS int) AS epoch, s.ex,
  row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42|' || cast(e.epoch AS varchar) || '|' || cast(s.ex AS varchar))) - 1
  AS position
FROM (SELECT ex FROM fx_split WHERE role = 'train') s CROSS JOIN range(2) e(epoch)
"""


def _shuffled(spark, sf_dir, epochs: int = 2) -> DataFrame:
    sp = fx.fx_split(spark, sf_dir).filter(F.col("role") == "train")
    r = sp.select("ex", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    r = r.withColumn("h", X.seeded_hash(FIXTURE.seed, "epoch", "ex"))
    g = global_index(r, [F.col("epoch"), F.col("h")], name="g")
    # position within its epoch = global position minus the epoch's start (one row per epoch)
    starts = g.groupBy("epoch").agg(F.min("g").alias("g0"))
    return g.join(F.broadcast(starts), "epoch").select(
        F.col("epoch").cast("int"), "ex", (F.col("g") - F.col("g0")).alias("position"))


@register("shuffle_train", with_fx(SHUFFLE_SQL, "fx_split"))
def q_shuffle_train(spark, sf_dir):
    """a seeded random order of the train examples, new in each epoch."""
    return _shuffled(spark, sf_dir)


@register("train_batches", with_fx(f"""
SELECT epoch, cast(position // 1024 AS bigint) AS batch, cast(count(*) AS bigint) AS n
FROM ({SHUFFLE_SQL}) s JOIN (SELECT ex FROM ({VALID_SQL}) WHERE role = 'train' AND n_valid > 0 AND target_idx > 0) t
ON s.ex = t.ex GROUP BY epoch, position // 1024
""", "fx_split", "encoded"))
def q_train_batches(spark, sf_dir):
    """Repeat -> shuffle -> encode -> filter -> batches of 1024 by shuffled position."""
    b = Build(spark, sf_dir)
    ok = _valid_counts(b).filter((F.col("role") == "train") & (F.col("n_valid") > 0) & (F.col("target_idx") > 0))
    j = _shuffled(spark, sf_dir).join(ok.select("ex"), "ex")
    return j.groupBy("epoch", F.floor(F.col("position") / 1024).cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- text forms ----------------------------------------------------------

@register("emit_example_lines", with_fx(LINES_SQL, "fx_ctx"))
def q_emit_example_lines(spark, sf_dir):
    """`target src,hash,dst ...` per example."""
    return L.emit_example_lines(fx.fx_ctx(spark, sf_dir))


@register("read_raw_examples", with_fx("""
SELECT ex, p[1] AS target, cast(len(p) - 1 AS int) AS n_contexts, p[2] AS first_context
FROM (SELECT ex, string_split(line, ' ') AS p FROM lines)
""", "fx_ctx", extra=[("lines", LINES_SQL)]))
def q_read_raw_examples(spark, sf_dir):
    """A3 / B1: lines back to target and contexts."""
    p = L.parse_example(L.emit_example_lines(fx.fx_ctx(spark, sf_dir)))
    return p.select("ex", "target", F.size("contexts").alias("n_contexts"), F.col("contexts")[0].alias("first_context"))


PADDED_SQL = f"""
SELECT ex, role, target || ' ' || string_agg({CTX_TEXT}, ' ' ORDER BY pos) || repeat(' ', cast(greatest(0, {MAXC} - count(*)) AS int)) AS line
FROM sampled GROUP BY ex, role, target
"""


def _padded(spark, sf_dir):
    return L.padded_lines(Build(spark, sf_dir).sampled, FIXTURE)


@register("write_padded_dataset", with_fx(f"SELECT role, line FROM ({PADDED_SQL})", "sampled"))
def q_write_padded_dataset(spark, sf_dir):
    """Padded lines of the sampled bags, one text output per role, read back."""
    out = L.scratch_path(spark, "padded")
    _padded(spark, sf_dir).select("role", "line").write.partitionBy("role").text(out)
    return spark.read.text(out).select("role", F.col("value").alias("line"))


@register("parse_example", with_fx("""
SELECT ex, cast(len(p) - 1 AS int) AS n_fields,
       cast(len(list_filter(p[2:], lambda c: c = '')) AS int) AS n_empty
FROM (SELECT ex, string_split(line, ' ') AS p FROM padded)
""", "sampled", extra=[("padded", PADDED_SQL)]))
def q_parse_example(spark, sf_dir):
    """B1: only the newline is stripped, so padding blanks become empty contexts."""
    p = L.parse_example(_padded(spark, sf_dir))
    return p.select("ex", F.size("contexts").alias("n_fields"),
                    F.size(F.filter("contexts", lambda c: c == "")).alias("n_empty"))


SPLIT_CTX_SQL = """
SELECT ex, p[1] AS target, cast(i AS int) AS i, coalesce(c[1], '<PAD_OR_OOV>') AS src,
       coalesce(c[2], '<PAD_OR_OOV>') AS path, coalesce(c[3], '<PAD_OR_OOV>') AS dst
FROM (SELECT ex, p, i, string_split(p[i + 1], ',') AS c
      FROM (SELECT ex, string_split(line, ' ') AS p FROM padded) t, range(1, len(p)) r(i))
"""


@register("split_context", with_fx(SPLIT_CTX_SQL, "sampled", extra=[("padded", PADDED_SQL)]))
def q_split_context(spark, sf_dir):
    """B2: every field of a padded line as (src, path, dst); empty fields -> ('', PAD, PAD)."""
    p = L.parse_example(_padded(spark, sf_dir))
    return L.split_contexts(p, FIXTURE.token_specials.pad)


@register("read_padded_examples", with_fx(f"""
SELECT ex, target, cast(sum(CASE WHEN src = '' THEN 0 ELSE 1 END) AS bigint) AS n_real,
       cast(sum(CASE WHEN src = '' THEN 1 ELSE 0 END) AS bigint) AS n_padding
FROM ({SPLIT_CTX_SQL}) GROUP BY ex, target
""", "sampled", extra=[("padded", PADDED_SQL)]))
def q_read_padded_examples(spark, sf_dir):
    """A4: space-delimited padded dataset, empty field -> PAD context."""
    p = L.parse_example(_padded(spark, sf_dir))
    c = L.split_contexts(p, FIXTURE.token_specials.pad)
    return c.groupBy("ex", "target").agg(F.sum((F.col("src") != "").cast("long")).alias("n_real"),
                                         F.sum((F.col("src") == "").cast("long")).alias("n_padding"))


@register("read_in_memory_lines", with_fx("""
SELECT ex, p[1] AS target, cast(len(p) - 1 AS int) AS n_contexts FROM (SELECT ex, string_split(line, ' ') AS p FROM lines)
""", "fx_ctx", extra=[("lines", LINES_SQL)]))
def q_read_in_memory_lines(spark, sf_dir):
    """A5: lines handed over as a DataFrame go through the same parse, nothing filtered."""
    p = L.parse_example(L.emit_example_lines(fx.fx_ctx(spark, sf_dir)))
    return p.select("ex", "target", F.size("contexts").alias("n_contexts"))


WORD_HIST_SQL = "SELECT w AS word, count(*) AS cnt FROM fx_words GROUP BY w"


@register("write_histogram", with_fx(f"SELECT word || ' ' || cast(cnt AS varchar) AS value FROM ({WORD_HIST_SQL})",
                                     "fx_words"))
def q_write_histogram(spark, sf_dir):
    """`word count` text file, read back."""
    h = V.histogram(F.col("w"), fx.fx_words(spark, sf_dir))
    out = L.scratch_path(spark, "hist")
    L.write_text(h.select(F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value")), out)
    return spark.read.text(out)


@register("read_histogram", with_fx(f"""
SELECT word, cast(row_number() OVER (ORDER BY cnt DESC, word) AS int) AS idx, cast(cnt AS bigint) AS cnt
FROM ({WORD_HIST_SQL}) WHERE cnt >= 2
""", "fx_words"))
def q_read_histogram(spark, sf_dir):
    """Histogram text -> vocabulary (min count 2, indices from 1, file order)."""
    h = V.histogram(F.col("w"), fx.fx_words(spark, sf_dir))
    return L.read_histogram(L.histogram_lines(h), min_count=2, start_from=1)


@register("save_load_freq", with_fx("""
SELECT 'token' AS vocab, word, cast(cnt AS bigint) AS cnt FROM tok_counts
UNION ALL SELECT 'path', word, cast(cnt AS bigint) FROM path_counts
UNION ALL SELECT 'target', word, cast(cnt AS bigint) FROM tgt_counts
UNION ALL SELECT 'meta', 'n_train_examples', cast(count(*) AS bigint) FROM (
  SELECT ex FROM flags WHERE role = 'train' GROUP BY ex HAVING sum(CASE WHEN keep THEN 1 ELSE 0 END) > 0)
""", "tok_counts", "path_counts", "tgt_counts", "flags"))
def q_save_load_freq(spark, sf_dir):
    """The three count maps and the train-example count, as parquet, reloaded."""
    b = Build(spark, sf_dir)
    freq = (b.token_counts.select(F.lit("token").alias("vocab"), "word", "cnt")
            .unionByName(b.path_counts.select(F.lit("path").alias("vocab"), "word", "cnt"))
            .unionByName(b.target_counts.select(F.lit("target").alias("vocab"), "word", "cnt")))
    n_train = (b.sizes.filter((F.col("role") == "train") & (F.col("k") > 0)).agg(F.count(F.lit(1)).alias("cnt"))
               .select(F.lit("meta").alias("vocab"), F.lit("n_train_examples").alias("word"), "cnt"))
    out = L.scratch_path(spark, "freq")
    freq.write.mode("overwrite").parquet(out + "/freq")
    n_train.write.mode("overwrite").parquet(out + "/meta")
    return spark.read.parquet(out + "/freq").unionByName(spark.read.parquet(out + "/meta"))


@register("save_load_vocab", with_fx(VOCAB_SQL, "tok_vocab", "path_vocab", "tgt_vocab"))
def q_save_load_vocab(spark, sf_dir):
    """A10: stored without specials; on load the lowest index must equal the
    number of specials (else error), then the specials are added back."""
    b, s = Build(spark, sf_dir), FIXTURE
    out = L.scratch_path(spark, "vocab")
    v = _vocabs(b)
    n_special = s.token_specials.n
    v.filter(F.col("idx") >= n_special).write.mode("overwrite").partitionBy("vocab").parquet(out)
    loaded = spark.read.parquet(out)
    bad = loaded.groupBy("vocab").agg(F.min("idx").alias("m")).filter(F.col("m") != n_special).collect()
    if bad:  # at most one row per vocabulary
        raise ValueError(f"stored vocabulary {bad[0]['vocab']} starts at index {bad[0]['m']}, "
                         f"expected {n_special} (special-word mode mismatch)")
    rows = [(k, w, i) for k in ("token", "path", "target") for i, w in enumerate(s.token_specials.ordered)]
    with_specials = spark.createDataFrame(rows, "vocab string, word string, idx int")
    return with_specials.unionByName(loaded.select("vocab", "word", "idx"))


@register("count_examples_cached", with_fx("""
SELECT role, cast(count(*) AS bigint) AS n FROM fx_split GROUP BY role
""", "fx_split"))
def q_count_examples_cached(spark, sf_dir):
    """Example counts per role kept in a meta table; reused when present."""
    name = f"example-counts-{hashlib.md5(sf_dir.encode()).hexdigest()}"
    return L.stored(spark, name, lambda: fx.fx_split(spark, sf_dir).groupBy("role").agg(F.count(F.lit(1)).alias("n")))


def _role_lines(spark, sf_dir):
    """(ex, line, role), stored once for the passes of the roles."""
    ctx = stored(fx.fx_ctx(spark, sf_dir))
    roles = fx.fx_split(spark, sf_dir, ctx).select("ex", "role")
    return stored(L.emit_example_lines(ctx).join(roles.hint("merge"), "ex"))


@register("append_output", with_fx("SELECT role, cast(count(*) AS bigint) AS n FROM lines_r GROUP BY role",
                                   "fx_split", extra=[("lines", LINES_SQL),
                                                      ("lines_r", "SELECT l.*, s.role FROM lines l JOIN fx_split s ON l.ex = s.ex")]))
def q_append_output(spark, sf_dir):
    """The lines of each role appended to one output, read back."""
    lines = _role_lines(spark, sf_dir)
    out = L.scratch_path(spark, "append")
    for role in ("train", "val", "test"):
        lines.filter(F.col("role") == role).write.mode("append").parquet(out)
    return spark.read.parquet(out).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@register("union_outputs", with_fx("""
SELECT role, cast(count(*) AS bigint) AS n, cast(sum(length(line)) AS bigint) AS chars FROM lines_r GROUP BY role
""", "fx_split", extra=[("lines", LINES_SQL),
                        ("lines_r", "SELECT l.*, s.role FROM lines l JOIN fx_split s ON l.ex = s.ex")]))
def q_union_outputs(spark, sf_dir):
    """G1: per-role outputs concatenated (bag union by name)."""
    lines = _role_lines(spark, sf_dir)
    parts = [lines.filter(F.col("role") == r) for r in ("train", "val", "test")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).cast("long").alias("chars"))


@register("unique_in_order", with_fx("""
SELECT doc_id, w, cast(line_no AS int) AS first_line, cast(pos AS int) AS first_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY line_no, pos) AS r FROM fx_words) WHERE r = 1
""", "fx_words"))
def q_unique_in_order(spark, sf_dir):
    """Distinct words of each document with their first-seen position (long form, no big arrays)."""
    w = fx.fx_words(spark, sf_dir)
    # line and position (positive ints) as one long: a minimum that hash aggregation can keep, so words
    # are neither sorted nor spilled before the shuffle
    at = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    first = w.groupBy("doc_id", "w").agg(F.min(at).alias("at"))
    return first.select("doc_id", "w", F.shiftright("at", 32).cast("int").alias("first_line"),
                        F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("first_pos"))


@register("extractor_contract", with_fx(f"""
SELECT ex, cast(pos AS int) AS pos, src, cast({S.h8('path')} AS varchar) AS path, dst FROM fx_ctx
""", "fx_ctx"))
def q_extractor_contract(spark, sf_dir):
    """K1: any extractor plugs in by producing example rows (id, target,
    contexts array<struct<src, path, dst>>); here the text lines of A20 are
    turned into that row form and validated, then unnested to the long form."""
    from ..sources.bags import to_long, validate_bags

    p = L.parse_example(L.emit_example_lines(fx.fx_ctx(spark, sf_dir)))
    parts = F.transform("contexts", lambda c: F.split(c, ",", -1))
    bags = p.select(F.col("ex").alias("example_id"), "target",
                    F.transform(parts, lambda q: F.struct(q[0].alias("src"), q[1].alias("path"), q[2].alias("dst")))
                    .alias("contexts"))
    return to_long(validate_bags(bags)).select(F.col("example_id").alias("ex"), "pos", "src", "path", "dst")
