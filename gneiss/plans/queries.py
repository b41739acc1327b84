"""Queries of the operators over the given tables, and their DuckDB SQL.

Documents stand for files (source: the snapshot, doc_id: its place, text: the bytes), parts for header entries (brand: the
artifact), embeddings for tensors of 64 elements, events for a log of references by day, conversations for a mutation log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import idents
from gneiss.functions.shapes import dimensions
from gneiss.operators import convert, decide, morphisms, planning, reads, relayout, rules, store, topology, transfer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- objects and plans

OBJECTS = "SELECT source, doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS size FROM documents"


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("session"), F.col("doc_id").alias("ord"), idents.digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS size, 'objects/sha256/' || sha256(text)[1:2] || '/' || sha256(text)[3:4] || '/' || sha256(text) AS key FROM documents")
def object_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", idents.digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return d.withColumn("key", idents.object_key(idents.ref(F.col("digest"))))


@query(f"SELECT source AS session, digest, min(doc_id) AS ord, any_value(size) AS size FROM ({OBJECTS}) GROUP BY ALL")
def distinct_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.distinct_objects(declared(spark, sf_dir))


@query("SELECT source AS session, digest, size, row_number() OVER (PARTITION BY source ORDER BY o, digest) - 1 AS ord FROM (SELECT source, digest, min(doc_id) AS o, any_value(size) AS size FROM (%s) GROUP BY ALL)" % OBJECTS)
def object_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.closure(declared(spark, sf_dir)).select("session", "digest", "size", F.col("ord").cast("long").alias("ord"))


@query("""
SELECT doc_id, k AS ord, k * 1000 AS "offset", least(1000, strlen(text) - k * 1000)::BIGINT AS length,
       sha256(encode(text)[k * 1000 + 1 : k * 1000 + 1000]) AS digest
FROM (SELECT doc_id, text, unnest(range(0, (strlen(text)::BIGINT + 999) // 1000)) AS k FROM documents)
""")
def grid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.hash_grid(table(spark, sf_dir, "documents"), ["doc_id"], 1000, "text")


@query("SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM documents")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "doc_id", planning.offsets(F.col("n_chars"), ["source"], "doc_id").alias("start"))


@query("""
WITH r AS (SELECT offset_, length, source, doc_id FROM (SELECT source, doc_id, n_chars AS length,
  coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ FROM documents) WHERE doc_id % 101 <> 7),
b AS (SELECT *, coalesce(lag(offset_ + length) OVER (PARTITION BY source ORDER BY offset_, length), 0) AS before, row_number() OVER (PARTITION BY source ORDER BY offset_, length) = 1 AS f FROM r),
w AS (SELECT source, min(CASE WHEN f AND offset_ <> 0 THEN 1 WHEN offset_ > before THEN 2 WHEN offset_ < before THEN 3 WHEN length <= 0 THEN 4 END) AS why, sum(length) AS total FROM b GROUP BY source),
s AS (SELECT source, sum(n_chars) AS size FROM documents GROUP BY source)
SELECT source, coalesce(['start', 'gap', 'overlap', 'empty'][why], CASE WHEN coalesce(total, 0) <> size THEN 'size' END) AS reason
FROM s LEFT JOIN w USING (source) WHERE reason IS NOT NULL
""")
def coverage_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose plan lost regions, here every hundred-first but one, and how."""
    d = table(spark, sf_dir, "documents")
    regions = d.select("source", "doc_id", F.col("n_chars").alias("length"), planning.offsets(F.col("n_chars"), ["source"], "doc_id").alias("offset")).where("doc_id % 101 <> 7")
    sizes = d.groupBy("source").agg(F.sum("n_chars").alias("size"))
    return planning.coverage_refusals(regions, sizes, ["source"])


@query(f"""
WITH o AS (SELECT source AS session, digest, min(doc_id) AS ord, any_value(size) AS size FROM ({OBJECTS}) GROUP BY ALL),
h AS (SELECT DISTINCT sha256(text) AS digest FROM documents JOIN labels USING (doc_id))
SELECT session, ord, digest, size, CASE WHEN h.digest IS NULL THEN 'need' ELSE 'have' END AS status,
       CASE WHEN h.digest IS NULL THEN 'staging/sha256/' || digest[1:2] || '/' || digest[3:4] || '/' || digest END AS key
FROM o LEFT JOIN h USING (digest)
""")
def have_need_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return transfer.have_need(declared(spark, sf_dir), labelled.select(idents.digest(F.col("text")).alias("digest")))


@query(f"""
WITH o AS (SELECT source AS session, digest, any_value(size) AS size FROM ({OBJECTS}) GROUP BY ALL),
s AS (SELECT sha256(text) AS digest, max(strlen(text) + (quality = 0)::INT)::BIGINT AS stored FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT session, CASE WHEN stored IS NULL THEN 'absent' WHEN stored <> size THEN 'size' ELSE 'ready' END AS state FROM o LEFT JOIN s USING (digest))
SELECT session, count(*) AS objects, count(*) FILTER (WHERE state = 'ready') AS ready, count(*) FILTER (WHERE state <> 'ready') AS failed, count(*) FILTER (WHERE state <> 'ready') = 0 AS complete
FROM p GROUP BY session
""")
def promotion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are in the store, those of low quality a byte too long."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    held = d.groupBy(idents.digest(F.col("text")).alias("digest")).agg(F.max(F.octet_length("text") + (F.col("quality") == 0).cast("int")).cast("long").alias("size"))
    plan = transfer.distinct_objects(declared(spark, sf_dir)).withColumn("key", F.lit(None).cast("string"))
    return transfer.promotion_report(plan, held)


@query("""
WITH RECURSIVE o AS (SELECT source AS session, doc_id AS ord, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
t AS (SELECT session, ord, size, k, 0::BIGINT AS pack, 0::BIGINT AS start FROM o WHERE k = 1
      UNION ALL SELECT o.session, o.ord, o.size, o.k, CASE WHEN t.start + t.size + o.size > 50000 THEN t.pack + 1 ELSE t.pack END, CASE WHEN t.start + t.size + o.size > 50000 THEN 0 ELSE t.start + t.size END
      FROM t JOIN o ON o.session = t.session AND o.k = t.k + 1)
SELECT session, ord, pack, start AS "offset" FROM t
""")
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("ord"), F.lit("").alias("digest"), F.col("n_chars").alias("size"))
    return transfer.pack(d, 50_000).select("session", "ord", "pack", "offset")


@query("SELECT source, sha256(string_agg(doc_id || ' ' || sha256(text), chr(10) ORDER BY doc_id)) AS manifest FROM documents GROUP BY source")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), idents.digest(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("source").agg(idents.digest(lines).alias("manifest"))


# ---- the store


@query(f"""
WITH m AS (SELECT DISTINCT source AS root, digest FROM ({OBJECTS})), o AS (SELECT digest, any_value(size) AS size FROM ({OBJECTS}) GROUP BY digest),
n AS (SELECT digest, count(*) AS roots FROM m GROUP BY digest)
SELECT root, count(*) AS objects, sum(size)::BIGINT AS resident, coalesce(sum(size) FILTER (WHERE roots = 1), 0)::BIGINT AS exclusive FROM m JOIN n USING (digest) JOIN o USING (digest) GROUP BY root
""")
def snapshot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declared(spark, sf_dir)
    objects = d.groupBy("digest").agg(F.max("size").alias("size"))
    return store.usage(store.mark(d.select(F.col("session").alias("root"), "digest")), objects)


@query(f"""
WITH o AS (SELECT digest, any_value(size) AS size FROM ({OBJECTS}) GROUP BY digest), live AS (SELECT DISTINCT digest FROM ({OBJECTS}) WHERE source < 'src5'),
q AS (SELECT sha256(text) AS digest, max(doc_id % 4) AS since FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT digest, size, CASE WHEN live.digest IS NOT NULL AND since IS NOT NULL THEN 'rescue' WHEN live.digest IS NOT NULL THEN 'keep' WHEN since IS NULL THEN 'quarantine' WHEN since <= 1 THEN 'delete' ELSE 'wait' END AS action,
  CASE WHEN live.digest IS NULL AND since IS NULL THEN 3 WHEN live.digest IS NULL AND since > 1 THEN since ELSE -1 END::BIGINT AS epoch
FROM o LEFT JOIN live USING (digest) LEFT JOIN q USING (digest)
""")
def gc_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch 3; snapshots up to src5 are roots, what isn't English was set aside in some epoch before."""
    d = table(spark, sf_dir, "documents").withColumn("digest", idents.digest(F.col("text")))
    objects = d.groupBy("digest").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    marks = store.mark(d.where("source < 'src5'").select(F.col("source").alias("root"), "digest"))
    aside = d.where("lang <> 'en'").groupBy("digest").agg(F.max(F.col("doc_id") % 4).alias("epoch"))
    return store.collect(objects, marks, aside, F.lit(3).cast("long")).withColumn("epoch", F.coalesce("epoch", F.lit(-1)).cast("long"))


@query("SELECT 'tree' AS kind, doc_id::VARCHAR AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'ref', 'page-' || page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def scrub_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    refs = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("name"), F.col("page_id").cast("string").alias("target"))
    return store.scrub(trees, refs, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")))


@query("""
WITH e AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS epoch FROM events),
s AS (SELECT user_id, epoch, lead(epoch) OVER (PARTITION BY user_id ORDER BY epoch) AS next FROM e), m AS (SELECT max(epoch) AS last FROM e)
SELECT user_id, epoch::BIGINT AS referenced, (epoch + 1)::BIGINT AS quarantined, CASE WHEN coalesce(next, last + 1) > epoch + 3 THEN epoch + 3 ELSE -1 END::BIGINT AS deleted FROM s, m WHERE coalesce(next, last + 1) > epoch + 1
""")
def epoch_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (users) that days (epochs) refer to: set aside the day after, deleted two days later if not referred to before."""
    from gneiss.streaming.epochs import quarantine_spans

    e = table(spark, sf_dir, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"))
    return quarantine_spans(e, "user_id").withColumn("deleted", F.coalesce("deleted", F.lit(-1)).cast("long"))


@query("SELECT lower(url) AS folded, count(DISTINCT url) AS n, min(url) AS first, max(url) AS last FROM (SELECT CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', 3) ELSE upper(split_part(url, '/', 3)) END AS url FROM pages) GROUP BY 1 HAVING count(DISTINCT url) > 1")
def casefold_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.get(F.split("url", "/"), F.lit(2))
    p = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, host).otherwise(F.upper(host)).alias("path"))
    return store.case_collisions(p, []).select("folded", "n", "first", "last")


@query(r"""
SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN starts_with(url, '/') THEN 'absolute' WHEN contains(url, '\') THEN 'backslash' WHEN regexp_matches(url, '[\x00-\x1f\x7f]') THEN 'control'
  WHEN list_contains(string_split(url, '/'), '') THEN 'empty-segment' WHEN list_contains(string_split(url, '/'), '.') OR list_contains(string_split(url, '/'), '..') THEN 'dot-segment' END AS reason FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN substr(url, 9) WHEN 2 THEN '/' || url WHEN 3 THEN 'a/../' || page_id ELSE 'x/' || page_id || '\y' END AS url FROM pages)
""")
def path_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, url = F.col("page_id") % 5, F.col("url")
    path = F.when(n == 0, url).when(n == 1, F.substr(url, F.lit(9))).when(n == 2, F.concat(F.lit("/"), url)).when(n == 3, F.concat(F.lit("a/../"), F.col("page_id"))).otherwise(F.concat(F.lit("x/"), F.col("page_id"), F.lit("\\y")))
    return table(spark, sf_dir, "pages").select("page_id", idents.path_refusal(path).alias("reason"))


@query()
def mutation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs of changes to small trees."""
    t = F.col("turn")
    op = F.when(F.col("role") == "system", "mkdir").when(t % 5 == 4, "rename").when(t % 7 == 6, "remove").when(t % 3 == 2, "truncate").otherwise("put")
    path = F.concat(F.lit("f"), (t % 4).cast("string"))
    arg = F.when(op == "rename", F.concat(F.lit("g"), t.cast("string"))).when(op == "truncate", t.cast("string")).otherwise(F.substring(idents.digest(F.col("text")), 1, 8))
    return store.fold_mutations(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("workspace"), t.alias("ord"), op.alias("op"), path.alias("path"), arg.alias("arg")))


# ---- reads


@query("""
SELECT doc_id, k AS "range", hex(encode(text)[k * 300 + 1 : least(k * 300 + 450, strlen(text))]) AS bytes
FROM (SELECT doc_id, text, unnest(range(0, (strlen(text)::BIGINT + 299) // 300)) AS k FROM documents)
""")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every file all ranges of 450 bytes, 300 apart, read over a grid of 1000 bytes."""
    d = table(spark, sf_dir, "documents")
    chunks = planning.hash_grid(d, ["doc_id"], 1000, "text").join(d.select("doc_id", "text"), "doc_id")
    chunks = chunks.withColumn("content", F.substr(F.col("text").cast("binary"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))).drop("text")
    n = F.octet_length("text").cast("long")
    ranges = d.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", n - 1, F.lit(300).cast("long")))).alias("range"))
    ranges = ranges.select("doc_id", "range", (F.col("range") * 300).alias("start"), F.least(F.col("range") * 300 + 450, F.col("n")).alias("end"))
    return reads.read_ranges(ranges, chunks, ["doc_id"], 1000).select("doc_id", "range", F.hex("bytes").alias("bytes"))


@query("""
WITH n AS (SELECT doc_id, unnest(range(0, (strlen(text)::BIGINT + 999) // 1000)) AS k, strlen(text) AS size, text FROM documents),
g AS (SELECT doc_id, k * 1000 AS o, least(1000, size - k * 1000) AS l, text FROM n)
SELECT doc_id, o AS "offset", l::BIGINT AS length, CASE WHEN doc_id % 2 = 0 AND o % 2000 = 0 THEN sha256(encode(text)[o + 1 : o + l]) END AS digest FROM g
""")
def adopt_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cut that can take over every second object of every second file."""
    cut = planning.hash_grid(table(spark, sf_dir, "documents"), ["doc_id"], 1000, "text")
    held = cut.where("doc_id % 2 = 0 and offset % 2000 = 0")
    return reads.adopt(cut.select("doc_id", "offset", "length"), held, ["doc_id"])


# ---- headers and rules: parts as header entries

NAME = "concat('model.blocks.', p_size, '.', replace(p_name, ' ', '_'), '.', p_partkey, '.weight')"
HEADER_SQL = "SELECT p_brand AS artifact, lower(p_type) || '/part-' || p_partkey % 3 || '.safetensors' AS member, p_partkey AS ord, 'model.blocks.' || p_size || '.' || replace(p_name, ' ', '_') || '.' || p_partkey || '.weight' AS name, ['F32', 'BF16', 'F16'][p_partkey % 3 + 1] AS dtype, [p_size * 8, (p_partkey % 8 + 1) * 16]::BIGINT[] AS shape FROM part"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("artifact"), F.concat(F.lower("p_type"), F.lit("/part-"), (F.col("p_partkey") % 3).cast("string"), F.lit(".safetensors")).alias("member"), F.col("p_partkey").alias("ord"), F.expr(NAME).alias("name"),
        F.element_at(F.array(F.lit("F32"), F.lit("BF16"), F.lit("F16")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("dtype"), F.array((F.col("p_size") * 8).cast("long"), (F.col("p_partkey") % 8 + 1) * 16).alias("shape"),
    )


REKEYS = [{"from_key": "model.blocks.{i}.red_widget.{i}.weight", "to_key": "net.{i}.red.{i}.w"}, {"from_prefix": "model.blocks.1", "to_prefix": "one."}, {"from_prefix": "model.", "to_prefix": "root."}]
TOPOLOGY_SQL = f"SELECT artifact AS topology, member AS component, 0 AS component_ord, CASE WHEN member LIKE 'economy%' THEN 'denoiser' ELSE 'vae' END AS role, name AS key, shape, CASE WHEN dtype = 'F16' THEN dtype END AS island, 'BF16' AS dtype FROM ({HEADER_SQL})"


def topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    role = F.when(F.col("member").startswith("economy"), "denoiser").otherwise("vae")
    return h.select(F.col("artifact").alias("topology"), F.col("member").alias("component"), F.lit(0).alias("component_ord"), role.alias("role"), F.col("name").alias("key"), "shape", F.when(F.col("dtype") == "F16", F.col("dtype")).alias("island"), F.lit("BF16").alias("dtype"))


@query(f"""
SELECT name, CASE WHEN regexp_matches(name, '^model\\.blocks\\.(0|[1-9][0-9]*)\\.red_widget\\.(0|[1-9][0-9]*)\\.weight$') THEN regexp_replace(name, '^model\\.blocks\\.(0|[1-9][0-9]*)\\.red_widget\\.(0|[1-9][0-9]*)\\.weight$', 'net.\\1.red.\\2.w')
  WHEN starts_with(name, 'model.blocks.1') THEN 'one.' || substr(name, 15) WHEN starts_with(name, 'model.') THEN 'root.' || substr(name, 7) ELSE name END AS renamed FROM ({HEADER_SQL})
""")
def rekey_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("name", morphisms.rekey(F.col("name"), REKEYS).alias("renamed"))


@query(f"SELECT name, regexp_matches(name, '^model\\.blocks\\.(0|[1-9][0-9]*)\\.small_ring\\.(0|[1-9][0-9]*)\\.weight$') AS hit FROM ({HEADER_SQL})")
def hole_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir).select("name", F.col("name").rlike(morphisms.pattern_regex("model.blocks.{i}.small_ring.{i}.weight")).alias("hit"))


@query(f"""
WITH h AS ({HEADER_SQL}), s AS (SELECT artifact, dtype, sum(shape[1] * shape[2] * CASE dtype WHEN 'F32' THEN 4 ELSE 2 END) AS w FROM h GROUP BY ALL)
SELECT artifact, arg_max(dtype, (w, 1000 - ascii(dtype) * 2 - length(dtype))) AS dtype FROM s GROUP BY artifact
""")
def role_dominant_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.dominant_dtype(headers(spark, sf_dir), ["artifact"])


RULE = {
    "name": "demo.fp8-rowwise", "version": 1, "base_dtype": "BF16", "reference_tolerant": True, "scope_roles": ["denoiser"],
    "eligible": {"source_dtypes": ["F32", "BF16"], "rank": 2, "key_suffix": ".weight", "dim_align": [16, 16], "require_repeated_block_segment": True, "skip_module_substrings": ["red", "large"], "skip_module_exact": ["proj"]},
    "emissions": [{"key": "{module}.weight", "dtype": "F8_E4M3", "shape": ["d0", "d1"]}, {"key": "{module}.weight_scale", "dtype": "F32", "shape": ["d0"]}, {"key": "{key}_blocks", "dtype": "U8", "shape": ["ceil(d0/128)*128*ceil(d1/16/4)*4"], "optional": True}],
}
ELIGIBLE_SQL = "(role = 'denoiser' AND coalesce(island, dtype) IN ('F32', 'BF16') AND shape[1] % 16 = 0 AND shape[2] % 16 = 0 AND NOT contains(key, 'red') AND NOT contains(key, 'large'))"


@query(f"SELECT topology, key, {ELIGIBLE_SQL} AS eligible FROM ({TOPOLOGY_SQL})")
def eligible_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topologies(spark, sf_dir).select("topology", "key", rules.eligible(RULE).alias("eligible"))


@query(f"""
WITH t AS (SELECT *, {ELIGIBLE_SQL} AS hit, key[1 : length(key) - 7] AS module FROM ({TOPOLOGY_SQL}))
SELECT topology, component, key, ['F8_E4M3'] AS dtypes, shape, false AS optional, true AS transformed, NULL::VARCHAR AS reason FROM t WHERE hit
UNION ALL SELECT topology, component, module || '.weight_scale', ['F32'], [shape[1]], false, true, NULL FROM t WHERE hit
UNION ALL SELECT topology, component, key || '_blocks', ['U8'], [((shape[1] + 127) // 128) * 128 * (((shape[2] + 15) // 16 + 3) // 4) * 4], true, true, NULL FROM t WHERE hit
UNION ALL SELECT topology, component, key, CASE WHEN island IS NOT NULL THEN ['BF16', island] ELSE ['BF16'] END, shape, false, false, NULL FROM t WHERE NOT hit
""")
def layout_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rule(topologies(spark, sf_dir), RULE).select("topology", "component", "key", "dtypes", "shape", "optional", "transformed", "reason")


@query(f"SELECT name, [shape[1] // 8, CASE WHEN shape[1] % 16 = 0 THEN shape[1] // 16 ELSE -1 END, ((shape[1] + 127) // 128) * 128] AS dims FROM ({HEADER_SQL})")
def shape_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    return h.select("name", F.array(*(F.coalesce(dimensions([f], F.col("shape"))[0], F.lit(-1)).cast("long") for f in ("d0/8", "d0/16", "ceil(d0/128)*128"))).alias("dims"))


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts for each brand: its own header as it is, and one with another type that comes first."""
    h = headers(spark, sf_dir).select(F.col("artifact").alias("brand"), F.col("member").alias("component"), F.col("name").alias("key"), "dtype", "shape", "ord")
    bad = h.select(F.concat(F.lit("a."), "brand").alias("layout"), F.lit(0).alias("layout_ord"), "component", F.lit(0).alias("component_ord"), "key", F.array(F.lit("F64")).alias("dtypes"), "shape", F.lit(False).alias("optional"), F.lit(False).alias("vacant"))
    good = h.select(F.concat(F.lit("b."), "brand").alias("layout"), F.lit(1).alias("layout_ord"), "component", F.lit(0).alias("component_ord"), "key", F.array("dtype").alias("dtypes"), F.when(F.col("ord") % 97 == 5, F.array(F.lit(1).cast("long"))).otherwise(F.col("shape")).alias("shape"), F.lit(False).alias("optional"), F.lit(False).alias("vacant"))
    return bad.unionByName(good)


@query(f"""
WITH h AS ({HEADER_SQL}), m AS (SELECT artifact, min(member) AS member FROM h WHERE ord % 97 = 5 GROUP BY artifact),
bad AS (SELECT artifact, member, min(ord) AS at FROM h JOIN m USING (artifact, member) WHERE ord % 97 = 5 GROUP BY ALL),
x AS (SELECT bad.artifact, count(h.ord) AS matched FROM bad LEFT JOIN h ON h.artifact = bad.artifact AND h.member = bad.member AND h.ord < bad.at GROUP BY ALL)
SELECT DISTINCT h.artifact, CASE WHEN x.artifact IS NULL THEN 'b.' || h.artifact END AS layout, CASE WHEN matched > 0 THEN 'shape' WHEN matched = 0 THEN 'dtype' END AS reason FROM h LEFT JOIN x USING (artifact)
""")
def stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layout each brand's header is; some differ in a shape."""
    return decide.stamp(headers(spark, sf_dir), _layouts(spark, sf_dir)).select("artifact", "layout", "reason")


@query(f"""
WITH h AS ({HEADER_SQL}), bad AS (SELECT artifact, member, name, ord FROM h WHERE ord % 97 = 5), m AS (SELECT artifact, min(member) AS member FROM bad GROUP BY artifact), f AS (SELECT b.artifact, b.member, arg_min(b.name, b.ord) AS tensor, min(b.ord) AS at FROM bad b JOIN m USING (artifact, member) GROUP BY ALL)
SELECT f.artifact, (SELECT count(*) FROM h WHERE h.artifact = f.artifact AND h.member = f.member AND h.ord < f.at) AS matched, f.tensor, 'shape' AS reason FROM f
WHERE EXISTS (SELECT 1 FROM h WHERE h.artifact = f.artifact AND h.member = f.member AND h.ord < f.at)
""")
def closest_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand without a layout, the refusal that came closest, where it matched anything at all."""
    return decide.stamp(headers(spark, sf_dir), _layouts(spark, sf_dir)).where("layout is null and matched > 0 and reason = 'shape'").select("artifact", "matched", "tensor", "reason")


EDGES = [("a", "b", "m1", 1), ("b", "c", "m2", 2), ("a", "c", "m9", 3), ("c", "d", "m3", 1), ("b", "d", "m8", 4), ("d", "e", "m4", 2), ("e", "a", "m5", 1)]
EDGES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{n}', {t})" for a, b, n, t in EDGES) + ") e(a, b, name, tier)"


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(decide.routes(EDGES), "source string, target string, steps array<string>, cost int, worst int").withColumn("hops", F.size("steps"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey + 1) % 25 FROM nation),
w AS (SELECT DISTINCT a AS source, a AS target, 0 AS hops FROM e UNION SELECT w.source, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.target WHERE w.hops < 25)
SELECT source::VARCHAR AS source, target::VARCHAR AS target, min(hops)::INTEGER AS hops FROM w GROUP BY ALL
""")
def route_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as topologies, each with morphisms to two others; 25 rows, as a catalogue has few, so the search is the driver's."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").collect()
    edges = sorted({(str(r[0]), str(b), f"{r[2]}-{k}", k + 1) for r in n for k, b in enumerate(((r[0] * 7 + 3) % 25, (r[0] + r[1] + 1) % 25))})
    found = [(a, b, len(steps)) for a, b, steps, *_ in decide.routes(edges)]
    return spark.createDataFrame(found, "source string, target string, hops int")


@query(f"""
WITH RECURSIVE w AS (SELECT DISTINCT a AS source, a AS target, 0 AS hops, 0 AS cost, ''::VARCHAR AS path FROM {EDGES_SQL} UNION ALL SELECT w.source, e.b, w.hops + 1, w.cost + e.tier, w.path || e.name FROM w JOIN {EDGES_SQL} ON e.a = w.target WHERE w.hops < 5),
r AS (SELECT source, target, min(hops) AS hops, arg_min(cost, (hops, path)) AS cost FROM w GROUP BY ALL),
s AS (SELECT p_partkey AS artifact, ['a', 'b', 'c', 'd', 'e', 'x'][p_partkey % 6 + 1] AS topology, ['plain', 'fp8', 'fp4'][p_size % 3 + 1] AS quant, ['torch.contiguous@1', 't'][p_size % 2 + 1] AS arrangement FROM part),
l AS (SELECT * FROM (VALUES ('L1', 0, 'c', 'plain', 'torch.contiguous@1'), ('L2', 1, 'e', 'fp8', 't'), ('L3', 2, 'a', 'plain', 'cand')) l(lane, lane_ord, topology, quant, arrangement)),
p AS (SELECT s.artifact, l.lane, l.lane_ord, CASE WHEN s.topology = l.topology THEN 0 ELSE r.hops END AS hops, CASE WHEN s.topology = l.topology THEN 0 ELSE r.cost END AS rc, s.quant AS sq, l.quant AS lq, s.arrangement AS sa, l.arrangement AS la
      FROM s JOIN l ON true LEFT JOIN r ON r.source = s.topology AND r.target = l.topology WHERE s.topology = l.topology OR r.hops IS NOT NULL),
c AS (SELECT *, CASE WHEN sq <> lq AND sq = 'fp4' THEN 'no-inverse' WHEN sa <> la AND la = 'cand' THEN 'candidate' END AS reason, rc + CASE WHEN sq = lq OR sq = 'fp4' THEN 0 ELSE 4 END + CASE WHEN sa = la OR la = 'cand' THEN 0 ELSE 3 END AS cost, hops = 0 AND sq = lq AND sa = la AS exact FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY (reason IS NOT NULL), NOT exact, cost, lane_ord) AS k FROM c)
SELECT s.artifact, CASE WHEN reason IS NULL THEN lane END AS lane, CASE WHEN b.artifact IS NULL OR reason IS NOT NULL THEN 'refuse' WHEN exact THEN 'admit' ELSE 'derive' END AS decision, CASE WHEN b.artifact IS NOT NULL AND reason IS NULL THEN cost ELSE -1 END::BIGINT AS cost,
  CASE WHEN b.artifact IS NULL THEN 'no-bridge' ELSE reason END AS reason FROM s LEFT JOIN b ON b.artifact = s.artifact AND k = 1
""")
def admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stamps against three lanes."""
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    stamps = table(spark, sf_dir, "part").select(key.alias("artifact"), at("abcdex", key % 6).alias("topology"), at(("plain", "fp8", "fp4"), size % 3).alias("quant"), at(("torch.contiguous@1", "t"), size % 2).alias("arrangement"))
    lanes = spark.createDataFrame([("L1", 0, "c", "plain", "torch.contiguous@1"), ("L2", 1, "e", "fp8", "t"), ("L3", 2, "a", "plain", "cand")], "lane string, lane_ord int, topology string, quant string, arrangement string")
    quants = spark.createDataFrame([("plain", False, False), ("fp8", True, True), ("fp4", True, False)], "quant string, transforms boolean, inverse boolean")
    records = spark.createDataFrame([("torch.contiguous@1", 0, False), ("t", 2, False), ("cand", 2, True)], "arrangement string, rank int, candidate boolean")
    return decide.admit(stamps, lanes, _routes(spark), quants, records).select("artifact", "lane", "decision", F.coalesce("cost", F.lit(-1)).cast("long").alias("cost"), "reason")


# ---- morphisms

SEAM = {"target": "{i}.qkv", "component": "", "groups": 1, "parts": [{"role": "q", "share": 1, "key": "{i}.q"}, {"role": "k", "share": 1, "key": "{i}.k"}, {"role": "v", "share": 2, "key": "{i}.v"}]}


@query("""
WITH p AS (SELECT p_partkey AS i, p_size AS n FROM part)
SELECT i || '.qkv' AS target, [4 * n, 64]::BIGINT[] AS shape, CASE WHEN i % 5 = 0 THEN 'parts' WHEN i % 5 = 1 THEN 'inner' END AS reason FROM p WHERE i % 5 > 1
UNION ALL SELECT i || '.qkv', CASE WHEN i % 5 = 0 THEN [2 * n, 64] ELSE [4 * n, 64] END::BIGINT[], CASE WHEN i % 5 = 0 THEN 'parts' ELSE 'inner' END FROM p WHERE i % 5 <= 1
""")
def fuse_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split projections fused; some lack a part, some differ in width."""
    p = table(spark, sf_dir, "part")
    i, n = F.col("p_partkey"), F.col("p_size").cast("long")
    wide = F.when(i % 5 == 1, F.lit(32)).otherwise(F.lit(64)).cast("long")
    parts = F.array(F.struct(F.lit("q").alias("part"), F.array(n, F.lit(64).cast("long")).alias("shape")), F.struct(F.lit("k").alias("part"), F.array(n, wide).alias("shape")), F.struct(F.lit("v").alias("part"), F.array(2 * n, F.lit(64).cast("long")).alias("shape")))
    rows = p.withColumn("x", F.explode(parts)).where(~((i % 5 == 0) & (F.col("x.part") == "v")))
    t = rows.select(F.lit("t").alias("topology"), F.lit("").alias("component"), F.concat(i.cast("string"), F.lit("."), F.col("x.part")).alias("key"), F.col("x.shape").alias("shape"))
    return morphisms.fuse(t, SEAM, 0).select("target", "shape", "reason")


@query("""
SELECT p_partkey || '.' || part AS key, [(p_size // 4) * share, 16]::BIGINT[] AS shape, CASE WHEN p_size % 4 <> 0 THEN 'shares' END AS reason FROM part, (VALUES ('q', 1), ('k', 1), ('v', 2)) s(part, share)
""")
def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.lit("t").alias("topology"), F.lit("").alias("component"), F.concat(F.col("p_partkey").cast("string"), F.lit(".qkv")).alias("key"), F.array(F.col("p_size").cast("long"), F.lit(16).cast("long")).alias("shape"))
    return morphisms.split(t, SEAM, 0).select("key", "shape", "reason")


@query(f"""
WITH t AS ({TOPOLOGY_SQL}), l AS (SELECT component, key, shape FROM t WHERE key NOT LIKE '%.7.%'), r AS (SELECT component, key, CASE WHEN contains(key, 'ring') THEN [1]::BIGINT[] ELSE shape END AS shape FROM t WHERE key NOT LIKE '%.9.%')
SELECT component, key, CASE WHEN l.shape IS NULL THEN 'only-right' WHEN r.shape IS NULL THEN 'only-left' ELSE 'shape' END AS reason FROM l FULL JOIN r USING (component, key) WHERE l.shape IS NULL OR r.shape IS NULL OR l.shape <> r.shape
""")
def same_topology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topologies(spark, sf_dir)
    left = t.where("key not like '%.7.%'")
    right = t.where("key not like '%.9.%'").withColumn("shape", F.when(F.contains("key", F.lit("ring")), F.array(F.lit(1).cast("long"))).otherwise(F.col("shape")))
    return morphisms.difference(left, right)


@query(f"SELECT artifact, name, \"offset\", (sum(length) OVER (PARTITION BY artifact ORDER BY ord) - length)::BIGINT AS new_offset FROM (SELECT artifact, name, ord, ord * 100 AS \"offset\", shape[1] * shape[2] AS length FROM ({HEADER_SQL})) WHERE name LIKE '%ring%'")
def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir).select("artifact", "name", (F.col("ord") * 100).alias("offset"), (F.col("shape")[0] * F.col("shape")[1]).alias("length"))
    kept, _ = reads.subset(h, h.where("name like '%ring%'").select("artifact", "name"), ["artifact"])
    return kept.select("artifact", "name", "offset", "new_offset")


# ---- arrangements and conversions

TRANSPOSED = {"rank": 2, "sub_axes": [{"axis": 0, "extent": "d0"}, {"axis": 1, "extent": "d1"}], "permutation": [1, 0], "candidate": False}
CHANNELS_LAST = {"rank": 4, "sub_axes": [{"axis": a, "extent": f"d{a}"} for a in range(4)], "permutation": [0, 2, 3, 1], "candidate": False}
BLOCKSCALE = {"rank": 2, "sub_axes": [{"axis": 0, "extent": "ceil(d0/128)"}, {"axis": 0, "extent": "4"}, {"axis": 0, "extent": "32"}, {"axis": 1, "extent": "ceil(d1/4)"}, {"axis": 1, "extent": "4"}], "permutation": [0, 3, 2, 1, 4], "candidate": False}


@query("SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[(i % 8) * 8 + i // 8 + 1]) AS moved FROM embeddings")
def relayout_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", relayout.apply(F.col("embedding"), [8, 8], TRANSPOSED).alias("moved"))


@query("SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[(i // 32) * 32 + (i % 2) * 16 + (i // 8 % 4) * 4 + (i // 2 % 4) + 1]) AS moved FROM embeddings")
def channels_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", relayout.apply(F.col("embedding"), [2, 2, 4, 4], CHANNELS_LAST).alias("moved"))


@query("SELECT vec_id, embedding AS back FROM embeddings")
def relayout_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", relayout.apply_inverse(relayout.apply(F.col("embedding"), [2, 2, 4, 4], CHANNELS_LAST), [2, 2, 4, 4], CHANNELS_LAST).alias("back"))


@query("""
SELECT p_partkey, ((p_size + 127) // 128) * 128 * ((p_partkey % 9 + 4) // 4) * 4 AS elements, p_size % 128 <> 0 OR (p_partkey % 9 + 1) % 4 <> 0 AS padded,
  [(p_size + 127) // 128, (p_partkey % 9 + 4) // 4, 32, 4, 4]::BIGINT[] AS storage FROM part WHERE p_size > 0
""")
def blockscale_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 9 + 1)
    p = relayout.plan(shape, BLOCKSCALE)
    return table(spark, sf_dir, "part").where("p_size > 0").select("p_partkey", p["elements"].alias("elements"), p["padded"].alias("padded"), p["storage"].alias("storage"))


E4M3_SQL = """CASE WHEN m = 0 THEN 0.0 WHEN m < 0.015625 THEN least(round_even(m * 512, 0), 7) / 512 ELSE least(round_even(m / pow(2, e - 3), 0) * pow(2, e - 3), 448.0) END"""


@query("SELECT vec_id, greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 448.0, 1e-12) AS scale FROM embeddings")
def fp8_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.quantise_rows(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "scale")


@query(f"""
WITH s AS (SELECT vec_id, embedding, greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 448.0, 1e-12) AS scale FROM embeddings),
v AS (SELECT vec_id, k, embedding[k]::DOUBLE / scale AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM s)),
m AS (SELECT *, least(abs(x), 448.0) AS m, greatest(floor(log2(CASE WHEN x = 0 THEN 1 ELSE least(abs(x), 448.0) END)), -6) AS e FROM v)
SELECT vec_id, list(CASE WHEN x < 0 THEN -({E4M3_SQL}) ELSE {E4M3_SQL} END ORDER BY k) AS codes FROM m GROUP BY vec_id
""")
def fp8_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.quantise_rows(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "codes")


@query()
def dequant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.dequantise_error(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "scale", "error")


@query(f"""
WITH t AS (SELECT artifact, member AS component, name, dtype, shape, ord FROM ({HEADER_SQL})), l AS (SELECT component, key, dtypes, shape, optional FROM (
  SELECT topology, component, key, ['F8_E4M3'] AS dtypes, shape, false AS optional FROM ({TOPOLOGY_SQL}) WHERE {ELIGIBLE_SQL}
  UNION ALL SELECT topology, component, key, CASE WHEN island IS NOT NULL THEN ['BF16', island] ELSE ['BF16'] END, shape, false FROM ({TOPOLOGY_SQL}) WHERE NOT {ELIGIBLE_SQL}))
SELECT t.artifact, t.name, CASE WHEN list_contains(l.dtypes, t.dtype) THEN 'inherit' WHEN list_contains(l.dtypes, 'F8_E4M3') THEN 'quantize-rowwise' ELSE 'cast' END AS step FROM t JOIN l ON l.component = t.component AND l.key = t.name
""")
def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = rules.apply_rule(topologies(spark, sf_dir), RULE)
    tensors = headers(spark, sf_dir).withColumnRenamed("member", "component")
    return convert.conversion_plan(tensors, layout).select("artifact", "name", "step")


@query("""
WITH l AS (SELECT lang, min(doc_id) * 3 + 1 AS inode FROM documents GROUP BY lang), s AS (SELECT lang, source, min(doc_id) * 3 + 2 AS inode FROM documents GROUP BY ALL)
SELECT inode, lang AS path FROM l UNION ALL SELECT inode, lang || '/' || source FROM s UNION ALL SELECT doc_id * 3 + 3, lang || '/' || source || '/' || doc_id FROM documents
""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories by language and source, a file a document; only parents and names are given."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    langs = d.groupBy("lang").agg((F.min("doc_id") * 3 + 1).alias("up"))
    sources = d.groupBy("lang", "source").agg((F.min("doc_id") * 3 + 2).alias("inode"))
    root = langs.select(F.lit(0).cast("long").alias("parent"), F.col("lang").alias("name"), F.col("up").alias("inode"))
    middle = sources.join(langs, "lang").select(F.col("up").alias("parent"), F.col("source").alias("name"), "inode")
    leaves = d.join(sources, ["lang", "source"]).select(F.col("inode").alias("parent"), F.col("doc_id").cast("string").alias("name"), (F.col("doc_id") * 3 + 3).alias("inode"))
    return store.tree_paths(root.unionByName(middle).unionByName(leaves))


# ---- runs, records, lanes

RECORDS_SQL = "SELECT source, doc_id AS ord, lang = 'de' AS hole, n_chars AS length FROM documents"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("source", F.col("doc_id").alias("ord"), (F.col("lang") == "de").alias("hole"), F.lit(None).cast("string").alias("digest"), F.col("n_chars").alias("length"))


@query(f"""
WITH b AS (SELECT *, lag(hole) OVER (PARTITION BY source ORDER BY ord) AS before FROM ({RECORDS_SQL})),
w AS (SELECT source, min(CASE WHEN length <= 0 THEN 2 WHEN hole AND coalesce(before, false) THEN 3 WHEN NOT hole AND length > 20000 THEN 4 END) AS why, sum(length) AS total FROM b GROUP BY source)
SELECT source, coalesce(['', 'zero-length', 'adjacent-holes', 'record-size'][why], CASE WHEN total <> total + length(source) % 2 THEN 'sum' END) AS reason FROM w WHERE reason IS NOT NULL
""")
def record_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with holes side by side or records over 20,000; sources with odd names claim a byte more than they have."""
    r = records(spark, sf_dir)
    sizes = r.groupBy("source").agg((F.sum("length") + F.length("source") % 2).alias("size"))
    return store.record_refusals(r, sizes, ["source"], 20_000)


@query(f"""
WITH s AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({RECORDS_SQL}))
SELECT source, ord, least(length, 30000 - start)::BIGINT AS length, CASE WHEN NOT hole AND start + length > 30000 THEN 'inside-data' END AS reason FROM s WHERE start < 30000 AND source IN (SELECT source FROM documents GROUP BY source HAVING sum(n_chars) >= 30000)
""")
def truncate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run cut to 30,000 bytes, where it is longer."""
    r = records(spark, sf_dir)
    whole = r.join(r.groupBy("source").agg(F.sum("length").alias("total")).where("total >= 30000"), "source").drop("total")
    return store.truncate(whole, ["source"], F.lit(30_000).cast("long")).select("source", "ord", "length", "reason")


@query("SELECT lang, path, row_number() OVER (PARTITION BY lang ORDER BY path) - 1 AS ordinal FROM (SELECT lang, source || '/' || doc_id AS path FROM documents)")
def path_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").select("lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit("file").alias("kind"))
    return store.ordinals(e, ["lang"]).select("lang", "path", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT source AS session, doc_id::VARCHAR AS digest, CASE WHEN doc_id % 2 = 0 AND n_chars > 3000 THEN 'too-large-for-pack' ELSE 'small-blob' END AS reason FROM documents WHERE (doc_id % 2 = 0 AND n_chars > 3000) OR (doc_id % 2 = 1 AND n_chars <= 3000)")
def lane_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("doc_id").cast("string").alias("digest"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 2 == 0, "pack").otherwise("blob").alias("lane"))
    return transfer.lane_refusals(d, 3000)


@query("""
SELECT p_brand AS artifact, p_partkey || '.qkv' AS name, g * 3 + p AS ord, (p_partkey * 1000 + (g * 4 + [0, 1, 2][p + 1]) * unit)::BIGINT AS "offset", ([1, 1, 2][p + 1] * unit)::BIGINT AS length
FROM (SELECT p_brand, p_partkey, p_size, p_size * 1048576 AS unit FROM part WHERE p_partkey % 3 > 0), (VALUES (0), (1)) g(g), (VALUES (0), (1), (2)) p(p)
""")
def seam_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused projections of two groups cut at their seams; every third has rows that don't divide."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = F.when(n % 3 == 0, size * 8 + 1).otherwise(size * 8)
    t = table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_brand").alias("artifact"), F.concat(n.cast("string"), F.lit(".qkv")).alias("name"), F.array(rows, F.lit(4).cast("long")).alias("shape"), (n * 1000).alias("offset"), (size * 8 * (1 << 20)).alias("length"))
    entry_ = {"pattern": "{i}.qkv", "fusion": {"axis": 0, "groups": 2, "parts": [{"role": "q", "share": 1}, {"role": "k", "share": 1}, {"role": "v", "share": 2}]}}
    out = planning.seam_cuts(t, [entry_], ["artifact"])
    return out.select("artifact", "name", F.col("ord").cast("long").alias("ord"), "offset", "length")


@query("SELECT p_brand AS artifact, CASE WHEN p_partkey % 5 = 0 THEN 'new.' || p_name || p_partkey ELSE p_name || p_partkey END AS name, p_name || p_partkey AS source FROM part")
def rekeyed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("artifact"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), "p_partkey")
    names = p.where("p_partkey % 5 = 0").select(F.col("name").alias("old"), F.concat(F.lit("new."), "name").alias("new"))
    return reads.rekeyed(p, names, ["artifact"]).where("reason is null").select("artifact", "name", "source")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """What a publisher of the documents has and needs."""
    return have_need_plan(spark, sf_dir)
