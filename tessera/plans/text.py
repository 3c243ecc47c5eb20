"""Word counts, shards, parsers, logs and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import linalg, scalars
from tessera.operators import ring, sharding, sync_modes, wordcount
from tessera.plans.tables import SHARDS, table
from tessera.sources import metrics as metric_tables
from tessera.sources import points as point_files
from tessera.sources import text as logs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = r"w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents), v AS (SELECT * FROM w WHERE length(word) >= {})"


@query(f"WITH {_WORDS.format(1)} SELECT word, count(*) AS n FROM v GROUP BY word ORDER BY n DESC, word LIMIT 20")
def wordcount_top20(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return wordcount.top(wordcount.merge(wordcount.shard_counts(docs, sharding.by_key("doc_id", SHARDS))), 20)


@query(f"WITH {_WORDS.format(1)} SELECT word, count(*) AS n FROM v GROUP BY word")
def wordcount_full(spark, sf):
    return wordcount.word_count(table(spark, sf, "documents"))


@query(f"WITH {_WORDS.format(2)} SELECT word, count(*) AS n FROM v GROUP BY word")
def wordcount_minlen2(spark, sf):
    return wordcount.word_count(table(spark, sf, "documents"), min_len=2)


@query(f"WITH {_WORDS.format(1)} SELECT doc_id % 4 AS shard, word, count(*) AS n FROM v GROUP BY ALL")
def wordcount_shard_partial(spark, sf):
    return wordcount.shard_counts(table(spark, sf, "documents"), sharding.by_key("doc_id", SHARDS))


@query(f"WITH {_WORDS.format(1)}, p AS (SELECT doc_id % 4 AS shard, word, count(*) AS n FROM v GROUP BY ALL) SELECT word, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY word")
def wordcount_shard_merge(spark, sf):
    return wordcount.merge(wordcount.shard_counts(table(spark, sf, "documents"), sharding.by_key("doc_id", SHARDS)))


_NUMBERED = "n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents)"


@query(f"WITH {_NUMBERED} SELECT doc_id, line, line % 4 AS shard FROM n")
def shard_round_robin(spark, sf):
    return sharding.round_robin(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "line", "shard")


@query(f"WITH {_NUMBERED}, t AS (SELECT ceil(count(*) / 4.0) AS size FROM documents) SELECT doc_id, CAST(floor(line / size) AS BIGINT) AS shard FROM n, t")
def shard_contiguous(spark, sf):
    return sharding.contiguous(table(spark, sf, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "shard")


@query(
    f"WITH {_NUMBERED}, t AS (SELECT count(*) AS total FROM documents), h AS (SELECT line % 4 AS shard, count(*) AS num_lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS file_size_bytes FROM n GROUP BY 1) "
    "SELECT shard, num_lines, file_size_bytes, CAST(shard * ceil(total / 4.0) AS BIGINT) AS start_line, CAST(least((shard + 1) * ceil(total / 4.0), total) AS BIGINT) AS end_line FROM h, t"
)
def shard_meta(spark, sf):
    return sharding.shard_meta(sharding.round_robin(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", SHARDS), SHARDS)


@query("SELECT count(*) AS lines FROM documents")
def line_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("lines"))


def _lines(spark, sf) -> DataFrame:
    """Point lines, some of them dirty, from line items."""
    k = F.col("l_orderkey") % 9
    row = F.concat_ws(",", F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    line = F.when(k == 0, "f0,f1,f2").when(k == 1, F.concat(row, F.lit(","))).when(k == 2, F.concat_ws(",", row, F.lit("7"))).when(k == 3, F.concat(F.lit(" "), row)).when(k == 4, "").when(k == 5, F.regexp_replace(row, ",", ",,")).when(k == 6, "1,x,3").otherwise(row)
    return table(spark, sf, "lineitem").select(line.alias("value"))


_LINES = """r AS (SELECT l_orderkey % 9 AS k, concat_ws(',', CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS row FROM lineitem),
l AS (SELECT CASE k WHEN 0 THEN 'f0,f1,f2' WHEN 1 THEN row || ',' WHEN 2 THEN concat_ws(',', row, '7') WHEN 3 THEN ' ' || row WHEN 4 THEN '' WHEN 5 THEN replace(row, ',', ',,') WHEN 6 THEN '1,x,3' ELSE row END AS value FROM r)"""


@query(
    f"WITH {_LINES}, t AS (SELECT list_filter(list_transform(string_split(value, ','), lambda x: trim(x)), lambda x: x <> '') AS t FROM l), "
    "v AS (SELECT list_transform(t, lambda x: TRY_CAST(x AS DOUBLE)) AS f FROM t WHERE len(t) = 3) "
    "SELECT f[1] AS f0, f[2] AS f1, f[3] AS f2, count(*) AS n FROM v WHERE f[1] IS NOT NULL AND f[2] IS NOT NULL AND f[3] IS NOT NULL GROUP BY ALL"
)
def points_parse_dirty(spark, sf):
    got = point_files.parse_points(_lines(spark, sf), 3)
    return got.groupBy(*(F.element_at("features", k + 1).alias(f"f{k}") for k in range(3))).agg(F.count("*").alias("n"))


@query(
    f"WITH {_LINES}, t AS (SELECT list_transform(string_split(trim(value), ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS f FROM l) "
    "SELECT f[3] AS label, round(sum(f[1]), 4) AS s0, round(sum(f[2]), 4) AS s1, count(*) AS n FROM t WHERE len(f) = 3 AND f[1] IS NOT NULL AND f[2] IS NOT NULL AND f[3] IS NOT NULL GROUP BY 1"
)
def labelled_parse_dirty(spark, sf):
    got = point_files.parse_labelled(_lines(spark, sf), 2)
    return got.groupBy("label").agg(F.round(F.sum(F.element_at("features", 1)), 4).alias("s0"), F.round(F.sum(F.element_at("features", 2)), 4).alias("s1"), F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('f0,f1,label', true, 3), ('1.5,2,3', false, 3), ('7', false, 1)) t(first_line, has_header, n_cols)")
def header_sniff(spark, sf):
    rows = []
    for line in ("f0,f1,label", "1.5,2,3", "7"):
        rows.append((line, *point_files.sniff_header(spark.createDataFrame([("",), (line,)], "value string"))))
    return spark.createDataFrame(rows, "first_line string, has_header boolean, n_cols int")


@query("SELECT CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, round(sum(l_quantity), 4) AS s FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def labelled_clean(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("f0"), F.col("l_linenumber").cast("double").alias("label"))
    return point_files.clean_labelled(df).groupBy(F.col("label").cast("bigint").alias("line")).agg(F.count("*").alias("n"), F.round(F.sum("f0"), 4).alias("s"))


def _log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").withColumn("pos", F.floor(F.col("event_id") / 25))
    k = F.col("event_id") % 25
    line = F.when(k == 1, F.format_string("[SparkSession] rank up local[%d] x heap=%d MB, was local[99] heap=1 MB", F.col("user_id") % 8 + 1, F.col("user_id") * 64)).when(k % 5 == 2, F.format_string("%s %d done", F.element_at(F.array(*(F.lit(x) for x in ("Iteration", "epoch", "Round:", "iters ="))), (F.col("user_id") % 4 + 1).cast("int")), F.col("user_id") % 40)).when(
        k == 8, F.format_string("Max-Iter iter 99 %d", F.col("user_id"))).when(k % 9 == 4, F.format_string("Total WCSS : %s", F.format_number(F.col("value") * 100, 2))).otherwise(F.concat(F.lit("note "), F.col("event_type")))
    return e.select(F.col("pos").alias("log"), k.alias("line_no"), line.alias("line"))


_LOG = """l AS (SELECT event_id // 25 AS log, event_id % 25 AS line_no, CASE WHEN event_id % 25 = 1 THEN format('[SparkSession] rank up local[{}] x heap={} MB, was local[99] heap=1 MB', user_id % 8 + 1, user_id * 64)
  WHEN event_id % 25 % 5 = 2 THEN format('{} {} done', (['Iteration', 'epoch', 'Round:', 'iters ='])[user_id % 4 + 1], user_id % 40) WHEN event_id % 25 = 8 THEN 'Max-Iter iter 99 ' || user_id
  WHEN event_id % 25 % 9 = 4 THEN 'Total WCSS : ' || format('{:,.2f}', value * 100) ELSE 'note ' || event_type END AS line FROM events)"""


# The oracles take the lines' own parts, not the patterns.
@query(f"WITH {_LOG}, h AS (SELECT log, arg_min(line, line_no) AS l FROM l WHERE line LIKE '[SparkSession]%' GROUP BY log) SELECT log, CAST(split_part(split_part(l, 'local[', 2), ']', 1) AS INT) AS cores, CAST(split_part(split_part(l, 'heap=', 2), ' ', 1) AS INT) AS heap_mb FROM h")
def log_regex_alloc(spark, sf):
    return logs.allocation(_log(spark, sf), "log", "line_no")


@query("SELECT event_id // 25 AS log, CAST(max(user_id % 40) AS INT) AS iterations FROM events WHERE event_id % 25 % 5 = 2 GROUP BY 1")
def log_regex_iters(spark, sf):
    return logs.iterations(_log(spark, sf), "log", "line_no")


@query("SELECT event_id // 25 AS log, arg_max(round(value * 100, 2), event_id % 25) FILTER (event_id % 25 IN (4, 13)) AS wcss FROM events GROUP BY 1")
def log_regex_wcss(spark, sf):
    whole = _log(spark, sf).groupBy("log").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return whole.select("log", logs.last_wcss(F.col("body")).alias("wcss"))


_LINES_BY_HAND = (
    (1, "[SparkSession] a local[4] b heap=3072 MB then local[9] heap=1 MB", 4, 3072, None, None), (2, "[SparkSession] local[2] heap=512MB", None, None, None, None),
    (3, "epoch 7", None, None, 7, None), (4, "Round 3", None, None, 3, None), (5, "iterations: 12", None, None, 12, None), (6, "Iteration [4]", None, None, 4, None),
    (7, "diter 9", None, None, None, None), (8, "MAX-ITER iter 50", None, None, None, None), (9, "max_iter: iter 60", None, None, None, None), (10, "iters=5 of round 8", None, None, 8, None),
    (11, "Total WCSS : 1.25e+07", None, None, None, 1.25e7), (12, "Total WCSS:2,616,692.1636", None, None, None, 2616692.1636), (13, "Total WCSS : none", None, None, None, None),
    (14, "Total WCSS : 5.5 Total WCSS : 4E-3", None, None, None, 0.004),
)


def _by_hand(k: int, name: str, kind: str) -> str:
    rows = ", ".join(f"({r[0]}, CAST({'NULL' if r[k] is None else repr(r[k])} AS {kind}))" for r in _LINES_BY_HAND)
    return f"SELECT CAST(log AS BIGINT) AS log, {name} FROM (VALUES {rows}) t(log, {name})"


def _hand_log(spark) -> DataFrame:
    return spark.createDataFrame([(r[0], 1, r[1]) for r in _LINES_BY_HAND], "log bigint, line_no int, line string")


@query(f"SELECT * FROM ({_by_hand(2, 'cores', 'INT')}) JOIN ({_by_hand(3, 'heap_mb', 'INT')}) USING (log) JOIN ({_by_hand(4, 'iterations', 'INT')}) USING (log) JOIN ({_by_hand(5, 'wcss', 'DOUBLE')}) USING (log)")
def log_lines_by_hand(spark, sf):
    """Each pattern over lines whose figures are written out by hand."""
    log = _hand_log(spark)
    out = log.select("log", logs.last_wcss(F.col("line")).alias("wcss"))
    return out.join(logs.allocation(log, "log", "line_no"), "log", "left").join(logs.iterations(log, "log", "line_no"), "log", "left")


@query("SELECT t, CAST(floor(mb) AS BIGINT) AS mb FROM (VALUES ('512m', 512.0), (' 4G ', 4096.0), ('2048k', 2.0), ('1073741824', 1024.0), ('1.5g', 1536.0), ('64MB', 64.0)) v(t, mb)")
def mem_parse(spark, sf):
    return spark.createDataFrame([(t,) for t in ("512m", " 4G ", "2048k", "1073741824", "1.5g", "64MB")], "t string").select("t", scalars.memory_mb(F.col("t")).alias("mb"))


@query("SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, ': (.*)}', 1) AS DOUBLE), 0.0) AS v FROM events")
def safe_float(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.number(F.regexp_extract("props", r": (.*)\}", 1)).alias("v"))


@query("SELECT CAST(s AS BIGINT) AS step, round(0.001 + 0.5 * (0.1 - 0.001) * (1 + cos(pi() * s / 30)), 9) AS rate FROM range(31) t(s)")
def cosine_lr(spark, sf):
    return spark.range(31).select(F.col("id").alias("step"), F.round(linalg.cosine_rate(F.col("id"), 30, 0.1, 0.001), 9).alias("rate"))


@query("SELECT CAST(s AS BIGINT) AS staleness, round(0.5 / (1 + greatest(s, 0)), 9) AS alpha FROM range(-2, 9) t(s)")
def staleness_alpha(spark, sf):
    return spark.range(-2, 9).select(F.col("id").alias("staleness"), F.round(linalg.staleness_rate(F.col("id")), 9).alias("alpha"))


@query(
    "WITH s AS (SELECT CAST(x AS BIGINT) AS shard FROM range(7) t(x)), d AS (SELECT unnest([1, -1, 2, -2]) AS step) SELECT DISTINCT shard, CAST(((shard + step) % 7 + 7) % 7 AS BIGINT) AS peer FROM s, d"
)
def ring_neighbours(spark, sf):
    return ring.neighbour_frame(spark.range(7).withColumnRenamed("id", "shard"), 7, 2)


@query(
    "SELECT * FROM (VALUES ('none','none'),('no_sync','none'),('queue','ps_sync_fedavg_queue'),('fedavg_queue','ps_sync_fedavg_queue'),('ps_sync_fedavg_queue','ps_sync_fedavg_queue'),"
    "('mpi_fedavg','ps_sync_fedavg_mpi'),('fedavg_mpi','ps_sync_fedavg_mpi'),('ps_sync_fedavg_mpi','ps_sync_fedavg_mpi'),('mpi','allreduce_mpi'),('allreduce','allreduce_mpi'),('allreduce_mpi','allreduce_mpi'),"
    "('async','ps_async'),('async_ps','ps_async'),('ps_async','ps_async'),('hybrid','hybrid_ps_allreduce'),('hybrid_ps_allreduce','hybrid_ps_allreduce'),('gossip','gossip'),('decentralized','gossip')) t(alias, mode)"
)
def sync_mode_alias(spark, sf):
    return sync_modes.alias_frame(spark)


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS digest, length(text) AS n FROM documents")
def text_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("digest"), F.length("text").cast("bigint").alias("n"))


@query("SELECT event_id, format('{}_{}_w{}_c{}_r{}', event_type, CASE WHEN user_id % 2 = 0 THEN 'none' ELSE 'gossip' END, user_id % 4, user_id % 8 + 1, event_id % 3) AS run_id FROM events")
def run_id_format(spark, sf):
    return table(spark, sf, "events").select("event_id", F.format_string("%s_%s_w%d_c%d_r%d", "event_type", F.when(F.col("user_id") % 2 == 0, "none").otherwise("gossip"), F.col("user_id") % 4, F.col("user_id") % 8 + 1, F.col("event_id") % 3).alias("run_id"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def utc_stamp(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


@query("SELECT event_id, event_type, round(value, 4) AS value FROM events")
def json_round_trip(spark, sf):
    """Records written as JSON texts and read back."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    back = metric_tables.decode(metric_tables.encode(e, ["event_id", "event_type", "value"]), metric_tables.ddl("event_id bigint, event_type string, value double"))
    return back.select("event_id", "event_type", F.round("value", 4).alias("value"))


@query("SELECT line, header, label_name, label_float FROM (VALUES (1, true, 'y', true), (2, false, 'label', false), (3, true, 'label', false)) t(line, header, label_name, label_float)")
def label_probe(spark, sf):
    rows = []
    for k, lines in enumerate((["f0,y", "1.5,1.0"], ["1.5,1", "2.5,0"], []), 1):
        i = point_files.template_info(spark.createDataFrame([(x,) for x in lines], "value string"))
        rows.append((k, i["header"], i["label_name"], i["label_float"]))
    return spark.createDataFrame(rows, "line int, header boolean, label_name string, label_float boolean")


@query("SELECT name, mode, exchanges FROM (VALUES ('no_sync', 'none', false), ('queue', 'ps_sync_fedavg_queue', false), ('mpi', 'allreduce_mpi', true), ('decentralized', 'gossip', true), ('hybrid', 'hybrid_ps_allreduce', true)) t(name, mode, exchanges)")
def mode_descriptors(spark, sf):
    rows = [(n, sync_modes.descriptor(n).name, sync_modes.exchanges(n)) for n in ("no_sync", "queue", "mpi", "decentralized", "hybrid")]
    return spark.createDataFrame(rows, "name string, mode string, exchanges boolean")


@query(f"WITH {_WORDS.format(1)}, c AS (SELECT word, count(*) AS n FROM v GROUP BY word) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS position FROM c QUALIFY position <= 2000 OR position % 100 = 0")
def wordcount_sorted(spark, sf):
    """All counts in order, most frequent first, numbered without one task that sorts them; some of the places."""
    counts = wordcount.word_count(table(spark, sf, "documents"), "text")
    # The count and the word's first two bytes, so that the many words of one count are split as well.
    prefix = F.conv(F.rpad(F.hex(F.substring(F.col("word").cast("binary"), 1, 2)), 4, "0"), 16, 10).cast("bigint")
    ordered = sharding.numbered(counts.withColumn("key", prefix - F.col("n") * 65536), "key", ties=["word"])
    return ordered.select("word", "n", (F.col("line") + 1).alias("position")).where("position <= 2000 or position % 100 = 0")
