"""The operators as queries over whole test tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querydelta.llm import bpe, chunks, decontaminate, langid, licences, mixing, neardup, packing, periods, pii, prefixes, quality, sharding, sql
from querydelta.llm.scratch import Scratch

#: Ends each document in token files.
END_ID = 2
SHARDS = 24


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).path("tokens")
    packing.write_token_files(_documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return packing.read_documents(spark, folder)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_documents(spark, sf_dir))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    added = F.when(F.col("added") == "", F.array().cast("array<string>")).otherwise(F.split("added", ","))

    def rank(span):
        kind, start = F.split(span, ":")[0], F.split(span, ":")[1].cast("bigint")
        return F.struct(start.alias("start"), F.array_position(F.array(*map(F.lit, pii.KINDS)), kind).alias("kind"), span.alias("span"))

    spans = F.transform(F.array_sort(F.transform(F.concat(base, added), rank)), lambda ranked: ranked["span"])
    return found.select(
        "doc_id",
        *[_count(base, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.col("base"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"),
    )


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda span: span.startswith(f"{kind}:"))).cast("bigint")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded_digests(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(SHARDS)
    return sharding.shard_documents(_documents(spark, sf_dir), tree, tree.with_region([[(SHARDS, 1.0)]]))


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprint_documents(_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return langid.identify_languages(_documents(spark, sf_dir), held_out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


WORD_GAPS = r"[\x20\x09-\x0D]+"


def _periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every tenth text made to repeat itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WORD_GAPS), lambda word: word != "")
    coded = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    coded = coded.select("*", F.size("words").cast("bigint").alias("n"))
    start = F.expr("g % n")
    period = F.floor((F.col("n") - start) / (3 + F.col("g") % 8)) + 1
    coded = coded.select("*", F.when(F.col("n") > 0, F.struct(start.alias("a"), period.alias("p"))).alias("cut"))
    a, p, rest = F.col("cut.a").cast("int"), F.col("cut.p").cast("int"), (F.col("n") - F.col("cut.a")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(rest / p).cast("int")))
    rebuilt = F.concat(F.slice("words", 1, a), F.slice(cycle, 1, rest))
    return coded.select("doc_id", F.when(F.col("cut").isNotNull(), F.array_join(rebuilt, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(_periodic(_documents(spark, sf_dir)))
    best = F.col("strongest")
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        *[best[name].alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Equal words of a text at any distance, joined to stretches; for small tables.
RUNS_SQL = f"""
WITH coded AS (
  SELECT doc_id, {sql.words("text")} AS w, {sql.crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
cut AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM coded),
rebuilt AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i:
    w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM cut),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM rebuilt),
same AS (
  SELECT x.doc_id, y.i - x.i AS period, x.i FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
placed AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS stretch FROM same),
stretches AS (
  SELECT doc_id, min(i) AS start, count(*) + period AS length, period FROM placed GROUP BY doc_id, period, stretch
  HAVING count(*) + period >= greatest(6, 4 * period)),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS text
  FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1)
SELECT rebuilt.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM rebuilt LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN best USING (doc_id)
"""

def op12_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    mixed = mixing.mix_sources(_documents(spark, sf_dir), words, weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same queues, merged in one window over all documents; for small tables.
MIX_SQL = f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len({sql.words("text")}) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * sum(size) AS cap,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source),
fill(turn, level) AS (
  SELECT 0, CAST((SELECT sum(source_size) FROM sources) / (SELECT sum(weight) FROM sources) AS DOUBLE)
  UNION ALL SELECT turn + 1, coalesce(
    (SELECT sum(source_size) FROM sources) - (SELECT sum(cap) FROM sources WHERE cap < weight * level), (SELECT sum(source_size) FROM sources))
    / (SELECT sum(weight) FROM sources WHERE cap >= weight * level) FROM fill WHERE turn < (SELECT count(*) FROM sources)),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM fill ORDER BY turn DESC LIMIT 1)) AS target FROM sources),
line AS (
  SELECT sized.doc_id, sized.source, size, source_size, target,
    sum(size) OVER (PARTITION BY sized.source ORDER BY CAST('0x' || substr(md5('mix:' || sized.doc_id), 1, 15) AS BIGINT), doc_id) AS before
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source WHERE size > 0),
copies AS (SELECT *, ((copy - 1) * source_size + before) / target AS finish FROM line, (VALUES (1), (2), (3)) c(copy)),
merged AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, before) AS upto FROM copies),
taken AS (
  SELECT doc_id, sum(size) AS taken FROM merged WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT sized.doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source LEFT JOIN taken USING (doc_id)
"""

def _rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first turns of every twentieth conversation put before those that follow it."""
    role, words = F.coalesce("role", F.lit("")), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.struct(
        "turn", role.alias("role"), prefixes.turn_token(F.col("role"), F.col("text")).alias("token"),
        F.coalesce(words, F.lit(0)).alias("words"),
    )
    own = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda turn: F.struct(turn["token"].alias("token"), turn["words"].alias("words"))).alias("own"))
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.when(F.col("head").isNotNull(), F.slice("head", 1, h)).otherwise(F.slice("own", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, members = prefixes.prefix_trie(_rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    digests = prefixes.member_digests(members)
    return nodes.join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: Every prefix of every conversation as a list, and every ancestor of every node; for small tables.
TRIE_SQL = f"""
WITH own AS (
  SELECT conv_id, list(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns,
    list(len({sql.words("text")}) ORDER BY turn NULLS FIRST) AS words FROM conversations GROUP BY conv_id),
cut AS (SELECT *, {sql.crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns,
    list_concat(list_slice(coalesce(b.words, []), 1, c.h), list_slice(c.words, c.h + 1, len(c.words))) AS words
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
coded AS (SELECT conv_id, list_transform(turns, lambda t: md5(t)) AS path, words FROM rebuilt),
members AS (SELECT conv_id, path, words, unnest(range(0, len(path) + 1)) AS depth FROM coded),
nodes AS (
  SELECT path[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words[depth]), 0) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len(path)), '')) AS ends_sha256
  FROM members GROUP BY path[1:depth], depth),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
above AS (SELECT path, unnest(range(0, depth + 1)) AS up, (n_convs - 1) * words AS saved, n_children = 0 AS leaf FROM told),
trees AS (SELECT path[1:up] AS path, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM above GROUP BY 1)
SELECT told.conv_id, told.depth, parents.conv_id AS parent_conv_id, told.n_convs, told.n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, told.ends_sha256
FROM told JOIN trees ON trees.path = told.path
LEFT JOIN nodes parents ON told.depth > 0 AND parents.path = told.path[1:told.depth - 1]
"""

#: All pairs with a common shingle, their exact similarity, and reachability; for small tables.
NEAR_DEDUP_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT a, b FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
FROM sets LEFT JOIN least ON node = doc_id
"""

QUERIES = {
    query.__name__: query
    for query in (
        op1_token_files, op2_personal_data, op3_byte_bpe, op4_hash_tree, op5_chunk_fingerprints, op6_decontamination,
        op7_licences, op8_language_id, op9_quality, op10_near_dedup, op11_periodic_runs, op12_fair_mix, op13_prefix_trie,
    )
}
ORACLE_SQL = {
    "op7_licences": licences.licence_sql(), "op10_near_dedup": NEAR_DEDUP_SQL, "op11_periodic_runs": RUNS_SQL,
    "op12_fair_mix": MIX_SQL, "op13_prefix_trie": TRIE_SQL,
}
