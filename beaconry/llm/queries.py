"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconry.llm import conversation_repair, decontamination, mixing, ngram_trie, packing, passages, sharding, simhash, spelling, suffixes, topk, toxicity, winnowing
from beaconry.llm.common import documents
from beaconry.session import materialize


def vocabulary() -> tuple[str, str]:
    """Path of the byte-level ranks among the public vocabulary files, and their pattern."""
    module = importlib.import_module("public_tokenizers")
    return module.path("byte_bpe_50k.tiktoken"), module.PATTERN


def remainder(parts: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(0))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), *vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_classes(documents(spark, sf_dir))
    return classes.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.without_repeats(documents(spark, sf_dir)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder(4) == 2
    model = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = topk.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_scores(data, data.where(F.col("vec_id") % 50 == 0), k=5)


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ngram_trie.scored(documents(spark, sf_dir), remainder(7) != 2)
    return scores.withColumn("held_out", ~F.col("learn")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated_spans(documents(spark, sf_dir), items, F.col("doc_id").cast("string").cast("binary"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select(
        F.col("id").cast("string").cast("long").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir)))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by the crc32 of ``conv_id:turn``: dropped, emptied, cut, repeated, or given to the user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate, text = F.crc32(key) % 20, F.coalesce("text", F.lit(" "))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return turns.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("time"),
    ).drop("time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    edited = materialize(conversation_repair.edits(damaged(turns)), "edits")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = turns.select("conv_id").distinct()
    counts = conversation_repair.summary(edited).withColumnRenamed("conv", "of")
    texts = conversation_repair.digests(conversation_repair.repaired(edited))
    joined = every.join(counts, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(
        texts, F.col("conv_id").eqNullSafe(F.col("conv")), "left"
    )
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in names),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_passages": op2_passages,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_suffixes": op5_suffixes,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_topk": op8_topk,
    "op9_ngram_trie": op9_ngram_trie,
    "op10_winnowing": op10_winnowing,
    "op11_decontamination": op11_decontamination,
    "op12_spelling": op12_spelling,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL: dict[str, str] = {
    "op5_suffixes": r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
strings AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS string FROM texts, unnest(range(0, n_bytes - 49)) AS t(s)),
earliest AS (SELECT string, min(doc_id) AS earliest FROM strings GROUP BY string),
repeats AS (SELECT doc_id, s FROM strings JOIN earliest USING (string) WHERE earliest < doc_id),
marked AS (
  SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 50, TRUE) AS begins FROM repeats),
numbered AS (
  SELECT doc_id, s, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS low, max(s) + 50 AS high FROM numbered GROUP BY doc_id, span),
placed AS (SELECT *, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS earlier FROM spans),
cut AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last,
    string_agg(substr(h, 2 * earlier + 1, 2 * (low - earlier)), '' ORDER BY low) AS kept
  FROM placed JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
""",
    "op8_topk": """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    max(CAST(list_sum(list_transform(range(1, len(v.ints) + 1), lambda i: q.ints[i] * v.ints[i])) AS BIGINT)) AS score
  FROM vectors AS q JOIN vectors AS v ON q.vec_id <> v.vec_id AND len(q.ints) = len(v.ints)
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_decontamination": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM asked, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN phrases USING (n, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op12_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\xC0-\xFF]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, xor(list_reduce(list_transform(range(octet_length(encode(k))), lambda i:
      CAST(('0x' || substr(hex(encode(k)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda r, j: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)),
    4294967295), 4294967295) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs)),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM hashed),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
gaps AS (
  SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps AS a JOIN gaps AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps AS a JOIN words AS b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({'n': -n, 'other': other}) AS top FROM near GROUP BY word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 10 * words.n THEN top.other END AS form,
    CASE WHEN -top.n >= 10 * words.n THEN -top.n END AS form_n FROM words LEFT JOIN best USING (word)),
led(word, reached) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT led.word, formed.form FROM led JOIN formed ON formed.word = led.reached WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.n, formed.n_near, formed.form, formed.form_n, led.reached AS root
FROM formed JOIN led USING (word) JOIN formed AS last ON last.word = led.reached AND last.form IS NULL
""".replace("\\xC0-\\xFF", "\u00c0-\u00ff"),
    "op13_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda r, j: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)),
    4294967295), 4294967295) % 20 AS fate FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM damaged),
known AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM known),
inserts(a, b, edits, cost) AS (
  VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 2, 'I', 3),
    (1, 3, 'II', 6), (2, 3, 'I', 3), (3, 2, 'I', 3)),
choices(a, b, edit, cost, initial) AS (
  VALUES (0, 0, 'D', 4, NULL), (1, 1, 'D', 4, NULL), (2, 2, 'D', 4, NULL), (3, 3, 'D', 4, NULL), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'),
    (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (0, 2, 'R', 3, NULL), (1, 2, 'R', 3, NULL), (3, 2, 'R', 3, NULL),
    (2, 3, 'R', 3, NULL)),
moves AS (
  SELECT inserts.a AS a, choices.b AS b, edits || edit AS edits, edit, inserts.cost + choices.cost AS cost, initial
  FROM inserts JOIN choices ON inserts.b = choices.a),
best(conv_id, i, state, least) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'cost': 0, 'audit': ''} FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT best.conv_id, f.i, moves.b, min({'cost': best.least.cost + moves.cost
      + CASE WHEN moves.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': best.least.audit || moves.edits})
  FROM best JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i + 1
  JOIN moves ON moves.a = best.state AND (moves.initial IS NULL OR moves.initial = f.initial)
    AND (moves.edit = 'D' OR coalesce(f.fault = 'truncated', TRUE))
  GROUP BY best.conv_id, f.i, moves.b),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
ended AS (
  SELECT best.conv_id, min({'cost': least.cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
    'audit': least.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS least
  FROM best JOIN counted ON counted.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = n GROUP BY best.conv_id),
letters AS (
  SELECT conv_id, p, least.audit[p] AS letter FROM ended, unnest(range(1, len(least.audit) + 1)) AS t(p)),
numbered AS (
  SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
kept AS (
  SELECT n.conv_id, p, o, letter, f.role, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN o = 1 AND letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
  FROM numbered AS n LEFT JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.i WHERE letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY p) AS text FROM kept GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.least.cost, 0) AS BIGINT) AS cost,
  coalesce(e.least.audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
