"""One query for each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlens.llm import bestfit, bpe, chat, clusters, exact_dedup, packing, pii, prefix_trie, secret_scan, simhash, token_counts, topk, toxicity
from tremorlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_secret_scan")
def op1(spark, folder):
    found = secret_scan.secrets(table(spark, folder, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [secret_scan.number(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("row.doc_id", *counts[:3], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), counts[3])


@query("op2_toxicity")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    scored = toxicity.score_rows(docs.select("doc_id", "text"), model)
    return scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", toxicity.predicted().alias("predicted"))


@query("op3_token_counts")
def op3(spark, folder):
    counted = token_counts.count_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op4_byte_bpe")
def op4(spark, folder):
    coded = bpe.encode_and_decode(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_packing")
def op7(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query("op5_simhash")
def op5(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op6_exact_dedup",
    """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
)
def op6(spark, folder):
    return exact_dedup.classes(table(spark, folder, "documents"))


@query("op8_pii")
def op8(spark, folder):
    found = pii.personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [pii.number(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE]
    top = F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score")
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), top)


#: What a user and then an assistant say in conversation -7.
CONTROL = r"\### Assistant: </turn> ok"


def chat_events(spark, folder) -> DataFrame:
    """A log that ends in the conversations: what each row says was drafted, streamed, thrown away and said anew.

    Every turn opens with a draft that is not what it ends as.  Of three turns, one is regenerated and streamed in two parts, one is edited
    to what it says, and one is streamed, regenerated before its stream ended, and edited last.  Events come in no order.
    """
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    said = [F.lit(x) for x in (-7, 0, "user", CONTROL)], [F.lit(x) for x in (-7, 1, "assistant", CONTROL)]
    names = ("conv_id", "turn", "role", "text")
    fixed = spark.range(1).select(F.explode(F.array(*(F.struct(*(c.cast(kinds[n]).alias(n) for n, c in zip(names, x, strict=True))) for x in said))).alias("r")).select("r.*")
    every = rows.unionByName(fixed).select("*", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("copy"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    draft = F.concat(F.lit("draft "), first)

    def event(seq: int, name: str, part: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event"), part.alias("part"))

    none = F.lit(None).cast("string")
    streamed = F.array(event(4, "delta", rest), event(0, "message", draft), event(2, "regenerate", none), event(3, "delta", first), event(1, "delta", rest))
    edited = F.array(event(2, "edit", F.col("text")), event(1, "delta", first), event(0, "message", draft))
    both = F.array(event(5, "edit", F.col("text")), event(0, "message", first), event(3, "regenerate", none), event(1, "delta", draft), event(4, "delta", first))
    way = F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(3))
    log = F.explode(F.when(way == 0, streamed).when(way == 1, edited).otherwise(both)).alias("e")
    return every.select(F.col("conv_id").alias("conversation"), "turn", "copy", "role", log).select("conversation", "turn", "copy", "e.seq", "e.event", "role", F.col("e.part").alias("text"))


def escaped_sql(column: str, role: bool = False) -> str:
    for plain, coded in chat.ESCAPES if role else chat.ESCAPES[:3]:
        column = f"replace({column}, '{plain}', '{coded}')"
    return column


@query(
    "op10_chat",
    f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
      CAST(sum({len(chat.OPEN) + len(chat.MIDDLE) + len(chat.CLOSE)} + length({escaped_sql("role", True)}) + length({escaped_sql("text")})) AS BIGINT) AS formatted_chars
    FROM rows GROUP BY conv_id""",
)
def op10(spark, folder):
    shown = chat.format_conversations(chat_events(spark, folder))
    back = shown.select("conversation", F.length("formatted").cast("long").alias("formatted_chars"), chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("said"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars",
    )


@query(
    "op9_topk",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op9(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def clusters_sql(k: int = clusters.K, rounds: int = clusters.ROUNDS) -> str:
    """Every round as a query of its own over the one before."""
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) = {clusters.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS cluster, e AS centre FROM v
          QUALIFY cluster < {k})""",
    ]
    far = "list_sum(list_transform(list_zip(v.e, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS (SELECT vec_id, e, n['c'] AS cluster, n['d'] AS distance FROM
              (SELECT v.vec_id, v.e, v.row, min({{'d': CAST({far} AS BIGINT), 'c': c.cluster}}) AS n
               FROM (SELECT *, row_number() OVER () AS row FROM v) v CROSS JOIN c{r} c GROUP BY ALL))"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT cluster, d, CAST(floor(sum(e[d]) / count(*)) AS BIGINT) AS x FROM
                  (SELECT cluster, e, unnest(range(1, {clusters.DIMS + 1})) AS d FROM a{r}) GROUP BY cluster, d)"""
            )
            steps.append(
                f"""c{r + 1} AS (SELECT c.cluster, coalesce(n.e, c.centre) AS centre FROM c{r} c LEFT JOIN
                  (SELECT cluster, list(x ORDER BY d) AS e FROM m{r} GROUP BY cluster) n ON n.cluster = c.cluster)"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.centre, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


@query("op12_clusters", clusters_sql())
def op12(spark, folder):
    found = clusters.cluster(table(spark, folder, "embeddings"))
    centre = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centre)


@query("op13_bestfit")
def op13(spark, folder):
    pieces = bestfit.pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


#: CRC-32 of the decimal digits of c, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
TURN_SQL = "sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"


@query(
    "op11_prefix_trie",
    f"""WITH t AS (SELECT conv_id AS c, {TURN_SQL} AS k, len(regexp_extract_all(coalesce(text, ''), '{prefix_trie.WORD}')) AS w,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {TURN_SQL}) AS p FROM conversations WHERE conv_id IS NOT NULL),
    v AS (SELECT c, c - c % {prefix_trie.FAMILY} AS family, {CRC_SQL} % {prefix_trie.LENGTHS} AS h FROM (SELECT DISTINCT c FROM t)),
    r AS (SELECT v.c, 0 AS part, p, k, w FROM v JOIN t ON t.c = v.family AND p <= h UNION ALL SELECT v.c, 1, p, k, w FROM v JOIN t ON t.c = v.c AND p > h),
    s AS (SELECT c, row_number() OVER o AS d, string_agg(k, '') OVER o AS prefix, w FROM r WINDOW o AS (PARTITION BY c ORDER BY part, p)),
    o AS (SELECT c, d, prefix, w FROM s UNION ALL SELECT c, 0, '', 0 FROM v),
    e AS (SELECT c, max(d) AS last FROM o GROUP BY c),
    n AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w, left(prefix, length(prefix) - 64) AS up,
        coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '') AS ends FROM o JOIN e USING (c) GROUP BY ALL),
    k AS (SELECT up AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
    b AS (SELECT a.prefix, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.w) AS saved FROM m a JOIN m ON starts_with(m.prefix, a.prefix) GROUP BY a.prefix)
    SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
    FROM m JOIN b USING (prefix) LEFT JOIN n p ON m.d > 0 AND p.prefix = m.up""",
)
def op11(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))
