"""The operators as queries over the supplied tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import (
    best_fit_packing,
    bpe_tree,
    brown_ngrams,
    compression_bands,
    cross_parsing,
    dart_minhash,
    filter_audit,
    itq_hamming,
    kn_toxicity,
    prefix_trie,
    quote_links,
    secret_crf,
    sparse_suffixes,
)
from martwright.llm.rows import fold_of
from martwright.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message_id(conv_id: Column, turn: Column) -> Column:
    """A number for each (conv_id, turn), in order of turns within a conversation.

    Turns 0 to 999 are numbered as the SQL does. Others, which would run into the next
    conversations, have the ranges of 2 ** 61 numbers around 2 ** 62 and -2 ** 62 to themselves.
    What fits nowhere is an error.
    """
    conv_id, turn = conv_id.cast("long"), turn.cast("long")
    usual = turn.between(0, 999)
    far = F.when(turn > 0, F.lit(1 << 62)).otherwise(F.lit(-(1 << 62)))
    return (
        F.when(usual & conv_id.between(-(10**15), 10**15), conv_id * 1000 + turn)
        .when(~usual & conv_id.between(-(1 << 28), 1 << 28) & turn.between(-(1 << 32), (1 << 32) - 1),
              far + conv_id * (1 << 32) + turn)
        .otherwise(F.raise_error(F.lit("conv_id or turn too large for a message id")).cast("long"))
    )


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msg_id, text): the turns of ``conversations`` as mail. Each turn quotes the turn before it
    and, one level deeper, what that one quoted first."""
    turns = (
        table(spark, sf_dir, "conversations")
        .where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("conv_id", "turn")
        .agg(F.coalesce(F.max("text"), F.lit("")).alias("text"),
             F.coalesce(F.max("role"), F.lit("someone")).alias("role"))
    )

    def quoted(back: int) -> DataFrame:
        mark = "> " * back
        lines = F.concat(F.lit(mark), F.replace("text", F.lit("\n"), F.lit("\n" + mark)))
        head = F.concat(F.lit("> " * (back - 1) + "On an earlier day the "), "role",
                        F.lit(" wrote:\n"))
        return turns.select("conv_id", (F.col("turn") + back).alias("turn"),
                            F.concat(head, lines).alias(f"quote{back}"))

    both = turns.join(quoted(1), ["conv_id", "turn"], "left").join(
        quoted(2), ["conv_id", "turn"], "left"
    )
    mail = F.concat_ws("\n", "text", F.when(F.col("quote1").isNotNull(), ""), "quote1", "quote2")
    number = message_id(F.col("conv_id"), F.col("turn"))
    return both.select(number.alias("msg_id"), mail.alias("text"))


@query
def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(mailbox(spark, sf_dir))


# States what the mailbox quotes instead of parsing it.
ORACLE["op1_quote_links"] = r"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, coalesce(max(text), '') AS text,
        CASE WHEN turn BETWEEN 0 AND 999 THEN conv_id * 1000 + turn
            WHEN turn > 0 THEN 4611686018427387904 + conv_id * 4294967296 + turn
            ELSE -4611686018427387904 + conv_id * 4294967296 + turn END AS id
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), said AS (
    SELECT DISTINCT id, conv_id, turn, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS print
    FROM (SELECT id, conv_id, turn, unnest(regexp_split_to_array(text, '\n(?:\s*\n)+')) AS p
          FROM turns)
), prints AS (
    SELECT * FROM said WHERE print <> ''
), quotes AS (
    SELECT DISTINCT t.id, 1 AS level, p.print FROM turns t JOIN prints p
    ON p.conv_id = t.conv_id AND p.turn = t.turn - 1
    UNION
    SELECT t.id, 2, p.print FROM turns t JOIN prints p
    ON p.conv_id = t.conv_id AND p.turn = t.turn - 2
), held AS (
    SELECT *, count(*) OVER (PARTITION BY print, lev) AS n
    FROM (SELECT id, 0 AS lev, print FROM prints UNION SELECT id, level, print FROM quotes)
), pairs AS (
    SELECT q.id, q.level, q.print, h.id AS holder, h.n, row_number() OVER (
        PARTITION BY q.id, q.level, q.print, h.lev ORDER BY h.id DESC) AS back
    FROM quotes q JOIN held h ON h.print = q.print AND h.lev IN (0, q.level - 1) AND h.id < q.id
), agreed AS (
    SELECT DISTINCT id, level, print, holder FROM pairs
    WHERE (id, holder) IN (SELECT (id, holder) FROM pairs WHERE n <= 16 OR back = 1)
), ranked AS (
    SELECT id, holder, min(level) AS low, sum(n) AS agreeing, min_by(n, level) AS at_low
    FROM (SELECT id, holder, level, count(*) AS n FROM agreed GROUP BY ALL) GROUP BY id, holder
), links AS (
    SELECT id, holder AS original,
        row_number() OVER (PARTITION BY id ORDER BY low, at_low DESC, agreeing DESC, holder DESC) AS k
    FROM ranked
), replies AS (
    SELECT t.id, l.original AS parent, t.text
    FROM turns t LEFT JOIN links l ON l.id = t.id AND l.k = 1
), chain AS (
    SELECT id, id AS root, 0 AS depth FROM replies WHERE parent IS NULL
    UNION ALL
    SELECT r.id, c.root, c.depth + 1 FROM replies r JOIN chain c ON r.parent = c.id
)
SELECT c.id AS message_id, c.root AS conversation_id, r.parent AS parent_id,
    CAST(c.depth AS BIGINT) AS depth,
    row_number() OVER (PARTITION BY c.root ORDER BY c.id) - 1 AS position,
    regexp_replace(regexp_replace(r.text, '^\s+', ''), '\s+$', '') AS body
FROM chain c JOIN replies r USING (id)
"""


@query
def op2_brown_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of(F.col("doc_id"), 7) == 2
    return brown_ngrams.score(table(spark, sf_dir, "documents"), held_out)


@query
def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the vocabulary's place is this query's parameter

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    vocabulary = bpe_tree.share(spark, ranks, public_tokenizers.PATTERN)
    coded = bpe_tree.with_bytes(bpe_tree.with_tokens(docs, vocabulary), vocabulary)
    # An array as text is [1, 2, 3].
    listed = F.expr("trim(BOTH '[]' FROM replace(cast(ids AS string), ',', ''))")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = kn_toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return kn_toxicity.with_toxicity(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.log_ratio").alias("log_ratio"),
        F.col("toxicity.n_tokens").alias("n_tokens"),
    )


@query
def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


@query
def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "kept", "ratio", "n_chunks", "n_repetitive", "n_incompressible")
    judged = compression_bands.with_quality(docs, bands=compression_bands.MEASURED)
    return judged.select("doc_id", *[F.col(f"quality_rules.{x}").alias(x) for x in names])


@query
def op8_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    automata = cross_parsing.learn(docs.where(~held_out))
    found = cross_parsing.with_language(docs.drop("lang"), automata)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.bits").alias("bits"),
    )


@query
def op9_itq_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_hamming.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.inline("spans").alias("start_word", "end_word"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failures(table(spark, sf_dir, "documents"))
    postings = filter_audit.posting_lists(failed, table(spark, sf_dir, "labels"))
    return filter_audit.audit(filter_audit.removals(postings))


ORACLE["op12_filter_audit"] = r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')
            AS words
    FROM documents
), marked AS (
    SELECT part,
        list_filter([
            CASE WHEN len(words) < 200 THEN 'A' END,
            CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
            CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)
                THEN 'C' END,
            CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
            CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END
        ], lambda f: f IS NOT NULL) AS fails,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
        coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
    FROM docs
), kinds AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM marked GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS f,
        string_split(substr(filter_order, 1, step - 1), '') AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counts AS (
    SELECT part, filter_order, step, f,
        sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, before)) AS kept,
        sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS removed,
        sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)) AS redundant,
        sum(n) FILTER (fails = [f]) AS unique_fails,
        sum(n) FILTER (good AND list_contains(fails, f) AND NOT list_has_any(fails, before))
            AS good_lost,
        sum(n) FILTER (toxic AND list_contains(fails, f) AND NOT list_has_any(fails, before))
            AS toxic_lost
    FROM kinds, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
    CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
    CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
    CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counts
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_in_order(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(turns))
    return nodes.drop("id", "parent")


# Keeps every prefix as a list of its turns, and sums over the prefixes of each node.
ORACLE["op13_prefix_trie"] = r"""
WITH RECURSIVE bytes(i, k, v) AS (
    SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
    FROM bytes WHERE k < 8
), digits(conv, s, i, crc) AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT)
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    UNION ALL
    SELECT conv, s, d.i + 1, xor(crc >> 8, b.v)
    FROM digits d JOIN bytes b ON b.k = 8 AND b.i = xor(crc, ascii(substr(s, d.i + 1, 1))) & 255
    WHERE d.i < length(s)
), convs AS (
    SELECT conv, conv - conv % 100 AS base, xor(crc, 4294967295) % 6 AS h
    FROM digits WHERE i = length(s)
), turns AS (
    SELECT conv_id AS conv, coalesce(text, '') AS text,
        length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
    SELECT c.conv, 0 AS own, t.k, t.said, t.text FROM convs c JOIN turns t ON t.conv = c.base
    WHERE t.k <= c.h
    UNION ALL
    SELECT c.conv, 1, t.k, t.said, t.text FROM convs c JOIN turns t ON t.conv = c.conv
    WHERE t.k > c.h
), whole AS (
    SELECT c.conv, coalesce(list(p.said ORDER BY own, k) FILTER (p.said IS NOT NULL), []) AS said,
        coalesce(list(p.text ORDER BY own, k) FILTER (p.said IS NOT NULL), []) AS texts
    FROM convs c LEFT JOIN parts p USING (conv) GROUP BY c.conv
), starts AS (
    SELECT conv, d, said[1:d] AS path, length(texts[d]) AS size, d = len(said) AS ends
    FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM whole)
), nodes AS (
    SELECT path, d, min(conv) AS conv_id, count(*) AS n_convs, coalesce(max(size), 0) AS size,
        sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (ends), ''))
            AS ends_sha256
    FROM starts GROUP BY path, d
), kids AS (
    SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (
    SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)
), above AS (
    SELECT path[1:a] AS path, sum((n_convs - 1) * size) AS saved, count_if(n_children = 0) AS leaves
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL
)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id,
    c.n_convs, c.n_children, CAST(a.leaves AS BIGINT) AS n_leaves,
    CAST(a.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN above a USING (path) LEFT JOIN nodes p ON c.d > 0 AND p.path = c.path[1:c.d - 1]
"""


@query
def op11_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_crf.with_secrets(docs, secret_crf.learn(docs))

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
        )

    spans = F.col("secrets.spans")
    base = F.filter(spans, lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *[F.col(f"secrets.{n}").alias(n) for n in ("n_assign", "n_access", "n_hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
