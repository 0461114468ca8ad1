"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship


SQL = {
    "op1_line_dedup": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM documents
        ), w AS (
            SELECT doc_id, start, list_slice(lines, start, start + 2) AS win
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS start FROM d WHERE len(lines) >= 3)
        ), again AS (
            SELECT doc_id, start FROM (
                SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS place FROM w
            ) WHERE place > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start, start + 3)) AS place FROM again
        ), cut AS (
            SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, len(lines) AS n_lines, coalesce(len(places), 0) AS n_removed,
                   list_filter(lines, lambda x, i: places IS NULL OR NOT list_contains(places, i)) AS rest
            FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
        )
        SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(array_to_string(rest, chr(10))) AS kept_sha256 FROM kept
    """,
    "op1_repeated_lines": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines FROM documents
        ), l AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM d
        ), gone AS (
            SELECT doc_id, place FROM (
                SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS n FROM l
            ) WHERE n > 1
        ), cut AS (
            SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, len(lines) AS n_lines, coalesce(len(places), 0) AS n_removed,
                   list_filter(lines, lambda x, i: places IS NULL OR NOT list_contains(places, i)) AS rest
            FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
        )
        SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(array_to_string(rest, chr(10))) AS kept_sha256 FROM kept
    """,
    "op2_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<[\\\\]*[|](im_start|im_end|endoftext|startoftext)[|]>')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op4_topk_bsi": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
        )
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 5
    """,
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, words, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))
                                                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM d
        ), e AS (
            SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
        ), links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
        ), least AS (
            SELECT x, min(y) AS component_id FROM reach GROUP BY x
        )
        SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id,
               CASE WHEN len(words) > 0 THEN sha256(array_to_string(words, ' ')) END AS class_id
        FROM s JOIN least ON s.doc_id = least.x
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), w AS (
            SELECT doc_id, start, list_slice(words, start, start + 19) AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM d WHERE len(words) >= 20)
        ), again AS (
            SELECT doc_id, start FROM (
                SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS place FROM w
            ) WHERE place > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM again
        ), cut AS (
            SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
                   list_filter(words, lambda x, i: places IS NULL OR NOT list_contains(places, i)) AS rest
            FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
        )
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
    """,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 3 lines or more over whole texts; lines of runs that also start earlier go."""
    from tessera.llm.line_dedup import remove_repeated_lines

    out = remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op1_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of any length, single lines too: every line that also occurs earlier goes."""
    from tessera.llm.line_dedup import remove_repeated_lines

    out = remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=1)
    return out.select("doc_id", "n_lines", "n_removed", "kept_sha256")


#: A conversation whose texts hold the template's own control strings.
TRICKY = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and digests of what the grammar reads back."""
    from tessera.llm.chat_format import format_turns, read_back

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(tricky)))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by an additive model with pairwise interactions."""
    from tessera.llm.quality_gam import THRESHOLD, held_out, with_score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_score(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_topk_bsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector, by a bit-sliced index."""
    from tessera.llm.topk_bsi import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 5-word shingles have a similarity of 0.8 or more, as components."""
    from tessera.llm.jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, by the automaton of the merges."""
    from tessera.llm.bpe_automaton import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are identical without white space."""
    from tessera.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, mixed by source in proportion to the sources' tokens."""
    from tessera.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow files of token rows, written in id order and read back."""
    from tessera.llm.token_files import read_back, write_tokens

    return read_back(write_tokens(_table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words over whole texts; words of windows that also start earlier go."""
    from tessera.llm.substring_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_units").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__sha").alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op1_repeated_lines": op1_repeated_lines,
        "op2_chat_format": op2_chat_format,
        "op3_quality_gam": op3_quality_gam,
        "op4_topk_bsi": op4_topk_bsi,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_bpe_automaton": op6_bpe_automaton,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_token_files": op9_token_files,
        "op10_substring_dedup": op10_substring_dedup,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the whole of documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
