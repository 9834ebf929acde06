"""Registered queries of the corpus operators, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewright.llm import (
    bpe,
    cascade,
    conversations,
    main_text,
    mixing,
    near_dup,
    ngram,
    quality,
    secret_scan,
    spelling,
    suffix_dedup,
    vectors,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The ranks of a public vocabulary, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), rank_file(), ["doc_id"])


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule stops a document depends on the order and so on timings; the verdict does not
    return cascade.apply_rules(_table(spark, sf_dir, "documents")).drop("failed_rule")


def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(_table(spark, sf_dir, "documents"))


def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_histories(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at"
    )


def projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_byte_bpe": byte_pairs,
    "op2_order_minhash": near_duplicates,
    "op3_index_merge": index_merge,
    "op4_weak_labels": weak_labels,
    "op5_pfair_mix": pfair_mix,
    "op6_tag_ratio": page_text,
    "op7_randomness_battery": secrets,
    "op8_rule_cascade": rule_cascade,
    "op9_log_frequency_bloom": ngram_scores,
    "op10_projection_passes": projection_passes,
    "op11_trie_frontier": spelling_variants,
    "op12_two_stage_suffixes": repeated_strings,
    "op13_block_tables": repaired_conversations,
}

#: The checksum of a text as the SQL engine has to compute it: table, then one step per byte.
CRC = r"""
        steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        )"""


def checksum(value: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes; needs ``steps``."""
    octets = f"list_transform(range(octet_length(encode({value}))), lambda i: CAST('0x' || substr(hex(encode({value})), 2 * i + 1, 2) AS BIGINT))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    )


#: The other operators have no SQL form; they are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_index_merge": r"""
        WITH captured AS (
            SELECT page_id, coalesce(html, '') AS body, regexp_replace(url, '[\x00-\x20]', '%20', 'g') AS url FROM pages
        ), sized AS (
            SELECT *, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
                   regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
            FROM captured
        ), headed AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head,
                   regexp_replace(lower(regexp_extract(bare, '^([^/?#]*)', 1)), '^www\.', '') AS host
            FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN head <> page_id THEN head END AS refers_to,
               array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_replace(bare, '^[^/?#]*', '') AS url_key,
               strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
        FROM headed
    """,
    "op8_rule_cascade": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                   coalesce(text, '') AS text
            FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS five
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
        ), twice AS (
            SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS step(k) GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words
        ), counted AS (
            SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
            FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), facts AS (
            SELECT doc_id, len(w)::BIGINT AS n_words,
                   coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
                   coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
                   len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_capital,
                   len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
            FROM words LEFT JOIN counted USING (doc_id) LEFT JOIN repeated USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
                    OR word_chars < 2 * n_words OR word_chars > 25 * n_words
                    OR 5 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines
                    OR (n_words >= 20 AND 10 * n_capital > 4 * n_words)
                    OR 10 * n_stutter > 3 * n_words) AS kept
        FROM facts
    """,
    "op11_trie_frontier": rf"""
        WITH RECURSIVE {CRC}, runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), uses AS (
            SELECT doc_id, run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS mark, count(*) AS uses FROM runs GROUP BY ALL
        ), marked AS (
            SELECT run, uses, {checksum("mark")} AS h FROM uses, steps
        ), changed AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
                   uses FROM marked
        ), words AS (
            SELECT word, CAST(sum(uses) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(uses) >= 3
        ), shorter AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ), near AS (
            SELECT s.word AS a, w.word AS b FROM shorter s JOIN words w ON w.word = s.rest
            UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.rest
            UNION SELECT s.word, o.word FROM shorter s JOIN shorter o ON s.rest = o.rest AND s.i = o.i AND s.word <> o.word
        ), ranked AS (
            SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place
            FROM near JOIN words ON words.word = b
        ), formed AS (
            SELECT w.word, CASE WHEN r.n >= 2 * w.n THEN r.b END AS form, w.n, coalesce(r.n_near, 0) AS n_near,
                   CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
            FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.place = 1
        ), ways AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL SELECT ways.word, formed.word, formed.form FROM ways JOIN formed ON formed.word = ways.next
        )
        SELECT word, form, root, n, n_near, form_n
        FROM formed JOIN (SELECT word, root FROM ways WHERE next IS NULL) USING (word)
    """,
    "op12_two_stage_suffixes": r"""
        WITH texts AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
            FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS i FROM texts)
        ), later AS (
            SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
        ), fresh AS (
            SELECT doc_id, i, CASE WHEN i <= lag(i + 100) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM later
        ), numbered AS (
            SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fresh
        ), spans AS (
            SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS past FROM spans
        ), cut AS (
            SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS past,
                   string_agg(substr(h, 2 * past + 1, 2 * (low - past)), '' ORDER BY low) AS head
            FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(past, 0) + 1))) AS kept_sha256
        FROM texts LEFT JOIN cut USING (doc_id)
    """,
    "op13_block_tables": rf"""
        WITH RECURSIVE {CRC}, given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {checksum("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
            FROM conversations, steps
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM given WHERE fault <> 0
        ), placed AS (
            SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                   row_number() OVER by_turn AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   lag(role[1]) OVER by_turn AS before
            FROM damaged WINDOW by_turn AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
        ), judged AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind
            FROM placed
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count_if(kind = 'blank') AS blank, count_if(kind = 'duplicate') AS duplicate, count_if(kind = 'truncated') AS truncated,
                   count_if(k > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id
        ), added(state, letters, reached, paid, lines) AS (
            -- up to three inserted rows; states: 0 nothing yet, 1 after s, 2 after u, 3 after a
            VALUES (0, '', 0, 0, ''), (0, 'I', 2, 5, 'user:' || chr(10)), (0, 'II', 3, 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
                   (1, '', 1, 0, ''), (1, 'I', 2, 5, 'user:' || chr(10)), (1, 'II', 3, 10, 'user:' || chr(10) || 'assistant:' || chr(10)),
                   (2, '', 2, 0, ''), (2, 'I', 3, 5, 'assistant:' || chr(10)), (2, 'II', 2, 10, 'assistant:' || chr(10) || 'user:' || chr(10)),
                   (3, '', 3, 0, ''), (3, 'I', 2, 5, 'user:' || chr(10)), (3, 'II', 3, 10, 'user:' || chr(10) || 'assistant:' || chr(10))
        ), edits(letter, price, from_state, initial, to_state, line) AS (
            VALUES ('K', 0, 0, 's', 1, NULL), ('K', 0, 0, 'u', 2, NULL), ('K', 0, 1, 'u', 2, NULL), ('K', 0, 3, 'u', 2, NULL),
                   ('K', 0, 2, 'a', 3, NULL), ('R', 1, 0, NULL, 2, 'user'), ('R', 1, 1, NULL, 2, 'user'), ('R', 1, 3, NULL, 2, 'user'),
                   ('R', 1, 2, NULL, 3, 'assistant'), ('D', 2, 0, NULL, 0, ''), ('D', 2, 1, NULL, 1, ''), ('D', 2, 2, NULL, 2, ''),
                   ('D', 2, 3, NULL, 3, '')
        ), best AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, 0 AS cost, '' AS audit, '' AS lines FROM conversations
            UNION ALL
            SELECT conv_id, k, state, cost, audit, lines FROM (
                SELECT b.conv_id, j.k, e.to_state AS state,
                       b.cost + i.paid + e.price + CASE WHEN e.letter <> 'D' AND j.kind = 'truncated' THEN 5 ELSE 0 END AS cost,
                       b.audit || i.letters || e.letter AS audit,
                       b.lines || i.lines || CASE WHEN e.letter = 'D' THEN '' ELSE coalesce(e.line, j.role) || ':' || j.text || chr(10) END AS lines
                FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.k = b.k + 1
                JOIN added i ON i.state = b.state JOIN edits e ON e.from_state = i.reached
                WHERE (e.letter = 'D' OR j.kind NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = j.role[1])
            ) QUALIFY row_number() OVER (PARTITION BY conv_id, k, state ORDER BY cost, audit) = 1
        ), ended AS (
            SELECT b.conv_id, b.cost + i.paid AS cost, b.audit || i.letters AS audit, b.lines || i.lines AS lines
            FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
            JOIN added i ON i.state = b.state AND i.reached IN (0, 3)
            WHERE b.k = coalesce(c.n, 0)
            QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + i.paid, b.audit || i.letters) = 1
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
               sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
        FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
}
