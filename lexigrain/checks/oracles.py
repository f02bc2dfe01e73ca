"""DuckDB statements for the registered queries, written independently of the Spark code."""

from __future__ import annotations

# White space as one class body, because \s covers ASCII only there. A chr(1) is put before the last
# white space of a run that precedes text, which stands in for the missing look-ahead.
_WS = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def _pretokens(column: str) -> str:
    marked = (
        rf"regexp_replace({column}, '([{_WS}]+)([{_WS}])([^{_WS}])', '\1' || chr(1) || '\2\3', 'g')"
    )
    pattern = (
        r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+"
        rf"| ?[^{_WS}\x{{1}}\p{{L}}\p{{N}}]+|[{_WS}]+"
    )
    return f"regexp_extract_all({marked}, '{pattern}')"


_SIZE = "octet_length(encode(text))"

# Bytes, their printable letters and the ids of their tokens; lists indexed by byte value + 1.
_ALPHABET = """
alphabet AS (
    SELECT b, chr(code::INT) AS letter, row_number() OVER (ORDER BY code) AS id
    FROM (SELECT b, CASE WHEN plain THEN b
                         ELSE 255 + sum(CASE WHEN plain THEN 0 ELSE 1 END) OVER (ORDER BY b) END AS code
          FROM (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS plain
                FROM range(256) t(b)))),
codes AS (
    SELECT list(chr((id + 32)::INT) ORDER BY b) AS symbols, list(letter ORDER BY b) AS letters
    FROM alphabet)"""


def _by_byte(column: str, table: str) -> str:
    raw = f"hex(encode({column}))"
    return (
        f"array_to_string(list_transform(range(1, length({raw})::INT, 2), "
        f"lambda i: {table}[('0x' || substr({raw}, i, 2))::INT + 1]), '')"
    )


_WORDS = f"""
words AS (
    SELECT word, count(*) AS freq
    FROM (SELECT unnest({_pretokens('text')}) AS word FROM documents) GROUP BY word)"""


def _training(merges: int) -> str:
    """``states``: every word after k merges, for k = 0..merges; counted on documents only."""
    return f"""
WITH RECURSIVE {_ALPHABET},
occurrences AS (
    SELECT word, sum(d)::BIGINT AS f_doc, sum(v)::BIGINT AS f_conv FROM (
        SELECT unnest({_pretokens('text')}) AS word, 1 AS d, 0 AS v FROM documents
        UNION ALL
        SELECT unnest({_pretokens('text')}), 0, 1 FROM conversations)
    GROUP BY word),
states AS (
    SELECT 0 AS k, word, {_by_byte('word', 'codes.symbols')} AS s, f_doc, f_conv, NULL::VARCHAR AS pair
    FROM occurrences, codes
    UNION ALL
    SELECT k + 1, word, replace(s, best.pair, chr(289 + k)), f_doc, f_conv, best.pair
    FROM states, (
        SELECT pair FROM (
            SELECT unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS pair, f_doc
            FROM states WHERE k < {merges} AND f_doc > 0)
        GROUP BY pair ORDER BY sum(f_doc) DESC, pair LIMIT 1) best
    WHERE k < {merges}),
steps AS (SELECT DISTINCT k - 1 AS rank, pair FROM states WHERE k > 0)"""


def _merges(merges: int) -> str:
    """Merge rows, with the spelling of every token kept in a map that grows by one entry per step."""
    return f"""
{_training(merges)},
vocab AS (
    SELECT 0 AS k, map_from_entries(list((chr((id + 32)::INT), letter))) AS spelling FROM alphabet
    UNION ALL
    SELECT k + 1, map_concat(spelling, MAP {{chr(289 + k):
               spelling[substr(pair, 1, 1)] || spelling[substr(pair, 2, 1)]}})
    FROM vocab JOIN steps ON rank = k)
SELECT rank::INT AS rank, spelling[substr(pair, 1, 1)] AS "left", spelling[substr(pair, 2, 1)] AS "right",
       spelling[chr(289 + rank)] AS token, (257 + rank)::INT AS token_id
FROM steps, (SELECT spelling FROM vocab ORDER BY k DESC LIMIT 1)"""


SMALL, FULL, STEP = 8, 63, 16


_STATES = _training(FULL)
_IDS = "array_to_string(list_transform(range(1, length(s) + 1), lambda i: unicode(substr(s, i, 1)) - 32), ' ')"


def _budget(keys: str, table: str) -> str:
    return f"""
sized AS (SELECT {keys}, text, {_SIZE} AS n,
                 sum({_SIZE}) OVER (ORDER BY {keys} ROWS UNBOUNDED PRECEDING)::BIGINT AS done
          FROM {table} WHERE text <> ''),
total AS (SELECT sum(n)::BIGINT AS total FROM sized)"""


def _cut(room: str) -> str:
    """The text cut at ``room`` bytes, stepping back over bytes that continue a character."""
    def lead(at: str) -> str:
        return f"substr(hex(encode(text)), 2 * ({at}) - 1, 1) NOT IN ('8', '9', 'A', 'B')"

    keep = f"CASE WHEN {lead(f'{room} + 1')} THEN {room}" + "".join(
        f" WHEN {lead(f'{room} + 1 - {k}')} THEN {room} - {k}" for k in (1, 2)
    ) + f" ELSE {room} - 3 END"
    return f"CASE WHEN {_SIZE} <= {room} THEN text ELSE decode(encode(text)[1:({keep})]) END"


_HELDOUT = f"""
WITH {_budget('doc_id', 'documents')},
after_skip AS (SELECT doc_id, text, n, done - n - (
        SELECT min(done) FROM sized, total WHERE done >= total * 60 // 100) AS before
    FROM sized),
slice AS (SELECT doc_id, {_cut('(total * 20 // 100 - before)')} AS text
          FROM after_skip, total WHERE before >= 0 AND before < total * 20 // 100)"""

_POINTS = f"""
{_STATES},
sizes AS (SELECT unnest(range(257, {257 + FULL + 1}, {STEP})) AS v UNION SELECT {257 + FULL})"""


def _points(weight: str, table: str) -> str:
    return f"""{_POINTS},
used AS (SELECT sum({_SIZE})::BIGINT AS bytes_used, count(*) AS documents_used FROM {table} WHERE text <> ''),
points AS (
    SELECT v::INT AS vocab_size, sum({weight} * length(s))::BIGINT AS token_count
    FROM states JOIN sizes ON k = v - 257 GROUP BY v)"""


_RATIOS = (
    "bytes_used::DOUBLE / token_count AS bytes_per_token, "
    "token_count::DOUBLE / bytes_used AS tokens_per_byte"
)

_COMPARISON = f"""{_points('f_conv', 'conversations')},
scored AS (
    SELECT name, (257 + k)::INT AS vocab_size, sum(f_conv * length(s))::BIGINT AS token_count,
           greatest(1, ceil(log2(257 + k)))::INT AS bits
    FROM states JOIN (VALUES ('bytes', 0), ('small', {SMALL}), ('full', {FULL})) t(name, kk) ON k = kk
    GROUP BY name, k),
report AS (
    SELECT name, vocab_size, token_count, {_RATIOS}, bits AS fixed_id_bits_per_token,
           (token_count * bits)::DOUBLE / bytes_used AS fixed_id_bits_per_byte,
           (bytes_used * 8)::DOUBLE / (token_count * bits) AS fixed_id_compression_ratio
    FROM scored, used)"""

ORACLES: dict[str, str] = {
    "corpus_scan": "SELECT doc_id, text FROM documents",
    "corpus_stats": f"""
        SELECT sum({_SIZE})::BIGINT AS bytes_used, count(*) AS documents_used
        FROM documents WHERE text <> ''""",
    "nonempty_docs": r"""
        SELECT * FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS text
                       FROM documents) WHERE text <> ''""",
    "utf8_bytes": f"SELECT doc_id, {_SIZE}::BIGINT AS n_bytes FROM documents",
    "utf8_truncate": f"""
        SELECT doc_id, {_cut('half')} AS text
        FROM (SELECT doc_id, text, {_SIZE} // 2 AS half FROM documents)""",
    "size_parse": r"""
        SELECT doc_id, literal, CASE WHEN regexp_full_match(upper(literal), '[1-9][0-9]*\s*(B|KB|MB|GB)')
            THEN regexp_extract(literal, '^[0-9]+')::BIGINT * CASE regexp_extract(upper(literal), '[A-Z]+$')
                 WHEN 'B' THEN 1 WHEN 'KB' THEN 1000 WHEN 'MB' THEN 1000000 ELSE 1000000000 END
            END AS n_bytes
        FROM (SELECT doc_id, unnest([n || 'B', n || ' kb', n || 'mb', n || '  GB', '0' || n || 'MB',
                                     n || '.5GB', n || 'TB', n]) AS literal
              FROM (SELECT doc_id, n_chars::VARCHAR AS n FROM documents))""",
    "tokenizer_select": """
        WITH registry AS (SELECT DISTINCT lang AS name, '/models/' || lang || '/tokenizer.json' AS path
                          FROM documents),
        asked AS (SELECT lang AS name FROM documents UNION ALL SELECT source FROM documents)
        SELECT name, any_value(path) AS path, CASE WHEN any_value(path) IS NULL THEN 'unknown'
               WHEN count(*) > 1 THEN 'duplicate' ELSE 'selected' END AS status
        FROM asked LEFT JOIN registry USING (name) GROUP BY name""",
    "byte_budget_prefix": f"""
        WITH {_budget('doc_id', 'documents')}
        SELECT * FROM (
            SELECT doc_id, {_cut('(total * 60 // 100 - (done - n))')} AS text FROM sized, total
            WHERE done - n < total * 60 // 100) WHERE text <> ''""",
    "byte_budget_prefix_turns": f"""
        WITH {_budget('conv_id, turn', 'conversations')}
        SELECT * FROM (
            SELECT conv_id, turn, {_cut('(total * 35 // 100 - (done - n))')} AS text FROM sized, total
            WHERE done - n < total * 35 // 100) WHERE text <> ''""",
    "byte_budget_prefix_scaled": f"""
        SELECT conv_id, turn, {_SIZE}::BIGINT AS n_bytes,
               (sum({_SIZE}) OVER w - {_SIZE})::BIGINT AS bytes_before, count(*) OVER w - 1 AS documents_before
        FROM conversations WHERE text <> ''
        WINDOW w AS (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)""",
    "heldout_slice": f"{_HELDOUT} SELECT doc_id, text FROM slice WHERE text <> ''",
    "heldout_cache": f"{_HELDOUT} SELECT text FROM slice WHERE text <> ''",
    "heldout_legacy": "SELECT text, true AS ok FROM conversations",
    "progress_marks": f"""
        WITH {_budget('doc_id', 'documents')},
        cut AS (SELECT doc_id, total, {_cut('(total * 60 // 100 - (done - n))')} AS text FROM sized, total
                WHERE done - n < total * 60 // 100),
        running AS (SELECT doc_id, total, sum({_SIZE}) OVER w AS bytes_used, count(*) OVER w AS documents_used
                    FROM cut WHERE text <> '' WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
        lagged AS (SELECT *, coalesce(lag(bytes_used) OVER (ORDER BY doc_id), 0) AS earlier FROM running)
        SELECT doc_id, bytes_used::BIGINT AS bytes_used, (total * 60 // 100)::BIGINT AS max_bytes,
               (100 * bytes_used)::DOUBLE / (total * 60 // 100) AS pct, documents_used
        FROM lagged WHERE bytes_used // (total * 2 // 100) > earlier // (total * 2 // 100)""",
    "shortfall_check": f"""
        WITH {_budget('doc_id', 'documents')},
        wanted AS (SELECT unnest([total * 50 // 100, total * 150 // 100]) AS requested FROM total),
        used AS (SELECT requested, sum(octet_length(encode(
                     {_cut('(requested - (done - n))')})))::BIGINT AS bytes_used
                 FROM sized, wanted WHERE done - n < requested GROUP BY requested)
        SELECT requested, bytes_used, requested - bytes_used AS shortfall, requested - bytes_used <= 3 AS ok
        FROM used""",
    "pretokenize": f"""
        SELECT doc_id, len(w)::INT AS n_words, array_to_string(w, '|') AS words
        FROM (SELECT doc_id, {_pretokens('text')} AS w FROM documents)""",
    "pretokenize_pages": f"""
        SELECT page_id, len(w)::INT AS n_words, array_to_string(w, '|') AS words
        FROM (SELECT page_id, {_pretokens('html')} AS w FROM pages)""",
    "byte_alphabet": f"""
        WITH {_ALPHABET}, {_WORDS}
        SELECT word, {_by_byte('word', 'codes.letters')} AS letters FROM words, codes""",
    "word_type_counts": f"WITH {_WORDS} SELECT word, freq FROM words",
    "base_vocabulary": f"""
        WITH {_ALPHABET}, {_WORDS},
        raw AS (SELECT freq, hex(encode(word)) AS h FROM words),
        counts AS (SELECT b, sum(freq)::BIGINT AS n FROM (
                       SELECT freq, unnest(list_transform(range(1, length(h)::INT, 2),
                                           lambda i: ('0x' || substr(h, i, 2))::INT)) AS b FROM raw)
                   GROUP BY b)
        SELECT id::INT AS token_id, letter AS token, coalesce(n, 0)::BIGINT AS n
        FROM alphabet LEFT JOIN counts USING (b)
        UNION ALL SELECT 0, '[UNK]', 0""",
    "pair_counts": f"""
        WITH {_ALPHABET}, {_WORDS},
        symbols AS (SELECT freq, {_by_byte('word', 'codes.symbols')} AS s FROM words, codes),
        pairs AS (SELECT freq, unnest(list_transform(range(1, length(s)),
                                      lambda i: substr(s, i, 2))) AS pair FROM symbols)
        SELECT (unicode(pair) - 32)::INT AS left_id, (unicode(substr(pair, 2, 1)) - 32)::INT AS right_id,
               sum(freq)::BIGINT AS n
        FROM pairs GROUP BY pair""",
    "bpe_train_small": _merges(SMALL),
    "bpe_train_exact": _merges(FULL),
    "merge_prefix": f"SELECT * FROM ({_merges(FULL)}) WHERE rank < {SMALL}",
    "tokenizer_files": f"SELECT *, token_id AS table_id FROM ({_merges(FULL)})",
    "vocab_size": f"{_STATES} SELECT (257 + count(*))::BIGINT AS vocab_size FROM steps",
    "bpe_encode_words": f"""{_STATES}
        SELECT word, f_conv AS freq, length(s)::INT AS n_tokens, {_IDS} AS ids
        FROM states WHERE k = {FULL} AND f_conv > 0""",
    "doc_token_counts": f"""{_STATES},
        placed AS (SELECT doc_id, unnest({_pretokens('text')}) AS word FROM documents)
        SELECT doc_id, sum(length(s))::BIGINT AS n_tokens
        FROM placed JOIN states USING (word) WHERE k = {FULL} GROUP BY doc_id""",
    "doc_token_ids": f"""{_STATES},
        split AS (SELECT conv_id, turn, {_pretokens('text')} AS w FROM conversations),
        placed AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split)
        SELECT conv_id, turn, string_agg({_IDS}, ' ' ORDER BY pos) AS ids
        FROM placed JOIN states USING (word) WHERE k = {FULL} GROUP BY conv_id, turn""",
    "byte_decode": "SELECT conv_id, turn, text FROM conversations",
    "token_totals": f"""{_STATES}
        SELECT 'full' AS name, sum(f_conv * length(s))::BIGINT AS token_count FROM states WHERE k = {FULL}""",
    "tokenizer_comparison": f"{_COMPARISON} SELECT * FROM report",
    "fixed_id_stats": f"""{_COMPARISON}
        SELECT name, vocab_size, fixed_id_bits_per_token, fixed_id_bits_per_byte, fixed_id_compression_ratio
        FROM report""",
    "compression_ratios": f"""{_points('f_doc', 'documents')}
        SELECT 'full' AS name, token_count, {_RATIOS} FROM points, used WHERE vocab_size = {257 + FULL}""",
    "vocab_grid": f"{_POINTS} SELECT v::INT AS vocab_size FROM sizes",
    "prefix_point": f"""{_STATES},
        used AS (SELECT sum({_SIZE})::BIGINT AS bytes_used FROM conversations),
        point AS (SELECT 304 AS vocab_size, sum(f_conv * length(s))::BIGINT AS token_count
                  FROM states WHERE k = 304 - 257)
        SELECT vocab_size, token_count, {_RATIOS} FROM point, used""",
    "prefix_sweep": f"""{_points('f_conv', 'conversations')}
        SELECT vocab_size, token_count, {_RATIOS} FROM points, used""",
    "prefix_sweep_documents": f"""{_points('f_doc', 'documents')}
        SELECT vocab_size, token_count, {_RATIOS} FROM points, used""",
    "sweep_summary": f"""{_points('f_conv', 'conversations')}
        SELECT any_value(bytes_used) AS evaluated_utf8_bytes, any_value(documents_used) AS evaluated_documents,
               string_agg(vocab_size || ':' || token_count, ' ' ORDER BY vocab_size) AS points
        FROM points, used""",
    "parity_check": f"""{_points('f_conv', 'conversations')},
        direct AS (SELECT 304 AS vocab_size, sum(f_conv * length(s))::BIGINT AS earlier_count
                   FROM states WHERE k = 304 - 257)
        SELECT vocab_size, token_count, earlier_count, token_count = earlier_count AS equal
        FROM points LEFT JOIN direct USING (vocab_size)""",
    "points_csv": f"{_points('f_conv', 'conversations')} SELECT vocab_size, token_count FROM points",
    "special_literal": f"""
        SELECT doc_id, len(w)::INT AS n_words, array_to_string(w, '|') AS words FROM (
            SELECT doc_id, list_concat(list_concat({_pretokens('head')}, ['[UNK]']), {_pretokens('tail')}) AS w
            FROM (SELECT doc_id, substr(text, 1, length(text) // 2) AS head,
                         substr(text, length(text) // 2 + 1) AS tail FROM documents))""",
    "bpe_encode_other_base": f"""{_STATES}
        SELECT word, f_conv AS freq, length(s)::INT AS n_tokens, {_IDS.replace('- 32', '- 33')} AS ids
        FROM states WHERE k = {FULL} AND f_conv > 0""",
    "heldout_meta": f"""{_HELDOUT},
        taken AS (SELECT sum({_SIZE})::BIGINT AS b, count(*) AS d FROM slice WHERE text <> ''),
        skipped AS (SELECT {_cut('(total * 60 // 100 - (done - n))')} AS text FROM sized, total
                    WHERE done - n < total * 60 // 100),
        passed AS (SELECT sum({_SIZE})::BIGINT AS b, count(*) AS d FROM skipped WHERE text <> '')
        SELECT passed.b AS skipped_utf8_bytes, passed.d AS skipped_documents,
               taken.b AS cached_utf8_bytes, taken.d AS cached_documents FROM taken, passed""",
    "heldout_migrated": "SELECT text FROM conversations WHERE text <> ''",
    "points_read": f"""{_points('f_conv', 'conversations')}
        SELECT vocab_size, token_count, {_RATIOS} FROM points, used""",
    "axis_label": """
        SELECT size, CASE WHEN size = 0 THEN '0' WHEN size = 1000000 THEN '1M' ELSE size // 1000 || 'k' END AS label
        FROM (SELECT ((o_orderkey - 1) * 1000)::BIGINT AS size FROM orders)""",
}
