"""DuckDB SQL with the results of those text queries that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_key, doc_id, source, coalesce(text, '') AS text
    FROM documents
), cut AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), windows AS (
    SELECT row_key, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT row_key, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), repeated AS (
    SELECT row_key, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY row_key, a, b, c) > 1
), covered AS (
    SELECT row_key, count(DISTINCT i + step) AS n
    FROM repeated, (VALUES (0), (1), (2)) AS steps(step)
    GROUP BY row_key
), lines AS (
    SELECT row_key, count(*) - count(DISTINCT line) AS n
    FROM (SELECT row_key, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    GROUP BY row_key
), measured AS (
    SELECT row_key, doc_id, source, len(words) AS n_words,
        length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM cut LEFT JOIN covered USING (row_key) LEFT JOIN lines USING (row_key)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 20 * n_words AS more_failed
    FROM measured
), hosts AS (
    SELECT source, count(*) AS n, count(*) FILTER (base_failed OR more_failed) AS bad
    FROM judged WHERE source IS NOT NULL GROUP BY source
), prior AS (
    SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts
), strength AS (
    SELECT m, v, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) END AS s FROM prior
), verdicts AS (
    SELECT source, CASE WHEN v > 0 THEN (bad + m * s) / (n + s) ELSE m END <= 0.6 AS host_kept
    FROM hosts, strength
)
SELECT doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars,
    cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines,
    cast(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND coalesce(host_kept, true) AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""

# A backslash goes before another, and behind the first character of each control string.
CHAT_FORMATTING = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), formatted AS (
    SELECT *, '<|turn|>' || escaped(role) || '<|text|>' || escaped(text) || '<|end|>' AS line
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, line))
        AS turns_sha256,
    cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, line)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    cast(sum(length(line)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id
"""
for _name in ("role", "text"):
    _escaped = rf"replace({_name}, '\', '\\')"
    for _control in ("<|", "<s>", "</s>", "[INST]", "[/INST]"):
        _broken = _control[0] + "\\" + _control[1:]
        _escaped = f"replace({_escaped}, '{_control}', '{_broken}')"
    CHAT_FORMATTING = CHAT_FORMATTING.replace(f"escaped({_name})", _escaped)

BENCHMARK_DECONTAMINATION = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_key, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 13) AS size,
        array_to_string(words[i : i + least(len(words), 13) - 1], ' ') AS window_text
    FROM (
        SELECT *, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i
        FROM items WHERE len(words) > 0
    )
), doc_windows AS (
    SELECT row_key, size, i, array_to_string(words[i : i + size - 1], ' ') AS window_text
    FROM (
        SELECT row_key, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM item_windows)
        WHERE len(words) >= size
    )
), found AS (
    SELECT row_key, i, size, item_id FROM doc_windows JOIN item_windows USING (size, window_text)
), hit AS (
    SELECT row_key, count(DISTINCT place) AS n_hit
    FROM (SELECT row_key, unnest(range(i, i + size)) AS place FROM found)
    GROUP BY row_key
), named AS (
    SELECT row_key, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT row_key, cast(item_id AS VARCHAR) AS id FROM found)
    WHERE id IS NOT NULL
    GROUP BY row_key
)
SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (row_key) LEFT JOIN named USING (row_key)
"""

NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS shingle
    FROM (
        SELECT *, unnest(range(1, len(words) - least(len(words), 5) + 2)) AS i
        FROM docs WHERE len(words) > 0
    )
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
    WHERE 100 * k >= 75 * (sx.n + sy.n - k)
), reach AS (
    SELECT doc_id AS origin, doc_id AS node FROM docs
    UNION
    SELECT origin, y FROM reach JOIN links ON x = node
)
SELECT docs.doc_id, cast(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles,
    min(node) AS component_id
FROM docs JOIN reach ON origin = docs.doc_id LEFT JOIN sizes USING (doc_id)
GROUP BY docs.doc_id
"""



def _merkle_levels(first: str, first_way: str, name: str, levels: int) -> tuple[str, str, str]:
    """CTEs of ``levels`` rounds over nodes (tree, place, digest, size), and of the way up from
    leaves (row_key, tree, place, proof, folded). Returns them, the last nodes and the last ways."""
    parts = []
    nodes, way = first, first_way
    for i in range(1, levels + 1):
        parts.append(f"""
{name}_run{i} AS MATERIALIZED (
    SELECT tree, place // 8 AS place, size, list(digest ORDER BY place) AS digests
    FROM {nodes} GROUP BY tree, place // 8, size
), {name}_nodes{i} AS MATERIALIZED (
    SELECT tree, place, (size + 7) // 8 AS size,
        CASE WHEN size = 1 THEN digests[1] ELSE sha256(array_to_string(digests, '')) END AS digest
    FROM {name}_run{i}
), {name}_way{i} AS MATERIALIZED (
    SELECT row_key, tree, w.place // 8 AS place,
        proof || array_to_string(digests[: w.place % 8], '')
            || array_to_string(digests[w.place % 8 + 2 :], '') AS proof,
        CASE WHEN size = 1 THEN folded ELSE sha256(
            array_to_string(digests[: w.place % 8], '') || folded
            || array_to_string(digests[w.place % 8 + 2 :], '')) END AS folded
    FROM {way} w JOIN {name}_run{i} r USING (tree) WHERE r.place = w.place // 8
)""")
        nodes, way = f"{name}_nodes{i}", f"{name}_way{i}"
    return ",".join(parts), nodes, way


def _merkle_manifest(levels: int = 10) -> str:
    """The whole tree, level by level; ten levels of eight hold 8 ** 10 rows of a language."""
    lower, subroots, lower_way = _merkle_levels("leaves", "start", "lower", levels)
    upper, roots, upper_way = _merkle_levels("tops", "top_start", "upper", levels)
    fields = " || ".join(
        f"coalesce(strlen(cast({name} AS VARCHAR)) || ':' || {name}, '-')"
        for name in ("doc_id", "source", "lang", "n_chars")
    )
    leaf = f"sha256({fields} || coalesce(strlen({{0}}) || ':' || {{0}}, '-'))"
    upper_case, lower_case = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH crc AS MATERIALIZED (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))
), numbered AS MATERIALIZED (
    SELECT row_number() OVER () AS row_key, * FROM (
        SELECT doc_id, lang, text, n_chars, source, xor(4294967295, list_reduce(
            [4294967295] || list_transform(
                string_split(cast(doc_id AS VARCHAR), ''), lambda x: cast(ascii(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
        FROM documents, crc)
), hashed AS MATERIALIZED (
    SELECT row_key, doc_id, lang, {leaf.format("text")} AS leaf,
        CASE WHEN crc % 3 = 0 THEN translate(text, '{upper_case}', '{lower_case}') ELSE text END
            AS present,
        source, n_chars
    FROM numbered
), languages AS MATERIALIZED (
    SELECT lang AS own_lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, size
    FROM (SELECT lang, count(*) AS size FROM documents GROUP BY lang)
), placed AS MATERIALIZED (
    SELECT row_key, doc_id, leaf, {leaf.format("present")} AS present, tree, size,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
    FROM hashed h JOIN languages l ON lang IS NOT DISTINCT FROM own_lang
), leaves AS (
    SELECT tree, place, size, leaf AS digest FROM placed
), start AS (
    SELECT row_key, tree, place, '' AS proof, present AS folded FROM placed
), {lower}, tops AS MATERIALIZED (
    SELECT 0 AS tree, tree AS place, count(*) OVER () AS size, digest FROM {subroots}
), top_start AS (
    SELECT row_key, 0 AS tree, tree AS place, proof, folded FROM {lower_way}
), {upper}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256,
    folded AS folded_root, folded = r.digest AS verified
FROM placed JOIN {upper_way} w USING (row_key) JOIN tops s ON s.place = placed.tree
    CROSS JOIN {roots} r
"""


ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op6_quality_rules": QUALITY_RULES,
    "op7_chat_formatting": CHAT_FORMATTING,
    "op9_benchmark_decontamination": BENCHMARK_DECONTAMINATION,
    "op11_merkle_manifest": _merkle_manifest(),
}
