r"""SQL counterparts of the named queries, for DuckDB over the same tables.

Written from the definitions, not from the Spark code: windows and unnested
lists stand where the Spark side uses array functions and Java regular expressions.
"""

from __future__ import annotations

import re

from patchlens.functions.constants import EXTENDED_KEYWORDS, KEYWORDS, LINT_PATTERNS, RISKY_TOKENS

W = r"[\pL\pN_]"
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x{85}\pZ"
TOKEN = (
    r"[\pL\pN_]+|>>>=|<<=|>>=|>>>|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|->|::"
    r"|[^ \t\n\r\f\x0B]"
)


def quoted(*items: str) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


NOT_CALLABLE = quoted(
    *"if for while switch catch synchronized try return throw new super this assert case else do instanceof".split()
)
NOT_A_TYPE = quoted(
    *"return throw package import break continue assert else new case goto instanceof extends implements".split()
)
BINARY = quoted(
    "+", "-", "*", "/", "%", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "&", "|", "^", "<<", ">>", ">>>",
    "instanceof",
)
ASSIGN = quoted("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=")
BLOCK = quoted(*"if else for while do try catch finally switch".split())
RESERVED = quoted(
    *(
        "abstract assert boolean break byte case catch char class const continue default do double else enum "
        "extends final finally float for goto if implements import instanceof int interface long native new "
        "package private protected public return short static strictfp super switch synchronized this throw "
        "throws transient try void volatile while true false null"
    ).split()
)


SECRET = b"test-secret".ljust(64, b"\0")
INNER_PAD = bytes(b ^ 0x36 for b in SECRET).hex()
OUTER_PAD = bytes(b ^ 0x5C for b in SECRET).hex()


def hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def lint(text: str) -> str:
    return " + ".join(hits(text, p) for p in LINT_PATTERNS)


def word_hits(lower_text: str, words) -> str:
    """Substring counts by length difference."""
    return " + ".join(
        f"(length({lower_text}) - length(replace({lower_text}, '{w}', ''))) // {len(w)}" for w in words
    )


def lines(text: str) -> str:
    split = f"regexp_split_to_array({text}, '{BREAK}')"
    return f"(CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN {split}[-1] = '' THEN {split}[:-2] ELSE {split} END)"


# --- views -------------------------------------------------------------------------

VIEWS: dict[str, str] = {
    "snippets": r"""
        SELECT doc_id, source,
               source || '/' || lang || '/D' || doc_id || CASE WHEN doc_id % 4 = 3 THEN '.py' ELSE '.java' END AS path,
               array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
                   (['public void m() { // ', 'if (x == null && y > 0) { ', 'for (int i = 0; i < n; i++) { ',
                     '} /* TODO */ ', 'System.out.print(v); ', 'try { f.read(); } catch (Exception e) { throw e; } ',
                     'return cache.get(k) ; ', '++n; // error '])[(doc_id + i - 1) % 8 + 1] || l), chr(10)) AS code
        FROM documents""",
    "diffs": r"""
        SELECT doc_id // 4 AS diff_id, string_agg(
                 'diff --git a/' || path || ' b/' || path || chr(10) || 'index 1..2' || chr(10) || '--- a/' || path
                 || chr(10) || '+++ b/' || path || chr(10) || '@@ -1 +1 @@' || chr(10)
                 || array_to_string(list_transform(string_split(code, chr(10)),
                      lambda l, i: (['+', '-', ' '])[(i - 1) % 3 + 1] || l), chr(10)),
                 chr(10) ORDER BY doc_id) AS diff_text
        FROM snippets GROUP BY 1""",
    "pairs": r"""
        SELECT doc_id // 2 AS k, arg_min(source, doc_id) AS source, arg_min(path, doc_id) AS path, arg_min(code, doc_id) AS before,
               CASE WHEN count(*) = 1 THEN '' ELSE arg_max(code, doc_id) END AS after
        FROM snippets GROUP BY 1""",
    "sized_pairs": r"""
        SELECT *, len(string_split(before, chr(10))) + len(string_split(after, chr(10))) AS size FROM pairs""",
    "changes": r"""
        SELECT source AS project, md5(k::VARCHAR) AS commit_hash, path AS file_path, before AS buggy_change,
               after AS fixed_change, CASE WHEN size < 10 THEN 0.5 ELSE 1.0 END::DOUBLE AS buggy_label,
               CASE WHEN size < 10 THEN 0.5 ELSE 0.0 END::DOUBLE AS fixed_label
        FROM sized_pairs""",
    "commits": r"""
        SELECT k, md5(k::VARCHAR) AS commit_hash, 'https://example.com/' || source || '.git' AS project_url, source,
               (['Fix null check', 'Add feature', 'Refactor io', 'Resolve issue', 'Prefix rename'])[k % 5 + 1] AS msg,
               CASE WHEN k = 0 THEN 0 WHEN k % 10 = 9 THEN 2 ELSE 1 END AS n_parents, 1704067200 + 60 * k AS committed_at
        FROM (SELECT doc_id // 2 AS k, arg_min(source, doc_id) AS source FROM documents GROUP BY 1)""",
    "fixes": r"""
        SELECT * FROM commits WHERE n_parents < 2 AND regexp_matches(lower(msg), 'fix|bug|resolve|patch|defect|error')""",
    "mined": r"""
        SELECT f.source AS project, f.commit_hash, f.msg, p.path AS file_path, p.before AS buggy_change,
               p.after AS fixed_change, CASE WHEN size < 10 THEN 0.5 ELSE 1.0 END::DOUBLE AS buggy_label,
               CASE WHEN size < 10 THEN 0.5 ELSE 0.0 END::DOUBLE AS fixed_label
        FROM sized_pairs p JOIN fixes f USING (k) WHERE p.path LIKE '%.java' AND size >= 5""",
    "trees": r"""
        SELECT k, md5(k::VARCHAR) AS commit_hash, 'p' || p || '.java' AS path,
               CASE WHEN (k + p) % 3 = 0 THEN md5(k::VARCHAR) ELSE md5('base' || p) END AS blob
        FROM commits, range(10) r(p) WHERE (k + p) % 7 <> 0""",
    "labelled_diffs": rf"""
        SELECT diff_id, diff_text,
               len(list_filter({lines('diff_text')}, lambda l: l LIKE '+%' AND l NOT LIKE '+++%')) AS added_loc,
               len(list_filter({lines('diff_text')}, lambda l: l LIKE '-%' AND l NOT LIKE '---%')) AS removed_loc,
               {lint('diff_text')} AS lint_warnings
        FROM diffs""",
    "diff_lines": rf"""
        SELECT diff_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
        FROM (SELECT diff_id, {lines('diff_text')} AS l FROM diffs)""",
    "diff_sections": r"""
        SELECT *, sum(CASE WHEN line LIKE 'diff --git%' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY diff_id ORDER BY n) - 1 AS pos FROM diff_lines""",
    "parsed": r"""
        SELECT diff_id, pos::INTEGER AS pos,
               max(CASE WHEN line LIKE 'diff --git%' THEN substr(split_part(line, ' ', 3), 3) END) AS filename,
               string_agg(substr(line, 2), chr(10) ORDER BY n)
                 FILTER (WHERE line LIKE '+%' AND line NOT LIKE '+++%') AS content
        FROM diff_sections GROUP BY diff_id, pos
        HAVING count(*) FILTER (WHERE line LIKE '+%' AND line NOT LIKE '+++%') > 0""",
    "samples": r"""
        SELECT md5(concat_ws('|', project, commit_hash, file_path, side)) AS sample_id, commit_hash, file_path, side,
               snippet, label, soft_label
        FROM (SELECT *, 'buggy' AS side, buggy_change AS snippet, 1.0::DOUBLE AS label, buggy_label AS soft_label FROM changes
              UNION ALL
              SELECT *, 'fixed', fixed_change, 0.0::DOUBLE, fixed_label FROM changes)""",
    "tokens": rf"""
        SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (
          SELECT doc_id, regexp_extract_all(
                   regexp_replace(regexp_replace(code, '\\[^\n]', ' ', 'g'),
                     '/\*[\s\S]*?(?:\*/|\z)|//[^\n\r]*|"[^"\n]*"|''[^''\n]*''', ' ', 'g'),
                   '{TOKEN}') AS t
          FROM snippets)""",
    "token_ctx": r"""
        SELECT *, lag(tok) OVER w AS p1, lag(tok, 2) OVER w AS p2, lead(tok) OVER w AS n1, lead(tok, 2) OVER w AS n2,
               lead(tok, 3) OVER w AS n3, lead(tok, 4) OVER w AS n4, lead(tok, 5) OVER w AS n5
        FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    "declared": rf"""
        SELECT doc_id, len(list_filter(
                 regexp_extract_all(' ' || string_agg(tok, ' ' ORDER BY pos) || ' ',
                   '[^ ]+ {W}+ \( [^()]*\) (?:throws [\pL\pN_., ]+ )?\{{'),
                 lambda m: regexp_matches(split_part(m, ' ', 1), '[\pL\pN_>\]]$') AND split_part(m, ' ', 1) <> 'new'
                           AND split_part(m, ' ', 2) NOT IN ({NOT_CALLABLE}))) AS methods
        FROM tokens GROUP BY doc_id""",
    "token_counts": rf"""
        SELECT doc_id,
          count(*) FILTER (WHERE tok = 'if') AS ifs,
          count(*) FILTER (WHERE tok IN ('for', 'while')) AS loops,
          count(*) FILTER (WHERE tok = 'try') AS tries,
          count(*) FILTER (WHERE tok = 'catch') AS catches,
          count(*) FILTER (WHERE regexp_full_match(tok, '[\pL_]{W}*') AND regexp_matches(p1, '[\pL\pN_>\]]$')
                   AND p1 NOT IN ({NOT_A_TYPE}) AND n1 IN ('=', ';')) AS variables,
          count(*) FILTER (WHERE tok = 'return') AS return_statements,
          count(*) FILTER (WHERE regexp_full_match(tok, '{W}+') AND tok NOT IN ({NOT_CALLABLE}) AND n1 = '('
                   AND p1 IS DISTINCT FROM 'new') AS callish,
          count(*) FILTER (WHERE tok IN ({BINARY})) AS binary_operations,
          count(*) FILTER (WHERE tok IN ({ASSIGN}))
            - count(*) FILTER (WHERE regexp_full_match(tok, '[\pL_]{W}*') AND regexp_matches(p1, '[\pL\pN_>\]]$')
                       AND p1 NOT IN ({NOT_A_TYPE}) AND n1 = '=') AS assignments,
          count(*) FILTER (WHERE tok = 'class' AND p1 IS DISTINCT FROM '.') AS classes,
          count(*) FILTER (WHERE tok = 'switch') AS switch_statements,
          count(*) FILTER (WHERE tok = '?' AND coalesce(p1, '') NOT IN ('<', ',')) AS ternary_expressions,
          count(*) FILTER (WHERE tok IN ('==', '!=') AND (p1 = 'null' OR n1 = 'null')) AS null_checks,
          count(*) FILTER (WHERE tok = '[' AND regexp_matches(p1, '[\pL\pN_)\]]$') AND n1 <> ']'
                   AND NOT (coalesce(p2, '') = 'new' AND regexp_full_match(p1, '{W}+'))) AS array_accesses,
          count(*) FILTER (WHERE tok = '(' AND (regexp_matches(p1, '[=(,+*/%&|?:<>!-]$') OR p1 = 'return')
                   AND regexp_full_match(n1, '[\pL_]{W}*')
                   AND ((n2 = ')' AND regexp_matches(n3, '^[\pL\pN_(]'))
                        OR (n2 = '[' AND n3 = ']' AND n4 = ')' AND regexp_matches(n5, '^[\pL\pN_(]')))) AS cast_expressions,
          count(*) FILTER (WHERE tok IN ('if', 'for', 'while', 'case', 'catch', '&&', '||')) AS points,
          count(*) FILTER (WHERE tok = 'do' AND n1 = '{{') AS dos,
          count(DISTINCT CASE WHEN tok IN ({BINARY}) THEN tok END) AS unique_operators,
          count(DISTINCT CASE WHEN regexp_full_match(tok, '[\pL_]{W}*') AND tok NOT IN ({RESERVED}) THEN tok END)
            AS unique_names
        FROM token_ctx GROUP BY doc_id""",
    # braces: segments between braces, then matching by depth
    "brace_segments": r"""
        SELECT *, coalesce(sum(CASE WHEN tok IN ('{', '}') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
        FROM tokens""",
    "brace_parens": r"""
        SELECT *, sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
                    OVER (PARTITION BY doc_id, seg ORDER BY pos) AS parens
        FROM brace_segments""",
    "brace_flags": rf"""
        SELECT doc_id, seg, max(pos) FILTER (WHERE tok IN ('{{', '}}')) AS pos,
               max(tok) FILTER (WHERE tok IN ('{{', '}}')) AS brace,
               coalesce(max(pos) FILTER (WHERE tok IN ({BLOCK})), 0)
                 > coalesce(max(pos) FILTER (WHERE tok = ';' AND parens <= 0), 0) AS control
        FROM brace_parens GROUP BY doc_id, seg
        HAVING count(*) FILTER (WHERE tok IN ('{{', '}}')) > 0""",
    "brace_levels": r"""
        SELECT *, sum(CASE brace WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos)
                    + CASE brace WHEN '}' THEN 1 ELSE 0 END AS level
        FROM brace_flags""",
    "brace_matches": r"""
        SELECT doc_id, pos, CASE
                 WHEN brace = '{' THEN control::INT
                 WHEN lag(brace) OVER w = '{' THEN -(lag(control) OVER w)::INT ELSE 0 END AS step
        FROM brace_levels WINDOW w AS (PARTITION BY doc_id, level ORDER BY pos)""",
    "nesting": r"""
        SELECT doc_id, greatest(max(depth), 0) AS nesting_depth FROM (
          SELECT doc_id, sum(step) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM brace_matches) GROUP BY doc_id""",
    "code": rf"""
        SELECT s.doc_id, len({lines('code')}) AS lines_of_code,
               len(list_filter({lines('code')}, lambda l: regexp_matches(l, '[^{SPACE}]'))) AS non_empty_lines,
               t.* EXCLUDE (doc_id), d.methods, t.callish - d.methods AS method_invocations,
               points + ternary_expressions + 1 AS complexity,
               points + ternary_expressions + 1 - dos AS complexity_without_do,
               coalesce(n.nesting_depth, 0)::BIGINT AS nesting_depth, greatest(d.methods, 1) AS method_count,
               unique_operators + unique_names AS vocabulary_size
        FROM snippets s JOIN token_counts t USING (doc_id) JOIN declared d USING (doc_id) LEFT JOIN nesting n USING (doc_id)""",
    "code_full": r"""
        SELECT *, complexity / method_count AS complexity_per_method, lines_of_code / method_count AS loc_per_method,
               CASE WHEN non_empty_lines > 0 THEN (ifs + loops + switch_statements) / non_empty_lines ELSE 0 END AS decision_density,
               ifs AS if_count, loops AS loop_count, (tries + catches) / method_count AS exception_ratio,
               CASE WHEN non_empty_lines > 0 THEN method_invocations / non_empty_lines ELSE 0 END AS invocation_density,
               CASE WHEN non_empty_lines > 0 THEN variables / non_empty_lines ELSE 0 END AS variable_ratio,
               CASE WHEN binary_operations > 0 THEN null_checks / binary_operations ELSE 0 END AS null_check_ratio,
               CASE WHEN non_empty_lines > 0 THEN array_accesses / non_empty_lines ELSE 0 END AS array_ratio,
               CASE WHEN non_empty_lines > 0 THEN cast_expressions / non_empty_lines ELSE 0 END AS cast_ratio,
               CASE WHEN non_empty_lines > 0 THEN assignments / non_empty_lines ELSE 0 END AS assignment_density,
               return_statements / method_count AS return_ratio,
               CASE WHEN vocabulary_size > 1 THEN vocabulary_size * log2(vocabulary_size) ELSE 0 END AS halstead_volume
        FROM code""",
    "webhooks": rf"""
        SELECT event_id, event_type, user_id, action, repo, head_sha, shape, body, CASE
                 WHEN event_id % 4 = 0 THEN 'sha256=bad'
                 WHEN event_id % 100 <> 1 THEN 'sha256=' || sha256(
                   unhex('{OUTER_PAD}')
                   || unhex(sha256(
                   unhex('{INNER_PAD}')
                   || encode(body)))) END AS signature
        FROM (SELECT *, CASE shape
                WHEN 7 THEN '{{"action": "' || action || '", "pull_request": {{"number": ' || user_id
                WHEN 11 THEN '{{"action": "' || action || '", "pull_request": {{"number": ' || user_id
                             || '}}, "repository": {{"full_name": "' || repo || '"}}}}'
                ELSE '{{"action": "' || action || '", "pull_request": {{"number": ' || user_id || ', "head": {{"sha": "'
                     || head_sha || '"}}}}, "repository": {{"full_name": "' || repo || '"}}}}' END AS body
              FROM (SELECT event_id, user_id, event_id % 50 AS shape,
                      CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'pull_request' ELSE 'push' END AS event_type,
                      (['opened', 'synchronize', 'reopened', 'closed', 'labeled'])[event_id % 5 + 1] AS action,
                      'org/r' || user_id % 10 AS repo, md5('head' || user_id) AS head_sha FROM events))""",
    "projected": r"""
        SELECT event_id, event_type, signature, event_id % 4 <> 0 AND event_id % 100 <> 1 AS authentic,
               CASE WHEN shape <> 7 THEN action END AS action, CASE WHEN shape <> 7 THEN repo END AS repo,
               CASE WHEN shape <> 7 THEN user_id END AS pr, CASE WHEN shape NOT IN (7, 11) THEN head_sha END AS head_sha
        FROM webhooks""",
    "requests": r"""
        SELECT * FROM projected WHERE authentic AND event_type = 'pull_request'
          AND action IN ('opened', 'synchronize', 'reopened') AND head_sha IS NOT NULL""",
    "triaged": rf"""
        SELECT 'org/r' || diff_id % 10 AS repo, diff_id AS pr, md5('head' || diff_id) AS head_sha, pos, filename,
               ({lint('content')}) > 0 OR contains(content, 'FORCE_RISK') AS risky
        FROM parsed WHERE filename LIKE '%.java'""",
    "pr_files": r"""
        SELECT 'org/r' || (doc_id // 4) % 10 AS repo, path || CASE WHEN doc_id % 10 = 7 THEN '.moved' ELSE '' END AS filename, md5('head' || (doc_id // 4)) AS head_sha,
               CASE WHEN doc_id % 10 = 5 THEN '' ELSE code END AS code, doc_id
        FROM snippets""",
    "attached": r"""
        SELECT t.repo, t.pr, t.head_sha, t.pos, t.filename, f.code, f.doc_id,
               sha256(concat_ws('|', t.repo, t.pr, t.head_sha, t.pos, t.filename)) AS report_id
        FROM triaged t JOIN pr_files f USING (repo, filename, head_sha) WHERE t.risky AND f.code <> ''""",
    "responses": r"""
        SELECT conv_id, turn, CASE conv_id % 4
                 WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || listed || chr(10) || '```' || chr(10) || 'That is all.'
                 WHEN 1 THEN '[]'
                 WHEN 2 THEN 'See [1] first: ' || listed
                 ELSE '[{"line": ' || turn || ', "severity": "major", "message": "' || md5(text) END AS response
        FROM (SELECT *, '[{"line": ' || turn || ', "severity": "major", "message": "' || md5(text) || '"}, {"line": "'
                || turn || '", "severity": "critical", "message": "again ' || md5(text) || '"}]' AS listed
              FROM conversations WHERE role = 'assistant')""",
    "answers": r"""
        SELECT conv_id, turn, (unnest(range(len(items))))::INTEGER AS ord, unnest(items) AS item FROM (
          SELECT conv_id, turn, CASE WHEN json_valid(j) AND json_type(j) = 'ARRAY'
                   THEN from_json(j, '[{"line": "VARCHAR", "severity": "VARCHAR", "message": "VARCHAR"}]') END AS items
          FROM (SELECT conv_id, turn, regexp_extract(response, '(?s)\[.*\]') AS j FROM responses))
        WHERE len(items) > 0""",
    "review_findings": r"""
        SELECT conv_id, turn, ord, TRY_CAST(item.line AS INTEGER) AS line, item.severity AS severity,
               item.message AS message, 'LLM' AS source FROM answers""",
    "code_lines": rf"""
        SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS line
        FROM (SELECT doc_id, {lines('code')} AS l FROM snippets)""",
    "lint_findings": "\n UNION ALL\n".join(
        f"SELECT doc_id, line::INTEGER AS line, {i} AS rule, 'warning' AS severity, 'matches {p}' AS message, "
        f"'Checkstyle' AS source FROM code_lines WHERE regexp_matches(text, '{p}')"
        for i, p in enumerate(LINT_PATTERNS)
    ),
    "all_findings": r"""
        SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY part, line, rule) - 1)::INTEGER AS ord,
               shown AS line, severity, message, source
        FROM (SELECT doc_id AS file_id, 0 AS part, line, rule, line AS shown, severity, message, source FROM lint_findings
              UNION ALL
              SELECT conv_id, turn + 1, ord, 0, line, severity, message, source FROM review_findings
              WHERE conv_id IN (SELECT doc_id FROM snippets))""",
    "issues": r"""
        SELECT a.*, f.ord, f.line, f.severity, f.message, f.source
        FROM attached a JOIN all_findings f ON f.file_id = a.doc_id""",
    "predictions": r"""
        SELECT doc_id, quality AS label, h / 10000 AS score, (h > 5000)::INT AS prediction
        FROM (SELECT *, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10001 AS h FROM labels)""",
    "token_vectors": r"""
        SELECT vec_id, p AS pos, embedding[8 * p + 1 : 8 * p + 8] AS vec FROM embeddings, unnest(range((len(embedding) + 7) // 8)) r(p)""",
    "pooled": r"""
        SELECT vec_id, d AS dim, avg(coalesce(vec[d + 1], 0)::DOUBLE) AS value FROM token_vectors, range(8) r(d) GROUP BY ALL""",
}


def basic(table: str, key: str, text: str) -> str:
    return rf"""SELECT {key}, len({lines(text)}) AS num_lines, length({text}) AS num_chars,
        {word_hits(f'lower({text})', KEYWORDS)} AS keyword_count FROM {table}"""


def rich(table: str, key: str, text: str, extra: str = "") -> str:
    low = f"lower({text})"
    return rf"""SELECT {key}, {extra} len({lines(text)}) AS num_lines, length({text}) AS num_chars,
        {word_hits(low, EXTENDED_KEYWORDS)} AS keyword_count,
        {word_hits(low, ['if', 'for', 'while', 'switch', 'case'])} AS control_count,
        {word_hits(low, ['try', 'catch', 'throw', 'throws', 'finally'])} AS exception_count,
        {hits(text, W + '+[' + SPACE + ']*' + chr(92) + '(')} AS method_calls,
        len(list_filter({lines(text)}, lambda l: contains(l, '//') OR contains(l, '/*'))) / (len({lines(text)}) + 1e-5) AS comment_ratio,
        {word_hits(low, ['null', 'fail', 'error', 'exception', 'retry'])} AS suspicious_count,
        CASE WHEN len({lines(text)}) = 0 THEN 0 ELSE
          list_aggregate(list_transform({lines(text)}, lambda l: length(l)), 'stddev_samp') END AS line_stddev,
        {word_hits(low, ['thread', 'file', 'socket', 'inputstream', 'system.exit'])} AS buggy_api_count,
        coalesce(list_aggregate(regexp_extract_all({text}, '{W}+'), 'entropy'), 0) AS entropy
        FROM {table}"""


RICH = (
    "num_lines", "num_chars", "keyword_count", "control_count", "exception_count", "method_calls",
    "comment_ratio", "suspicious_count", "line_stddev", "buggy_api_count", "entropy",
)
BASIC = RICH[:3]
VIEWS["basic_samples"] = basic("samples", "sample_id, label", "snippet")
VIEWS["rich_samples"] = rich("samples", "sample_id, label", "snippet")
VIEWS["rich_long"] = " UNION ALL ".join(
    f"SELECT sample_id, label, '{c}' AS feature, {c}::DOUBLE AS value FROM rich_samples" for c in RICH
)
VIEWS["complete_long"] = (
    "SELECT * FROM rich_long WHERE sample_id IN (SELECT sample_id FROM rich_samples WHERE line_stddev IS NOT NULL)"
)


def hashed(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


CODE_RATIOS = (
    "complexity_per_method", "loc_per_method", "decision_density", "exception_ratio", "invocation_density",
    "variable_ratio", "null_check_ratio", "array_ratio", "cast_ratio", "assignment_density", "return_ratio",
)
CONSTRUCTS = (
    "methods, ifs, loops, tries, catches, variables, return_statements, method_invocations, binary_operations, "
    "assignments, classes, switch_statements, ternary_expressions, null_checks, array_accesses, cast_expressions"
)
DIMS = "SELECT vec_id, (dim)::INTEGER AS dim, round(value, 6) AS value FROM"



def ranked(table: str, key: str = "sample_id", label: str = "label") -> str:
    """Rows with their place ``r`` (from 0) in their class of ``n``, in the order of the hash."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hashed(42, key)}, {key}) - 1 AS r,
                count(*) OVER (PARTITION BY {label}) AS n FROM {table})"""


TESTED = f"""
    SELECT sample_id, label, TRUE AS score_is_share, TRUE AS prediction_follows, TRUE AS learned
    FROM {ranked('samples')} WHERE r >= floor(n * 0.75 + 0.5)"""

QUERIES: dict[str, str] = {
    "src_changes_roundtrip": "SELECT * FROM changes",
    "src_changes_json": "SELECT * FROM changes",
    "src_changes_json_array": "SELECT * FROM changes",
    "src_commit_tables": "SELECT project, commit_hash, file_path, buggy_change, fixed_change, buggy_label, fixed_label FROM mined",
    "corpus_class_counts": "SELECT label, count(*) AS n FROM samples GROUP BY label",
    "commits_latest_branch": """
        SELECT project_url, commit_hash, committed_at FROM commits WHERE ('0x' || substr(commit_hash, 1, 4))::BIGINT % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY project_url ORDER BY committed_at DESC, commit_hash) <= 10""",
    "diff_dataset_per_project": """
        SELECT commit_hash, added_loc, removed_loc FROM labelled_diffs JOIN (
          SELECT k, commit_hash, n_parents FROM commits WHERE ('0x' || substr(commit_hash, 1, 4))::BIGINT % 3 <> 0
          QUALIFY row_number() OVER (PARTITION BY project_url ORDER BY committed_at DESC, commit_hash) <= 20) ON k = 2 * diff_id
        WHERE n_parents > 0""",
    "src_diff_csv_roundtrip": """
        SELECT substr(diff_text, 1, 5000) AS diff_text, added_loc::INTEGER AS added_loc, removed_loc::INTEGER AS removed_loc,
               lint_warnings::INTEGER AS lint_warnings, (lint_warnings > 0)::INTEGER AS label FROM labelled_diffs""",
    "src_lint_xml": """
        SELECT path AS filename, line, CASE line % 3 WHEN 1 THEN 'error' WHEN 2 THEN severity ELSE 'info' END AS severity,
               message, f.source FROM lint_findings f JOIN snippets USING (doc_id)""",
    "emb_cache_missing": """
        SELECT DISTINCT sha256(code) AS key, length(code) AS n_chars FROM snippets
        WHERE sha256(code) NOT IN (SELECT sha256(code) FROM snippets JOIN embeddings ON doc_id * 3 = vec_id)""",
    "mine_project_name": "SELECT commit_hash, source AS project FROM commits",
    "mine_bugfix_commits": "SELECT commit_hash, source AS project, msg FROM fixes",
    "filter_language": "SELECT doc_id, path FROM snippets WHERE path LIKE '%.java'",
    "mine_modified_pairs": """
        SELECT c.source AS project, commit_hash, path AS file_path, before AS buggy_code, after AS fixed_code
        FROM pairs p JOIN commits c USING (k)
        WHERE regexp_matches(lower(msg), 'fix|bug|resolve|patch|defect|error|issue') AND path LIKE '%.java'
          AND k % 7 <> 0 AND k % 11 <> 0 AND before <> '' AND after <> ''""",
    "mine_changes": """SELECT project, commit_hash, file_path, buggy_change, fixed_change, buggy_label, fixed_label FROM mined""",
    "commits_latest_n": "SELECT commit_hash, committed_at FROM commits ORDER BY committed_at DESC, commit_hash LIMIT 200",
    "commits_latest_per_project": """
        SELECT project_url, commit_hash, committed_at FROM commits
        QUALIFY row_number() OVER (PARTITION BY project_url ORDER BY committed_at DESC, commit_hash) <= 10""",
    "diff_first_parent": """
        SELECT md5(coalesce(n.k, o.k + 1)::VARCHAR) AS commit_hash, coalesce(n.path, o.path) AS path, o.blob AS old_blob,
               n.blob AS new_blob,
               CASE WHEN o.blob IS NULL THEN 'added' WHEN n.blob IS NULL THEN 'deleted' ELSE 'modified' END AS change
        FROM (SELECT * FROM trees WHERE k > 0) n
        FULL JOIN (SELECT * FROM trees WHERE k < (SELECT max(k) FROM commits)) o ON n.k = o.k + 1 AND n.path = o.path
        WHERE n.blob IS DISTINCT FROM o.blob""",
    "src_lint_xml_mapped": """
        SELECT path AS filename, line, CASE line % 3 WHEN 1 THEN 'major' ELSE 'minor' END AS severity, message, f.source
        FROM lint_findings f JOIN snippets USING (doc_id)""",
    "corpus_append": """
        SELECT project, count(*) AS n_changes, count(DISTINCT commit_hash) AS n_commits,
               count_if(buggy_label = 0.5)::BIGINT AS n_soft
        FROM (SELECT project, commit_hash, buggy_label FROM changes
              UNION ALL SELECT project, commit_hash, buggy_label FROM mined) GROUP BY project""",
    "diff_dataset": """
        SELECT commit_hash, substr(diff_text, 1, 5000) AS diff_text, added_loc::INTEGER AS added_loc,
               removed_loc::INTEGER AS removed_loc, lint_warnings::INTEGER AS lint_warnings, (lint_warnings > 0)::INTEGER AS label
        FROM labelled_diffs JOIN (SELECT k, commit_hash, n_parents FROM commits ORDER BY committed_at DESC, commit_hash LIMIT 200)
          ON k = 2 * diff_id WHERE n_parents > 0""",
    "corpus_counts": """
        SELECT project, count(*) AS n_changes, count(DISTINCT commit_hash) AS n_commits,
               count_if(buggy_label = 0.5)::BIGINT AS n_soft FROM changes GROUP BY project""",
    "diff_parse": "SELECT diff_id, pos, filename, content FROM parsed",
    "diff_stats": "SELECT diff_id, added_loc, removed_loc FROM labelled_diffs",
    "diff_lint": "SELECT diff_id, lint_warnings FROM labelled_diffs",
    "diff_labelled": """
        SELECT diff_id, substr(diff_text, 1, 5000) AS diff_text, added_loc::INTEGER AS added_loc,
               removed_loc::INTEGER AS removed_loc, lint_warnings::INTEGER AS lint_warnings,
               (lint_warnings > 0)::INTEGER AS label FROM labelled_diffs""",
    "line_diff_multiset": rf"""
        WITH b AS (SELECT k, unnest({lines('before')}) AS line FROM pairs), a AS (SELECT k, unnest({lines('after')}) AS line FROM pairs)
        SELECT k, line, 'removed' AS op, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL
        UNION ALL
        SELECT k, line, 'added', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL""",
    "feat_basic": basic("snippets", "doc_id", "code"),
    "feat_text11": f"SELECT * REPLACE ({r6('comment_ratio', 'line_stddev', 'entropy')}) FROM ({rich('snippets', 'doc_id', 'code')})",
    "feat_entropy": rf"""
        SELECT doc_id, round(-sum(n / total * log2(n / total)) + 0.0, 6) AS entropy, count(*) AS distinct_words
        FROM (SELECT doc_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total
              FROM (SELECT doc_id, unnest(regexp_extract_all(code, '{W}+')) AS w FROM snippets) GROUP BY doc_id, w)
        GROUP BY doc_id""",
    "feat_metadata": r"""
        SELECT md5(concat_ws('|', project, commit_hash, file_path, side)) AS sample_id, length(msg) AS msg_length,
               regexp_matches(lower(msg), 'fix|bug|patch')::BIGINT AS has_bug_keyword,
               length(file_path) - length(replace(replace(file_path, '/', ''), '\', '')) AS path_depth,
               length(snippet) AS snippet_length
        FROM (SELECT *, 'buggy' AS side, buggy_change AS snippet FROM mined
              UNION ALL SELECT *, 'fixed', fixed_change FROM mined)""",
    "feat_assemble": rf"""
        WITH f AS ({basic('snippets', 'doc_id, path', 'code')}),
        z AS (SELECT doc_id, path, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in BASIC)} FROM f)
        SELECT vec_id AS sample_id, (len(embedding) + 4)::BIGINT AS n_features,
               {', '.join(f'round(embedding[{i + 1}]::DOUBLE / norm, 6) AS f{i}' for i in range(64))},
               round(num_lines, 6) AS f64, round(num_chars, 6) AS f65, round(keyword_count, 6) AS f66,
               (length(path) - length(replace(path, '/', '')))::DOUBLE AS f67
        FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)
        JOIN z ON doc_id = vec_id""",
    "code_size": "SELECT doc_id, lines_of_code, non_empty_lines FROM code",
    "code_constructs": f"SELECT doc_id, {CONSTRUCTS} FROM code",
    "code_cyclomatic": "SELECT doc_id, complexity, complexity_without_do FROM code",
    "code_nesting": "SELECT doc_id, nesting_depth FROM code",
    "code_halstead": "SELECT doc_id, unique_operators, unique_names, round(halstead_volume, 6) AS halstead_volume FROM code_full",
    "code_ratios": f"SELECT doc_id, {r6(*CODE_RATIOS)} FROM code_full",
    "code_vector5": "SELECT doc_id, lines_of_code, methods, complexity_without_do, tries, variables FROM code",
    "code_vector20": f"""
        SELECT doc_id, lines_of_code, non_empty_lines, method_count, complexity, nesting_depth, if_count, loop_count,
               vocabulary_size, {r6(*CODE_RATIOS, 'halstead_volume')} FROM code_full""",
    "prep_unpivot_hard": "SELECT sample_id, side, snippet, label FROM samples",
    "prep_unpivot_soft": "SELECT sample_id, side, soft_label AS label, (soft_label > 0.5)::INTEGER AS label_binary FROM samples",
    "prep_min_lines": f"""
        SELECT commit_hash, file_path FROM changes
        WHERE len({lines('buggy_change')}) >= 3 AND len({lines('fixed_change')}) >= 3""",
    "prep_split": f"""
        SELECT sample_id, label, CASE WHEN {hashed(42, 'sample_id')} % 10000 < 7500 THEN 'train' ELSE 'test' END AS split
        FROM samples""",
    "prep_split_grouped": f"""
        SELECT sample_id, label, CASE WHEN {hashed(42, 'commit_hash')} % 10000 < 8000 THEN 'train' ELSE 'test' END AS split
        FROM samples""",
    "prep_split_stratified": f"""
        SELECT sample_id, label, CASE WHEN r < floor(n * 0.75 + 0.5) THEN 'train' ELSE 'test' END AS split FROM {ranked('samples')}""",
    "prep_folds_stratified": f"""
        SELECT sample_id, label, list_sum([CASE WHEN r >= floor(n * i / 5 + 0.5) THEN 1 ELSE 0 END for i in [1, 2, 3, 4]])::INTEGER AS fold
        FROM {ranked('samples')}""",
    "prep_iqr_sketch": "SELECT feature, TRUE AS q1_holds, TRUE AS q3_holds, TRUE AS ordered FROM complete_long GROUP BY feature",
    "prep_anova_chosen": """
        WITH c AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM complete_long GROUP BY ALL),
        g AS (SELECT feature, sum(n * m) / sum(n) AS grand FROM c GROUP BY feature),
        f AS (SELECT feature, (sum(n * (m - grand) ** 2) / (count(*) - 1)) / (nullif(sum(w), 0) / (sum(n) - count(*))) AS f_value
              FROM c JOIN g USING (feature) GROUP BY feature)
        SELECT feature FROM f ORDER BY f_value DESC NULLS LAST, feature LIMIT 5""",
    "prep_folds": f"SELECT sample_id, label, ({hashed(42, 'sample_id')} % 5)::INTEGER AS fold FROM samples",
    "prep_sample_n": "SELECT sample_id, side FROM samples ORDER BY md5('42:' || sample_id), sample_id LIMIT 300",
    "prep_standardize": f"""
        WITH s AS (SELECT *, CASE WHEN {hashed(42, 'sample_id')} % 10000 < 7500 THEN 'train' ELSE 'test' END AS split FROM basic_samples),
        m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in BASIC)} FROM s WHERE split = 'train')
        SELECT sample_id, split, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in BASIC)} FROM s, m""",
    "prep_robust_scale": f"""
        WITH q AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q_{c}' for c in BASIC)} FROM basic_samples)
        SELECT sample_id, {', '.join(
            f'round(({c} - q_{c}[2]) / CASE WHEN q_{c}[3] > q_{c}[1] THEN q_{c}[3] - q_{c}[1] ELSE 1 END, 6) AS {c}' for c in BASIC)}
        FROM basic_samples, q""",
    "prep_iqr_bounds": """
        SELECT feature, round(q[1], 6) AS q1, round(q[2], 6) AS q3, round(q[1] - 1.5 * (q[2] - q[1]), 6) AS lower,
               round(q[2] + 1.5 * (q[2] - q[1]), 6) AS upper
        FROM (SELECT feature, quantile_cont(value, [0.25, 0.75]) AS q FROM rich_long GROUP BY feature)""",
    "prep_outliers": f"""
        WITH q AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, [0.25, 0.75]) AS q_{c}' for c in BASIC)} FROM basic_samples)
        SELECT sample_id, label, num_lines, num_chars, keyword_count FROM basic_samples, q WHERE {' AND '.join(
            f'{c} BETWEEN q_{c}[1] - 1.5 * (q_{c}[2] - q_{c}[1]) AND q_{c}[2] + 1.5 * (q_{c}[2] - q_{c}[1])' for c in BASIC)}""",
    "prep_drop_allzero": """
        SELECT doc_id, tries, array_accesses, switch_statements FROM code
        WHERE tries + array_accesses + switch_statements > 0""",
    "prep_drop_nan": "SELECT sample_id, label FROM rich_samples WHERE line_stddev IS NOT NULL",
    "prep_class_weight": """
        SELECT doc_id, quality AS label,
               round(count(*) OVER () / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality)), 6) AS weight
        FROM labels""",
    "prep_pos_weight": """
        SELECT count_if(quality = 0)::BIGINT AS negatives, count_if(quality = 1)::BIGINT AS positives,
               round(count_if(quality = 0) / count_if(quality = 1), 6) AS positive_weight FROM labels""",
    "prep_anova_f": """
        WITH c AS (SELECT feature, label, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS ssw FROM complete_long GROUP BY ALL),
        g AS (SELECT feature, avg(value) AS grand, count(*) AS total FROM complete_long GROUP BY ALL)
        SELECT feature, round((sum(n * (mean - grand) ** 2) / (count(*) - 1)) / nullif(sum(ssw) / (max(total) - count(*)), 0), 6) AS f_value
        FROM c JOIN g USING (feature) GROUP BY feature""",
    "text_tfidf_risk": rf"""
        WITH tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (
              SELECT doc_id, unnest(regexp_extract_all(lower(code), '{W}{{2,}}')) AS t FROM snippets) GROUP BY ALL),
        vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM snippets)) / (1 + count(*))) + 1 AS idf
                  FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
        w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
        s AS (SELECT doc_id, coalesce(sum(w) FILTER (WHERE term IN ({quoted(*RISKY_TOKENS)})), 0)
                     / sqrt(sum(w * w)) AS raw FROM w GROUP BY doc_id),
        a AS (SELECT doc_id, coalesce(raw, 0) / (SELECT max(raw) FROM s) AS score FROM snippets LEFT JOIN s USING (doc_id))
        SELECT doc_id, round(score, 6) AS score, (score > 0.5)::INTEGER AS label FROM a""",
    "emb_l2_normalize": f"""{DIMS} (
        SELECT vec_id, d AS dim, embedding[d + 1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS value
        FROM embeddings, unnest(range(len(embedding))) r(d))""",
    "emb_mean_pool": f"{DIMS} pooled",
    "emb_concat": f"""
        WITH stacked AS (SELECT vec_id, d AS dim, embedding[d + 1]::DOUBLE AS value FROM embeddings, unnest(range(len(embedding))) r(d)
                         UNION ALL SELECT vec_id, dim + len(embedding), value FROM pooled JOIN embeddings USING (vec_id))
        {DIMS} (SELECT vec_id, dim, value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)) AS value FROM stacked)""",
    "eval_accuracy": "SELECT round(avg((label = prediction)::INT), 6) AS accuracy FROM predictions",
    "eval_class_report": """
        WITH p AS (SELECT c AS class, count_if(label = c) AS support, count_if(prediction = c) AS predicted,
                          count_if(label = c AND prediction = c) AS hits FROM predictions, (VALUES (0), (1)) v(c) GROUP BY c),
        m AS (SELECT class, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
                     coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1, support, hits FROM p),
        u AS (SELECT class::VARCHAR AS class, precision, recall, f1, support::BIGINT AS support FROM m
          UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM m
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                           sum(f1 * support) / sum(support), sum(support) FROM m)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM u""",
    "eval_confusion": """
        SELECT label, count_if(prediction = 0)::BIGINT AS predicted_0, count_if(prediction = 1)::BIGINT AS predicted_1
        FROM predictions GROUP BY label""",
    "eval_roc_auc": """
        SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS roc_auc
        FROM (SELECT score FROM predictions WHERE label = 1) p, (SELECT score FROM predictions WHERE label = 0) n""",
    "eval_cv_summary": f"""
        SELECT round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS std_accuracy, count(*) AS folds
        FROM (SELECT avg((label = prediction)::INT) AS a FROM predictions GROUP BY {hashed(42, 'doc_id')} % 5)""",
    "ml_quality_band": """
        SELECT lang, round(a, 6) AS accuracy, n, CASE WHEN a < 0.7 THEN 'below target' WHEN a < 0.8 THEN 'good' ELSE 'excellent' END AS band,
               n < 100 AS small_corpus
        FROM (SELECT lang, avg((label = prediction)::INT) AS a, count(*) AS n FROM predictions JOIN documents USING (doc_id) GROUP BY lang)""",
    "ml_bundle_roundtrip": f"""
        SELECT sample_id, label, TRUE AS same FROM {ranked('samples')} WHERE r >= floor(n * 0.75 + 0.5)""",
    "ml_train_gbt": TESTED,
    "ml_train_rf": TESTED,
    "ml_train_lr": TESTED,
    "ml_soft_vote": TESTED.replace("score_is_share", "is_mean"),
    "ml_code_ensemble": f"""
        WITH kept AS (SELECT k, md5(concat_ws('|', c.source, commit_hash, p.path, side)) AS sample_id, side, b.*
          FROM pairs p JOIN commits c USING (k), (VALUES ('buggy', 0), ('fixed', 1)) v(side, later)
          JOIN code b ON b.doc_id = 2 * k + later
          WHERE regexp_matches(lower(msg), 'fix|bug|resolve|patch|defect|error|issue') AND p.path LIKE '%.java'
            AND k % 7 <> 0 AND k % 11 <> 0 AND before <> '' AND after <> '')
        SELECT sample_id, label, TRUE AS score_is_share, TRUE AS prediction_follows, TRUE AS learned
        FROM {ranked("(SELECT *, CASE side WHEN 'buggy' THEN 1.0::DOUBLE ELSE 0 END AS label FROM kept)")}
        WHERE r >= floor(n * 0.8 + 0.5) AND (side = 'buggy' OR lines_of_code > 0)""",
    "ml_train_combined": f"""
        SELECT sample_id, label, TRUE AS score_is_share, TRUE AS prediction_follows, TRUE AS learned
        FROM {ranked('''(SELECT s.sample_id, (s.soft_label > 0.5)::DOUBLE AS label FROM samples s JOIN rich_samples r USING (sample_id)
            WHERE s.side = 'buggy' OR r.line_stddev IS NOT NULL)''')} WHERE r >= floor(n * 0.75 + 0.5)""",
    "ml_cv": f"""
        WITH sized AS (SELECT *, greatest(2, least(5, count(*) OVER () // 10)) AS k FROM {ranked('samples')})
        SELECT sample_id, list_sum([CASE WHEN i < k AND r >= floor(n * i / k + 0.5) THEN 1 ELSE 0 END for i in [1, 2, 3, 4]])::INTEGER AS fold,
               label, TRUE AS predicted, TRUE AS learned FROM sized""",
    "ml_random_search": """
        SELECT 20::BIGINT AS tried, 20::BIGINT AS distinct_settings, TRUE AS accuracies_are_shares, TRUE AS best_refitted, TRUE AS learned""",
    "ml_feature_importance": """
        SELECT 10::BIGINT AS features, 10::BIGINT AS distinct_features, 1.0::DOUBLE AS total, TRUE AS least_left_out, TRUE AS planted_first""",
    "triage_score": """
        SELECT diff_id, pos, filename, TRUE AS score_is_share, TRUE AS risky_follows, TRUE AS tells_planted FROM parsed WHERE filename LIKE '%.java'""",
    "triage_override": """
        SELECT doc_id, (doc_id % 2)::INTEGER AS prediction,
               CASE WHEN doc_id % 5 = 0 OR contains(code, 'FORCE_RISK') THEN 1 ELSE (doc_id % 2)::INTEGER END AS risky FROM snippets""",
    "triage_flagged": "SELECT repo, pr, head_sha, pos, filename FROM triaged WHERE risky",
    "review_attach_code": "SELECT repo, pr, head_sha, pos, filename, code FROM attached",
    "lint_lines": "SELECT doc_id, line, severity, message, source FROM lint_findings",
    "review_parse": "SELECT * FROM review_findings",
    "findings_severity_map": """
        SELECT conv_id, turn, ord, CASE WHEN raw IN ('error', 'fatal') THEN 'major' ELSE 'minor' END AS mapped,
               CASE WHEN raw IN ('critical', 'major', 'minor') THEN raw WHEN raw IN ('error', 'fatal') THEN 'major' ELSE 'minor' END AS normalized
        FROM (SELECT *, (['error', 'fatal', 'warning', 'info', NULL, severity])[(conv_id // 4) % 6 + 1] AS raw FROM review_findings)""",
    "findings_union": "SELECT * FROM all_findings",
    "report_build": "SELECT report_id, repo, pr, head_sha, filename, code, ord, line, severity, message, source FROM issues",
    "report_lookup": """
        SELECT DISTINCT report_id, filename, code FROM issues WHERE report_id = (SELECT min(report_id) FROM issues)""",
    "report_summary": """
        SELECT report_id, filename, count(*) AS n_issues,
               '**Change review for `' || filename || '`**' || chr(10) || chr(10) || 'This file was rated high-risk; the detailed review lists '
               || count(*) || ' issues.' || chr(10) || chr(10) || '[Open the report](http://localhost/report/' || report_id || ')' AS summary
        FROM issues GROUP BY report_id, filename""",
    "report_severity_counts": """
        SELECT report_id, count_if(severity = 'critical')::BIGINT AS critical, count_if(severity = 'major')::BIGINT AS major,
               count_if(severity NOT IN ('critical', 'major'))::BIGINT AS minor FROM issues GROUP BY report_id""",
    "report_by_source": """
        SELECT report_id, count_if(source <> 'LLM')::BIGINT AS static_issues, count_if(source = 'LLM')::BIGINT AS review_issues
        FROM issues GROUP BY report_id""",
    "event_authentic": "SELECT event_id, signature FROM projected WHERE authentic",
    "event_project": "SELECT event_id, event_type, action, repo, pr, head_sha FROM projected",
    "event_filter": """
        SELECT event_id, action, repo, pr FROM projected
        WHERE event_type = 'pull_request' AND action IN ('opened', 'synchronize', 'reopened')""",
    "stream_event_filter": "SELECT event_id, action, repo, pr, head_sha FROM requests",
    "stream_rejects": """
        SELECT event_id, CASE WHEN NOT authentic THEN 'unauthorized' WHEN action IS NULL THEN 'unreadable body' ELSE 'incomplete body' END AS reason
        FROM projected
        WHERE NOT authentic OR (event_type = 'pull_request' AND (action IS NULL
              OR (action IN ('opened', 'synchronize', 'reopened') AND head_sha IS NULL)))""",
    "stream_triage": """
        SELECT report_id, repo, pr, filename, count(*) AS n_issues FROM issues
        WHERE (repo, pr, head_sha) IN (SELECT (repo, pr, head_sha) FROM requests) GROUP BY ALL""",
}


def _review_prompt() -> str:
    from patchlens.operators.review import REVIEW_TEMPLATE

    before, after = REVIEW_TEMPLATE.split("{code}")
    return f"SELECT doc_id, {quoted(before)} || code || {quoted(after)} AS prompt FROM snippets"


QUERIES["review_prompts"] = _review_prompt()


def with_views(sql: str) -> str:
    """The query with the views it needs in front, in order of definition."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    # a query with its own WITH list continues the list of views
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"


ORACLE: dict[str, str] = {name: with_views(sql) for name, sql in QUERIES.items()}
