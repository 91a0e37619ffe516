"""SQL twins of the text queries that SQL can express, for DuckDB."""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII expression, bit by bit."""
    bit = "lambda r, i: xor(r >> 1, 3988292384 * (r & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """Nodes of trees over (tree, pos, digest), and what lies left and right of each."""
    run = "PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN"
    return f"""
    {name} AS (
        SELECT tree, 0 AS level, pos, count(*) OVER (PARTITION BY tree) AS n, digest FROM {leaves}
        UNION ALL
        SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
        FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16, n),
    {name}_beside AS (
        SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM {name} WHERE n > 1)"""


OP11 = f"""
WITH RECURSIVE
    hashed AS (
        SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
            CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(_LOWER)} END AS changed
        FROM documents),
    leaf AS (
        SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM hashed),
    {_tree('node', 'leaf')},
    sub AS (
        SELECT '' AS tree, tree AS own, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM node WHERE n = 1),
    {_tree('top', 'sub')},
    step AS (
        SELECT leaf.tree, leaf.pos, b.level, b.l, b.r
        FROM leaf JOIN node_beside b ON b.tree = leaf.tree AND b.pos = leaf.pos // (16 ** b.level)::BIGINT
        UNION ALL
        SELECT leaf.tree, leaf.pos, 100 + b.level, b.l, b.r
        FROM leaf JOIN sub ON sub.own = leaf.tree JOIN top_beside b ON b.pos = sub.pos // (16 ** b.level)::BIGINT),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY level) AS k FROM step),
    proof AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY k) AS text FROM numbered GROUP BY tree, pos),
    fold AS (
        SELECT tree, pos, 0::BIGINT AS k, coalesce(changed, leaf) AS digest FROM leaf
        UNION ALL
        SELECT f.tree, f.pos, s.k, sha256(s.l || f.digest || s.r)
        FROM fold f JOIN numbered s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1),
    folded AS (SELECT tree, pos, arg_max(digest, k) AS digest FROM fold GROUP BY tree, pos),
    root AS (SELECT digest FROM top WHERE n = 1)
SELECT leaf.doc_id, leaf.leaf, sub.digest AS subroot, root.digest AS root, sha256(coalesce(proof.text, '')) AS proof_sha256,
    folded.digest AS folded_root, folded.digest = root.digest AS verified
FROM leaf JOIN sub ON sub.own = leaf.tree JOIN folded ON folded.tree = leaf.tree AND folded.pos = leaf.pos
    LEFT JOIN proof ON proof.tree = leaf.tree AND proof.pos = leaf.pos, root
"""


def _said(column: str) -> str:
    return f"coalesce({column}::VARCHAR, ' ')"


_WHAT = crc32(f"({_said('conv_id')} || ':' || {_said('turn')})") + " % 20"
_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: (state, initial of the row's role or '' for any, next state, cost, edits); states: nothing yet, s, u and a was last.
_MOVES = """
    (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'),
    (0, 'a', 3, 5, 'IK'), (1, 'a', 3, 5, 'IK'), (3, 'a', 3, 5, 'IK'), (2, 'u', 2, 5, 'IK'),
    (0, '', 2, 1, 'R'), (1, '', 2, 1, 'R'), (3, '', 2, 1, 'R'), (2, '', 3, 1, 'R'),
    (0, '', 3, 6, 'IR'), (1, '', 3, 6, 'IR'), (3, '', 3, 6, 'IR'), (2, '', 2, 6, 'IR'),
    (0, '', 0, 2, 'D'), (1, '', 1, 2, 'D'), (2, '', 2, 2, 'D'), (3, '', 3, 2, 'D')"""

OP13 = f"""
WITH RECURSIVE
    said AS (
        SELECT conv_id, turn, {_said('role')} AS role, {_said('text')} AS text, {_WHAT} AS what FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
            CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM said WHERE what <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32),
            sha256(strlen(role)::VARCHAR || ':' || role || text)) AS i, rtrim(text, {_SPACE}) AS shown
        FROM damaged),
    faulty AS (
        SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
            CASE WHEN shown = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM placed),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
        FROM faulty GROUP BY conv_id),
    move(was, initial, goes, price, edits) AS (VALUES {_MOVES}),
    best AS (
        SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS b FROM counts
        UNION ALL
        SELECT p.conv_id, f.i, m.goes,
            min({{'cost': (p.b.cost + m.price + CASE WHEN f.fault = 'truncated' AND m.edits <> 'D' THEN 5 ELSE 0 END)::BIGINT,
                  'audit': p.b.audit || m.edits}})
        FROM best p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
            JOIN move m ON m.was = p.state AND m.initial IN ('', f.initial) AND (m.edits = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
        GROUP BY p.conv_id, f.i, m.goes),
    whole AS (
        SELECT c.conv_id, min({{'cost': (b.b.cost + t.price)::BIGINT, 'audit': b.b.audit || t.edits}}) AS b
        FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n
            JOIN (VALUES (0, 0, ''), (1, 10, 'II'), (2, 5, 'I'), (3, 0, '')) t(state, price, edits) ON t.state = b.state
        GROUP BY c.conv_id),
    edit AS (
        SELECT conv_id, b.audit AS audit, k, substr(b.audit, k, 1) AS edit
        FROM (SELECT conv_id, b, unnest(range(1, length(b.audit) + 1)) AS k FROM whole)),
    kept AS (
        SELECT e.conv_id, e.k, e.edit, f.role, f.initial, f.text,
            row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS o
        FROM (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM edit) e
            LEFT JOIN faulty f ON e.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i
        WHERE e.edit <> 'D'),
    line AS (
        SELECT conv_id, o, CASE WHEN edit = 'K' THEN role
            WHEN (o + CASE WHEN first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY conv_id ORDER BY o) THEN 1 ELSE 0 END) % 2 = 1
            THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
        FROM kept),
    repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY o) AS text FROM line GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.b.cost, 0) AS cost,
    coalesce(w.b.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
