"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from seamline.llm import divergence, merkle, ngram_join as ngram_join_operator

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of a tree that the SQL spells out, enough for 8^8 leaves.
_TREE_LEVELS = 8


def _lowered(text: str) -> str:
    return f"translate({text}, '{_CAPITALS}', '{_SMALL}')"


def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    signs = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {signs}), lambda c, b: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    fields = [text if name == "text" else f"{name}::VARCHAR" for name in merkle.FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _levels(name: str, leaves: str, key: str) -> list[str]:
    """CTEs of one forest: the nodes of each level with their number, up to single nodes."""
    ctes = [f"{name}0 AS (SELECT {key} AS tree, pos, digest, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves})"]
    for level in range(1, _TREE_LEVELS + 1):
        ctes.append(
            f"{name}{level} AS (SELECT tree, pos // 8 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, (any_value(n) + 7) // 8 AS n "
            f"FROM {name}{level - 1} WHERE n > 1 GROUP BY tree, pos // 8)"
        )
    return ctes


def _sides(name: str) -> list[str]:
    """CTEs of the siblings of each node of each level, left and right."""
    return [
        f"{name}_s{level} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, "
        f"coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after "
        f"FROM {name}{level} a JOIN {name}{level} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.tree, a.pos)"
        for level in range(_TREE_LEVELS)
    ]


def _climb(name: str, source: str, columns: str, ids: str) -> list[str]:
    """CTEs that take rows (columns, tree, pos, proof, folded) up a forest, one level each."""
    ctes = []
    for level in range(_TREE_LEVELS):
        ctes.append(
            f"{name}_up{level} AS (SELECT {columns}, r.tree, r.pos // 8 AS pos, r.proof || coalesce(s.before || s.after, '') AS proof, "
            f"CASE WHEN s.pos IS NULL THEN r.folded ELSE sha256(s.before || r.folded || s.after) END AS folded "
            f"FROM {source} r LEFT JOIN {name}_s{level} s ON s.tree = r.tree AND s.pos = r.pos)"
        )
        source = f"{name}_up{level}"
    return ctes


def _tops(name: str) -> str:
    return " UNION ALL ".join(f"SELECT tree, digest FROM {name}{level} WHERE n = 1" for level in range(_TREE_LEVELS + 1))


def merkle_manifest() -> str:
    tampered = f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf(_lowered('text'))} END"
    ctes = [
        f"leaves AS (SELECT coalesce('=' || lang, '-') AS tree, doc_id, {_leaf('text')} AS digest, {tampered} AS other FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM leaves)",
        *_levels("t", "placed", "tree"), *_sides("t"),
        f"subroots AS ({_tops('t')})",
        "langs AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots)",
        *_levels("u", "langs", "'top'"), *_sides("u"),
        f"roots AS ({_tops('u')})",
        "start AS (SELECT doc_id, digest AS leaf, tree, pos, '' AS proof, coalesce(other, digest) AS folded FROM placed)",
        *_climb("t", "start", "r.doc_id, r.leaf", "doc_id"),
        f"inside AS (SELECT r.doc_id, r.leaf, s.digest AS subroot, 'top' AS tree, l.pos, r.proof, r.folded FROM t_up{_TREE_LEVELS - 1} r "
        "JOIN subroots s ON s.tree = r.tree JOIN langs l ON l.name = r.tree)",
        *_climb("u", "inside", "r.doc_id, r.leaf, r.subroot", "doc_id"),
    ]
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT r.doc_id, r.leaf, r.subroot, roots.digest AS root, sha256(r.proof) AS proof_sha256, "
        f"r.folded AS folded_root, r.folded = roots.digest AS verified FROM u_up{_TREE_LEVELS - 1} r, roots"
    )


def ngram_join() -> str:
    rule = ngram_join_operator.Similarity()
    shingle = " || ' ' || ".join(["w[i]", *(f"w[i + {k}]" for k in range(1, rule.width))])
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {rule.width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {rule.width - 2}), lambda i: {shingle}) END) AS s
  FROM docs
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {rule.percent} * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
classes AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id FROM docs d LEFT JOIN sizes s USING (doc_id) LEFT JOIN classes c USING (doc_id)
"""


def source_divergence() -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT r, lang, source, unnest(regexp_extract_all({_lowered('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM sources LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
own AS (
  SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c, (1 + {divergence.UNIT}::HUGEINT * (coalesce(c.c, 0) + 1) // (t.n + l.v))::HUGEINT AS p
  FROM totals t JOIN kept k ON k.lang = t.lang JOIN langs l ON l.lang = t.lang
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
whole AS (SELECT k.lang, k.term, (1 + {divergence.UNIT}::HUGEINT * (k.c + 1) // (l.n + l.v))::HUGEINT AS q FROM kept k JOIN langs l USING (lang)),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_values v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM own JOIN whole USING (lang, term) WHERE c > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.REPORTED}
"""


def statements() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join(), "op12_merkle_manifest": merkle_manifest(), "op13_source_divergence": source_divergence()}
