"""DuckDB SQL of the operators that repeat a step: the steps are written out, one common table expression each."""

from __future__ import annotations

SOURCE_LEVELS, ROOT_LEVELS = 13, 9  # trees of up to 3^13 leaves a source and 3^9 sources


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                                   for c in fields) + ")"


# the bitwise checksum of a decimal number's characters
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""


def _tree(t: str, levels: int) -> list[str]:
    """``t0`` (g, i, h) grown by runs of three, and per level the siblings left and right of each node."""
    out = []
    for k in range(levels):
        out.append(f"{t}n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {t}{k})")
        out.append(f"""{t}s{k} AS (SELECT x.g, x.i, x.n,
  coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l,
  coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r
  FROM {t}n{k} x JOIN {t}n{k} y ON x.g = y.g AND x.i // 3 = y.i // 3 GROUP BY ALL)""")
        out.append(f"""{t}{k + 1} AS (SELECT g, i // 3 AS i,
  CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {t}n{k} GROUP BY g, i // 3)""")
    return out


def _climb(t: str, levels: int, rows: str, g: str, i: str) -> list[str]:
    """Each row's path through the tree: its folded hash and the siblings met so far."""
    out = [f"{t}f0 AS ({rows})"]
    for k in range(levels):
        out.append(f"""{t}f{k + 1} AS (SELECT f.* EXCLUDE (cur, proof),
  CASE WHEN s.n = 1 THEN cur ELSE sha256(s.l || cur || s.r) END AS cur, proof || s.l || s.r AS proof
  FROM {t}f{k} f JOIN {t}s{k} s ON f.{g} = s.g AND f.{i} // {3 ** k} = s.i)""")
    return out


def merkle_sql() -> str:
    top = f"a{SOURCE_LEVELS}"
    parts = [
        f"""d AS (SELECT *, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents)""",
        f"""r AS (SELECT g, doc_id, leaf, {_leaf("told")} AS tampered,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)""",
        "a0 AS (SELECT g, i, leaf AS h FROM r)",
        *_tree("a", SOURCE_LEVELS),
        *_climb("a", SOURCE_LEVELS, "SELECT *, tampered AS cur, '' AS proof FROM r", "g", "i"),
        f"sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS j FROM {top})",
        "b0 AS (SELECT '' AS g, j AS i, h FROM sub)",
        *_tree("b", ROOT_LEVELS),
        *_climb("b", ROOT_LEVELS, f"""SELECT f.doc_id, f.leaf, sub.h AS subroot, '' AS allg, sub.j, f.cur, f.proof
  FROM af{SOURCE_LEVELS} f JOIN sub ON f.g = sub.g""", "allg", "j"),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b.h AS verified
FROM bf{ROOT_LEVELS}, (SELECT h FROM b{ROOT_LEVELS}) b
"""


def centroids_sql(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    parts = [
        f"""kept AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding,
  lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept
  ORDER BY sha256('1:' || vec_id), v LIMIT {k})""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""d{t} AS (SELECT kept.r, c{t}.c, list_sum(list_transform(list_zip(kept.v, c{t}.v),
  lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{t})""")
        parts.append(f"""a{t} AS (SELECT r, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if t < rounds:
            parts.append(f"""m{t} AS (SELECT c, list(s ORDER BY i) AS v FROM (
  SELECT a.c, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS s
  FROM a{t} a JOIN kept USING (r), LATERAL (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY a.c, i) GROUP BY c)""")
            parts.append(f"c{t + 1} AS (SELECT c{t}.c, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} z ON a.c = z.c
"""
