"""SQL of the operators that it can state exactly, for the engine that checks them."""

from __future__ import annotations

from .centroids import ShallotParams
from .host_rules import HostRuleParams
from .licenses import TEMPLATES, LicenseParams
from .merkle import FIELDS, ManifestParams
from .near_dup import NearDupParams

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def licenses(p: LicenseParams = LicenseParams()) -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    k = p.shingle_words
    return f"""
WITH t AS (SELECT name, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (VALUES {rows}) v(name, text)),
need AS (SELECT DISTINCT name, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) AS g FROM t),
d AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents),
have AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) AS g, unnest(range(0, len(w) - {k} + 1)) AS pos FROM d),
met AS (SELECT doc_id, name, count(DISTINCT g) AS shared, min(pos) AS first_shingle FROM have JOIN need USING (g) GROUP BY ALL),
size AS (SELECT name, count(*) AS n FROM need GROUP BY name)
SELECT doc_id, name AS license_id, shared / n AS containment, first_shingle FROM met JOIN size USING (name) WHERE shared * 100 >= n * {p.percent}"""


def near_dup(p: NearDupParams = NearDupParams()) -> str:
    k = p.shingle_words
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {p.percent} * (a.n + b.n - count(*))),
reach(doc_id, to_) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.to_),
least AS (SELECT doc_id, min(to_) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)"""


def centroids(p: ShallotParams = ShallotParams()) -> str:
    steps = [
        f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({p.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {p.dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {p.dims}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || vec_id), vec_id, v) - 1 AS c, v AS m FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{p.seed}:' || vec_id), vec_id, v) <= {p.centroids})"""
    ]
    for r in range(p.rounds + 1):
        steps.append(
            f"""a{r} AS (
  SELECT * FROM (SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) = 1)"""
        )
        if r < p.rounds:
            steps.append(
                f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {p.dims + 1})) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)"""
            )
    r = p.rounds
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(a{r}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{r}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{r} JOIN c{r} ON a{r}.c = c{r}.c"""
    )


def manifest(p: ManifestParams = ManifestParams(), heights: int = 8, upper_heights: int = 4) -> str:
    """Trees of up to ``fan_out ** heights`` documents and ``fan_out ** upper_heights`` languages."""
    k = p.fan_out
    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), "
        "lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"
    )
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        fields = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"

    def heights_of(name: str, group: str, top: int) -> list[str]:
        """Nodes of each height, with what stands before and after each in its run, and (at ``top``) the root."""
        window = f"PARTITION BY {group}, p // {k} ORDER BY p ROWS BETWEEN"
        out = []
        for h in range(top):
            out.append(
                f"{name}x{h} AS (SELECT *, coalesce(string_agg(h, '') OVER ({window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
                f"coalesce(string_agg(h, '') OVER ({window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{h})"
            )
            out.append(
                f"{name}{h + 1} AS (SELECT {group}, p // {k} AS p, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, "
                f"(n + {k - 1}) // {k} AS n FROM {name}{h} GROUP BY {group}, p // {k}, n)"
            )
        return out

    def folds(name: str, group: str, top: int, place: str, start: str) -> list[str]:
        """For each row: proof so far and node so far, height by height."""
        out = []
        for h in range(top):
            was = start if h == 0 else f"{name}f{h - 1}"
            out.append(
                f"{name}f{h} AS (SELECT r.* REPLACE (r.proof || x.b || x.a AS proof, CASE WHEN x.n = 1 THEN r.node ELSE sha256(x.b || r.node || x.a) END AS node) "
                f"FROM {was} r JOIN {name}x{h} x ON x.{group} = r.{group} AND x.p = r.{place} // {k**h})"
            )
        return out

    ctes = [
        "c AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)",
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % {p.tamper_every} = 0 THEN {leaf(low)} END AS tampered FROM documents, c)",
        "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS langs FROM (SELECT DISTINCT lang FROM d))",
        "r AS (SELECT doc_id, leaf, tree, langs, 0 AS whole, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, "
        "'' AS proof, coalesce(tampered, leaf) AS node FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang)",
        "n0 AS (SELECT tree, place AS p, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM r)",
        *heights_of("n", "tree", heights),
        f"u0 AS (SELECT 0 AS whole, tree AS p, h, count(*) OVER () AS n FROM n{heights})",
        *heights_of("u", "whole", upper_heights),
        *folds("n", "tree", heights, "place", "r"),
        *folds("u", "whole", upper_heights, "tree", f"nf{heights - 1}"),
    ]
    done = f"uf{upper_heights - 1}"
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, s.h AS subroot, w.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = w.h AS verified
FROM {done} f JOIN n{heights} s ON s.tree = f.tree JOIN u{upper_heights} w ON w.whole = f.whole"""
    )


def host_rules(p: HostRuleParams = HostRuleParams()) -> str:
    k = p.window
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {k} + 2)) AS pos, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: list_slice(w, i, i + {k - 1}))) AS g FROM w),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT pos + o) AS n FROM again, (SELECT unnest(range(0, {k})) AS o) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
c AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)),
j AS (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.repeat_percent} * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM j GROUP BY source),
prior AS (SELECT sum(failed)::DOUBLE / sum(docs)::DOUBLE AS m, var_pop(failed / docs) AS v FROM h),
s AS (SELECT m, CASE WHEN v <= 0 THEN 1000.0::DOUBLE ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, m * (1 - m) / nullif(v, 0) - 1)) END AS strength FROM prior),
r AS (SELECT source, (failed + m * strength) / (docs + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) + 0.0 AS host_rate, NOT base_failed AND rate <= {p.max_host_rate} AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source"""
